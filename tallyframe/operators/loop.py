"""The selection loop: rounds of candidates with carried state, and its stop rules.

When all rounds are known, the loop is one windowed plan (replay). A live loop is driven from outside, one written
table of state a round; SelectionLoop does that.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import filled, stripped
from tallyframe.operators.ranking import annotate_comparability, with_outcome


def new_candidates(handoff: DataFrame, seen: DataFrame) -> DataFrame:
    """handoff (model, ordinal) with a reason: 'duplicate_in_batch', 'already_seen' or null for a new one; case-folded."""
    own = handoff.withColumn("_key", F.lower(stripped(F.col("model"))))
    old = seen.select(F.lower(stripped(F.col("model"))).alias("_key")).distinct().withColumn("_seen", F.lit(True))
    n = F.row_number().over(Window.partitionBy("_key").orderBy("ordinal"))
    return own.join(old, "_key", "left").withColumn("_n", n).withColumn("reason", F.when(F.col("_seen"), "already_seen").when(F.col("_n") > 1, "duplicate_in_batch")).drop("_key", "_seen", "_n")


def replay(results: DataFrame, target: int = 0, minimum: float = 0.0) -> DataFrame:
    """results (dataset, round, ordinal, status, score, labeled_total, metric, evaluation_protocol): one row for each round
    with its best comparable score, the best before, successes so far, and the stop reason if a rule fires there."""
    rows = annotate_comparability(with_outcome(results))
    good = (F.col("outcome") == "success") & F.col("comparable")
    rounds = rows.groupBy("dataset", "round").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(good).alias("successes"), F.max(F.when(good, F.col("score"))).alias("score"))
    return stop_reasons(rounds, target, minimum)


def stop_reasons(rounds: DataFrame, target: int = 0, minimum: float = 0.0) -> DataFrame:
    """rounds (dataset, round, successes, score) with the best score before, successes so far, and the stop reason."""
    w = Window.partitionBy("dataset").orderBy("round")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.withColumns({"previous_best": F.max("score").over(before), "total_successes": F.sum("successes").over(w)})
    small = F.lit(minimum > 0) & F.col("previous_best").isNotNull() & (F.col("score").isNull() | (F.round(F.col("score") - F.col("previous_best"), 9) < minimum))
    enough = F.lit(target > 0) & (F.col("total_successes") >= target)
    return rounds.withColumn("stop_reason", F.when(enough, "target_reached").when(F.coalesce(small, F.lit(False)), "no_improvement"))


def until_stop(rounds: DataFrame) -> DataFrame:
    """The rounds of replay() that the loop runs: up to the first with a stop reason."""
    before = Window.partitionBy("dataset").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("_done", F.coalesce(F.max(F.col("stop_reason").isNotNull()).over(before), F.lit(False))).where("not _done").drop("_done")


def checksum(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def content_checksum(df: DataFrame) -> str:
    """Of a table's rows, whatever their order: their number, and the sums of two hashes of each."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    sums = [F.coalesce(F.sum(F.xxhash64(row, F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (1, 2)]
    return checksum([sorted(df.columns), *df.agg(F.count(F.lit(1)), *sums).collect()[0]])


def call_provider(provider: Callable[[dict], dict], request: dict, retries: int = 2) -> dict:
    """The answer of a provider of candidates to a request. The request is sent with its checksum, and the answer must name
    it under request_checksum and hold candidates; otherwise it is asked again, with the error, so many times."""
    own, error = checksum(request), ""
    for _ in range(retries + 1):
        try:
            answer = provider({**request, "checksum": own, **({"previous_error": error} if error else {})})
            if answer.get("request_checksum") != own:
                raise ValueError("the answer is to another request")
            if not isinstance(answer.get("candidates"), list):
                raise ValueError("the answer has no list of candidates")
            return answer
        except Exception as e:  # whatever a provider raises counts as a failed attempt
            error = f"{type(e).__name__}: {e}"
    raise RuntimeError(f"no valid answer in {retries + 1} attempts; last: {error}")


def retrieve_with_retries(provider: Callable[[dict], dict], request: dict, seen: set[str], requested: int, retries: int = 2) -> tuple[dict | None, str]:
    """(hand-over, reason): new candidates (model, ...) of a provider, asked again while they are too few, and told what was
    accepted and why others were not. Models count by their folded names; ranks are given anew. What was collected when
    attempts run out is enough, if it is something; else the provider's last error is raised, or the reason says whether it
    had only known candidates."""
    known, accepted, rejected, template, duplicates, error = {x.casefold() for x in seen}, [], [], None, 0, None
    for attempt in range(1, retries + 2):
        own = request if attempt == 1 else {**request, "seen_models": sorted({*request.get("seen_models", []), *(c["model"].casefold() for c in accepted)}), "retrieval_retry": {"attempt": attempt, "previous_rejections": list(rejected)}}
        try:
            answer = call_provider(provider, own, 0)
        except RuntimeError as e:
            error = e
            rejected.append({"model": "", "reason": "provider_error", "detail": str(e)})
            continue
        template, error = answer, None
        for c in answer["candidates"]:
            name = str(c["model"]).casefold()
            if name in known:
                duplicates += 1
                continue
            known.add(name)
            accepted.append(c)
        rejected += answer.get("retrieval_rejections") or []
        if len(accepted) >= requested:
            break
        rejected.append({"model": "", "reason": "insufficient_unique_candidates", "detail": f"Collected {len(accepted)} of {requested} requested candidates."})
    if not accepted:
        if error is not None:
            raise error
        return None, "no_new_candidates" if duplicates else "no_valid_candidates"
    ranked = [{**c, "rank": i} for i, c in enumerate(accepted[:requested], 1)]
    return {**template, "provider_input_checksum": checksum(request), "provider_attempt_count": attempt, "candidates": ranked, "retrieval_rejections": rejected}, "provider"


def feedback(results: DataFrame) -> DataFrame:
    """results (dataset, round, model, ordinal, and what annotate_comparability() reads): for each round of a dataset its best
    comparable model (the first of equals) and score, the models to compare with, those to leave out, and observations, in
    the order of the results. Lists hold distinct models."""
    rows = annotate_comparability(with_outcome(results))
    good = (F.col("outcome") == "success") & F.coalesce("comparable", F.lit(True))
    out = F.coalesce(F.col("outcome") != "success", F.lit(True)) & filled(F.col("model"))
    note = F.when(F.col("outcome") == "non_comparable", F.concat(F.lit("Exclude "), F.coalesce("model", F.lit("None")), F.lit(": "), F.col("non_comparable_reason"), F.lit(".")))
    best = rows.groupBy("dataset", "round").agg(F.max_by(F.struct("model", "score"), F.when(good, F.struct("score", -F.col("ordinal")))).alias("_b"))

    def listed(value: Column, name: str) -> DataFrame:
        first = rows.select("dataset", "round", "ordinal", value.alias("v")).where("v is not null").groupBy("dataset", "round", "v").agg(F.min("ordinal").alias("at"))
        return first.groupBy("dataset", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))

    joined = best
    for value, name in ((F.when(good, F.col("model")), "baseline_models"), (F.when(out, F.col("model")), "candidate_exclusions"), (note, "_notes")):
        joined = joined.join(listed(value, name), ["dataset", "round"], "left")
    text = F.concat(F.lit("Best comparable model in this round was "), F.col("_b.model"), F.lit(" with score "), F.format_string("%.4f", "_b.score"), F.lit("."))
    own = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return joined.select("dataset", "round", F.col("_b.model").alias("best_model"), F.col("_b.score").alias("best_score"), own("baseline_models").alias("baseline_models"), own("candidate_exclusions").alias("candidate_exclusions"), F.concat(F.when(F.col("_b.model").isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>")), own("_notes")).alias("observations"))


#: Why a loop ends.
STOP_REASONS = ("no_candidates", "duplicate_candidates", "all_candidates_failed", "target_reached", "no_improvement", "reviewed_stop", "static_rounds_finished", "max_rounds_reached")


def validate_capacity(rounds: int, candidates: int, target: int) -> None:
    """Raises if so many rounds of so many candidates can't reach the target."""
    if rounds < 1 or candidates < 1:
        raise ValueError("a loop has a round and a candidate at least")
    if rounds * candidates < target:
        raise ValueError(f"{rounds} rounds of {candidates} candidates can't reach {target} successes")


def reviewed_stop(df: DataFrame, target: int) -> DataFrame:
    """df (successes, decisions array<string>, votes_needed) with stop: the target is reached, and the review has all its
    votes and every one says 'stop'. Without votes needed, reaching the target is enough."""
    votes = F.coalesce("decisions", F.array().cast("array<string>"))
    unanimous = (F.size(votes) >= F.col("votes_needed")) & F.forall(votes, lambda x: F.coalesce(F.lower(x) == "stop", F.lit(False)))
    return df.withColumn("stop", (F.col("successes") >= target) & (target > 0) & ((F.col("votes_needed") == 0) | unanimous))


def reviewed_stop_by_votes(df: DataFrame, target: int) -> DataFrame:
    """reviewed_stop() of counted votes: df (successes, votes, others, votes_needed), others being the votes that aren't 'stop'.
    Counts come from an aggregation with a partial step; no list of votes is needed."""
    unanimous = (F.col("votes") >= F.col("votes_needed")) & (F.col("others") == 0)
    return df.withColumn("stop", (F.col("successes") >= target) & (target > 0) & ((F.col("votes_needed") == 0) | unanimous))


@dataclass
class SelectionLoop:
    """A live loop. retrieve(round, seen) gives candidates (dataset, model, ordinal, ...); evaluate(candidates) gives
    results. State is a written table in `folder`. A round's folder names the checksum of its request (the number of the
    round, the settings and the candidates); a stored result of the same request is read, not evaluated again. static
    holds rounds whose candidates are given. After run(), reason says why it ended: one of STOP_REASONS."""

    retrieve: Callable[[int, DataFrame], DataFrame]
    evaluate: Callable[[DataFrame], DataFrame]
    folder: str
    rounds: int = 2
    target: int = 0
    minimum: float = 0.0
    static: dict[int, DataFrame] | None = None
    review: Callable[[DataFrame], bool] | None = None
    reason: str = ""
    reused: int = 0

    def _round(self, r: int, found: DataFrame) -> DataFrame:
        """The results of a round's candidates, evaluated or from an earlier run."""
        spark = found.sparkSession
        request = checksum([r, self.target, self.minimum, content_checksum(found)])
        path = f"{self.folder}/round-{r}-{request[:16]}"
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            self.reused += 1
        else:
            self.evaluate(found).withColumn("round", F.lit(r)).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def run(self, seen: DataFrame) -> DataFrame | None:
        """seen (dataset, model): what was tried before. Returns all results, None without a round."""
        done, self.reason, self.reused = None, "max_rounds_reached", 0
        for r in range(1, self.rounds + 1):
            if self.static and r > max(self.static):
                self.reason = "static_rounds_finished"
                break
            given = self.static[r] if self.static and r in self.static else self.retrieve(r, seen)
            if not given.head(1):
                self.reason = "no_candidates"
                break
            found = new_candidates(given, seen).where("reason is null").drop("reason")
            if not found.head(1):
                self.reason = "duplicate_candidates"
                break
            new = self._round(r, found)
            done = new if done is None else done.unionByName(new)
            seen = seen.select("dataset", "model").union(new.select("dataset", "model")).distinct()
            state = replay(done, self.target, self.minimum).where(F.col("round") == r).select("stop_reason", "successes").collect()  # a row a dataset
            reasons = {x["stop_reason"] for x in state}
            if not any(x["successes"] for x in state):
                self.reason = "all_candidates_failed"
                break
            if None not in reasons and (reasons != {"target_reached"} or self.review is None or self.review(done)):
                self.reason = "reviewed_stop" if self.review and reasons == {"target_reached"} else min(reasons)
                break
        return done
