"""Mixing domains to target weights with soft memberships, in DataFrame expressions only.

1. A naive Bayes classifier over hashed words is fitted on a labelled table (a bounded sample of it) and gives every
   document a posterior over domains. The evidence is capped, so that memberships stay soft on long texts.
2. Rates x >= 0 are fitted by projected gradient on the weighted least squares between expected domain token totals
   S_d = sum_i x_i tokens_i p_id and their targets T_d. An iteration is one aggregation to one number a domain; a
   document's rate is an expression of its own posterior and the residuals so far.
3. A document is emitted floor(rate + u) times, where u in [0, 1) is a hash of its id.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, table, written

#: Buckets of hashed words; the classifier's table has this many rows, which bounds its broadcast.
BUCKETS = 1 << 14
#: Labelled rows that the classifier is fitted on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: Words of evidence that a text counts for, at most.
EVIDENCE = 24
SMOOTHING = 0.5
#: Iterations between two written tables, iterations in all, and the relative residual at which the fit ends.
REPLAY, ITERATIONS, TOLERANCE = 8, 40, 1e-6
#: Share of a target that it may be missed by before the fit warns.
MISSED = 0.02
#: Default targets: shares to this power, as in multilingual mixing; and the weight of the domain of poor texts.
FLATTEN, POOR = 0.7, 0.5


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS))


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE)


def labelled_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, domain) of at most `rows` labelled documents: 'poor' where quality is 0, else the language. Rows without
    a language or a quality are not used."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    return joined.select("text", F.when(F.col("quality") == 0, F.lit("poor")).otherwise(F.col("lang")).alias("domain")).where("domain is not null")


def fit(labelled: DataFrame) -> tuple[list[str], DataFrame, list[float]]:
    """(domains, table of a bucket's log probabilities l0.., log priors) of labelled texts (text, domain)."""
    words = labelled.select("domain", F.explode(_words(F.col("text"))).alias("w")).where("w <> ''")
    counts = written(words.groupBy("domain", _bucket(F.col("w")).alias("bucket")).count(), "mix-counts")
    # One row a domain.
    docs = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    totals = {r[0]: r[1] for r in counts.groupBy("domain").agg(F.sum("count")).collect()}
    domains = sorted(docs) or ["all"]
    wide = counts.groupBy("bucket").agg(*[F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"c{i}") for i, d in enumerate(domains)])
    every = counts.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(wide, "bucket", "left")
    logs = [F.log((F.coalesce(f"c{i}", F.lit(0)) + SMOOTHING) / (totals.get(d, 0) + SMOOTHING * BUCKETS)).alias(f"l{i}") for i, d in enumerate(domains)]
    n = sum(docs.values())
    return domains, written(every.select("bucket", *logs), "mix-model"), [math.log(docs[d] / n) if n else 0.0 for d in domains]


def posteriors(docs: DataFrame, model: tuple[list[str], DataFrame, list[float]]) -> DataFrame:
    """(doc_id, tokens, p0..): one row for each doc_id, with the words of all its rows; a text without words has the
    priors. Words are summed where they are read, before the shuffle."""
    domains, logs, priors = model
    words = docs.select("doc_id", F.explode_outer(F.array_remove(_words(F.col("text")), "")).alias("w"))
    scored = words.withColumn("bucket", _bucket(F.col("w"))).join(F.broadcast(logs), "bucket", "left")
    sums = scored.groupBy("doc_id").agg(F.count("w").alias("tokens"), *[F.sum(F.when(F.col("w").isNotNull(), F.col(f"l{i}"))).alias(f"s{i}") for i in range(len(domains))])
    weight = F.least(F.col("tokens"), F.lit(EVIDENCE)) / F.greatest(F.col("tokens"), F.lit(1))
    sums = sums.select("doc_id", "tokens", *[(F.lit(p) + weight * F.coalesce(f"s{i}", F.lit(0.0))).alias(f"e{i}") for i, p in enumerate(priors)])
    top = F.greatest(*[F.col(f"e{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("e0")
    sums = sums.withColumn("top", top)
    sums = sums.select("doc_id", "tokens", *[F.exp(F.col(f"e{i}") - F.col("top")).alias(f"e{i}") for i in range(len(domains))])
    return sums.select("doc_id", "tokens", *[(F.col(f"e{i}") / reduce(add, [F.col(f"e{j}") for j in range(len(domains))])).alias(f"p{i}") for i in range(len(domains))])


def default_targets(domains: list[str], totals: list[float]) -> list[float]:
    """Token targets: flattened shares, scaled so that no domain but 'poor' shrinks, and 'poor' at POOR of its tokens."""
    n = sum(totals)
    if not n:
        return [0.0] * len(totals)
    flat = [(t / n) ** FLATTEN if t else 0.0 for t in totals]
    scale = max((t / f for d, t, f in zip(domains, totals, flat, strict=True) if f and d != "poor"), default=1.0)
    return [POOR * t if d == "poor" else scale * f for d, t, f in zip(domains, totals, flat, strict=True)]


def fit_rates(p: DataFrame, domains: list[str], targets: dict[str, float] | None = None) -> DataFrame:
    """p (doc_id, tokens, p0..) with a column rate. targets: tokens by domain; without, default_targets."""
    k = len(domains)
    first = p.agg(*[F.sum(F.col("tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in range(k)]).collect()[0]
    totals = [float(x or 0.0) for x in first]
    goal = [float(targets.get(d, 0.0)) for d in domains] if targets else default_targets(domains, totals)
    state, rate, now = p.withColumn("rate", F.lit(1.0)), F.col("rate"), totals
    for step in range(1, ITERATIONS + 1):
        gradient = [(s - g) / t if t else 0.0 for s, g, t in zip(now, goal, totals, strict=True)]
        if all(abs(s - g) <= TOLERANCE * max(g, t, 1e-9) for s, g, t in zip(now, goal, totals, strict=True)):
            break
        rate = F.greatest(F.lit(0.0), rate - reduce(add, [F.lit(x) * F.col(f"p{i}") for i, x in enumerate(gradient)]))
        if step % REPLAY == 0:
            state, rate = written(state.withColumn("rate", rate), "mix-rates"), F.col("rate")
        now = [float(x or 0.0) for x in state.agg(*[F.sum(rate * F.col("tokens") * F.col(f"p{i}")) for i in range(k)]).collect()[0]]
    else:
        missed = {d: round(s / g - 1, 4) if g else s for d, s, g in zip(domains, now, goal, strict=True) if abs(s - g) > MISSED * max(g, 1.0)}
        if missed:
            warnings.warn(f"after {ITERATIONS} iterations domains are still off their targets, by these shares: {missed}", stacklevel=2)
    return state.withColumn("rate", F.round(rate, 6))


def copies(rate: Column, doc_id: Column) -> Column:
    u = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 24)) / float(1 << 24)
    return F.floor(rate + u).cast("long")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, tokens, domain, posterior, rate, copies), one row for each doc_id of docs (a null one too): rows that
    share it are one document. A document without words has the prior of the labelled table. With no labelled rows
    there is one domain 'all' and every rate is 1; no documents, no rows. Other columns are ignored; ties between
    domains go to the first by name. A very long text is one row's words; its evidence is weighed like that of others.
    targets: tokens by domain; a fit that ends off its targets warns."""
    base = docs.select("doc_id", "text", "lang")
    model = fit(labelled_documents(base, labels))
    domains = model[0]
    p = written(posteriors(base, model), "mix-posteriors")
    fitted = fit_rates(p, domains, targets)
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("p0")
    name = reduce(lambda rest, i: F.when(F.col(f"p{i}") == F.col("posterior"), F.lit(domains[i])).otherwise(rest), reversed(range(len(domains))), F.lit(None).cast("string"))
    return fitted.withColumn("posterior", best).select("doc_id", "tokens", name.alias("domain"), F.round("posterior", 6).alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row repeated as often as its rate says (not at all, for some), in its own columns, whatever their
    names. Nulls, empty and very long texts, repeated rows and empty tables: see rates()."""
    plan = rates(docs, labels, targets).select(F.col("doc_id").alias("plan_id"), "copies")
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    joined = rows.join(plan, F.col("id").eqNullSafe(F.col("plan_id")))
    return joined.select(F.explode(F.array_repeat(F.col("row"), F.col("copies").cast("int"))).alias("row")).select("row.*")


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain, posterior, rate and copies of every document, for the default targets. Nulls, repeated rows, very long
    texts, clashing columns and empty tables: see rates()."""
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_soft_mixing": op3_soft_mixing}
SQL: dict[str, str] = {}
