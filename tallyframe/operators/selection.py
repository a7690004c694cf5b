"""Row selection, candidate conversion, failure rows and role inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.contract import measured_success, result_outcome
from tallyframe.functions.text import filled, has_gold, normalize_label_text, stripped
from tallyframe.operators.numbering import numbered

#: Families of labels that classifiers and datasets spell differently.
LABEL_FAMILIES = (
    (("science", "tech", "technology", "scitech", "sci tech"), ("scitech", "sci tech", "science technology")),
    (("world news", "worldpost", "the worldpost", "international"), ("world",)),
)
#: Quantisations of weight files, best first; and marks of projector files.
QUANTISATIONS = ("q4_k_m", "q5_k_m", "q4_k_s", "q5_0", "q4_0", "q3_k_m", "q6_k", "q8_0", "f16", "bf16")
PROJECTORS = ("mmproj", "projector")
#: Error lines that a log is searched for; the last of the last kind decides.
ERRORS = ("HTTPStatusError: Client error", "OSError: ", "ValueError: ", "RuntimeError: ", "TypeError: ", "KeyError: ", "ImportError: ", "ModuleNotFoundError: ")


def first_pairs_then_datasets(df: DataFrame, pairs: int = 0, datasets: int = 0) -> DataFrame:
    """The first `pairs` rows, and of these the rows of the first `datasets` datasets (0: all); in encounter order."""
    rows = df.orderBy("ordinal").limit(pairs) if pairs else df
    if not datasets:
        return rows
    first = rows.groupBy("dataset").agg(F.min("ordinal").alias("_f")).orderBy("_f").limit(datasets).select("dataset")
    return rows.join(first, "dataset", "left_semi")


def cycle_selection(df: DataFrame, per_dataset: int = 0, pairs: int = 0, datasets: int = 0) -> DataFrame:
    """The cycle runner's order: a limit for each dataset first, then the pair limit, then the dataset limit."""
    if per_dataset:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy("ordinal"))).where(F.col("_n") <= per_dataset).drop("_n")
    return first_pairs_then_datasets(df, pairs, datasets)


def hashed_sample(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """`limit` rows without replacement, in sampled order, with their place; all rows, in order, if limit is 0 or there
    are no more. The order is a hash of the seed and the key: the same on every cluster."""
    if limit <= 0:
        return numbered(df, [key], "sample_index")
    h = F.xxhash64(F.lit(seed), F.col(key))
    picked = df.withColumn("_h", h).orderBy("_h", key).limit(limit)
    return picked.withColumn("sample_index", F.row_number().over(Window.orderBy("_h", key)) - 1).drop("_h")


def convert_candidates(records: DataFrame, excluded: DataFrame, limit: int) -> DataFrame:
    """records (ordinal, model_name, model, rank, score, link_probability, gated, access_status): each with its model,
    final rank and score, and the first reason that rejects it, up to the record that fills the limit; later ones are
    not looked at, so they are not returned."""
    model = stripped(F.coalesce(F.when(F.col("model_name") != "", F.col("model_name")), F.col("model"), F.lit("")))
    rank = F.coalesce(F.col("rank"), F.col("ordinal") + 1)
    r = records.select("ordinal", model.alias("model"), rank.cast("long").alias("rank"), F.coalesce("score", "link_probability").alias("score"), F.coalesce(F.col("gated"), F.lit(False)).alias("gated"), F.lower(F.coalesce("access_status", F.lit(""))).alias("access"))
    old = excluded.select(F.lower(stripped(F.col("model"))).alias("_key")).where("_key <> ''").distinct().withColumn("_old", F.lit(True))
    r = r.withColumn("_key", F.lower("model")).join(old, "_key", "left")
    own = (
        F.when(F.col("model") == "", "missing_model").when(F.col("gated") | F.col("access").isin("gated", "private", "denied"), "gated_model").when(F.col("rank") < 1, "invalid_rank")
        .when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "non_finite_or_missing_score").when(F.col("_old"), "already_evaluated_or_excluded")
    )
    place = F.struct(F.when(F.col("rank") == 0, F.col("ordinal") + 1).otherwise(F.col("rank")), "ordinal")
    r = r.withColumns({"_own": own, "_place": place})
    again = F.row_number().over(Window.partitionBy("_key", F.col("_own").isNull()).orderBy("_place")) > 1
    r = r.withColumn("reason", F.coalesce(F.col("_own"), F.when(again, "duplicate_model")))
    # The record that fills the limit is the last of the first `limit` accepted ones; one row.
    full = r.where("reason is null").select("_place").orderBy("_place").limit(limit).agg(F.when(F.count(F.lit(1)) == limit, F.max("_place")).alias("_last"))
    looked = r.join(F.broadcast(full), F.col("_last").isNull() | (F.col("_place") <= F.col("_last")))
    if limit < 1:  # full before any record
        looked = looked.where(F.lit(False))
    return looked.select("ordinal", "model", "rank", "score", "reason")


def candidate_id(dataset: Column, model: Column, identity: Column) -> Column:
    """16 hexadecimal digits of a SHA-256 over the three, separated by zero bytes."""
    zero = F.lit("\0")
    return F.left(F.sha2(F.concat(dataset, zero, model, zero, identity).cast("binary"), 256), F.lit(16))


def failure_rows(results: DataFrame) -> DataFrame:
    """Rows that are neither planned nor measured, as failures."""
    bad = (F.coalesce(F.col("status"), F.lit("")) != "planned") & ~measured_success(F.col("status"), F.col("score"), F.col("labeled_total"))
    return results.where(bad).select("dataset", "model", F.lit("result_audit").alias("stage"), "status")


def first_filled(df: DataFrame, *columns: str) -> Column:
    """The first of the columns that is there and has a text; null without one. Tables of two naming schemes are read so."""
    own = [F.when(filled(F.col(c)), F.col(c).cast("string")) for c in columns if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def pair_keys(df: DataFrame) -> DataFrame:
    """df with dataset and model, whichever of two naming schemes it has them under."""
    return df.withColumns({"dataset": first_filled(df, "query_dataset", "dataset"), "model": first_filled(df, "model_name", "model")})


def failed_models(df: DataFrame) -> DataFrame:
    """(dataset, models): the models of failed rows, distinct, by their first ordinal. A row that has a status is judged by it,
    its score and its labelled rows (the columns of an evaluation come second, but for the labelled rows); one without, by
    its outcome."""
    status, score, labelled = first_filled(df, "status", "eval_status"), first_filled(df, "score", "eval_score"), first_filled(df, "eval_labeled_total", "labeled_total")
    failed = F.when(status.isNotNull(), result_outcome(status, score, labelled) == "failure").otherwise(F.lower(first_filled(df, "outcome")) == "failure")
    rows = pair_keys(df).where(failed).where("dataset is not null and model is not null")
    first = rows.groupBy("dataset", "model").agg(F.min("ordinal").alias("at"))
    return first.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models"))


def unsupported_rows(plans: DataFrame) -> DataFrame:
    """Summaries of plans (dataset, model, split, task, protocol, metric, notes array<string>) that can't be run: the note that says so
    (else the first one) as the reason, and counts of 0."""
    marked = F.get(F.filter("notes", lambda x: F.startswith(x, F.lit("Unsupported evaluation:"))), F.lit(0))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    rows = plans.where("protocol = 'unsupported'")
    return rows.select("model", "dataset", "split", "task", F.col("protocol").alias("evaluation_protocol"), "metric", zero.alias("total"), zero.alias("labeled_total"), zero.alias("correct"), none.alias("score"), none.alias("accuracy"), F.coalesce(marked, F.get("notes", F.lit(0))).alias("unsupported_reason"))


def missing_rows(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Expected pairs without a result, as failures."""
    gone = expected.select("dataset", "model").distinct().join(results.select("dataset", "model").distinct(), ["dataset", "model"], "left_anti")
    return gone.select("dataset", "model", F.lit("result_audit").alias("stage"), F.lit("missing").alias("status"))


def failure_reasons(*sources: DataFrame) -> DataFrame:
    """(dataset, model, reasons): distinct texts of all sources (dataset, model, ordinal, message) in order."""
    rows = sources[0].withColumn("_s", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_s", F.lit(i)))
    # A text's first place before the pair's list: the list holds distinct texts, whatever the number of rows.
    first = rows.where(filled(F.col("message"))).groupBy("dataset", "model", "message").agg(F.min(F.struct("_s", "ordinal")).alias("at"))
    texts = first.groupBy("dataset", "model").agg(F.array_sort(F.collect_list(F.struct("at", "message"))).alias("m"))
    return texts.select("dataset", "model", F.array_join(F.transform("m", lambda x: x["message"]), " | ").alias("reasons"))


def closest_label(raw: Column, candidates: Column) -> Column:
    """The candidate equal to raw after normalisation, else the one of the same family; '' without one."""
    n = normalize_label_text(raw)

    def pick(*wanted: str | Column) -> Column:
        return F.try_element_at(F.filter(candidates, lambda c: normalize_label_text(c).isin(*wanted)), F.lit(1))

    out = pick(n)
    for spellings, targets in LABEL_FAMILIES:
        out = F.coalesce(out, F.when(n.isin(*spellings), pick(*targets)))
    return F.coalesce(out, F.lit(""))


def error_line(log: Column, limit: int = 500) -> Column:
    """The error that a log ends with; kinds are tried in order, and the last match of the last kind counts. Without one,
    the text itself, shortened."""
    found = [F.regexp_extract_all(log, F.lit(f"({e}[^\\n]+)"), F.lit(1)) for e in ERRORS]
    last = F.try_element_at(F.concat(*found), F.lit(-1))
    return F.coalesce(last, F.when(F.length(log) > limit, F.concat(F.left(log, F.lit(limit - 3)), F.lit("..."))).otherwise(log))


def weight_file(files: Column) -> Column:
    """The weight file to load: no projector, unsharded or a first shard, the best known quantisation, then the name."""
    base = lambda f: F.lower(F.regexp_extract(f, r"([^/]*)$", 1))
    projector = lambda f: F.exists(F.array(*[F.lit(m) for m in PROJECTORS]), lambda m: F.contains(base(f), m))
    usable = F.filter(files, lambda f: F.endswith(F.lower(f), F.lit(".gguf")) & ~projector(f) & ~(f.rlike(r"-\d{5}-of-\d{5}\.gguf$") & ~f.rlike(r"-00001-of-\d{5}\.gguf$")))
    order = F.array(*[F.lit(q) for q in QUANTISATIONS])
    place = lambda f: F.coalesce(F.array_position(F.transform(order, lambda q: F.contains(F.lower(f), q)), F.lit(True)), F.lit(0))
    keyed = F.transform(usable, lambda f: F.struct(F.when(place(f) == 0, len(QUANTISATIONS) + 1).otherwise(place(f)).alias("p"), F.lower(f).alias("l"), f.alias("f")))
    return F.array_min(keyed)["f"]


def missing_shards(name: Column, files: Column) -> Column:
    """Shards of a sharded file that are not among the files."""
    total = F.regexp_extract(name, r"-of-(\d{5})\.gguf$", 1).try_cast("int")
    prefix = F.regexp_extract(name, r"^(.*)-\d{5}-of-\d{5}\.gguf$", 1)
    want = F.transform(F.sequence(F.lit(1), total), lambda i: F.concat(prefix, F.lit("-"), F.lpad(i.cast("string"), 5, "0"), F.lit("-of-"), F.lpad(total.cast("string"), 5, "0"), F.lit(".gguf")))
    return F.when(total.isNotNull(), F.array_except(want, files)).otherwise(F.array().cast("array<string>"))


def answer_column(df: DataFrame, candidates: list[str], rows: int) -> str:
    """Of the candidate columns, the one with most labels in the first rows; the first of equals, '' without any."""
    own = [c for c in candidates if c in df.columns]
    if not own:
        return ""
    # One row of counts.
    counts = df.limit(rows).agg(*[F.count_if(has_gold(F.col(c))).alias(c) for c in own]).collect()[0]
    return max(own, key=lambda c: counts[c]) if any(counts) else ""


def label_map(df: DataFrame, column: str) -> DataFrame:
    """(label_id, label): sorted distinct labels with dense ids."""
    found = df.where(has_gold(F.col(column))).select(F.col(column).cast("string").alias("label")).distinct()
    return numbered(found, ["label"], "label_id")


def task_and_audit(rows: DataFrame, runnable: Column) -> tuple[DataFrame, DataFrame]:
    """(tasks, audit): every row is audited with its decision; runnable ones get a dense task index in order."""
    audit = rows.withColumn("decision", F.when(F.coalesce(runnable, F.lit(False)), "run").otherwise("skip"))
    return numbered(audit.where("decision = 'run'"), ["ordinal"], "task_index"), audit


def current_cache(df: DataFrame, dimension: int = 1024) -> DataFrame:
    """df (summary, cached_summary, vector) with current: equal texts and a finite vector of that size that isn't zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists("vector", lambda x: x != 0)
    ok = (stripped(F.col("summary")) == stripped(F.col("cached_summary"))) & (stripped(F.col("summary")) != "") & (F.size("vector") == dimension) & finite & nonzero
    return df.withColumn("current", F.coalesce(ok, F.lit(False)))


def contracts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Known dataset contracts (dataset, field, value) as a table; join it by dataset to override inferred fields."""
    return spark.createDataFrame(rows, "dataset string, field string, value string")


def overlay(defaults: DataFrame, specific: DataFrame, key: str) -> DataFrame:
    """specific over defaults, field by field; a null leaves the default. Both have the same columns."""
    fields = [c for c in defaults.columns if c != key]
    left = specific.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return defaults.join(left, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in fields])
