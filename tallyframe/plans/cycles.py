"""Queries over reviews, configurations, data cycles, option scores and sets, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.functions import vectors as v
from tallyframe.operators import aggregates as agg
from tallyframe.operators import contracts, joins, loop, scoring, selection, sequences
from tallyframe.operators.text_metrics import score_rows, token_f1_texts
from tallyframe.plans.fixtures import fixture, table, with_fixtures
from tallyframe.plans.runs import norm

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Rows that both engines derive from the tables by the same SQL; {S} is the engine's text type."""
    return spark.sql(sql.replace("{S}", "string"), **{t: table(spark, sf_dir, t) for t in tables})


def duck(sql: str, *tables: str) -> str:
    for t in tables:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{S}", "varchar")


# --- numbers, texts and sets ----------------------------------------------------------------------------------------


@query("SELECT event_id, format('{:.9g}', value / 7) AS a, format('{:.9g}', -value * value * 1234567.0) AS b, format('{:.9g}', value / 1e9) AS c FROM events")
def score_texts(spark, sf_dir):
    x = F.col("value")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.score_text(x / 7).alias("a"), text.score_text(-x * x * 1234567.0).alias("b"), text.score_text(x / F.lit(1e9)).alias("c"))


FIGURES = """SELECT o_orderkey AS pair_id,
  CASE o_orderkey % 9 WHEN 0 THEN concat('0.00000', cast(1 + o_orderkey % 7 AS {S})) WHEN 1 THEN concat('9', cast(1000000000000000 + o_orderkey AS {S}), '00000') WHEN 2 THEN concat(chr(9), cast(o_orderkey AS {S}), chr(10))
    WHEN 3 THEN concat('is ', cast(o_orderkey AS {S}), '/3') WHEN 4 THEN concat('-', cast(o_orderkey AS {S}), '.50%') WHEN 5 THEN concat('5 or ', cast(o_orderkey % 50 AS {S}), ':4') WHEN 6 THEN concat(chr(9), chr(10)) WHEN 7 THEN concat('+', cast(o_orderkey AS {S}), ' 1/2%') ELSE concat('a', cast(o_orderkey AS {S})) END AS prediction,
  CASE o_orderkey % 9 WHEN 0 THEN concat('.00000', cast(1 + o_custkey % 7 AS {S}), '0') WHEN 1 THEN concat('9', cast(1000000000000000 + o_orderkey + o_custkey % 2 AS {S}), '00000.000') WHEN 2 THEN cast(o_orderkey + o_custkey % 2 AS {S})
    WHEN 3 THEN concat(cast(2 * o_orderkey + o_custkey % 2 AS {S}), ' / 6') WHEN 4 THEN concat('-', cast(o_orderkey + o_custkey % 2 AS {S}), '.5 %') WHEN 5 THEN concat(cast(o_custkey % 50 * 25 AS {S}), '%') WHEN 6 THEN CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE '0' END WHEN 7 THEN '1/2%' ELSE concat('a', cast(o_orderkey + o_custkey % 2 AS {S})) END AS reference
FROM {orders}"""
NUM = r"[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
LAST = f"list_last(regexp_extract_all(replace({{x}}, ',', ''), '(?:^|[^A-Za-z0-9_])({NUM}(?:\\s*[:/]\\s*{NUM})?%?)(?:[^A-Za-z0-9_]|$)', 1))"


@query(f"""WITH p AS ({duck(FIGURES, "orders")}), l AS (SELECT *, replace({LAST.replace("{x}", "prediction")}, ' ', '') AS a, replace({LAST.replace("{x}", "reference")}, ' ', '') AS b FROM p),
q AS (SELECT pair_id, prediction, reference, [a, b] AS s FROM l),
t AS (SELECT pair_id, prediction, reference, list_transform(s, lambda x: CASE WHEN x LIKE '%\\%' ESCAPE '\\' AND regexp_matches(x, '[:/]') THEN NULL ELSE [string_split_regex(rtrim(x, '%'), '[:/]')[1], CASE WHEN x LIKE '%\\%' ESCAPE '\\' THEN '100' WHEN regexp_matches(x, '[:/]') THEN string_split_regex(x, '[:/]')[2] ELSE '1' END] END) AS f FROM q),
n AS (SELECT pair_id, prediction, reference, list_transform(f, lambda y: list_transform(y, lambda z: z::DECIMAL(36, 8))) AS d FROM t WHERE true),
r AS (SELECT *, d[1][1] AS n1, d[1][2]::DECIMAL(10, 0) AS d1, d[2][1] AS n2, d[2][2]::DECIMAL(10, 0) AS d2 FROM n)
SELECT pair_id, CASE WHEN n1 IS NULL OR n2 IS NULL OR d1 = 0 OR d2 = 0 THEN {norm("prediction")} = {norm("reference")} WHEN d1 = d2 THEN n1 = n2 ELSE n1::DECIMAL(27, 8) * d2 = n2::DECIMAL(27, 8) * d1 END::INT::DOUBLE AS score FROM r""")
def exact_numbers(spark, sf_dir):
    return score_rows(derived(spark, sf_dir, FIGURES, "orders"), "numeric_match").select("pair_id", "score")


ENTITIES = """SELECT event_id AS pair_id,
  concat('[{{"type":"', CASE event_id % 3 WHEN 0 THEN 'chem' WHEN 1 THEN 'Gene' ELSE 'x-y' END, '","text":"', event_type, '"}}, {{"mention":["M', cast(user_id AS {S}), '","the m', cast(event_id % 5 AS {S}), '"]}}]') AS prediction,
  concat('[{{"text":"', event_type, '","type":"', CASE event_id % 4 WHEN 0 THEN 'chemical' WHEN 1 THEN 'gene' ELSE 'X Y' END, '"}},[{{"text":"m', cast(event_id % 5 AS {S}), '","type":"entity"}}]]') AS reference
FROM {events}"""
ENTITIES_SQL = ENTITIES.replace("{{", "{").replace("}}", "}").replace("{S}", "varchar").replace("{events}", "events")


@query(f"""WITH p AS ({ENTITIES_SQL}), k AS (SELECT pair_id, user_id, event_type, CASE event_id % 3 WHEN 0 THEN 'chemical' WHEN 1 THEN 'gene' ELSE 'x y' END AS pt, CASE event_id % 4 WHEN 0 THEN 'chemical' WHEN 1 THEN 'gene' ELSE 'x y' END AS rt, event_id % 5 AS m FROM p JOIN events ON event_id = pair_id),
s AS (SELECT pair_id, list_distinct([pt || '::' || replace(event_type, '_', ''), 'entity::m' || user_id, 'entity::m' || m]) AS p, list_distinct([rt || '::' || replace(event_type, '_', ''), 'entity::m' || m]) AS r FROM k)
SELECT pair_id, round(2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)), 9) AS score FROM s""")
def entity_sets(spark, sf_dir):
    rows = derived(spark, sf_dir, ENTITIES, "events")
    return score_rows(rows, "set_f1").select("pair_id", F.round("score", 9).alias("score"))


TEXT_PAIRS = "SELECT a.doc_id AS pair_id, a.text AS prediction, b.text AS reference FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1"
DOC_TOKENS = f"WITH pairs AS ({duck(TEXT_PAIRS, 'documents')}), t AS (SELECT pair_id, list_filter(string_split({norm('prediction')}, ' '), lambda x: x <> '') AS p, list_filter(string_split({norm('reference')}, ' '), lambda x: x <> '') AS r FROM pairs)"


@query(DOC_TOKENS + """, a AS (SELECT pair_id, x, count(*) AS k FROM (SELECT pair_id, unnest(p) AS x FROM t) GROUP BY 1, 2), b AS (SELECT pair_id, x, count(*) AS k FROM (SELECT pair_id, unnest(r) AS x FROM t) GROUP BY 1, 2),
s AS (SELECT a.pair_id, sum(least(a.k, b.k))::DOUBLE AS o FROM a JOIN b ON a.pair_id = b.pair_id AND a.x = b.x GROUP BY 1), c AS (SELECT t.pair_id, len(p) AS n, len(r) AS m, coalesce(s.o, 0) AS o FROM t LEFT JOIN s ON s.pair_id = t.pair_id)
SELECT pair_id, CASE WHEN n = 0 OR m = 0 THEN (n = m)::INT::DOUBLE WHEN o = 0 THEN 0.0::DOUBLE ELSE round(2 * (o / n) * (o / m) / (o / n + o / m), 9) END AS score FROM c""")
def qa_f1_documents(spark, sf_dir):
    """Whole texts against whole texts. They are normalised before they meet, in the tasks that read them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize_answer(F.col("text")).alias("text"))
    pairs = spark.sql(TEXT_PAIRS, documents=docs)
    return pairs.select("pair_id", F.round(token_f1_texts(F.col("prediction"), F.col("reference")), 9).alias("score"))


@query()
def rouge_l_documents(spark, sf_dir):
    """Whole texts against whole texts; SQL has no way that ends in time, tests hold it against the table of cells."""
    return score_rows(derived(spark, sf_dir, TEXT_PAIRS, "documents"), "rouge_l").select("pair_id", F.round("score", 9).alias("score"))


# --- reviews, configurations and caches -----------------------------------------------------------------------------

REVIEWS = """SELECT event_id, concat('{{', CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('"required":', CASE WHEN event_id % 13 = 0 THEN '1' ELSE 'true' END, ',') END, '"consensus":false,"decision":"', CASE event_id % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN 'stop' ELSE 'continue' END,
  '","retrieval":{{"improvement_probable":', CASE WHEN event_id % 17 = 0 THEN '"yes"' ELSE 'true' END, ',"confidence":', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE cast(event_id % 10 AS {S}) END, ',"reasoning":"', CASE WHEN event_id % 19 = 0 THEN '  ' ELSE event_type END,
  '"}},"critic":', CASE WHEN event_id % 23 = 0 THEN '[]' ELSE '{{"improvement_probable":false,"confidence":0.5,"reasoning":"r"}}' END, ',"orchestrator":{{"decision":"', CASE WHEN event_id % 29 = 0 THEN 'go' ELSE 'stop' END, '","confidence":1,"reasoning":"r"}}}}') AS review FROM {events}"""
REVIEWS_SQL = duck(REVIEWS.replace("{{", "{").replace("}}", "}"), "events")


@query(f"""WITH r AS ({REVIEWS_SQL}), j AS (SELECT event_id, review::JSON AS j FROM r)
SELECT event_id, CASE WHEN json_type(j) <> 'OBJECT' THEN 'not an object' WHEN len(list_filter(['consensus', 'critic', 'decision', 'orchestrator', 'required', 'retrieval'], lambda k: NOT list_contains(json_keys(j), k))) > 0 THEN 'missing ' || list_filter(['consensus', 'critic', 'decision', 'orchestrator', 'required', 'retrieval'], lambda k: NOT list_contains(json_keys(j), k))[1]
  WHEN json_type(j, '$.required') <> 'BOOLEAN' THEN 'required flag' WHEN json_type(j, '$.consensus') <> 'BOOLEAN' THEN 'consensus flag' WHEN j ->> '$.decision' NOT IN ('continue', 'stop') THEN 'decision'
  WHEN json_type(j, '$.retrieval') <> 'OBJECT' THEN 'retrieval object' WHEN json_type(j, '$.critic') <> 'OBJECT' THEN 'critic object' WHEN json_type(j, '$.retrieval.improvement_probable') <> 'BOOLEAN' THEN 'retrieval improvement_probable'
  WHEN json_type(j, '$.retrieval.confidence') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR NOT (j ->> '$.retrieval.confidence')::DOUBLE BETWEEN 0 AND 1 THEN 'retrieval confidence' WHEN trim(j ->> '$.retrieval.reasoning') = '' THEN 'retrieval reasoning'
  WHEN j ->> '$.orchestrator.decision' NOT IN ('continue', 'stop') THEN 'orchestrator decision' ELSE '' END AS error FROM j""")
def review_contract(spark, sf_dir):
    rows = derived(spark, sf_dir, REVIEWS, "events")
    return rows.select("event_id", contracts.review_error(F.col("review")).alias("error"))


@query("""WITH r AS (SELECT user_id % 50 AS k, count_if(event_type = 'purchase') AS successes, list(CASE WHEN value > 60 THEN 'Stop' WHEN value > 1 THEN 'stop' ELSE 'go' END ORDER BY event_id) AS decisions FROM events GROUP BY 1)
SELECT k, successes, successes >= 5 AND (k % 3 = 0 OR (len(decisions) >= k % 3 * 20 AND len(list_filter(decisions, lambda x: lower(x) <> 'stop')) = 0)) AS stop FROM r""")
def reviewed_stops(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("value") > 60, "Stop").when(F.col("value") > 1, "stop").otherwise("go")
    r = e.groupBy((F.col("user_id") % 50).alias("k")).agg(F.count_if(F.col("event_type") == "purchase").alias("successes"), F.count(said).alias("votes"), F.count_if(F.lower(said) != "stop").alias("others"))
    return loop.reviewed_stop_by_votes(r.withColumn("votes_needed", F.col("k") % 3 * 20), 5).select("k", "successes", "stop")


CONFIGS = """SELECT p_partkey, concat('{{"use_cache":', CASE p_partkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'false' ELSE 'true' END, ',"layers":[{{"use_cache":', CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '1' END, '}}],"name":"', p_name, '"',
  CASE WHEN p_partkey % 5 = 0 THEN ',"architectures":["XBertModel"]' ELSE ',"model_type":"own"' END, CASE WHEN p_partkey % 7 = 0 THEN ',"rope_type":"linear"' ELSE '' END, '}}') AS config FROM {part}"""


@query("""SELECT p_partkey, p_partkey % 3 < 1 OR p_partkey % 3 = 2 AS cache, p_partkey % 2 = 0 AS inner_cache, CASE WHEN p_partkey % 5 = 0 THEN 'bert' ELSE 'own' END AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'linear' END AS rope, p_name AS name FROM part""")
def config_rewrite(spark, sf_dir):
    rows = derived(spark, sf_dir, CONFIGS, "part").select("p_partkey", contracts.rewrite_config("config").alias("c"))
    get = lambda path: F.get_json_object("c", path)
    return rows.select("p_partkey", (get("$.use_cache") == "true").alias("cache"), (get("$.layers[0].use_cache") == "true").alias("inner_cache"), get("$.model_type").alias("kind"), get("$.type").alias("rope"), get("$.name").alias("name"))


@query("""WITH d AS (SELECT page_id, regexp_extract(url, '//([^?]*)', 1) AS dataset FROM pages), n AS (SELECT page_id, list_distinct([dataset, replace(dataset, '/', '___'), regexp_replace(regexp_replace(dataset, '^/+|/+$', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), replace(dataset, '/', '--'), string_split(dataset, '/')[-1]]) AS names FROM d)
SELECT page_id, len(names)::INT AS n, array_to_string(list_sort(names), ' ') AS names FROM n""")
def cache_names(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", contracts.cache_names(F.regexp_extract("url", "//([^?]*)", 1)).alias("names"))
    return d.select("page_id", F.size("names").alias("n"), F.array_join("names", " ").alias("names"))


SPLITS = """SELECT concat(event_type, '_', cast(user_id AS {S})) AS dataset, event_id AS ordinal, cast(floor(value) AS bigint) AS rows,
  CASE WHEN event_id % 41 = 0 THEN 'x: Dataset scripts are no longer supported, y' WHEN event_id % 53 = 0 THEN 'it requires a different version of datasets' WHEN event_id % 31 = 0 THEN 'connection lost' END AS error FROM {events}"""


@query(f"""WITH s AS ({duck(SPLITS, "events")}), e AS (SELECT dataset, min(ordinal) AS stop FROM s WHERE error LIKE '%Dataset scripts are no longer%' OR error LIKE '%different version of datasets%' GROUP BY 1), k AS (SELECT s.*, e.stop FROM s LEFT JOIN e ON s.dataset = e.dataset WHERE e.stop IS NULL OR s.ordinal <= e.stop)
SELECT dataset, CASE WHEN max(stop) IS NOT NULL THEN 'skipped' WHEN count(error) > 0 THEN 'failed' ELSE 'ok' END AS status, count_if(error IS NULL) AS splits, count(error) AS failures, coalesce(sum("rows") FILTER (WHERE error IS NULL), 0)::BIGINT AS n FROM k GROUP BY dataset""")
def download_status(spark, sf_dir):
    s = contracts.download_status(derived(spark, sf_dir, SPLITS.replace(" AS rows", " AS `rows`"), "events"))
    return s.withColumnRenamed("rows", "n")


STEPS = """SELECT concat('d', cast(user_id AS {S})) AS dataset, user_id AS ordinal, CASE event_id % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'evaluate' ELSE 'delete' END AS name, cast(CASE WHEN event_id % 997 = 500 THEN 1 ELSE 0 END AS int) AS returncode,
  CASE WHEN event_id % 1201 = 700 THEN 2 END AS failures, CASE WHEN event_id % 307 = 5 THEN 1 END AS skipped FROM {events}"""


@query(f"""WITH s AS ({duck(STEPS, "events")}), d AS (SELECT dataset, ordinal, CASE WHEN max(coalesce(skipped, 0)) > 0 THEN 'skipped' WHEN count_if(returncode <> 0 OR (name = 'evaluate' AND coalesce(failures, 0) > 0)) > 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS steps FROM s GROUP BY 1, 2)
SELECT * FROM d WHERE ordinal <= coalesce((SELECT min(ordinal) FROM d WHERE status = 'failed'), ordinal)""")
def data_cycle(spark, sf_dir):
    return contracts.cycle(derived(spark, sf_dir, STEPS, "events")).select("dataset", "ordinal", "status", "steps")


@query("""WITH r AS (SELECT DISTINCT event_type AS dataset, user_id AS round, concat(event_type, user_id % 4) AS request FROM events), s AS (SELECT DISTINCT event_type AS dataset, user_id AS round FROM events WHERE value > 120), c AS (SELECT DISTINCT event_type AS dataset, user_id AS round, concat(event_type, (user_id + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END) % 4) AS request FROM events WHERE value < 10)
SELECT r.dataset, r.round, CASE WHEN s.round IS NOT NULL THEN 'static' WHEN c.round IS NOT NULL THEN 'cache' ELSE 'provider' END AS source FROM r LEFT JOIN s ON r.dataset = s.dataset AND r.round = s.round LEFT JOIN c ON r.dataset = c.dataset AND r.round = c.round AND r.request = c.request""")
def handoff_source(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("dataset"), F.col("user_id").alias("round"))
    request = lambda k: F.concat("dataset", ((F.col("round") + k) % 4).cast("string"))
    cached = e.where("value < 10").withColumn("request", request(F.when(F.col("event_id") % 2 == 0, 0).otherwise(1)))
    return contracts.obtained(e.select("dataset", "round", request(F.lit(0)).alias("request")).distinct(), e.where("value > 120"), cached).select("dataset", "round", "source")


# --- pairs of runs --------------------------------------------------------------------------------------------------


@query(with_fixtures("results") + """, f AS (SELECT *, (status IS NOT NULL)::INT + (score IS NOT NULL)::INT + (metric IS NOT NULL)::INT + (evaluation_protocol IS NOT NULL)::INT + 1 AS filled FROM results),
b AS (SELECT dataset, model, status, metric, round(score, 9) AS score, row_number() OVER (PARTITION BY dataset, model ORDER BY filled DESC, ordinal) AS rn FROM f), c AS (SELECT dataset, model, "condition", min(ordinal) AS pos FROM results GROUP BY 1, 2, 3), j AS (SELECT dataset, model, string_agg("condition", '; ' ORDER BY pos) AS conditions FROM c GROUP BY 1, 2), n AS (SELECT dataset, model, count(*) AS n_rows FROM results GROUP BY 1, 2)
SELECT b.dataset, b.model, b.status, b.metric, b.score, j.conditions, n.n_rows FROM b JOIN j ON b.dataset = j.dataset AND b.model = j.model JOIN n ON b.dataset = n.dataset AND b.model = n.model WHERE rn = 1""")
def merge_pairs(spark, sf_dir):
    r = fixture(spark, sf_dir, "results").select("ordinal", "dataset", "model", "condition", "status", "metric", "score", "evaluation_protocol")
    return agg.merge_pairs(r, ["condition"]).select("dataset", "model", "status", "metric", F.round("score", 9).alias("score"), F.col("condition").alias("conditions"), "n_rows")


@query(with_fixtures("results") + """, m AS (SELECT dataset, model, min(ordinal) AS pos FROM results WHERE status = 'ok' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos) AS n FROM m) SELECT dataset, string_agg(model, '; ' ORDER BY pos) AS models FROM k WHERE n <= 2 GROUP BY 1""")
def first_models(spark, sf_dir):
    return contracts.first_models(fixture(spark, sf_dir, "results").where("status = 'ok'"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'declared' END AS declared, value, CASE event_id % 3 WHEN 0 THEN value ELSE value + 1 END AS accuracy, CASE event_id % 5 WHEN 0 THEN value * (1 + 1e-12) ELSE 0 END AS macro_f1 FROM events)
SELECT event_id, CASE WHEN declared IS NOT NULL THEN declared WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN '' WHEN event_id % 3 = 0 AND value <> 0 THEN 'accuracy' WHEN event_id % 5 = 0 THEN 'macro_f1' WHEN value = 0 THEN 'macro_f1' ELSE '' END AS metric FROM s WHERE value > 0""")
def summary_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 0")
    i, x = F.col("event_id"), F.col("value")
    summary = F.create_map(F.lit("accuracy"), F.when(i % 3 == 0, x).otherwise(x + 1), F.lit("macro_f1"), F.when(i % 5 == 0, x * (1 + 1e-12)).otherwise(0.0))
    return e.select("event_id", contracts.summary_metric(F.when(i % 4 == 0, "declared"), x, summary).alias("metric"))


@query("""WITH l AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1) SELECT user_id, array_to_string(list_filter(['inline', 'error', 'click'], lambda x: CASE x WHEN 'inline' THEN true ELSE list_contains(t, x) END), '|') AS labels FROM l""")
def label_maps(spark, sf_dir):
    """'1' is in both maps and the inline one wins; -1, blanks and 'Missing..' are not usable."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    has = lambda x: F.when(F.array_contains("t", x), x).otherwise(" \t")
    file = F.create_map(F.lit("1"), F.lit("file"), F.lit("2"), has("error"), F.lit("-1"), F.lit("none"), F.lit("3"), F.lit("Missing value"))
    inline = F.create_map(F.lit("1"), F.lit("inline"), F.lit("4"), has("click"), F.lit("5"), F.lit("inline"))
    return u.select("user_id", F.array_join(contracts.usable_labels(contracts.merged_labels(file, inline)), "|").alias("labels"))


@query(with_fixtures("predictions") + """, a AS (SELECT * FROM predictions WHERE model = 'm0'), b AS (SELECT * FROM predictions WHERE model = 'm2') SELECT a.idx, a.target_answer, a.prediction AS first, b.prediction AS second FROM a JOIN b ON a.idx = b.idx""")
def strict_protocol_pairs(spark, sf_dir):
    p = fixture(spark, sf_dir, "predictions")
    side = lambda m, t, q: p.where(F.col("model") == m).select("idx", F.col("target_answer").alias(t), F.col("prediction").alias(q))
    return joins.strict_pairs(side("m0", "target_answer", "first"), side("m2", "other", "second"), "idx", {"target_answer": "other"}).drop("other")


# --- option scores, images, vertices and offsets --------------------------------------------------------------------

E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
LSE = "(list_max({x}) + ln(list_sum(list_transform({x}, lambda z: exp(z - list_max({x}))))))"


def _lp(x: str, i: str) -> str:
    return f"({x}[{i} + 1] - {LSE.replace('{x}', x)})"


def option_rows(spark, sf_dir) -> DataFrame:
    """Three continuations for each pair of neighbours: of one id, of two, and of none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", v.doubles(F.col("embedding")).alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    one, two, none = F.array(F.col("label")), F.array((F.col("label") * 7 % 64), (F.col("label") + F.col("vec_id")) % 64), F.array().cast("array<bigint>")
    options = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("label"), ids.cast("array<int>").alias("ids")) for i, (n, ids) in enumerate((("one", one), ("two", two), ("none", none)))])
    # The first place of the logits belongs to the prompt, whose last place predicts the first id.
    return p.select("vec_id", F.inline(options), F.lit(2).alias("prompt_length"), F.array("y", "x", "y").alias("logits"))


@query(f"""WITH {E}, p AS (SELECT a.vec_id, a.label, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, {_lp('x', 'label')} AS one, ({_lp('x', '(label * 7 % 64)')} + {_lp('y', '((label + vec_id) % 64)')}) / 2 AS two FROM p)
SELECT vec_id, CASE WHEN one >= two THEN 'one' ELSE 'two' END AS prediction, round(greatest(one, two), 6) AS score, 3::BIGINT AS options FROM s""")
def continuation_scores(spark, sf_dir):
    return scoring.option_scores(option_rows(spark, sf_dir), "vec_id", mean=True).select("vec_id", "prediction", F.round("score", 6).alias("score"), "options")


@query(f"""WITH {E}, p AS (SELECT a.vec_id, a.label, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, {_lp('x', 'label')} AS one, ({_lp('x', '(label * 7 % 64)')} + {_lp('y', '((label + vec_id) % 64)')}) / 2 AS two FROM p)
SELECT vec_id, CASE WHEN one >= two THEN 'one' ELSE 'two' END AS prediction, round(greatest(one, two), 6) AS score, CASE WHEN one >= two THEN 1 ELSE 2 END::BIGINT AS positions FROM s""")
def masked_candidates(spark, sf_dir):
    rows = option_rows(spark, sf_dir).select("vec_id", "ordinal", "label", F.posexplode("ids").alias("position", "id"), "logits")
    rows = rows.withColumn("logits", F.get("logits", F.col("position") + 1))
    return scoring.masked_scores(rows, "vec_id").select("vec_id", "prediction", F.round("score", 6).alias("score"), "positions")


def _cubic(size: int, out: int) -> list[list[int]]:
    """The fixed-point weights of a bicubic resize, pixel by pixel."""
    rows, scale = [], size / out
    for i in range(out):
        centre, reach = (i + 0.5) * scale, 2 * max(scale, 1)
        lo, hi = max(0, int(centre - reach + 0.5)), min(size, int(centre + reach + 0.5))
        w = []
        for j in range(size):
            d = abs((j - centre + 0.5) / max(scale, 1))
            k = (1.5 * d - 2.5) * d * d + 1 if d < 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0
            w.append(k if lo <= j < hi else 0.0)
        rows.append([int(x / sum(w) * 2**22 + (0.5 if x >= 0 else -0.5)) for x in w])
    return rows


_dots = lambda weights, pick: f"list_transform({weights}, lambda w: list_transform(range(8), lambda k: greatest(0, least(255, (list_sum(list_transform(range(8), lambda j: w[j + 1] * {pick})) + 2097152) >> 22))))"


@query(f"""WITH {E}, p AS (SELECT vec_id, list_transform(x, lambda z: (floor(abs(z) * 200)::BIGINT % 256)) AS b FROM e),
h AS (SELECT vec_id, {_dots(_cubic(8, 3), 'b[(k * 8 + j + 1)::INT]')} AS h FROM p),
t AS (SELECT vec_id, flatten(list_transform({_cubic(8, 3)}, lambda w: list_transform(h, lambda col: greatest(0, least(255, (list_sum(list_transform(range(8), lambda j: w[j + 1] * col[j + 1])) + 2097152) >> 22))))) AS b FROM h)
SELECT vec_id, round((list_avg(b) / 255 - 0.485) / 0.229, 6) AS red, round((b[2] / 255 - 0.456) / 0.224, 6) AS green, round((list_max(b) / 255 - 0.406) / 0.225, 6) AS top_blue FROM t""")
def image_tensor(spark, sf_dir):
    """An embedding as a grey 8 x 8 image, resized to 3 x 3 and normalised."""
    grey = F.transform(v.doubles(F.col("embedding")), lambda z: (F.floor(F.abs(z) * 200) % 256).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.transform(grey, lambda b: F.array(b, b, b))).alias("p"))
    small = rows.select("vec_id", scoring.resize(F.col("p"), F.lit(8), F.lit(8), 3).alias("p"))
    planes = small.select("vec_id", scoring.channels(F.col("p"), 9).alias("c"))
    mean = F.round(F.aggregate(F.get("c", F.lit(0)), F.lit(0.0), lambda s, x: s + x) / 9, 6)
    return planes.select("vec_id", mean.alias("red"), F.round(F.get(F.get("c", F.lit(1)), F.lit(1)), 6).alias("green"), F.round(F.array_max(F.get("c", F.lit(2))), 6).alias("top_blue"))


@query(f"WITH {E}, n AS (SELECT count(*) AS id, arg_min(x, vec_id) AS x FROM e) SELECT vec_id, round(list_sum(x), 6) AS total FROM e UNION ALL SELECT id, round(list_sum(x), 6) FROM n")
def append_vertex(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("x"))
    out = scoring.append_vertex(e, e.agg(F.min_by("x", "vec_id").alias("x")), "x", "vec_id")
    return out.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, z: s + z), 6).alias("total"))


@query("""WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^ \\n\\t]+') AS p FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, len(p)::INT AS pieces, (CASE WHEN len(p) > 0 THEN strpos(text, p[1]) - 1 ELSE 0 END)::INT AS first_start,
  (CASE WHEN len(p) > 0 THEN length(replace(regexp_replace(text, '[ \\n\\t]+$', ''), 'ß', 'ss')) - length(replace(p[-1], 'ß', 'ss')) + length(p[-1]) ELSE 0 END)::INT AS last_end FROM w""")
def piece_offsets(spark, sf_dir):
    """Of the words of all texts, the first one's start and the last one's end; places are those of the case-folded text."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    pieces = F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))
    o = c.select("conv_id", "turn", sequences.piece_offsets(F.col("text"), pieces).alias("o"))
    edge = lambda i, side: F.coalesce(F.try_element_at("o", F.lit(i))[side], F.lit(0))
    return o.select("conv_id", "turn", F.size("o").alias("pieces"), edge(1, "s").alias("first_start"), edge(-1, "e").alias("last_end"))


@query("""SELECT conv_id, count_if(trim(coalesce(text, '')) <> '') AS texts, count(text) AS all_texts, count(DISTINCT role) AS roles FROM conversations GROUP BY 1""")
def path_values(spark, sf_dir):
    """Values by dotted paths through arrays of structs, and two levels of arrays flattened."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.struct("text", F.split("text", "(?<=.)(?=$)").alias("parts")).alias("body"))).alias("turns"))
    texts = turns.select("conv_id", text.path_value("turns[].body.text").alias("t"), text.path_value("turns.body.parts", 1).alias("p"), text.path_value("turns[].role").alias("r"))
    return texts.select("conv_id", F.size(F.filter("t", text.filled)).cast("long").alias("texts"), F.size("t").cast("long").alias("all_texts"), F.size(F.array_distinct("r")).cast("long").alias("roles"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'purchase!' ELSE '' END AS label FROM events""")
def closest_labels(spark, sf_dir):
    candidates = F.array(F.lit("Click"), F.lit("purchase!"), F.lit("other kind"))
    return table(spark, sf_dir, "events").select("event_id", selection.closest_label(F.col("event_type"), candidates).alias("label"))
