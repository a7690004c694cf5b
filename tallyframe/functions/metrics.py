"""Row scores. All lie in [0, 1]; two empty sides score 1, one empty side 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.json_text import set_items
from tallyframe.functions.text import SPACES, bound, filled, last_number, normalize_answer, normalize_entity_type, same_number, tokens


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def _f1(overlap: Column, n: Column, m: Column) -> Column:
    """2PR/(P+R) in the order of operations that rounding depends on."""
    p, r = overlap / n, overlap / m
    return F.when((n == 0) | (m == 0), ((n == 0) & (m == 0)).cast("double")).when(overlap == 0, 0.0).otherwise(2 * p * r / (p + r))


def token_f1(p: Column, r: Column) -> Column:
    """Of two token arrays: multiset overlap. Both are sorted together, each token with its side; a run of equal tokens adds
    the smaller of its two counts, so that the work is that of a sort. Arrays and overlap are bound, as each is named several
    times. For answers; operators.text_metrics takes whole texts another way."""
    side = lambda arr, x: F.transform(arr, lambda t: F.struct(t.alias("t"), F.lit(x).alias("s")))
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("found"))

    def step(a: Column, x: Column) -> Column:
        # Within a run the tokens of p come first: n of them wait for partners.
        same = a["t"] == x["t"]
        n = F.when(same, a["n"]).otherwise(0)
        hit = (x["s"] == 1) & (n > 0)
        return F.struct(x["t"].alias("t"), (n + F.when(x["s"] == 0, 1).when(hit, -1).otherwise(0)).alias("n"), (a["found"] + hit.cast("int")).alias("found"))

    def counts(x: Column) -> Column:
        both = F.sort_array(F.concat(side(x["p"], 0), side(x["r"], 1)))  # array_sort would compare by an interpreted lambda
        return F.struct(F.aggregate(both, start, step, lambda a: a["found"]).alias("o"), F.size(x["p"]).alias("n"), F.size(x["r"]).alias("m"))

    return bound(bound(F.struct(p.alias("p"), r.alias("r")), counts), lambda c: _f1(c["o"], c["n"], c["m"]))


def lcs_length(p: Column, r: Column) -> Column:
    """Longest common subsequence of two token arrays, row by row of the usual table: the outer fold carries a row, the
    inner one builds the next by copying it, so the work is cubic. For pairs of a few words; operators.text_metrics takes
    longer ones another way."""
    zero = F.transform(F.concat(F.array(F.lit("")), r), lambda x: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        cells = F.arrays_zip(r.alias("y"), F.slice(prev, 1, F.size(r)).alias("diag"), F.slice(prev, 2, F.size(r)).alias("up"))
        step = lambda acc, c: F.concat(acc, F.array(F.when(c["y"] == x, c["diag"] + 1).otherwise(F.greatest(F.element_at(acc, -1), c["up"]))))
        return F.aggregate(cells, F.array(F.lit(0)), step)

    return F.when((F.size(p) == 0) | (F.size(r) == 0), 0).otherwise(F.element_at(F.aggregate(p, zero, row), -1))


def rouge_l(p: Column, r: Column) -> Column:
    return _f1(lcs_length(p, r), F.size(p), F.size(r))


def numeric_match(prediction: Column, reference: Column) -> Column:
    """Exact equality of the last numbers; of the normalised texts where a side has none."""
    same = same_number(last_number(prediction), last_number(reference))
    return F.coalesce(same, normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def canonical_set(c: Column) -> Column:
    """The items of a text, normalised and distinct: of a JSON array (and of arrays in it, at any depth), of a JSON object (a
    typed mention 'type::text' for each of its text or mention, else its keys and values), else the pieces between commas,
    semicolons and line ends. A null has none. Only texts that begin as JSON leave the JVM."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    json = c.rlike(rf"^{SPACES}*[\[{{]")
    plain = F.transform(F.split(F.when(~json, c), r"[,;\n]+"), lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("text")))

    def one(x: Column) -> Column:
        return bound(normalize_answer(x["text"]), lambda t: F.when((t != "") & x["kind"].isNotNull(), F.concat(normalize_entity_type(x["kind"]), F.lit("::"), t)).otherwise(t))

    items = F.coalesce(set_items(F.when(json, c)), plain)
    return F.array_distinct(F.filter(F.transform(items, one), lambda x: x != ""))


def set_f1(p: Column, r: Column) -> Column:
    """Of two canonical sets."""
    n, m = F.size(p), F.size(r)
    return F.when((n == 0) | (m == 0), ((n == 0) & (m == 0)).cast("double")).otherwise(2.0 * F.size(F.array_intersect(p, r)) / (n + m))


def best_of(references: Column, score: Callable[[Column], Column]) -> Column:
    """The best score over non-blank references; null if there are none."""
    usable = F.filter(references, filled)
    return F.array_max(F.transform(usable, score))


def metric(name: str, prediction: Column, reference: Column) -> Column:
    """A score by its name; accuracy and macro_f1 score rows by exact match."""
    if name == "qa_f1":
        return token_f1(tokens(prediction), tokens(reference))
    if name == "rouge_l":
        return rouge_l(tokens(prediction), tokens(reference))
    if name == "numeric_match":
        return numeric_match(prediction, reference)
    if name == "set_f1":
        return set_f1(canonical_set(prediction), canonical_set(reference))
    if name in ("accuracy", "exact_match", "macro_f1"):
        return exact_match(prediction, reference)
    raise ValueError(f"unknown metric {name!r}")
