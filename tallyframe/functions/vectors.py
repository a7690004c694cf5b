"""Vector, logit and sequence numerics on arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: an expression used inside a lambda is evaluated for every item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column, floor: float = 1e-8) -> Column:
    """a over its norm, the norm at least `floor`."""
    return bind(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def argmax(a: Column) -> Column:
    """0-based place of the largest item, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_sum_exp(a: Column) -> Column:
    return bind(F.array_max(a), lambda top: top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def token_logprob(logits: Column, token: Column) -> Column:
    return F.get(logits, token) - log_sum_exp(logits)


def softmax(a: Column) -> Column:
    return bind(log_sum_exp(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def sigmoid_labels(logits: Column) -> Column:
    """0-based labels with a probability of 0.5 or more; the largest alone if there is none."""
    hits = F.filter(F.transform(logits, lambda x, i: F.when(1 / (1 + F.exp(-x)) >= 0.5, i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(argmax(logits)))


def top_positions(a: Column, k: int) -> Column:
    """array<struct<v, i>> of the k largest, falling, the smaller place first among equals."""
    rows = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("i"), x.alias("v")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(x["v"].alias("v"), x["i"].alias("i")))


def best_span(start: Column, end: Column, max_tokens: int = 64, top: int = 20) -> Column:
    """struct<score, s, e>: the best start and end of the top candidates with s <= e < s + max_tokens; the first of
    equals in the order of candidates. null without one."""
    def pick(both: Column) -> Column:
        """Ends are in falling order, so the first that fits a start is its best."""

        def of_start(s: Column, k: Column) -> Column:
            fits = F.filter(both["ends"], lambda e: (e["i"] >= s["i"]) & (e["i"] - s["i"] + 1 <= max_tokens))
            e = F.try_element_at(fits, F.lit(1))
            return F.when(e.isNotNull(), F.struct((s["v"] + e["v"]).alias("score"), (-k).alias("k"), s["i"].alias("s"), e["i"].alias("e")))

        return F.array_max(F.transform(both["starts"], of_start))

    best = bind(F.struct(top_positions(start, top).alias("starts"), top_positions(end, top).alias("ends")), pick)
    return bind(best, lambda b: F.when(b.isNotNull(), F.struct(b["score"].alias("score"), b["s"].alias("s"), b["e"].alias("e"))))


def pad(ids: Column, length: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value).cast("bigint"), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def mean_pool(rows: Column, mask: Column) -> Column:
    """Mean of the masked rows of array<array<double>>, at least one counted, as a unit vector."""
    kept = F.filter(F.arrays_zip(rows.alias("r"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.transform(F.get(rows, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["r"], lambda a, b: a + b))
    mean = bind(F.greatest(F.size(kept), F.lit(1)), lambda n: F.transform(total, lambda x: x / n))
    return bind(mean, unit)


def head_and_tail(ids: Column, budget: int) -> Column:
    """ids if they fit; else the first quarter of the budget and the rest from the end."""
    head = budget // 4
    return F.when(F.size(ids) <= budget, ids).otherwise(F.concat(F.slice(ids, 1, head), F.slice(ids, -(budget - head), budget - head)))
