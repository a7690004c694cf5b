"""Values of JSON texts whose schema and depth are not known: canonical form, text leaves, items of a set.

Built-in expressions open a JSON text to a depth that the plan fixes; these walk it to any depth, in one pass over Arrow
batches without a shuffle. Rows that need no walk are given to Python as nulls.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parsed(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _mapped(rows: pd.Series, f) -> pd.Series:
    return pd.Series([None if x is None else f(x) for x in rows], dtype=object)


def _canonical(text: str) -> str | None:
    ok, value = _parsed(text)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if ok else None


@F.pandas_udf(T.StringType())
def canonical_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON text with the keys of all objects sorted, without blanks, numbers and escapes in one form; null for other texts."""
    for rows in parts:
        yield _mapped(rows, _canonical)


def json_digest(c: Column) -> Column:
    """SHA-256 of the canonical form: equal for texts of equal values, whatever the order of keys; null for other texts."""
    return F.sha2(canonical_json(c).cast("binary"), 256)


def _leaves(text: str) -> list[str]:
    ok, value = _parsed(text)
    out, open_ = [], [value if ok else text]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out += [x] if x.strip() else []
        elif isinstance(x, dict):
            open_ += [x["text"]] if "text" in x else reversed(x.values())
        elif isinstance(x, list):
            open_ += reversed(x)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_leaves(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The non-blank strings of a JSON text in order, at any depth; of an object with a key 'text', those below it alone. A text
    that is no JSON is a string."""
    for rows in parts:
        yield _mapped(rows, _leaves)


_ARTICLE, _PUNCTUATION = re.compile(r"\b(?:a|an|the)\b"), str.maketrans("", "", string.punctuation)


def _bare(value: object) -> bool:
    """Whether nothing is left of a value after normalisation."""
    text = "" if value is None else str(value)
    return not _ARTICLE.sub(" ", text.lower()).translate(_PUNCTUATION).strip()


def _items(text: str) -> list[tuple]:
    out, open_ = [], [text]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            own = x.strip()
            ok, value = _parsed(own) if own.startswith(("[", "{")) else (False, None)
            if ok:
                open_.append(value)
            else:
                out += [(None, p) for p in re.split(r"[,;\n]+", x)]
        elif isinstance(x, dict):
            named = x.get("text", x.get("mention"))
            mentions = [m for m in (named if isinstance(named, list) else [named]) if not _bare(m)]
            kind = str(x.get("type", "entity"))
            out += [(kind, str(m)) for m in mentions] or [(None, json.dumps(x, sort_keys=True, ensure_ascii=False))]
        elif isinstance(x, list):
            open_ += reversed(x)
        elif x is not None:
            out.append((None, str(x)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def set_items(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The items of a JSON text, arrays opened to any depth (and JSON texts in strings, too), each not yet normalised: of an
    object its texts or mentions with its type, or else the whole object; of a text the pieces between commas, semicolons
    and line ends."""
    for rows in parts:
        yield _mapped(rows, lambda x: [{"kind": k, "text": t} for k, t in _items(x)])
