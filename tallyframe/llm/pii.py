"""Format-preserving Feistel pseudonyms for personal data.

Validated values are replaced by a keyed permutation of their own format: a card number becomes another number with a
valid check digit and the same grouping, a date another date, an address another address. The permutation depends on
the key and the kind alone, so equal values stay linked across documents, and the holder of the key can undo it.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), ssn, phone (+ and country code, or ten digits as (ddd) ddd-dddd),
ipv4, date (ISO, also before a time, dd.mm.yyyy, dd/mm/yyyy, 1900 to 2099), email (the part before @, at most its last 64
characters) and secret (a quoted hexadecimal
credential). Numbers that fail their validation stay as they are. Where the longest candidate at a place fails, shorter
ones that end at a group are tried, then other kinds, and the scan goes on behind the first group: a number or word beside
a value does not hide it. Patterns look at a bounded stretch from each place, so a scan is linear in the text.

The key is an argument or the setting spark.tallyframe.pii.key. Where neither is there, a secret one is drawn for the
session: values stay linked in all that the session writes, and nobody can undo them or link them with other runs.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from itertools import accumulate, repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import prepare, table

ROUNDS = 10
KEY_SETTING = "spark.tallyframe.pii.key"
KINDS = ("card", "iban", "ssn", "phone", "ipv4", "date", "email", "secret")
_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """Keyed permutations of {0 .. radix^n - 1} written as n digits, and of {0 .. size - 1} by cycle walking."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, kind: str, n: int, radix: int, i: int, half: int) -> int:
        msg = f"{kind}|{radix}|{n}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(msg, key=self.key, digest_size=32).digest(), "big")

    def digits(self, value: int, n: int, kind: str, radix: int = 10, undo: bool = False) -> int:
        if n < 2:
            shift = 1 + self._round(kind, n, radix, 0, 0) % (radix - 1)
            return (value - shift if undo else value + shift) % radix**n
        left = n // 2
        sizes = (radix**left, radix ** (n - left))
        a, b = divmod(value, sizes[1])
        for i in range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS):
            # Even rounds change the left part by the right one, odd rounds the other way round.
            f = self._round(kind, n, radix, i, b if i % 2 == 0 else a) * (-1 if undo else 1)
            if i % 2 == 0:
                a = (a + f) % sizes[0]
            else:
                b = (b + f) % sizes[1]
        return a * sizes[1] + b

    def below(self, value: int, size: int, kind: str, undo: bool = False) -> int:
        n = 2 + (size - 1).bit_length() // 2 * 2
        while True:
            value = self.digits(value, n, kind, 2, undo)
            if value < size:
                return value


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _refill(shape: str, chars: str, member: Callable[[str], bool] = str.isdigit) -> str:
    """shape with its member characters replaced by chars in order."""
    it = iter(chars)
    return "".join(next(it) if member(c) else c for c in shape)


class Pseudonyms:
    """replace(text) -> (text, counts by kind). undo=True inverts."""

    #: In the order in which the kinds are tried at one place.
    EACH = {
        "email": re.compile(r"""(?P<email>[^\W_][\w.%+\-]{0,63}+(?=@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}))"""),
        "secret": re.compile(r"""(?P<secret>(?<=["'])[0-9a-f]{32,}(?=["'])|(?<=["'])[0-9A-F]{32,}(?=["']))"""),
        "iban": re.compile(r"""(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])"""),
        "ipv4": re.compile(r"""(?<![0-9A-Za-z.+])(?P<ipv4>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z]|\.[0-9])"""),
        "phone": re.compile(r"""(?<![0-9A-Za-z])(?P<phone>\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+[2-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ \-]?[0-9]{2,4}){2,3}|\([0-9]{3}\)[ ]?[0-9]{3}[ .\-][0-9]{4})(?![0-9A-Za-z])"""),
        "date": re.compile(r"""(?<![0-9A-Za-z])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?P<sep>[./])[0-9]{2}(?P=sep)[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]{2})|[.\-/][0-9])"""),
        "ssn": re.compile(r"""(?<![0-9A-Za-z\-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z]|-[0-9])"""),
        "card": re.compile(r"""(?<![0-9A-Za-z])(?P<card>[0-9](?:[ \-]?[0-9]){12,18})(?![0-9A-Za-z])"""),
    }
    #: One scan finds the places.
    PATTERN = re.compile("|".join(p.pattern for p in EACH.values()))
    NEEDS = re.compile("[0-9@]")
    #: Kinds of varying length, and the most characters that they have.
    VARYING, LONGEST = ("iban", "phone", "card"), 64
    GROUP = re.compile("[^0-9A-Za-z]*[0-9A-Za-z]+")
    #: Steps of a walk, at most: only long runs of short numbers come near. A value is replaced in any case, but behind a
    #: walk that was given up undoing may meet other values.
    WALK = 2000

    def __init__(self, key: str, undo: bool = False):
        self.f, self.undo = Feistel(key), undo

    def _at(self, text: str, p: int) -> tuple[str | None, int, int, bool]:
        """(kind or None, end, reach, first) of the valid value at a place: reach is the end of the longest candidate, and
        first tells that no other candidate was tried before."""
        reach, first = p, True
        for kind, pattern in self.EACH.items():
            m = pattern.match(text, p)
            if m is None:
                continue
            end = m.end()
            reach = max(reach, end)
            while end > p:
                if (end == m.end() or pattern.fullmatch(text, p, end)) and getattr(self, kind)(text[p:end]) is not None:
                    return kind, end, reach, first
                first = False
                if kind not in self.VARYING:
                    break
                end = max(text.rfind(c, p, end) for c in " -.")
        return None, p, reach, False

    def _places(self, text: str) -> list[tuple[int, str | None, int, int, bool]]:
        """(start, *_at) of all places that look like a value, valid or not."""
        out, m = [], self.PATTERN.search(text)
        while m:
            p = m.start()
            kind, end, reach, first = self._at(text, p)
            out.append((p, kind, end, reach, first))
            m = self.PATTERN.search(text, end if kind else self.GROUP.match(text, p).end())
        return out

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """Values are replaced in order, and put back in the reverse one. Where another candidate overlaps a value, the
        permutation is walked on until the same values are found as before, so that undoing meets them again."""
        places = self._places(text)
        now = [text[p:end] for p, _, end, _, _ in places]
        counts: dict[str, int] = {}

        def same(low: int, j: int, value: str) -> bool:
            """Whether the places low to j find what they found, with this value at j."""
            parts, starts, at, size = [], [], max(0, places[low][0] - 1), 0
            stop = places[j][2] + 5 * self.LONGEST
            for i in range(low, len(places)):
                p, kind, end = places[i][:3]
                if p >= stop:
                    break
                parts += [text[at:p], value if i == j else now[i]]
                starts.append(size + len(parts[-2]))
                size, at = starts[-1] + len(parts[-1]), end
            part = "".join(parts) + text[at : max(at, stop)]
            for i in range(low, j + 1):
                at = starts[i - low]
                kind, end = self._at(part, at)[:2]
                if kind != places[i][1] or end - at != len(value if i == j else now[i]):
                    return False
            return True

        for j in range(len(places) - 1, -1, -1) if self.undo else range(len(places)):
            p, kind, _, _, first = places[j]
            if kind is None:
                continue
            counts[kind] = counts.get(kind, 0) + 1
            step, low, k = getattr(self, kind), j, j - 1
            while k >= 0 and places[k][0] > p - self.LONGEST:
                low = k if places[k][3] > p else low
                k -= 1
            start = new = step(now[j])
            if (low < j or not first) and same(low, j, now[j]):
                for _ in range(self.WALK):
                    if same(low, j, new) or (new := step(new)) == start:
                        break
            now[j] = new
        out, at = [], 0
        for (p, _, end, _, _), value in zip(places, now, strict=True):
            out += [text[at:p], value]
            at = end
        return "".join(out) + text[at:], counts

    def _digits(self, s: str, kind: str) -> str:
        return str(self.f.digits(int(s), len(s), kind, undo=self.undo)).zfill(len(s))

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != d[-1]:
            return None
        body = self._digits(d[:-1], "card")
        return _refill(s, body + luhn_digit(body))

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
            return None
        digits = "".join(c for c in flat[4:] if c.isdigit())
        if not digits:
            return None
        body = _refill(flat[4:], self._digits(digits, "iban"))
        check = str(98 - number(body + flat[:2] + "00") % 97).zfill(2)
        return _refill(s, flat[:2] + check + body, str.isalnum)

    def ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        v = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        v, serial = divmod(self.f.below(v, 898 * 99 * 9999, "ssn", self.undo), 9999)
        area, group = divmod(v, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, s: str) -> str | None:
        country = re.match(r"\+[0-9]{1,3}(?![0-9])", s)
        head = country.group() if country else ""
        d = re.sub(r"\D", "", s[len(head) :])
        if not 7 <= len(d) + len(head) - bool(head) <= 15 or len(d) < 6:
            return None
        return head + _refill(s[len(head) :], self._digits(d, "phone"))

    def ipv4(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        v = self.f.below(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4", self.undo)
        return ".".join(map(str, v.to_bytes(4, "big")))

    def date(self, s: str) -> str | None:
        iso = s[4] == "-"
        y, m, d = (s[:4], s[5:7], s[8:]) if iso else (s[6:], s[3:5], s[:2])
        try:
            day = (date(int(y), int(m), int(d)) - _FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = _FIRST_DAY + timedelta(self.f.below(day, _DAYS, "date", self.undo))
        return new.isoformat() if iso else new.strftime(f"%d{s[2]}%m{s[2]}%Y")

    def _letters(self, s: str, kind: str) -> str:
        """Lower-case letters, upper-case letters and digits permuted each among themselves, all other characters kept."""
        for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
            own = [alphabet.index(c) for c in s if c in alphabet]
            if own:
                v = 0
                for x in own:
                    v = v * len(alphabet) + x
                v, out = self.f.digits(v, len(own), f"{kind}{len(alphabet)}{alphabet[0]}", len(alphabet), self.undo), []
                for _ in own:
                    v, x = divmod(v, len(alphabet))
                    out.append(alphabet[x])
                s = _refill(s, "".join(reversed(out)), alphabet.__contains__)
        return s

    def email(self, s: str) -> str:
        return self._letters(s, "email")

    def secret(self, s: str) -> str:
        v = self.f.digits(int(s, 16), len(s), "secret", 16, self.undo)
        out = f"{v:x}".zfill(len(s))
        return out.upper() if s != s.lower() else out


def session_key(spark: SparkSession) -> str:
    """The setting, or a secret key that is drawn and kept in it for the rest of the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, undo: bool = False, counts: bool = False) -> DataFrame:
    """docs with personal data in `text` replaced; all other columns as they are (n_chars follows the text, if there is
    such a column). counts=True adds pii_<kind> columns; where docs has one of that name, '_' follows the new one's. A null text stays null and an empty
    one empty; every row is treated alone, so repeated rows get equal texts. Texts without a digit or an @ are passed
    through; a very long text is scanned once. No documents, no rows."""
    spark = docs.sparkSession
    prepare(spark)
    key = key or session_key(spark)
    extra = [f"pii_{k}" for k in KINDS] if counts else []
    taken = {c.lower() for c in docs.columns}
    extra = [next(n for n in accumulate(repeat("_"), initial=c) if n not in taken) for c in extra]
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(c, T.LongType()) for c in extra])
    at = docs.columns.index(text)
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Pseudonyms(key, undo)
        for b in batches:
            cols, col = list(b.columns), b.column(at)
            hot = pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False)
            rows = pc.filter(pa.array(range(b.num_rows), pa.int64()), hot).to_pylist()
            found = [swap.replace(t) for t in col.filter(hot).to_pylist()]
            if any(c for _, c in found):
                cols[at] = pc.replace_with_mask(col, hot, pa.array([t for t, _ in found], col.type))
                if length >= 0:
                    new = pc.cast(pc.utf8_length(cols[at]), cols[length].type)
                    changed = pc.fill_null(pc.not_equal(cols[at], col), False)
                    cols[length] = pc.if_else(changed, new, cols[length])
            for k in KINDS if counts else ():
                n = [0] * b.num_rows
                for i, (_, c) in zip(rows, found, strict=True):
                    n[i] = c.get(k, 0)
                cols.append(pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values of each kind it had, for all documents. Nulls, empty and very
    long texts, repeated rows, clashing columns and empty tables: see pseudonymise(); only doc_id and text are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, counts=True).withColumn("pii_total", sum((F.col(f"pii_{k}") for k in KINDS[1:]), F.col(f"pii_{KINDS[0]}")))


QUERIES = {"op5_feistel_pseudonyms": op5_feistel_pseudonyms}
SQL: dict[str, str] = {}
