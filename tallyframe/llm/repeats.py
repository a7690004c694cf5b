"""Passages of `length` bytes that start more than once anywhere in a corpus, found by run-length indexes.

One index of a whole corpus has no bounded size, so equal windows are first brought together, exactly:

1. Texts that are equal become one row, kept in buckets by their SHA-256: later joins move no text.
2. The windows of a text are cut into pieces: runs of windows that share their anchor, the k-byte string of the smallest
   hash in the window (the leftmost of equal ones). The anchor depends on the window's bytes alone, so equal windows
   lie in pieces of one group, named by the anchor's hash, wherever they are. Each window is in one piece.
3. A group of one piece holds no repeat. Equal pieces of a group are one member; all their windows are repeated.
4. Unlike members of a group are trimmed to what another one shares, from the anchor to both sides. The rest goes
   through a run-length index in memory of bounded size: suffixes are sorted, the
   Burrows-Wheeler transform is run-compressed, and the suffixes at run heads and run tails are sampled with their
   match to the row above or below. Inside a run the match of a text position is that of the position before, less
   one, so that the samples in text order stream the matching statistics of all positions; where these reach `length`,
   windows are marked.
5. A group with more than GROUP_MAX members is dealt out first: its windows are cut by their distance to the anchor into
   FAN ranges, and the bytes that all windows of a range share name the new, smaller groups. A range of one distance
   shares the whole window, so this ends, and no group is ever held whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, mix, prepare, table, text_column, work_path, written

LENGTH = 400
#: Members of a group that goes to an index at once, the ranges that a larger one is dealt out to, and bytes of an index.
GROUP_MAX, FAN, INDEX_BYTES = 256, 4, 1 << 20
#: Windows hashed at a time.
CHUNK = 1 << 19
_BITS = np.uint64(20)


def anchor_bytes(length: int) -> int:
    """Bytes of an anchor: a power of two from 8 to 64, about a sixth of the window or less."""
    return min(64, max(8, 1 << ((length // 4).bit_length() - 1)))


def anchor_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place of raw on."""
    n = len(raw) - 7
    h = np.empty(n, np.uint64)
    for j in range(min(8, n)):
        part = h[j::8]
        part[:] = raw[j : j + 8 * len(part)].view("<u8")
    h, size = mix(h), 8
    while size < k:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:] * np.uint64(0xD6E8FEB86659FD93 + 2 * size)
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values: prefix minima of one block meet suffix minima of the one before."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def cut_pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of consecutive texts: (text, place in raw, windows, distance to the anchor, group). Where a block of CHUNK windows
    ends, a piece may be cut in two, which splits members but no groups."""
    k, out = anchor_bytes(length), []
    for lo in range(0, max(0, len(raw) - length + 1), CHUNK):
        hi = min(lo + CHUNK, len(raw) - length + 1)
        h = anchor_hashes(raw[lo : hi + length - 1], k)
        packed = (h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(packed, length - k + 1) & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
        first, last = offsets[:-1] - lo, offsets[1:] - length - lo
        some = (last >= first) & (last >= 0) & (first < hi - lo)
        edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, np.maximum(first[some], 0), last[some] + 1, [hi - lo]])
        edges = np.unique(edges[edges <= hi - lo])
        start, n = edges[:-1], np.diff(edges)
        text = np.searchsorted(offsets, start + lo, "right") - 1
        good = start + lo <= offsets[text + 1] - length
        start, n, text = start[good], n[good], text[good]
        out.append((text, start + lo, n, at[start] - start, h[at[start]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of some byte strings, with the suffixes at run ends sampled."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(np.r_[0, lengths[:-1] + 1]) if len(strings) else np.zeros(0, np.int64)
        text = np.zeros(int(lengths.sum()) + len(strings), np.int64)
        at = np.ones(len(text), bool)
        at[self.starts + lengths] = False  # a string's end is a symbol of its own, less than all bytes
        text[at] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        self.size, self._text = len(text), text
        self.levels: list[tuple[int, np.ndarray]] = []
        suffixes = self._sorted(text, at)
        before = text[suffixes - 1]  # of the first suffix the last string's end
        new = np.ones(self.size + 1, bool)
        new[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads, tails = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        #: The transform by runs: its symbols (0 for an end, else byte + 1) and the rows at which runs begin.
        self.symbols, self.run_starts = before[heads], heads
        self.heads = self._samples(suffixes[heads], suffixes[np.maximum(heads - 1, 0)], heads > 0)
        self.tails = self._samples(suffixes[tails], suffixes[np.minimum(tails + 1, self.size - 1)], tails < self.size - 1)
        del self.levels, self._text

    def _sorted(self, text: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The suffixes in order, by prefix tripling (doubling, where three ranks fill no key) over those that still share a rank. A
        rank at level d compares d symbols."""
        n, width = len(text), 7
        ends = np.flatnonzero(~inside)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the end
        key = np.zeros(n, np.int64)
        for j in range(width):
            part = np.zeros(n, np.int64)
            part[: max(0, n - j)] = text[j:]
            key |= np.where(j < left, part, 0) << (9 * (width - 1 - j))
        order = np.argsort(key, kind="stable")
        # Suffixes that end within the key differ by their ends, which are ordered by place.
        same = (key[order[1:]] == key[order[:-1]]) & (left[order[1:]] >= width)
        rank = np.empty(n, np.int32)
        begin = np.r_[0, np.where(same, 0, np.arange(1, n))] if n else np.zeros(0, np.int64)
        rank[order] = np.maximum.accumulate(begin)
        self.levels.append((width, rank))
        bits = n.bit_length()
        self.fan = fan = min(3, 63 // max(1, bits))
        rows = np.arange(n)
        while True:
            # Only suffixes that were tied before can be tied now.
            held = rank[order[rows]]
            tied = held[1:] == held[:-1]
            rows = rows[np.r_[False, tied] | np.r_[tied, False]] if n else rows
            if not len(rows):
                return order
            open_ = order[rows]
            key = rank[open_].astype(np.int64)
            for i in range(1, fan):  # a tied suffix has more than width symbols left, and one that has fewer shares its rank with none
                key = (key << bits) | rank[np.minimum(open_ + i * width, n - 1)]
            sub = np.argsort(key, kind="stable")
            order[rows] = open_[sub]
            key = key[sub]
            begin = np.r_[rows[0], np.where(key[1:] == key[:-1], 0, rows[1:])]
            rank = rank.copy()
            rank[order[rows]] = np.maximum.accumulate(begin)
            width *= fan
            self.levels.append((width, rank))

    def _samples(self, at: np.ndarray, other: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text positions, matches with the other suffixes) in text order."""
        match = self._common(at, other)
        match[~real] = 0
        order = np.argsort(at)
        return at[order], match[order]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b, from the longest level down, then symbol by symbol."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            for _ in range(self.fan - 1):
                step = np.where((rank[a] == rank[b]) & (a != b), width, 0)
                a, b, total = a + step, b + step, total + step
        for _ in range(self.levels[0][0] - 1):
            step = ((self._text[a] == self._text[b]) & (self._text[a] > 0)).astype(np.int64)
            a, b, total = a + step, b + step, total + step
        return total

    def statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The matching statistics of every text position against all others, as runs (begin, end, length at begin): from begin
        to before end the longest match with the row above, then below, falls by one a position."""
        for at, match in (self.heads, self.tails):
            yield at, np.r_[at[1:], self.size], match

    def repeated(self, length: int) -> np.ndarray:
        """For each text position, whether its next `length` bytes also start elsewhere."""
        edge = np.zeros(self.size + 1, np.int64)
        for begin, end, match in self.statistics():
            end = np.minimum(end, begin + match - length + 1)
            some = end > begin
            np.add.at(edge, begin[some], 1)
            np.add.at(edge, end[some], -1)
        return np.cumsum(edge[:-1]) > 0


KEY = ("k1", "k2")
_PIECE = "g long, f1 long, f2 long, k1 long, k2 long, at long, n long, off long, weight long, done boolean"
_RANGE = "k1 long, k2 long, at long, n long"


def with_key(df: DataFrame) -> DataFrame:
    """df with 128 bits of the SHA-256 of text in two long columns."""
    df = df.withColumn("_sha", F.sha2(F.col("text").cast("binary"), 256))
    # conv() to base -10 reads 64 bits as a signed number.
    return df.withColumns({k: F.expr(f"cast(conv(substr(_sha, {16 * i + 1}, 16), 16, -10) as bigint)") for i, k in enumerate(KEY)}).drop("_sha")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(k1, k2, data, copies): the distinct texts as bytes, and how many rows have each; in buckets by their key, so that
    joins on it leave data where it is. A null text is an empty one."""
    spark, name = docs.sparkSession, f"tallyframe_texts_{uuid.uuid4().hex}"
    hashed = with_key(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = hashed.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies")).select(*KEY, F.col("text").cast("binary").alias("data"), "copies")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, *KEY).write.bucketBy(n, *KEY).option("compression", "zstd").option("path", work_path(spark, "repeat-texts")).format("parquet").saveAsTable(name)
    return spark.table(name)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _longs(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def pieces(texts: DataFrame, length: int) -> DataFrame:
    """The pieces of all texts: group, fingerprint of the piece's bytes, text, first window, windows, distance to the anchor, weight
    and whether its windows are known to be repeated. Of equal pieces in one text, the first has weight 2, and the others'
    windows come as ranges (rows without a group), so that a long run of one byte is a few rows."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            raw, offsets = text_column(b, "data")
            text, start, n, off, g = cut_pieces(raw, offsets, length)
            if not len(text):
                continue
            view, end = memoryview(raw), start + n + (length - 1)
            digests = b"".join(xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True))
            f = np.frombuffer(digests, "<i8").reshape(-1, 2)
            order = np.lexsort((start, f[:, 1], f[:, 0], text))
            same = (text[order[1:]] == text[order[:-1]]) & (f[order[1:]] == f[order[:-1]]).all(axis=1)
            later, repeated = np.zeros(len(text), bool), np.zeros(len(text), bool)
            later[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            k1, k2, copies, at = _longs(b, "k1"), _longs(b, "k2"), _longs(b, "copies"), start - offsets[text]
            done, i = copies[text] > 1, np.flatnonzero(~later)
            weight = 1 + (repeated | done)
            rows = {"g": g.view(np.int64), "f1": f[:, 0], "f2": f[:, 1], "k1": k1[text], "k2": k2[text], "at": at, "n": n, "off": off, "weight": weight, "done": done}
            yield _batch({k: v[i] for k, v in rows.items()})
            j = np.flatnonzero(later & ~done)
            if len(j):  # neighbours are one range
                head = np.r_[True, (text[j[1:]] != text[j[:-1]]) | (at[j[1:]] != at[j[:-1]] + n[j[:-1]])]
                first = np.flatnonzero(head)
                rows |= {"n": np.add.reduceat(n[j], first)}
                none = pa.nulls(len(first), pa.int64())
                yield _batch({k: none if k == "g" else v if k == "n" else v[j][first] for k, v in rows.items()})

    return texts.select(*KEY, "data", "copies").mapInArrow(run, _PIECE)


def reach(groups: list[int], sides: list[bytes], width: int) -> np.ndarray:
    """How many leading bytes of each side, which has `width` at most, another one of its group could share: no fewer than it does."""
    order = sorted(range(len(sides)), key=lambda i: (groups[i], sides[i]))
    rows = np.frombuffer(b"".join(sides[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(sides), width)
    differ = np.ones((len(sides) + 1, width + 1), bool)  # the last column ends sides that are equal
    np.not_equal(rows[1:], rows[:-1], out=differ[1:-1, :-1])
    match = differ.argmax(axis=1)
    of = np.array(groups)[order]
    match[1:-1][of[1:] != of[:-1]] = 0
    out = np.empty(len(sides), np.int64)
    out[order] = np.maximum(match[1:], match[:-1])
    return np.minimum(out, [len(s) for s in sides])


def trimmed(rows: list[tuple], length: int) -> list[tuple]:
    """The members (g, k1, k2, at, w, off, content) less what no other member of their group can repeat, without those of which no
    window is left. Equal windows have one anchor at one distance, so what members share reaches from the anchor to both sides."""
    groups = [x[0] for x in rows]
    left = reach(groups, [x[6][: x[5]][::-1] for x in rows], length)
    right = reach(groups, [x[6][x[5] : x[5] + length] for x in rows], length)
    some = np.flatnonzero(left + right >= length).tolist()
    cuts = [(rows[i], int(left[i]), int(right[i])) for i in some]
    return [(g, k1, k2, at + off - a, w, content[off - a : off + z]) for (g, k1, k2, at, w, off, content), a, z in cuts]


def indexed_ranges(members: DataFrame, length: int) -> DataFrame:
    """(k1, k2, at, n): the repeated windows of the members of weight 1 (g, k1, k2, at, w, off, content). Groups are sorted together,
    trimmed and go through one run-length index after the other, each of whole groups and of about INDEX_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size, last = [], [], 0, None

        def marked() -> Iterator[pa.RecordBatch]:
            index = RunLengthIndex([x[-1] for x in held])
            hit = index.repeated(length)
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            begin, end = edge[::2], edge[1::2]  # never across strings: no window starts in a string's last bytes
            of = np.searchsorted(index.starts, begin, "right") - 1
            ones = np.array([x[4] < 2 for x in held])[of]
            begin, end, of = begin[ones], end[ones], of[ones]
            k1, k2, at = (np.array([x[c] for x in held], np.int64)[of] for c in (1, 2, 3))
            yield _batch({"k1": k1, "k2": k2, "at": at + begin - index.starts[of], "n": end - begin})

        def added() -> Iterator[pa.RecordBatch]:
            more = trimmed(rows, length)
            if held and sum(len(x[-1]) for x in held + more) > INDEX_BYTES:
                yield from marked()
                held.clear()
            held.extend(more)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= INDEX_BYTES and row[0] != last:
                    yield from added()
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[-1]), row[0]
        if rows:
            yield from added()
        if held:
            yield from marked()

    return members.select("g", "k1", "k2", "at", "w", "off", "content").repartition("g").sortWithinPartitions("g").mapInArrow(run, _RANGE)


def dealt_out(members: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces of smaller groups from members of large ones, whose windows have distances to the anchor from lo to before lo + width."""
    step = -(-width // FAN)
    ranges = members.withColumn("lo", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.col("lo") + i * step)))
    parts = ranges.withColumns({"i": F.expr(f"greatest(0L, off - lo - {step - 1})"), "j": F.expr("least(n - 1, off - lo)")}).where("i <= j")
    core = F.expr(f"substring(content, int(off - lo + 1), {length - step + 1})")
    inner = F.expr(f"substring(content, int(i + 1), int(j - i + {length}))")
    half = lambda k: F.expr(f"cast(conv(substr(_f, {1 + 16 * k}, 16), 16, -10) as bigint)")
    parts = parts.withColumn("_f", F.md5(inner)).select(
        F.xxhash64("g", "lo", core).alias("g"), half(0).alias("f1"), half(1).alias("f2"), "k1", "k2", (F.col("at") + F.col("i")).alias("at"),
        (F.col("j") - F.col("i") + 1).alias("n"), (F.col("off") - F.col("i")).alias("off"), F.least("w", F.lit(2)).alias("weight"), (F.col("w") > 1).alias("done"), "lo",
    )
    return parts


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, at, n): ranges of windows of `length` bytes that also start elsewhere, in the texts that have one copy."""
    every = written(pieces(texts, length), "repeat-pieces")
    level = every.where("g is not null").withColumn("lo", F.lit(0).cast("long"))
    shared = level.groupBy("g").agg(F.sum("weight").alias("w")).where("w > 1").select("g")
    rows = written(level.join(shared, "g", "left_semi"), "repeat-shared")
    found = [written(every.where("g is null").select("k1", "k2", "at", "n"), "repeat-ranges")]
    discard(every)
    width = length - anchor_bytes(length) + 1
    while True:
        # Of equal pieces, one place stands for all; w says whether there are more.
        one = F.min(F.struct("k1", "k2", "at", "n", "off", "lo")).alias("m")
        members = written(rows.groupBy("g", "f1", "f2").agg(F.sum("weight").alias("w"), one).select("g", "f1", "f2", "w", "m.*"), "repeat-members")
        found.append(written(rows.where("not done").join(members.where("w > 1").select("g", "f1", "f2"), ["g", "f1", "f2"], "left_semi").select("k1", "k2", "at", "n"), "repeat-ranges"))
        discard(rows)
        mixed = members.join(members.groupBy("g").agg(F.count("*").alias("d")).where("d > 1"), "g")
        content = F.substring(F.col("data"), (F.col("at") + 1).cast("int"), (F.col("n") + (length - 1)).cast("int"))
        unlike = written(mixed.join(texts.select(*KEY, "data"), list(KEY)).select("g", "w", "k1", "k2", "at", "n", "off", "lo", "d", content.alias("content")), "repeat-unlike")
        discard(members)
        found.append(written(indexed_ranges(unlike.where(F.col("d") <= GROUP_MAX), length), "repeat-ranges"))
        large = unlike.where(F.col("d") > GROUP_MAX)
        if large.isEmpty():
            break
        rows = written(dealt_out(large, length, width), "repeat-shared")
        width = -(-width // FAN)
        discard(unlike)
    discard(unlike)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cut_repeats(texts: DataFrame, windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of each distinct text: its bytes outside of repeated windows, and
    the removed runs as [start, end). All of a text with copies goes, if it has a window at all."""
    prepare(texts.sparkSession)
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for k1, k2, data, copies, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = [[0, len(data)]] if copies > 1 and len(data) >= length else []
                for at, n in sorted((x["at"], x["n"]) for x in found or ()) if not spans else ():
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], at + n + length - 1)
                    else:
                        spans.append([at, at + n + length - 1])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((k1, k2, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": z} for a, z in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    # A text has fewer ranges than bytes.
    by_text = windows.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("found"))
    rows = texts.join(by_text, list(KEY), "left").select(*KEY, "data", "copies", "found")
    return rows.mapInArrow(run, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: bigint, end: bigint>>")


def without_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """docs with the columns n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary) and spans: each text less all bytes
    that are covered by a string of `length` bytes which also starts anywhere else, in the same document included. Strings
    are judged on the input. A null text is empty; it and texts under `length` bytes stay whole; of repeated rows nothing
    stays, if they are long enough, whatever their ids; a very long text is one row, its pieces are dealt out. No
    documents, no rows. Columns of docs with these names are replaced. length: 16 or more."""
    if length < 16:
        raise ValueError("length must be 16 or more")
    texts = distinct_texts(docs)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if with_text else [])]
    cut = cut_repeats(texts, repeated_windows(texts, length), length).select(*KEY, F.struct(*new).alias("_cut"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_key(own).drop("text").join(cut, list(KEY)).select("_row.*", "_cut.*")


def op11_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document. Nulls, repeated rows, empty and very long texts, clashing
    columns and empty tables: see without_repeats()."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("text")


QUERIES = {"op11_run_length_index": op11_run_length_index}
SQL: dict[str, str] = {}
