"""N-gram Jaccard join through a count-vector R-tree.

A document's set holds its distinct word shingles; sets link at a Jaccard similarity of p / q or more (`Link`). Shingle
hashes fall into groups; a document's group counts are a point, and two sets overlap in at most the sum of the coordinate
minima of their points. The index has two levels:

* Tiles, the distributed upper level. For two linked sets of n1 and n2 shingles, at most r = (q - p) (n1 + n2) / (q + p)
  shingles are in only one of them. Cut the hash range into r + 1 + s blocks: at least s + 1 blocks are equal in both. So every
  document goes to the tile of each of its non-empty blocks, and linked documents with at most s empty blocks meet in
  some tile. A document with more uses twice as many blocks as well, and there its empty ones too if they are many.
* A bulk-loaded R-tree over the group-count points of a tile's members. A point has at least eight times as many groups as its
  set has shingles, so that the bound stays sharp on long sets; upper nodes are kept over fewer groups, which adding
  neighbours gives. A probe descends into nodes whose summed minima with the node's upper corner reach the overlap that a
  link needs.

First each member is tried against one pivot of its tiles, on whole sets; this joins groups of copies through a few stars.
Where a tile still holds two or more components, the pairs of different components that the bound leaves are its
candidates; it emits a spanning forest of them, the most similar ones, so that rows out are fewer than members and tiles
agree on them. These pairs are verified on whole sets. Only in tiles that emitted a pair which failed can
links be left: there the members with a candidate are contested, tiles with the same contested members are one, and their
whole sets meet in one task, which verifies, unites and emits what united something. No link is lost, and links inside a
component need not be listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import discard, mix, prepare, signed, table, text_column, word_hashes, written

#: Words of a shingle, and the Jaccard similarity of a link, of op10; other callers give their own.
SHINGLE, SIMILARITY = 4, 0.85
#: Coordinates of a point: the least number of groups, that of an R-tree's upper nodes, and the largest.
GROUPS, MOST_GROUPS = 128, 1 << 16
#: Entries of an R-tree node.
FANOUT = 16
#: Members of a tile that one task holds at a time; a larger tile is cut into parts, and pairs of parts are joined.
TILE = 1024
#: Bytes of whole sets that contested members verified together have, about; more are cut into parts, too.
VERIFY_BYTES = 32 << 20
#: Tiles are counted on one fingerprint in HEAT; one with HOT or more there is dealt out by fingerprint from the start.
HEAT, HOT = 64, 32
#: Empty blocks that a set may have before it needs the doubled blocks: this many, and a 32nd of the blocks.
SLACK = 3
#: Members of a star that one task verifies against its pivot.
STAR = 128
#: Rows of the broadcast filter that keeps texts of uninvolved documents out of the shuffle; a fixed bound. When all
#: slots are taken, the filter lets everything pass, and the join behind it decides alone.
SLOTS = 1 << 20
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_EMPTY = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Link:
    """What links two documents: sets of shingles of so many words, at a Jaccard similarity of at least p / q."""

    shingle: int = SHINGLE
    similarity: float = SIMILARITY

    def __post_init__(self):
        if self.shingle < 1 or not 0 < self.similarity <= 1:
            raise ValueError("a shingle has a word or more, and a similarity lies above 0 and is 1 at most")

    @cached_property
    def ratio(self) -> tuple[int, int]:
        return Fraction(str(self.similarity)).limit_denominator(10000).as_integer_ratio()

    @cached_property
    def factors(self) -> np.ndarray:
        """Odd factors of the words of a shingle."""
        more = np.arange(len(_MULT), max(len(_MULT), self.shingle), dtype=np.uint64)
        return np.r_[np.array(_MULT, np.uint64), mix((more + np.uint64(1)) * _MULT[0]) | np.uint64(1)]

    @cached_property
    def bands(self) -> np.ndarray:
        """Limits of size bands; linked sets lie in one band or in neighbouring ones."""
        (p, q), edges = self.ratio, [1]
        while edges[-1] < 2**40:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2, edges[-1] * q // p + 1))
        return np.array(edges, np.int64)

    def differing(self, total: int) -> int:
        """Shingles that are in only one of two linked sets, at most; total: the sum of their sizes."""
        p, q = self.ratio
        return (q - p) * total // (q + p)

    def holds(self, both, total):
        """Whether (at most) so many shared shingles link sets of these sizes, summed; numbers, arrays or columns."""
        p, q = self.ratio
        return both * (p + q) >= total * p


#: The link of op10.
LINK = Link()


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, link: Link = LINK) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than a shingle's make one shingle; no word, none."""
    h, cuts = word_hashes(raw, offsets)
    n, size, factors = len(h), link.shingle, link.factors
    grams = np.zeros(n, np.uint64)
    if n >= size:
        last = n - size + 1
        acc = np.zeros(last, np.uint64)
        for k in range(size):
            acc += h[k : k + last] * factors[k]
        grams[:last] = mix(acc)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo >= size:
            yield np.unique(grams[lo : hi - size + 1])
        elif hi > lo:
            short = (h[lo:hi] * factors[: hi - lo]).sum(keepdims=True) + np.array([hi - lo], np.uint64)
            yield mix(short ^ _EMPTY)
        else:
            yield grams[:0]


def content(s: np.ndarray) -> np.ndarray:
    """Hashes of a set's hashes, which tiles and fingerprints add up."""
    return mix(s ^ _MULT[2])


def fingerprint(s: np.ndarray, added: np.ndarray | None = None) -> tuple[int, int]:
    """Of a set: 128 bits. Sets of equal content are one node of the link graph. added: content(s), if it is known."""
    added = content(s) if added is None else added
    sums = np.array([mix(s ^ _EMPTY).sum(dtype=np.uint64), added.sum(dtype=np.uint64)], np.uint64)
    one, two = signed(mix(mix(sums) + s.sum(dtype=np.uint64) * np.array(_MULT[:2], np.uint64) + np.uint64(len(s))))
    return int(one), int(two)


def counts(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes in equal ranges: the least power of two of at least eight for each shingle, in the limits."""
    groups = min(MOST_GROUPS, max(GROUPS, 1 << (8 * len(s) - 1).bit_length()))
    out = np.bincount((s >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
    return out.astype(np.uint8 if out.max(initial=0) < 256 else np.uint32)


def point(s: np.ndarray) -> bytes:
    """counts(s), stored under a Huffman code: the number of counts above 1, their places and the rest of them as 32-bit
    integers, and a bit for each group, set if its count is not 0."""
    c = counts(s)
    more = np.flatnonzero(c > 1)
    z = zlib.compressobj(1, zlib.DEFLATED, -9, 8, zlib.Z_HUFFMAN_ONLY)
    head = np.r_[len(more), more, c[more].astype(np.int64) - 1].astype("<u4")
    return z.compress(head.tobytes() + np.packbits(c > 0).tobytes()) + z.flush()


def _unpacked(data: bytes) -> np.ndarray:
    data = zlib.decompress(data, -9)
    k = int.from_bytes(data[:4], "little")
    more = np.frombuffer(data, "<u4", 2 * k, 4).reshape(2, k)
    c = np.unpackbits(np.frombuffer(data, np.uint8, -1, 4 + 8 * k))
    if k and more[1].max() > 254:
        c = c.astype(np.uint32)
    c[more[0]] += more[1].astype(c.dtype)
    return c


#: Points that a worker has read, and their bytes; beyond CACHE_BYTES it starts again.
_points: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
_held = [0]
CACHE_BYTES = 48 << 20


def _read_point(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A stored point, over all its groups and over GROUPS."""
    found = _points.get(data)
    if found is None:
        c = _unpacked(data)
        found = c, fold_groups(c)
        _held[0] += len(data) + c.nbytes + found[1].nbytes + 400
        if _held[0] > CACHE_BYTES:
            _points.clear()
            _held[0] = 0
        _points[data] = found
    return found


def fold_groups(c: np.ndarray) -> np.ndarray:
    """Counts over GROUPS groups."""
    if len(c) == GROUPS:
        return c
    c = c.reshape(GROUPS, -1).sum(1, dtype=np.uint32)
    return c.astype(np.uint8) if c.max() < 256 else c


def matrix(points: list[np.ndarray]) -> np.ndarray:
    """Counts as rows over as many groups as the shortest has; neighbours of longer ones are added."""
    groups = min(map(len, points))
    rows = [c if len(c) == groups else c.reshape(groups, -1).sum(1, dtype=np.uint32) for c in points]
    out = np.stack(rows)
    return out.astype(np.uint8) if out.dtype != np.uint8 and out.max() < 256 else out


def _families(n: int, link: Link) -> list[tuple[int, int]]:
    """(family, blocks - 1) that a set of n shingles belongs to: its band's, and those of pairs across a band's edges."""
    p, q = link.ratio
    k = int(np.searchsorted(link.bands, n, "right")) - 1
    low, high = int(link.bands[k]), int(link.bands[k + 1])
    out = [(2 * k, link.differing(2 * (high - 1)))]
    for edge, number in ((high, 2 * k + 1), (low, 2 * k - 1)):
        small, large = edge - 1, (edge - 1) * q // p
        if (edge == high and n * q >= p * edge) or (edge == low and n <= large):
            out.append((number, link.differing(small + large)))
    return [(f, r) for f, r in out if r > 0]


def tile_keys(s: np.ndarray, link: Link = LINK, added: np.ndarray | None = None) -> np.ndarray:
    """The tiles of one set. added: content(s), if it is known."""
    out, added = [], content(s) if added is None else added
    for family, r in _families(len(s), link):
        blocks = r + 1 + SLACK + (r + 1) // 32
        for doubled in (0, 1):
            blocks <<= doubled
            of = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            salt = np.uint64((family * 2 + doubled) << 40)
            out.append(mix(np.add.reduceat(added, at) ^ mix((of[at] | salt) * _MULT[3])))
            if blocks - len(at) < blocks - r:
                break
            if doubled:
                none = np.setdiff1d(np.arange(blocks, dtype=np.uint64), of[at])
                out.append(mix(mix((none | salt) * _MULT[3]) ^ _EMPTY))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


_INDEX = pa.schema([("fp", pa.int64()), ("fp2", pa.int64()), ("tile", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("point", pa.binary())])
_INDEX_DDL = "fp long, fp2 long, tile long, doc_id long, n long, point binary"
#: Fingerprints whose tiles a task has emitted; beyond this many it forgets, and copies are removed later.
SEEN = 1 << 20


def _fresh(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[tuple]:
    """(batch, number in it, set, content, fingerprint, new) of every text; new: this task has not seen an equal set lately."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        for i, s in enumerate(shingle_sets(*text_column(b), link)):
            added = content(s)
            fp = fingerprint(s, added)
            new = len(s) > 0 and fp not in seen
            if new:
                seen.add(fp)
                if len(seen) > SEEN:
                    seen.clear()
            yield b, i, s, added, fp, new


def _index(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """A row for each text: its fingerprint, size, and point (null for a set seen before). For one fingerprint in HEAT
    also a row for each of its tiles."""
    out: list[list] = []
    batch = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _INDEX, strict=True)], schema=_INDEX)

    for b, i, s, added, fp, new in _fresh(batches, link):
        if b is not batch or len(out) > 1 << 16:
            if out:
                yield flush()
            batch, ids, out = b, b.column(0).cast(pa.int64()).to_pylist(), []
        out.append([*fp, None, ids[i], len(s), point(s) if new else None])
        if new and fp[0] % HEAT == 0:
            out += [[fp[0], None, t, None, None, None] for t in signed(tile_keys(s, link, added)).tolist()]
    if out:
        yield flush()


_KEYS = pa.schema([("tile", pa.int64()), ("fp", pa.int64())])


def _tile_rows(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """(tile, fp) of every set, straight into the shuffle: this is the largest intermediate, and is never written."""
    tiles, owners, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        t, o = np.concatenate(tiles), np.concatenate(owners)
        for at in range(0, len(t), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(t[at : at + (1 << 18)]), pa.array(o[at : at + (1 << 18)])], schema=_KEYS)

    for _, _, s, added, fp, new in _fresh(batches, link):
        if new:
            tiles.append(signed(tile_keys(s, link, added)))
            owners.append(np.full(len(tiles[-1]), fp[0], np.int64))
            held += len(tiles[-1])
            if held > 1 << 17:
                yield from flush()
                tiles, owners, held = [], [], 0
    if held:
        yield from flush()


_TILES = pa.schema([("tile", pa.int64()), ("chunk", pa.int64()), ("fp", pa.int64())])
_TILES_DDL = "tile long, chunk long, fp long"


def _shared_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tile, fp): tiles of two sets or more, without repeated rows. Tiles with the same members get the
    same name, so that they can be told apart later; a tile larger than TILE keeps its own name and is cut into chunks.
    Memory: one batch and one chunk."""

    def small(t: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
        at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[at, len(t)])
        name = np.repeat(mix(np.add.reduceat(mix(f.view(np.uint64) ^ _EMPTY), at) ^ _MULT[0]).view(np.int64), size)
        keep = np.repeat(size > 1, size)
        if keep.any():
            return pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(np.zeros(keep.sum(), np.int64)), pa.array(f[keep])], schema=_TILES)
        return None

    held_t = held_f = np.zeros(0, np.int64)
    big, index = None, 0
    for b in batches:
        t = np.concatenate([held_t, b.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False)])
        if big is not None:
            m = int(np.searchsorted(t != big, True))
            own, t, f = f[:m], t[m:], f[m:]
            own = own[np.r_[own[:1] != last, own[1:] != own[:-1]]] if m else own
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), big)), pa.array((index + np.arange(len(own))) // TILE), pa.array(own)], schema=_TILES)
                index, last = index + len(own), own[-1]
            if not len(t):
                held_t, held_f = t, f
                continue
            big = None
        if len(t) > 1:
            keep = np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1])]
            t, f = t[keep], f[keep]
        cut = int(np.searchsorted(t == t[-1], True)) if len(t) else 0
        if cut and (out := small(t[:cut], f[:cut])) is not None:
            yield out
        held_t, held_f = t[cut:], f[cut:]
        if len(held_t) > TILE:
            big, index, last = held_t[-1], len(held_t), held_f[-1]
            yield pa.RecordBatch.from_arrays([pa.array(held_t), pa.array(np.arange(index) // TILE), pa.array(held_f)], schema=_TILES)
            held_t = held_f = np.zeros(0, np.int64)
    if len(held_t) and (out := small(held_t, held_f)) is not None:
        yield out


class CountRTree:
    """Bulk-loaded R-tree over group-count points (arrays of counts) with set sizes. coarse: fold_groups() of the points."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, link: Link = LINK, coarse: list[np.ndarray] | None = None):
        self.points, self.sizes, self.link = points, sizes, link
        self.coarse = matrix([fold_groups(c) for c in points] if coarse is None else coarse)

    @cached_property
    def fine(self) -> np.ndarray:
        return matrix(list(self.points))

    @cached_property
    def order(self) -> np.ndarray:
        """Sort-tile: by size, then by where the mass lies, so that a leaf's corner stays close to its points."""
        wide = self.coarse.reshape(len(self.points), 4, -1).sum(2, dtype=np.int64)
        return np.lexsort((wide[:, 1], wide[:, 0], self.sizes * 16 // np.maximum(1, self.sizes.max())))

    @cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, p, n = [], self.coarse[self.order], self.sizes[self.order]
        while len(p) > FANOUT:
            at = np.arange(0, len(p), FANOUT)
            p, n = np.maximum.reduceat(p, at), np.minimum.reduceat(n, at)
            out.append((p, n))
        return out

    def _leaves(self, i, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows the bound leaves for row i, or for as many rows i, and their bounds."""
        both, total = bound(self.coarse[rows], self.coarse[i]), self.sizes[rows] + self.sizes[i]
        keep = np.flatnonzero(self.link.holds(both, total))
        both = both[keep]
        if len(keep) and len(self.points[0]) > GROUPS:
            both = bound(self.fine[rows[keep]], self.fine[i if np.ndim(i) == 0 else i[keep]])
            good = self.link.holds(both, total[keep])
            keep, both = keep[good], both[good]
        return keep, both

    def _probe(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        q, size, at = self.coarse[i], self.sizes[i], None
        for p, n in reversed(self.levels):
            at = np.arange(len(p)) if at is None else (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < len(p)]
            at = at[self.link.holds(bound(p[at], q), n[at] + size)]
        at = np.arange(len(self.order)) if at is None else (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        rows = self.order[at[at < len(self.order)]]
        keep, both = self._leaves(i, rows)
        return rows[keep], both

    def probe(self, i: int) -> np.ndarray:
        """Rows whose summed minima with row i reach the overlap that a link of these sizes needs; i is one of them."""
        return self._probe(i)[0]

    def pairs(self, allowed: Callable, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (i, j) that the bound leaves, of those that allowed(i, j) lets pass, and their bounds; all that have an
        i in rows, once or twice, never (i, i). A single leaf is tried as a whole, a larger tree by a probe for each row."""
        if len(self.points) <= 2 * FANOUT:
            i, j = np.triu_indices(len(self.points), 1)
            keep = allowed(i, j)
            i, j = i[keep], j[keep]
            if len(i):
                keep, both = self._leaves(i, j)
                if len(keep):
                    yield i[keep], j[keep], both
            return
        for i in range(len(self.points)) if rows is None else rows:
            j, both = self._probe(i)
            keep = (j != i) & allowed(i, j)
            if keep.any():
                yield np.full(int(keep.sum()), i), j[keep], both[keep]


def bound(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(points, q).sum(1, dtype=np.uint32).astype(np.int64)


def _tree(points: np.ndarray, sizes: np.ndarray, link: Link) -> CountRTree:
    """The tree of stored points."""
    read = [_read_point(x) for x in points]
    return CountRTree([x for x, _ in read], sizes, link, [x for _, x in read])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Rows of consecutive equal values in the first `keys` columns: columns as numpy arrays, binary ones as arrays of
    bytes and lists of hashes as arrays of arrays."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> Iterator[list[np.ndarray]]:
        cols = []
        for c in (x.combine_chunks() for x in rows.columns):
            if pa.types.is_list(c.type):
                c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
                own, cuts = c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()
                cols.append(np.empty(len(c), object))
                cols[-1][:] = [own[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            else:
                cols.append(c.to_numpy(zero_copy_only=False) if not isinstance(c, pa.ChunkedArray) else c.to_numpy())
        new = np.zeros(len(rows), bool)
        new[0] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        for lo, hi in zip(at, np.r_[at[1:], len(rows)], strict=True):
            yield [c[lo:hi] for c in cols]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        same = np.ones(b.num_rows, bool)
        for i in range(keys):
            k = b.column(i).to_numpy(zero_copy_only=False)
            same &= k == k[-1]
        if same.all() and all(held[0].column(i)[0] == b.column(i)[0] for i in range(keys)):
            continue  # one group so far
        cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        rows = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
        if len(rows):
            yield from flush(rows)
        held = [b.slice(cut)] if cut < b.num_rows else []
    if held:
        yield from flush(pa.Table.from_batches(held))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(a), np.concatenate(b)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=_PAIRS)


def _stars(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """Rows (tile, chunk, node, n, point): each member with the first pivot of its tile chunk that the bound leaves."""
    a, b, held = [], [], 0
    for _, _, node, n, points in _groups(batches, 2):
        if len(node) < 2:
            continue
        tree, left = _tree(points, n, link), np.arange(len(node))
        while len(left) > 1:
            pivot, left = left[0], left[1:]
            if len(left) > 2 * FANOUT:
                near = np.isin(left, tree.probe(pivot), assume_unique=True)
            else:
                near = np.zeros(len(left), bool)
                near[tree._leaves(pivot, left)[0]] = True
            hit = left[near]
            hit = hit[node[hit] != node[pivot]]
            if len(hit):
                b.append(node[hit])
                a.append(np.full(len(hit), node[pivot]))
                held += len(hit)
            left = left[~near]
        if held > 1 << 16:
            yield _pairs(a, b)
            a, b, held = [], [], 0
    if held:
        yield _pairs(a, b)


def forest(i: np.ndarray, j: np.ndarray, comp: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of the edges (i, j) between members of these components, the places of a spanning forest: the least by key."""
    label, chosen, left = np.unique(comp, return_inverse=True)[1], [], np.arange(len(i))
    root = list(range(int(label.max()) + 1))

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    while len(left):
        ends = label[i[left]], label[j[left]]
        left = left[ends[0] != ends[1]]
        if not len(left):
            break
        ends = np.r_[label[i[left]], label[j[left]]]
        order = np.lexsort((np.tile(key[left], 2), ends))
        first = order[np.r_[True, ends[order][1:] != ends[order][:-1]]]
        for e in np.unique(left[first % len(left)]).tolist():
            x, y = find(int(label[i[e]])), find(int(label[j[e]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                chosen.append(e)
        label = np.array([find(c) for c in range(len(root))])[label]
    return np.array(sorted(chosen), np.int64)


def _candidates(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """Rows (tile, i, j, chunk, node, component, n, point): a spanning forest of the pairs of different components that
    the bound leaves, between the parts i and j of a tile."""
    a, b, held = [], [], 0
    for node, comp, n, i, j, both in _open_pairs(batches, link):
        x, y = node[i].view(np.uint64), node[j].view(np.uint64)
        unlike = ((1 - both / (n[i] + n[j] - both)) * (1 << 20)).astype(np.uint64) << np.uint64(40)
        keep = forest(i, j, comp, unlike | mix(mix(np.minimum(x, y)) + np.maximum(x, y)) >> np.uint64(24))
        a.append(node[i[keep]])
        b.append(node[j[keep]])
        held += len(keep)
        if held > 1 << 16:
            yield _pairs(a, b)
            a, b, held = [], [], 0
    if held:
        yield _pairs(a, b)


def _open_pairs(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[tuple]:
    """(node, component, n, i, j, bound) of each (tile, i, j): the pairs of different components that the bound leaves."""
    for _, ci, cj, chunk, node, comp, n, points in _groups(batches, 3):
        if (comp == comp[0]).all():
            continue
        apart = ci[0] != cj[0]  # between two parts, pairs inside one are not asked for
        of, most = np.unique(comp, return_counts=True)
        rows = np.flatnonzero(comp != of[most.argmax()])  # every pair of two components has one of these
        found = list(_tree(points, n, link).pairs(lambda x, y: (comp[x] != comp[y]) & (not apart or chunk[x] != chunk[y]), rows))
        if found:
            yield node, comp, n, *(np.concatenate(c) for c in zip(*found, strict=True))


_CONTESTED = pa.schema([("name", pa.int64()), ("node", pa.int64()), ("component", pa.int64())])


def _contested(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """Rows as for _candidates(): the members of the parts i and j of a tile that are in such a pair, under a name that
    equal groups of members share."""
    seen, out, held = set(), [], 0
    for node, comp, n, i, j, _ in _open_pairs(batches, link):
        part = np.cumsum(8 * n) // VERIFY_BYTES
        found: dict[tuple[int, int], np.ndarray] = {}
        for p, q in np.unique(np.sort(np.stack([part[i], part[j]]), 0), axis=1).T.tolist():
            flags = found.setdefault((p, q), np.zeros(len(node), bool))
            own = (np.minimum(part[i], part[j]) == p) & (np.maximum(part[i], part[j]) == q)
            flags[i[own]] = flags[j[own]] = True
        for flags in found.values():
            name = int(signed(mix(mix(node[flags].view(np.uint64) ^ _EMPTY).sum(keepdims=True)))[0])
            if name not in seen:
                seen.add(name)
                if len(seen) > SEEN:
                    seen.clear()
                out.append((np.full(flags.sum(), name), node[flags], comp[flags]))
                held += len(out[-1][0])
        if held > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_CONTESTED)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_CONTESTED)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Hashes that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _uniting(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """Rows (name, node, component, shingles): verified links of a name's members that unite components, and no others."""
    for _, node, comp, sets in _groups(batches, 1):
        n, root = np.array([len(s) for s in sets], np.int64), {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for some, others, _ in CountRTree([counts(s) for s in sets], n, link).pairs(lambda x, y: (x < y) & (comp[x] != comp[y])):
            for i, j in zip(some.tolist(), others.tolist(), strict=True):
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and link.holds(shared(sets[i], sets[j]), int(n[i] + n[j])):
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIRS)


def _star_links(batches: Iterator[pa.RecordBatch], link: Link) -> Iterator[pa.RecordBatch]:
    """Rows (star, salt, member, node, shingles), a star's pivot first: the members that link with their pivot."""
    star, pivot = None, None
    for b in batches:
        stars, member, nodes, col = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
        cuts, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(np.uint64)
        out = []
        for i in range(b.num_rows):
            s = values[cuts[i] : cuts[i + 1]]
            if not member[i]:
                star, pivot = stars[i], s.copy()
            elif star == stars[i] and len(pivot) and len(s) and link.holds(shared(pivot, s), len(pivot) + len(s)):
                out.append((star, nodes[i]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_PAIRS)


def _with_text(docs: DataFrame, roles: DataFrame) -> DataFrame:
    """roles (node, ...) with the documents' texts, one row a role and document row."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    taken = roles.select(slot("node").alias("_slot")).distinct()
    near = docs.withColumn("_slot", slot("doc_id")).join(F.broadcast(taken), "_slot", "left_semi").drop("_slot")
    return near.join(roles, near["doc_id"] == roles["node"])


def _star_verified(stars: DataFrame, docs: DataFrame, link: Link) -> DataFrame:
    """Of the pairs (a, b), those whose sets link. A member's set is moved once for each pivot a that it has; a large star
    is salted, and its pivot copied to every salt."""
    sized = stars.groupBy("a").agg(F.count(F.lit(1)).alias("k")).withColumn("salts", (F.col("k") / STAR).cast("long") + 1)
    sized = written(sized, "ngram-sizes")  # so that both sides of the join are shuffled, and a hot star can be split
    member = stars.join(sized, "a").select(F.col("a").alias("star"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(1).alias("member"), F.col("b").alias("node"))
    pivot = sized.select(F.col("a").alias("star"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("node"))
    roles = written(member.unionByName(pivot), "ngram-roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], _set_column(b, link)], names=["star", "salt", "member", "node", "shingles"])

    rows = _with_text(docs, roles).select("star", "salt", "member", "node", "text")
    sets = rows.mapInArrow(run, "star long, salt long, member int, node long, shingles array<long>")
    return sets.repartition("star", "salt").sortWithinPartitions("star", "salt", "member").mapInArrow(partial(_star_links, link=link), "a long, b long").distinct()


def _set_column(b: pa.RecordBatch, link: Link) -> pa.ListArray:
    sets = [signed(s) for s in shingle_sets(*text_column(b), link)]
    values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), values)


def _contested_links(roles: DataFrame, docs: DataFrame, link: Link) -> DataFrame:
    """The links that unite components among members (name, node, component) of one name."""
    roles = written(roles.distinct(), "ngram-contested")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = _set_column(b, link)
            cuts, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(np.uint64)
            fps = [fingerprint(values[lo:hi])[0] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), col], names=["node", "fp", "shingles"])

    texts = _with_text(docs, roles.select("node").distinct()).select("node", "text").mapInArrow(run, "node long, fp long, shingles array<long>")
    sets = written(texts.where("size(shingles) > 0").dropDuplicates(["node", "fp"]), "ngram-sets")
    rows = roles.join(sets, "node").select("name", "node", "component", "shingles")
    return rows.repartition("name").sortWithinPartitions("name", "node").mapInArrow(partial(_uniting, link=link), "a long, b long")


def _parts(tiles: DataFrame) -> DataFrame:
    """(tile, i, j, chunk, node, component) of tiles (tile, node, component) with two components or more: every pair of
    members of different components meets in some (tile, i, j). A tile of up to TILE members is one part. A larger one is
    cut by a hash: its largest component into parts that are paired with the others' parts only, and the others into
    parts that are paired with all, so that the copies of a row grow with the members outside the largest component."""
    sizes = tiles.groupBy("tile", "component").agg(F.count(F.lit(1)).alias("k"))
    split = sizes.groupBy("tile").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all")).where("`all` > most")
    pieces = lambda rows: F.when(F.col("all") > TILE, F.ceil(rows / TILE)).otherwise(0).cast("long")
    split = written(split.select("tile", "top", pieces(F.col("most")).alias("main"), pieces(F.col("all") - F.col("most")).alias("rest")), "ngram-open")
    rows = tiles.join(split, "tile")
    small = rows.where("rest = 0").select("tile", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("chunk"), "node", "component")
    big = rows.where("rest > 0").withColumn("outer", F.col("component") != F.col("top"))
    big = big.withColumn("chunk", F.when(F.col("outer"), F.pmod(F.xxhash64("node"), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("node"), F.col("main"))))
    last = F.when(F.col("outer"), F.col("rest") + F.col("main")).otherwise(F.col("rest")) - 1
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return small.unionByName(big.select("tile", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "component"))


def _labels(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """(tile, node, component) of tiles; a node without a link is its own component."""
    return tiles.select("tile", "node").join(found, "node", "left").select("tile", "node", F.coalesce("component", "node").alias("component"))


def _dealt(tiles: DataFrame, points: DataFrame) -> DataFrame:
    """The parts of tiles (tile, node, component) with their points, a part's pair together and in order."""
    rows = _parts(tiles).join(points, "node").select("tile", "i", "j", "chunk", "node", "component", "n", "point")
    return rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "node")


def _tiles(docs: DataFrame, index: DataFrame, nodes: DataFrame, link: Link) -> DataFrame:
    """(tile, chunk, node) of tiles with two sets or more. Hot tiles, found on one fingerprint in HEAT, are shared anyway:
    their rows are dealt out by fingerprint and never meet in one task."""
    rows = docs.mapInArrow(partial(_tile_rows, link=link), "tile long, fp long")
    heat = index.where("tile is not null").groupBy("tile").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= HOT)
    heat = written(heat.select("tile", (F.col("k") * HEAT / TILE + 1).cast("long").alias("chunks")), "ngram-heat")
    hot = bool(heat.head(1))
    cool = rows.join(heat, "tile", "left_anti") if hot else rows
    out = cool.repartition("tile").sortWithinPartitions("tile", "fp").mapInArrow(_shared_tiles, _TILES_DDL)
    if hot:
        out = out.unionByName(rows.join(heat, "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"), "fp"))
    return out.distinct().join(nodes.select("fp", "node"), "fp").select("tile", "chunk", "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes with an edge (a, b): component is the smallest node reachable. Minimum labels with
    pointer jumping; every round is a written table, so lost executors cost one round. Ends when no label changes."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "ngram-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "ngram-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = written(hooked.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "ngram-labels")
        if not new.where("old <> component").head(1):
            return new.select("node", "component")
        labels = new.select("node", "component")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text): links at this Jaccard similarity of the sets of
    shingles of so many words. A null or empty text has an empty set and links with nothing; equal sets always link; a
    similarity of exactly the limit links. A null doc_id gets a null component. Rows that repeat a doc_id are all
    returned, and count as one document, in whose component are the links of each of its sets. A very long text is one set like others
    (hashes of its distinct shingles are held in memory, 8 bytes each). No documents, no rows. Other columns are ignored."""
    link = Link(shingle, similarity)
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _labelled(docs, link)[0]


def _labelled(docs: DataFrame, link: Link) -> tuple[DataFrame, DataFrame]:
    """jaccard_components(), and the written table (doc_id) of the ids that several rows have."""
    spark: SparkSession = docs.sparkSession
    index = written(docs.mapInArrow(partial(_index, link=link), _INDEX_DDL), "ngram-index")
    sets = written(index.where("tile is null").drop("tile"), "ngram-counts")
    # One node for all documents of equal sets, named by the smallest doc_id.
    nodes = written(sets.where("n > 0 and doc_id is not null").groupBy("fp", "fp2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("point").alias("point")), "ngram-nodes")
    tiles = written(_tiles(docs, index, nodes, link), "ngram-tiles")
    discard(index)
    points = nodes.select("node", "n", "point")
    placed = tiles.join(points, "node")
    stars = placed.select("tile", "chunk", "node", "n", "point").repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "node").mapInArrow(partial(_stars, link=link), "a long, b long")
    stars = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "ngram-stars")
    edges = _star_verified(stars, docs, link)
    again = written(sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-repeated")
    if again.head(1):  # the sets of one document belong together
        own = sets.where("n > 0").join(again, "doc_id").join(nodes.select("fp", "fp2", "node"), ["fp", "fp2"])
        edges = edges.unionByName(own.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")).distinct())
    edges = written(edges, "ngram-links")
    found = components(edges) if edges.head(1) else spark.createDataFrame([], "node long, component long")
    open_tiles = written(_labels(tiles, found), "ngram-labelled")
    pairs = written(_dealt(open_tiles, points).mapInArrow(partial(_candidates, link=link), "a long, b long").distinct(), "ngram-candidates")
    if pairs.head(1):
        good = written(_star_verified(pairs, docs, link), "ngram-links")
        edges, bad = edges.union(good), written(pairs.join(good, ["a", "b"], "left_anti"), "ngram-failed")
        found = components(edges) if edges.head(1) else found
        if bad.head(1):
            at = open_tiles.select("tile", F.col("node").alias("a")).join(bad, "a")
            at = at.join(open_tiles.select("tile", F.col("node").alias("b")), ["tile", "b"]).select("tile").distinct()
            left = written(_labels(open_tiles.join(at, "tile", "left_semi"), found), "ngram-labelled")
            contested = _dealt(left, points).mapInArrow(partial(_contested, link=link), "name long, node long, component long")
            more = written(_contested_links(contested, docs, link), "ngram-links")
            if more.head(1):
                found = components(edges.union(more))
    member = sets.join(nodes.select("fp", "fp2", "node"), ["fp", "fp2"], "left").join(found, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("doc_id")))
    return member.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), again


def one_per_component(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group of linked ones, in their own columns: that with the smallest doc_id. Of rows
    that repeat a doc_id, the one with the smallest hash of its columns stays. Rows of a null doc_id all stay. Otherwise
    as jaccard_components()."""
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, again = _labelled(own, Link(shingle, similarity))
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    again = again.select(F.col("doc_id").alias("id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    unnamed, named = rows.where("id is null"), rows.where("id is not null").join(keep, "id", "left_semi")
    if again.head(1):
        one = named.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        named = named.join(again, "id", "left_anti").unionByName(one)
    return named.unionByName(unnamed).select("row.*")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of all documents: sets of four words, links from 0.85 on. Nulls, empty texts,
    repeated rows and empty tables: see jaccard_components()."""
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 0.85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_ngram_jaccard": op10_ngram_jaccard}
SQL = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.gram = b.gram AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM o UNION SELECT y, x FROM o),
r(doc_id, other) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT s.doc_id AS doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.g)
""",
}
