"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pieces.

A text is cut where white space begins after a character that is none. No token of either vocabulary spans such a cut
(their pre-tokenizers put white space only at the start of a match, or drop it), so the ids of a text are those of its
pieces in a row. Pieces repeat; each distinct one is encoded once while it stays in the cache. A new piece of visible ASCII is
cut by the vocabulary's own pre-tokenizer rule and given to its merge model directly, which passes over the rest of the
library's work on offsets; all others go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

#: Pieces kept by one Python worker; when full, the cache starts again. About 200 MB.
CACHE_PIECES = 1_000_000
_WORDS = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: White space outside ASCII, and separators that some regex engines count as such: such texts are encoded whole.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ODD_BYTES = (b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_VISIBLE = re.compile(rb"\n?[!-~]+")
#: What the pre-tokenizers of the two vocabularies match in ASCII text, by the way the library shows them.
_RULES = {
    "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)": re.compile(rb"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+"),
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])""": re.compile(rb"'(?:[sdmt]|ll|ve|re)|[a-z]+|[0-9]|[^\sa-z0-9]+"),
}
#: What byte-level vocabularies write for a space and a line end.
_SPACE, _LINE = "\u0120", "\u010a"
_encoders: dict[str, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file of the public_tokenizers package, or name itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> "Encoder":
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary_path(name))
    return _encoders[name]


class Encoder:
    """encode(texts) -> one bytes object a text: its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.drops_space = any(t.endswith("</w>") for t in vocab)
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.sizes[i] = len(t) - 4 * (self.drops_space and t.endswith("</w>"))
        self.cache: dict[bytes, bytes] = {}
        self.rule, self.model, self.parts = _RULES.get(repr(self.tok.pre_tokenizer)), self.tok.model, {}
        if self.model.dropout or (self.drops_space and "Lowercase" not in repr(self.tok.normalizer)):
            self.rule = None

    def _each(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _joined(self, pieces: list[bytes]) -> list[bytes]:
        """Several pieces in one call, told apart by the bytes that their ids stand for."""
        glue = b" " if self.drops_space else b""
        text = glue.join(pieces).decode("utf-8")
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        if self.drops_space and not text.isascii():
            want = [len(p) if p.isascii() else len(unicodedata.normalize("NFC", p.decode()).lower().encode()) for p in pieces]
        else:
            want = list(map(len, pieces))
        ends, reach = np.cumsum(want), np.cumsum(self.sizes[ids])
        at = np.searchsorted(reach, ends)
        if len(ids) == 0 or at[-1] != len(ids) - 1 or not np.array_equal(reach[np.minimum(at, len(ids) - 1)], ends):
            return self._each(pieces)
        raw, cuts = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _merged(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _visible(self, missing: list[bytes]) -> list[bytes]:
        """Fills the cache for keys of visible ASCII, a line end before it or not, and returns the other keys."""
        cache, merged, left = self.cache, self._merged, []
        lead, space = ("", b"") if self.drops_space else (_SPACE, b" ")
        if len(self.parts) > CACHE_PIECES // 10:
            self.parts.clear()
        for k in missing:
            if k.isalpha():
                cache[k] = merged(lead + (k.lower() if self.drops_space else k).decode())
            elif _VISIBLE.fullmatch(k) and b"<|" not in k:
                line = k[:1] == b"\n"
                out = [merged(_LINE)] if line and not self.drops_space else []
                own = k.lower() if self.drops_space else k
                for part in self.rule.findall(own[1:] if line else space + own):
                    got = self.parts.get(part)
                    if got is None:
                        got = self.parts[part] = merged(part.decode().replace(" ", _SPACE))
                    out.append(got)
                cache[k] = b"".join(out)
            else:
                left.append(k)
        return left

    def _learn(self, missing: list[bytes]) -> None:
        """Fills the cache for keys of missing; see _keys for what a key stands for."""
        if self.rule:
            missing = self._visible(missing)
        special = b"<|" in b" ".join(missing)
        if self.drops_space:
            plain = [(k, k) for k in missing if not (special and b"<|" in k)]
        else:
            plain = [(k, k if k[0] == 10 else b" " + k) for k in missing if k and k[0] != 255 and k != b"\n" and not (special and b"<|" in k)]
        for i in range(0, len(plain), 512):
            keys, pieces = zip(*plain[i : i + 512], strict=True)
            self.cache.update(zip(keys, self._joined(pieces), strict=True))
        if len(plain) < len(missing):
            rest = list(set(missing).difference(k for k, _ in plain))
            self.cache.update(zip(rest, self._each([k if self.drops_space else _piece(k) for k in rest]), strict=True))

    def _keys(self, text: bytes) -> list[bytes]:
        """The cache keys of a text's pieces in order. A vocabulary that drops white space has the words themselves. For
        the other, where single spaces and line ends are the only white space, keys are what lies between single spaces
        (a line end counts as one, and stays at the front); the first key gets a mark, as no space precedes it. Other
        texts are cut by the pattern, and the pieces are marked as complete."""
        if self.drops_space:
            return text.split()
        if any(x in text for x in (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\xff")):
            return [b"\xff" + p for p in _WORDS.findall(text)]
        keys = text.replace(b"\n", b" \n").split(b" ")
        keys[0] = b"\xff" + keys[0]
        return keys

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.drops_space:  # it lower-cases all but its special tokens, and so may we: fewer pieces
            texts = [t if b"<|" in t else t.lower() for t in texts]
            odd = [False] * len(texts)
        else:
            odd = [any(x in t for x in _ODD_BYTES) and bool(_ODD.search(t)) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        lists = [[] if o else self._keys(t) for t, o in zip(texts, odd, strict=True)]
        missing = set().union(*lists).difference(self.cache)
        if missing:
            self._learn(list(missing))
        get = self.cache.__getitem__
        return [self._each([t])[0] if o else b"".join(map(get, keys)) for t, o, keys in zip(texts, odd, lists, strict=True)]


def _piece(key: bytes) -> bytes:
    if key[:1] == b"\xff":
        return key[1:]
    return key if key[:1] == b"\n" else b" " + key


def slices(raw: np.ndarray, offsets: np.ndarray, budget: int = 1 << 20):
    """Runs (i, texts) of consecutive texts, of about budget bytes each."""
    data, n, i = raw.tobytes(), len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget))))
        yield i, [data[a:b] for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
        i = j
