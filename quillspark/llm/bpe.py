"""Vectorised byte-level BPE over Arrow text buffers.

Pre-tokens are found with numpy on the UTF-8 bytes of a whole slice of documents at once; each
distinct pre-token of a slice is merged once and the ids are gathered back by position. Slices
holding characters outside ASCII and the Latin letters U+00C0-U+024F go through the tiktoken
library as they are, so results equal ``encode_ordinary`` for every text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import numpy as np

#: Bytes of text handled at once; a longer document is cut at a space between two letters, which
#: is a pre-token boundary, so memory does not grow with the longest text.
SLICE_BYTES = 1 << 20
#: Distinct words, and bytes of them, remembered by a worker before its cache starts anew.
CACHE_WORDS, CACHE_BYTES = 200_000, 8 << 20

_L, _N, _S, _O, _E = 1, 2, 3, 4, 5  # letter, number, space, other, not handled here


def _classes() -> np.ndarray:
    t = np.full(256, _E, np.uint8)
    t[:128] = _O
    for a, z in ((65, 90), (97, 122)):
        t[a : z + 1] = _L
    t[48:58] = _N
    t[[9, 10, 11, 12, 13, 32]] = _S
    t[0xC3:0xCA] = _L  # lead bytes of U+00C0-U+027F
    t[0x80:0xC0] = _L
    return t


CLASSES = _classes()


@lru_cache(maxsize=4)
def encoding(path: str):
    """A tiktoken Encoding from a rank file (.tiktoken) or a tokenizers vocabulary (.json)."""
    import public_tokenizers
    import tiktoken

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        special = {x["content"] for x in vocab["added_tokens"]}
        back = {c: b for b, c in byte_chars().items()}
        ranks = {bytes(back[c] for c in w): i for w, i in vocab["model"]["vocab"].items() if w not in special}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes joined, and start and length by id."""
    enc = encoding(path)
    table = [b""] * enc.n_vocab
    for b, i in enc._mergeable_ranks.items():
        table[i] = b
    n = np.array([len(b) for b in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(n) - n, n


def boundaries(b: np.ndarray, docs: np.ndarray) -> np.ndarray | None:
    """Starts of the pre-tokens in bytes b, documents starting at docs; None if not handled here."""
    n = len(b)
    cls = CLASSES[b]
    if (cls == _E).any() or ((b >= 0x1C) & (b <= 0x1F)).any():
        return None
    lead = np.flatnonzero(b == 0xC3)
    if len(lead) and np.isin(b[lead + 1], (0x97, 0xB7)).any():
        return None
    lead = np.flatnonzero(b == 0xC9)
    if len(lead) and (b[lead + 1] > 0x8F).any():
        return None
    first = np.zeros(n + 1, bool)
    first[docs] = True
    first[n] = True
    new = np.empty(n, bool)  # a run of one class starts
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new |= first[:n]
    space = cls == _S
    ends = np.empty(n, bool)  # the last of its run, before more text of its document
    ends[:-1] = new[1:]
    ends[-1] = True
    last = ends & space & ~first[1:]
    start = new.copy()
    start[last] = True
    joined = np.flatnonzero(last & (b == 32)) + 1
    start[joined] = False
    q = np.flatnonzero(new & (b == 39))  # a lone quote at the start of a pre-token
    if len(q):
        q = q[start[q] & ends[q]]
        q = q[q + 1 < n]
        q = q[~first[q + 1]]
        c1 = b[q + 1]
        c2 = b[np.minimum(q + 2, n - 1)]
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        two &= (q + 2 < n) & ~first[np.minimum(q + 2, n)]
        one = np.isin(c1, (115, 116, 109, 100))
        for at, k in ((q[one], 2), (q[two & ~one], 3)):
            start[at + 1] = False
            after = at + k
            after = after[after < n]
            start[after] |= cls[after] == _L
    return np.flatnonzero(start)


#: Words up to this many bytes are hashed together, eight bytes at a step; longer ones by blake2b.
LONG_WORD = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of b on (zeros past its end) as one little-endian number."""
    wide = np.zeros(len(b) + 8, np.uint8)
    wide[: len(b)] = b
    return np.ndarray((len(b) + 1,), "<u8", wide, strides=(1,))


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each b[start:end]. Every eight bytes are mixed in before the next come, so no
    arrangement of letters cancels out as it can in a sum of powers."""
    n = end - start
    with np.errstate(over="ignore"):
        h = (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        view, live = eights(b), np.flatnonzero((n > 0) & (n <= LONG_WORD))
        at, left = start[live], n[live]
        while len(live):
            x = view[at]
            short = left < 8
            x[short] &= _KEEP[left[short]]
            h[live] = mix(h[live] ^ x) + np.uint64(0x9E3779B97F4A7C15)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(n > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(b[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def distinct(b: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a slice: the number of each word, and where the first of each number is.
    Words of one hash are compared byte by byte; should any differ, the words themselves are the keys."""
    import pandas as pd

    code, unique = pd.factorize(h)
    one = np.empty(len(unique), np.int64)
    one[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    n, rep = end - start, one[code]
    same = bool((n == n[rep]).all())
    view, live = eights(b), np.flatnonzero(rep != np.arange(len(rep)))
    at, other, left = start[live], start[rep[live]], n[live]
    while same and len(at):
        x = view[at] ^ view[other]
        short = left < 8
        x[short] &= _KEEP[left[short]]
        same = not x.any()
        more = left > 8
        at, other, left = at[more] + 8, other[more] + 8, left[more] - 8
    if not same:
        raw, seen = b.tobytes(), {}
        code = np.fromiter((seen.setdefault(raw[i:j], len(seen)) for i, j in zip(start.tolist(), end.tolist())), np.int64, len(n))
        one = np.empty(len(seen), np.int64)
        one[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return code, one


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then those of start[1], ..."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def slices(data: np.ndarray, offsets: np.ndarray):
    """Cuts of the documents into slices: (bytes, starts of its documents, their numbers)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        if j > i:
            a = int(offsets[i])
            yield data[a : int(offsets[j])], offsets[i:j] - a, np.arange(i, j)
            i = j
            continue
        a, z = int(offsets[i]), int(offsets[i + 1])
        while z - a > SLICE_BYTES:
            b = data[a : min(z, a + SLICE_BYTES)]
            c = CLASSES[b]
            at = np.flatnonzero((b[1:-1] == 32) & (c[:-2] == _L) & (c[2:] == _L) & (b[:-2] < 128) & (b[2:] < 128)) + 1
            if not len(at):
                break
            yield b[: at[-1]], np.zeros(1, np.int64), np.array([i])
            a += int(at[-1])
        yield data[a:z], np.zeros(1, np.int64), np.array([i])
        i += 1


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


class Encoder:
    """Encodes Arrow text columns; keeps a bounded cache of merged words."""

    def __init__(self, path: str):
        self.enc = encoding(path)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.held = 0

    def words(self, b: np.ndarray, docs: np.ndarray):
        """Pre-tokens of a slice: hash of each, start, end; None where the slice needs the library."""
        at = boundaries(b, docs)
        if at is None:
            return None
        end = np.append(at[1:], len(b))
        return hashes(b, at, end), at, end

    def _slice(self, b: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled = docs[np.diff(np.append(docs, len(b))) > 0]
        if not len(filled):
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        found = self.words(b, filled)
        if found is None:
            raw, lim = b.tobytes(), np.append(docs, len(b))
            ids = [self.enc.encode_ordinary(raw[lim[k] : lim[k + 1]].decode()) for k in range(len(docs))]
            n = np.array([len(x) for x in ids], np.int64)
            return np.fromiter((y for x in ids for y in x), np.uint32, int(n.sum())), n
        h, at, end = found
        code, one = distinct(b, at, end, h)
        if len(self.cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        raw = b.tobytes()
        keys = [raw[i:j] for i, j in zip(at[one].tolist(), end[one].tolist())]
        got = list(map(self.cache.get, keys))
        for k in [k for k, x in enumerate(got) if x is None]:
            got[k] = self.cache[keys[k]] = tuple(self.enc._encode_single_piece(keys[k]))
            self.held += len(keys[k])
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((y for x in got for y in x), np.uint32, int(n.sum()))
        each = n[code]
        ids = flat[ragged((np.cumsum(n) - n)[code], each)]
        sums = np.concatenate([[0], np.cumsum(each)])
        first = np.searchsorted(at, np.append(docs, len(b)))
        return ids, np.diff(sums[first])

    def column(self, column):
        """Yields (document number, ids) pieces in order; a long document comes in several pieces."""
        data, off = buffers(column)
        for b, docs, which in slices(data, off):
            ids, n = self._slice(b, docs)
            yield which, ids, n

    def encode(self, column) -> list[np.ndarray]:
        """The ids of each document."""
        out: list = [[] for _ in range(len(column))]
        for which, ids, n in self.column(column):
            for k, x in zip(which, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[k].append(x)
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]

    def counts(self, column) -> np.ndarray:
        """The number of ids of each document."""
        out = np.zeros(len(column), np.int64)
        for which, _, n in self.column(column):
            out[which] += n
        return out
