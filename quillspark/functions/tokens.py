"""Search tokens of Arrow texts, as ``text.tokens`` cuts them, by bytes and with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTER, CAPITAL, DIGIT = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(ord("a"), ord("z") + 1), ord("_")]] = LETTER
_KIND[ord("A") : ord("Z") + 1] = CAPITAL
_KIND[ord("0") : ord("9") + 1] = DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, whether each is in a word, whether it starts a token, where texts start and end); no text is null."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = (np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    before = np.zeros(len(kind) + 1, np.uint8)  # kind of the byte before in the same text
    before[1:] = kind
    before[offsets] = 0
    digits = np.flatnonzero(kind == DIGIT)
    if len(digits):  # those before the first letter of a word are none of it
        first = before[digits] != DIGIT
        lead = digits[(before[digits[first]] == 0)[np.cumsum(first) - 1]]
        kind[lead] = 0
        before[lead + 1] = 0
    return data, kind > 0, (kind > 0) & ((before[:-1] == 0) | (kind == CAPITAL)), offsets


def token_counts(texts: pa.Array) -> np.ndarray:
    """How many tokens each text has; no text is null."""
    _, word, start, offsets = _marked(texts)
    follows = np.zeros(len(word), bool)
    follows[:-1] = word[1:] & ~start[1:]
    return np.diff(np.searchsorted(np.flatnonzero(start & follows), offsets))


def coded_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, the number among these of each token in order, how many tokens each text has); no text is null."""
    data, word, start, offsets = _marked(texts)
    held = _LOWER[data[word]]
    cuts = np.append(np.flatnonzero(start[word]), len(held))
    count = np.diff(np.searchsorted(np.flatnonzero(start), offsets))
    long = np.diff(cuts) > 1
    all_ = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(held))
    coded = all_.filter(pa.array(long)).dictionary_encode()
    count = np.bincount(np.repeat(np.arange(len(count)), count)[long], minlength=len(count))
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), count
