"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Every input partition splits its texts into pre-tokens, numbers its distinct ones and keeps the
texts as sequences of these numbers by position. The distinct words go to hash buckets, where each
distinct word of the whole corpus is encoded once however many partitions hold it; the ids return
to the partition, and the texts are reassembled by position. A frequent word costs one dictionary
row for each partition, however often it occurs. Decoding joins the token-byte table.

Null texts count as empty. Repeated rows are encoded each. Empty tables give empty results. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import cut, lean, parts

#: Bytes of text that a block of documents gathers before it is closed (after a whole document).
BLOCK_BYTES = 8 << 20


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


class _Block:
    """Documents as sequences of numbers of this block's distinct words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hash: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.bytes = 0

    def add(self, h: np.ndarray, b: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        code, one = bpe.distinct(b, at, end, h)
        known, raw, get = len(self.number), b.tobytes(), self.number.setdefault
        numbers = np.fromiter((get(raw[i:j], len(self.number)) for i, j in zip(at[one].tolist(), end[one].tolist())), np.int64, len(one))
        w = one[numbers >= known]
        n = end[w] - at[w]
        self.hash.append(h[w])
        self.word.append(b[bpe.ragged(at[w], n)])
        self.size.append(n.astype(np.uint32))
        return numbers[code].astype(np.uint32)

    def dictionary(self, buckets: int):
        """(bucket, blob of the numbers, hashes and words in it)."""
        h, size, word = (np.concatenate(x) for x in (self.hash, self.size, self.word))
        start = np.cumsum(size, dtype=np.int64) - size
        of = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        lim = np.searchsorted(of[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(lim)):
            i = order[lim[k] : lim[k + 1]]
            steps = np.diff(i, prepend=0).astype(np.uint32)
            yield int(k), pack(steps, size[i], word[bpe.ragged(start[i], size[i].astype(np.int64))], h[i].sum(dtype=np.uint64, keepdims=True))

    def mark(self) -> np.ndarray:
        """Sum of the distinct words' hashes, by which texts and dictionary are held to be of one reading."""
        return np.array([sum(int(x.sum(dtype=np.uint64)) for x in self.hash) % (1 << 64)], np.uint64)


def _split(path: str, buckets: int, words: bool):
    """The dictionary rows of the blocks (words) or their texts as sequences."""

    def run(batches):
        splitter = bpe.Encoder(path)
        block, piece, held, number, base, last = _Block(), [], 0, 0, 0, -1
        part = TaskContext.get().partitionId()

        def close():
            nonlocal block, number
            at = part * (1 << 20) + number
            if words:
                out = [(at, k, None, None, None, x) for k, x in block.dictionary(buckets)] if block.hash else []
            else:
                out = [(at, -2, None, None, -1, pack(block.mark()))]
            block, number = _Block(), number + 1
            return out

        def rows(x):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*x), KINDS)], NAMES)

        for b in batches:
            key, (data, off) = b.column(0), bpe.buffers(b.column(1))
            for raw, docs, which in bpe.slices(data, off):
                if block.bytes > BLOCK_BYTES and base + which[0] != last:
                    piece += close()
                last = base + which[-1]
                block.bytes += len(raw)
                lim = np.append(docs, len(raw))
                filled = docs[np.diff(lim) > 0]
                found = splitter.words(raw, filled) if len(filled) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                if found is None:  # the library's own pattern, for rarer characters
                    import regex

                    pattern, text = regex.compile(splitter.enc._pat_str), raw.tobytes()
                    n, at = [], []
                    for k in range(len(docs)):
                        p = int(lim[k])
                        ws = pattern.findall(text[lim[k] : lim[k + 1]].decode())
                        for w in ws:
                            at.append(p)
                            p += len(w.encode())
                    at = np.array(at, np.int64)
                    end = np.append(at[1:], len(raw))
                    found = bpe.hashes(raw, at, end), at, end
                h, at, end = found
                seq = block.add(h, raw, at, end)
                first = np.searchsorted(at, lim)
                for k, doc in enumerate(() if words else which):
                    piece.append((part * (1 << 20) + number, -1, key[int(doc)].as_py(), int(base + doc), int(held), pack(seq[first[k] : first[k + 1]])))
                    held += 1
                if len(piece) >= 512:
                    yield rows(piece)
                    piece = []
            base += b.num_rows
        piece += close()
        if piece:
            yield rows(piece)

    return run


NAMES = ["block", "bucket", "doc_id", "doc", "ord", "blob"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
SCHEMA = "block long, bucket long, doc_id long, doc long, ord long, blob binary"


def encode_docs(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in a binary."""
    spark = docs.sparkSession
    buckets = max(16, 2 * parts(spark))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if "Exchange" in split._jdf.queryExecution().executedPlan().toString():
        split = cut(split)  # texts and words are read apart; an order that can change must not

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, known, out = bpe.encoding(path), {}, []
        for block, blob in zip(pdf["block"], pdf["blob"]):
            steps, size, word, mark = unpack(blob, np.uint32, np.uint32, np.uint8, np.uint64)
            raw, end = word.tobytes(), np.cumsum(size, dtype=np.int64)
            got = []
            for e, n in zip(end.tolist(), size.tolist()):
                w = raw[e - n : e]
                x = known.get(w)
                if x is None:
                    x = known[w] = tuple(enc._encode_single_piece(w))
                got.append(x)
            n = np.fromiter(map(len, got), np.uint32, len(got))
            out.append((block, pack(steps, n, np.fromiter((y for x in got for y in x), np.uint32, int(n.sum())), mark)))
        return pd.DataFrame(out, columns=["block", "blob"])

    words = split.mapInArrow(lean(_split(path, buckets, True)), SCHEMA).select("bucket", "block", "blob").groupBy("bucket").applyInPandas(merge, "block long, blob binary")

    def assemble(texts: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        number, n, ids, marks = [], [], [], 0
        for blob in dictionary["blob"]:
            a, b, c, m = unpack(blob, np.uint32, np.uint32, np.uint32, np.uint64)
            number.append(np.cumsum(a, dtype=np.int64)), n.append(b), ids.append(c)
            marks = (marks + int(m[0])) % (1 << 64)
        texts = texts.sort_values("ord")
        if len(texts) and int(unpack(texts["blob"].iloc[0], np.uint64)[0][0]) != marks:
            raise RuntimeError("texts and dictionary of a block differ: the input changed between two readings")
        texts = texts.iloc[1:]
        if number:
            number, n, ids = np.concatenate(number), np.concatenate(n).astype(np.int64), np.concatenate(ids)
            of, size = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            of[number], size[number] = np.cumsum(n) - n, n
        out, last = [], None
        for doc, doc_id, blob in texts[["doc", "doc_id", "blob"]].astype({"doc_id": object}).itertuples(index=False):
            (seq,) = unpack(blob, np.uint32)
            got = ids[bpe.ragged(of[seq], size[seq])].tobytes() if len(seq) else b""
            if doc == last:  # a long document comes in several pieces
                out[-1][1].append(got)
            else:
                out.append((doc_id, [got]))
            last = doc
        whole = [(k, b"".join(x)) for k, x in out]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(k) else int(k) for k, _ in whole], "Int64"), "n_tokens": [len(x) // 4 for _, x in whole], "ids": [x for _, x in whole]})

    texts = split.mapInArrow(lean(_split(path, buckets, False)), SCHEMA).select("block", "doc_id", "doc", "ord", "blob")
    got = texts.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(assemble, "doc_id long, n_tokens long, ids binary")
    return got


def decode_docs(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): joins each id with the token-byte table."""

    def run(batches):
        table, start, size = bpe.token_bytes(path)
        for b in (w.slice(k, 256) for w in batches for k in range(0, w.num_rows, 256)):
            out = []
            for x in b.column(2):
                i = np.frombuffer(x.as_py(), np.uint32)
                out.append(table[bpe.ragged(start[i], size[i])].tobytes() if len(i) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return ids.select("doc_id", "n_tokens", "ids").mapInArrow(lean(run), "doc_id long, n_tokens long, ids binary, decoded binary")
