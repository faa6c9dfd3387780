"""Best-fit packing of documents into sequences by bin completion over the length histogram.

Documents are encoded, an end id is appended, and only documents longer than a sequence are cut.
The packing itself works on the histogram of piece lengths, which has at most ``size`` entries
whatever the corpus, so the search costs the driver as much for any number of rows; ``bin_completion``
has the method. Pieces then find their sequence by their rank within their length; ranks come from
hash cells of bounded size, so a length that a third of all rows share is ranked by many tasks.

Null text counts as empty: one piece that holds the end id alone. Repeated rows are packed each, and
rows with a null or repeated id too; which of several equal pieces takes which place does not matter
to a packing. Texts of any length are encoded whole, in slices. An empty table gives no pieces. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .shared import cut, lean

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece. The first piece of a cut document takes the remainder, so all others
    are full. keep_ids adds the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        e = Encoder(path)
        for b in (w.slice(k, 1024) for w in batches for k in range(0, w.num_rows, 1024)):
            key, rows, ids_out = b.column(0), [], []
            end = np.array([end_id], np.uint32)
            for k, ids in enumerate(e.encode(b.column(1))):
                ids = np.append(ids, end)
                n = len(ids)
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                raw, doc = ids.tobytes(), key[k].as_py()
                for j, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * a : 4 * z]
                    rows.append((doc, j, a, z - a, zlib.crc32(part)))
                    if keep_ids:
                        ids_out.append(part)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids_out, pa.binary())] if keep_ids else [])], [*names, *(["ids"] if keep_ids else [])])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lean(run), PIECES + (", ids binary" if keep_ids else ""))


def bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: for each k, lengths over size - k take one each, those over half
    a sequence too, and what the others from k on have above the room beside the latter takes more."""
    at = np.zeros(size + 2, np.int64)
    for n, c in counts.items():
        at[n] += c
    up = np.concatenate([[0], np.cumsum(at)])  # pieces shorter than n
    mass = np.concatenate([[0], np.cumsum(at * np.arange(size + 2))])
    half, k = size // 2 + 1, np.arange(size // 2 + 1)
    top = np.maximum(size - k + 1, half)
    alone, beside = up[size + 1] - up[top], up[top] - up[half]
    free = size * beside - (mass[top] - mass[half])
    over = mass[half] - mass[k] - free
    return int(max(-(-mass[size + 1] // size), (alone + beside + np.maximum(0, -(-over // size))).max()))


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of a sequence, how many such sequences). Each piece,
    longest first, goes to the fullest sequence that it fits; equal pieces and equal sequences go together."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {size: []}
    order = []  # rooms of open sequences, rising
    for n in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        c = counts[n]
        while c:
            k = bisect.bisect_left(order, n)
            fill, times = rooms[order[k]].pop() if k < len(order) else ((), c)
            if k < len(order) and not rooms[order[k]]:
                del rooms[order[k]], order[k : k + 1]
            room = size - sum(fill)
            each = room // n
            used = min(times, c // each)  # these take as many as fit; at most one takes the rest
            parts = [((*fill, *[n] * each), used)]
            rest = c - used * each
            if used < times and rest and rest < each:
                parts.append(((*fill, *[n] * rest), 1))
                used, c = used + 1, 0
            else:
                c = rest
            if fill and used < times:
                parts.append((fill, times - used))
            for done, t in parts:
                if t:
                    left = size - sum(done)
                    if left not in rooms:
                        rooms[left] = []
                    if not rooms[left]:
                        bisect.insort(order, left)
                    rooms[left].append((done, t))
    return [x for room in rooms.values() for x in room]


def _use(left: dict[int, int], fill) -> tuple[tuple[int, ...], int]:
    each = {n: fill.count(n) for n in set(fill)}
    times = min(left[n] // c for n, c in each.items())
    for n, c in each.items():
        left[n] -= c * times
        if not left[n]:
            del left[n]
    return tuple(fill), times


def _reach(left: dict[int, int], first: int, room: int) -> tuple[list[int], list[int], list[int]]:
    """Lengths that fit beside ``first``, rising, how many of each may, and sums: sums[k] has bit s set if
    the k smallest can add up to s."""
    lengths = [n for n in sorted(left) if n <= room]
    most = [min(left[n] - (n == first), room // n) for n in lengths]
    sums, mask = [1], (1 << (room + 1)) - 1
    for n, many in zip(lengths, most):
        bits, step = sums[-1], 1
        while many > 0:  # any number of n up to many, in doubling steps
            step = min(step, many)
            bits |= bits << (n * step) & mask
            many -= step
            step *= 2
        sums.append(bits)
    return lengths, most, sums


def completion(left: dict[int, int], first: int, size: int, spare: int = 0) -> list[int]:
    """Beside ``first``, the filling with the most of the largest lengths among all whose waste is at
    most ``spare`` above the least; no other one dominates it."""
    lengths, most, sums = _reach(left, first, size - first)
    top = sums[-1].bit_length() - 1
    fill, low = [first], max(0, top - spare)
    for k in range(len(lengths) - 1, -1, -1):
        n = lengths[k]
        c = min(most[k], top // n)
        while (sums[k] & (1 << (top - n * c + 1)) - 1).bit_length() - 1 < low - n * c:
            c -= 1
        fill += [n] * c
        top, low = top - n * c, max(0, low - n * c)
    return fill


def fillings(left: dict[int, int], first: int, size: int, waste: int) -> list[tuple[int, ...]]:
    """All undominated fillings around ``first`` that waste at most ``waste``, least waste first. A filling
    is dominated if one length left out can stand for several of its pieces, or for a shorter one, that
    it matches or exceeds by no more than the waste."""
    room = size - first
    lengths, most, sums = _reach(left, first, room)
    out = []

    def grow(k: int, top: int, rest: tuple[int, ...]) -> None:
        low = top - waste
        if k == 0:
            return out.append((room - top, rest)) if low <= 0 and not dominated(rest, top) else None
        n = lengths[k - 1]
        for c in range(min(most[k - 1], top // n), -1, -1):
            if (sums[k - 1] & (1 << (top - n * c + 1)) - 1).bit_length() - 1 >= low - n * c:
                grow(k - 1, top - n * c, (*rest, *[n] * c))

    def dominated(rest: tuple[int, ...], free: int) -> bool:
        one, several = 0, 0  # sums of one piece, of two or more
        for n in rest:
            several |= (one | several) << n
            one |= 1 << n
        for x, m in zip(lengths, most):
            if rest.count(x) < m and ((one | several) >> max(1, x - free) & ((1 << (x - max(1, x - free))) - 1) or several >> x & 1):
                return True
        return False

    grow(len(lengths), room, ())
    return [(first, *rest) for _, rest in sorted(out, key=lambda f: (-f[0], [-n for n in f[1]]))]


def fits(left: dict[int, int], k: int, size: int, failed: set) -> list[tuple[int, ...]] | None:
    """A packing in k sequences, if there is one: branch and bound over undominated fillings of the largest
    piece left; a branch ends where the waste so far leaves too few sequences for what is left."""
    if not left:
        return []
    key = k, tuple(sorted(left.items()))
    if bound(left, size) > k or key in failed:
        return None
    for fill in fillings(left, max(left), size, k * size - sum(n * c for n, c in left.items())):
        rest = dict(left)
        for n in fill:
            rest[n] -= 1
            if not rest[n]:
                del rest[n]
        more = fits(rest, k - 1, size, failed)
        if more is not None:
            return [fill, *more]
    failed.add(key)
    return None


def exact(counts: dict[int, int], size: int, most: int) -> list[tuple[int, ...]] | None:
    """The smallest packing if it takes fewer than ``most`` sequences."""
    left = {n: c for n, c in counts.items() if c > 0}
    for k in range(bound(left, size), most):
        if (done := fits(left, k, size, set())) is not None:
            return done
    return None


#: Pieces that the search takes back at once. Up to so many a packing is the smallest possible.
EXACT = 40


def bin_completion(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion on a histogram. Best fit is the first incumbent; descents through undominated
    fillings, used as often as the counts allow, with rising waste allowed to a filling, are the next.
    Then the sequences that waste the most, EXACT pieces of them, are taken back and searched in full
    for a packing in fewer, again and again while that saves one. Up to EXACT pieces in all the result is
    the smallest packing; beyond, its distance from ``bound`` is known and README has it for each table."""
    best = best_fit(counts, size)
    need, least = sum(t for _, t in best), bound(counts, size)
    total = sum(n * c for n, c in counts.items())
    for spare in (0, *(1 << k for k in range(size.bit_length()))):
        if need <= least:
            break
        left = {n: c for n, c in counts.items() if c > 0}
        out, used, packed = [], 0, 0
        while left and used + -(-(total - packed) // size) < need:  # bound on the waste: can beat the best
            fill, times = _use(left, completion(left, max(left), size, spare))
            out.append((fill, times))
            used += times
            packed += times * sum(fill)
        if not left and used < need:
            best, need = out, used
    while need > least:
        best.sort(key=lambda x: sum(x[0]))
        taken: dict[tuple[int, ...], int] = {}
        pieces, some = 0, defaultdict(int)
        for fill, times in best:
            t = min(times, (EXACT - pieces) // len(fill))
            if t:
                taken[fill] = taken.get(fill, 0) + t
                pieces += t * len(fill)
                for n in fill:
                    some[n] += t
        done = exact(some, size, sum(taken.values()))
        if done is None:
            break
        kept = [(fill, times - min(times, taken.get(fill, 0))) for fill, times in _merged(best)]
        best = _merged([*((f, t) for f, t in kept if t), *((f, 1) for f in done)])
        need = sum(t for _, t in best)
    return best


def _merged(packing: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for fill, times in packing:
        out[fill] += times
    return list(out.items())


def plan(counts: dict[int, int], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: starts of rank intervals, and for each the first sequence, its step and offset."""
    table: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for fill, times in bin_completion(counts, size):
        at = 0
        for n in fill:
            table[n].append((taken[n], base, at))
            taken[n] += times
            at += n
        base += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in table.items()}


#: Rank cells over all lengths, about; a cell is what one window ranks.
CELLS = 4096


def pack(found: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to the pieces. The histogram and the cell counts that reach the
    driver have at most size and size + CELLS rows. Pieces are dealt to cells by their row, so rows that
    are alike in all columns spread too."""
    spark = found.sparkSession
    found = cut(found.withColumn("__cell", F.xxhash64(F.monotonically_increasing_id())))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    target = max(1, -(-sum(counts.values()) // CELLS))
    cells = [max(1, -(-counts.get(n, 0) // target)) for n in range(size + 1)]
    many = F.element_at(F.array(*[F.lit(c) for c in cells]), F.col("length").cast("int") + 1)
    placed = found.withColumn("__cell", F.pmod("__cell", many).cast("int"))
    first: dict[tuple[int, int], int] = {}
    before: dict[int, int] = defaultdict(int)
    for r in sorted(placed.groupBy("length", "__cell").agg(F.count("*").alias("n")).collect()):
        first[r["length"], r["__cell"]] = before[r["length"]]
        before[r["length"]] += r["n"]
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__cell").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sent = spark.sparkContext.broadcast((plan(counts, size), first))
    names = [c for c in found.columns if c != "__cell"]

    def run(batches):
        table, starts = sent.value
        for b in batches:
            length, cell, rank = (b.column(ranked_names.index(c)).to_numpy() for c in ("length", "__cell", "__rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for (n, c), at in pd.DataFrame({"n": length, "c": cell}).groupby(["n", "c"], sort=False).indices.items():
                r = rank[at] + starts[n, c]
                lo, base, offset = table[n]
                k = np.searchsorted(lo, r, "right") - 1
                seq[at], off[at] = base[k] + r - lo[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(b.column(ranked_names.index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    ranked_names = ranked.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in names)
    return ranked.mapInArrow(lean(run), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, size, end_id, keep_ids=keep_ids), size)
