"""MinHash near-duplicate detection with b-bit signatures.

Words are maximal runs of bytes other than space and \\t-\\r after lower-casing A-Z; a document's set
holds its distinct word shingles as 64-bit hashes (the whole sequence if it has fewer words; a set of
n shingles loses one to a collision with odds of n * n / 2**65). Documents are linked when
100 * intersection >= percent * union.

1. Equal sets collapse into classes, with partial aggregation first, so copies never meet pairwise and
   only classes take part in links. A class is named by its smallest document id.
2. A class has HASHES minima: bands of them make bucket keys, and BITS low bits of each are packed as
   its signature. The rows of a band follow from ``percent`` so that a pair at the threshold misses
   every bucket with odds under MISS (5e-8 at 80).
3. Candidates of a bucket are pairs of each member with the bucket's smallest, so a bucket of any size
   gives as many pairs as members. Pairs pass a size bound and the collision-corrected estimate from
   bit counts (ERRORS standard errors under the threshold, odds of 1e-6); both are exact column arithmetic.
4. Candidates are confirmed on full sets, the likeliest partner of each class first, then those still
   in two components. Sets are computed once for the classes that have candidates and lie dealt by
   class; a pair moves one set to the other, whose copies are salted where a class has many partners.
5. Buckets of three members or more that still hold two components are searched in full, in blocks
   dealt by rows and by bytes of sets. Signatures alone first tell which members have a likely partner
   in another component; only these are given their sets, and only confirmed links leave a task. A
   pair is looked at in the first bucket that it shares and nowhere else. A bucket that would need
   more copies of a member than there are bands is split by every other band first (a pair at 80 that
   shares no second band has odds of 1e-6).
6. Components come from min-label propagation with pointer jumping; later rounds only handle the roots
   of earlier ones.

Null and blank texts have an empty set and are linked with nothing. Rows with a null id take no part
in links: they are their own (null) component and kept. Rows that share an id are one document: what
is linked with one of them is linked with all, and each row is returned with its own set's size.
Texts of any length are read whole, in slices. Ties cannot arise: of a component the smallest id is
kept. Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import cut, kept, lean, parts

HASHES, BITS = 128, 4
#: Odds that a pair at the threshold may miss every bucket with, and the standard errors of as rare an
#: underestimate from the signatures.
MISS, ERRORS = 1e-6, 4.75
#: Members of a block of an open bucket, and bytes of their sets, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Pairs that one copy of a set is held against.
PARTNERS = 256

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C = np.uint64(0xD6E8FEB86659FD93)


def band_rows(percent: int) -> int:
    """Most minima of a band with which a pair at the threshold is missed with odds under MISS."""
    j = percent / 100
    fit = [r for r in (1, 2, 4, 8, 16) if (1 - j**r) ** (HASHES // r) <= MISS]
    if not fit:
        raise ValueError(f"{HASHES} hashes are too few for links at {percent} percent")
    return max(fit)


def least_estimate(percent: int) -> float:
    j, chance = percent / 100, 1 / (1 << BITS)
    q = j + (1 - j) * chance
    return j - ERRORS * (q * (1 - q) / HASHES) ** 0.5 / (1 - chance)


def shingle_sets(column, words: int):
    """Yields (document number, sorted distinct 64-bit shingle hashes) for each text of a column."""
    data, off = bpe.buffers(column)
    doc, held, carry = -1, [], np.zeros(0, np.uint64)

    def done():
        if not held and len(carry):
            with np.errstate(over="ignore"):
                total = np.uint64(len(carry))
                for h in carry:
                    total = total * _C + h
            return bpe.mix(np.array([total]))
        return np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)

    for raw, docs, which in bpe.slices(data, off):
        b = _LOWER[raw]
        text = ~_SPACE[b]
        first = np.zeros(len(b) + 1, bool)
        first[docs] = True
        before = np.zeros(len(b), bool)
        before[1:] = text[:-1]
        at = np.flatnonzero(text & (~before | first[:-1]))
        after = np.zeros(len(b), bool)
        after[:-1] = text[1:]
        end = np.flatnonzero(text & (~after | first[1:])) + 1
        h = bpe.hashes(b, at, end) if len(at) else np.zeros(0, np.uint64)
        lim = np.searchsorted(at, np.append(docs, len(b)))
        for k, d in enumerate(which):
            if d != doc:
                if doc >= 0:
                    yield doc, done()
                doc, held, carry = int(d), [], np.zeros(0, np.uint64)
            w = np.concatenate([carry, h[lim[k] : lim[k + 1]]])
            n = len(w) - words + 1
            if n > 0:
                with np.errstate(over="ignore"):
                    s = np.full(n, words, np.uint64)
                    for j in range(words):
                        s = s * _C + w[j : j + n]
                held.append(bpe.mix(s))
            carry = w[max(0, len(w) - words + 1) :] if n > 0 else w
    if doc >= 0:
        yield doc, done()


def minima(s: np.ndarray) -> np.ndarray:
    x = s.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096, None] * _A + _B).min(axis=0), out=out)
    return out


def signature(m: np.ndarray) -> np.ndarray:
    low = (m >> np.uint32(7)).astype(np.uint8) & np.uint8((1 << BITS) - 1)
    return (low[::2] | (low[1::2] << np.uint8(4))).view("<i8")


def corrected(apart):
    """The similarity from the number of low bits' groups that differ, less chance collisions."""
    chance = 1 / (1 << BITS)
    return (1 - apart / HASHES - chance) / (1 - chance)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures, by bit counts."""

    def apart(k: int) -> Column:
        x = a[k].bitwiseXOR(b[k])
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    words = HASHES * BITS // 64
    return corrected(sum((apart(k) for k in range(1, words)), apart(0)))


SIGNED = "doc_id long, n_shingles long, set_key binary, sig array<long>, keys array<long>"
LONGS = pa.list_(pa.int64())


def _sign(words: int, rows: int):
    def run(batches):
        for b in batches:
            n, key, sig, keys = [], [], [], []
            for _, s in shingle_sets(b.column(1), words):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if not len(s):
                    sig.append(None)
                    keys.append(None)
                    continue
                m = minima(s)
                sig.append(signature(m))
                wide = m.reshape(-1, rows).astype(np.uint64)
                h = np.arange(len(wide), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(rows):
                        h = bpe.mix(h * _C + wide[:, j])
                keys.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, LONGS), pa.array(keys, LONGS)], ["doc_id", "n_shingles", "set_key", "sig", "keys"])

    return run


def _sets(words: int):
    """(rep, set) of each row; of equal rows in one task one."""

    def run(batches):
        seen: set[tuple[int, bytes]] = set()
        for whole in batches:
            for b in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                rep, out = [], []
                for d, s in zip(b.column(0).to_pylist(), (s for _, s in shingle_sets(b.column(1), words))):
                    mark = d, hashlib.blake2b(s.tobytes(), digest_size=8).digest()
                    if mark not in seen:
                        seen.add(mark)
                        rep.append(d)
                        out.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(out, LONGS)], ["rep", "set"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over links (a, b)."""
    both = kept(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    label = kept(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"), "labels")
    while True:
        far = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(far.withColumnRenamed("a", "id"), "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = kept(step.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        label = step.select("id", "root")
        if step.where("old <> root").isEmpty():
            return label


class Links:
    """Confirmed links so far, as (id, root) labels, with what confirms more of them."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.label: DataFrame | None = None
        self.sets: list[DataFrame] = []

    def rooted(self, rows: DataFrame, col: str, root: str) -> DataFrame:
        if self.label is None:
            return rows.withColumn(root, F.col(col))
        return rows.join(self.label.select(F.col("id").alias(col), F.col("root").alias("__root")), col, "left").withColumn(root, F.coalesce("__root", col)).drop("__root")

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs that lie in two components."""
        if self.label is None:
            return pairs
        return self.rooted(self.rooted(pairs, "a", "ra"), "b", "rb").where("ra <> rb").drop("ra", "rb")

    def add(self, links: DataFrame) -> None:
        if self.label is None:
            self.label = components(links)
            return
        ids = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct().join(self.label, "id", "left_anti")
        every = self.label.union(ids.select("id", F.col("id").alias("root")))
        roots = self.rooted(self.rooted(links, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        top = components(roots).select(F.col("id").alias("root"), F.col("root").alias("top"))
        self.label = kept(every.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "labels")

    def need(self, reps: DataFrame) -> None:
        """Computes the sets of the classes (rep) that have none yet; they are dealt by class."""
        for known in self.sets:
            reps = reps.join(known.select("rep"), "rep", "left_anti")
        reps = kept(reps, "reps")
        if not reps.isEmpty():
            got = self.docs.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(lean(_sets(self.words)), "rep long, set array<long>")
            self.sets.append(cut(got.repartition(parts(self.docs.sparkSession), "rep")))

    def with_sets(self, rows: DataFrame, rep: str, out: str) -> DataFrame:
        return reduce(DataFrame.union, [rows.join(s.select(F.col("rep").alias(rep), F.col("set").alias(out)), rep) for s in self.sets])

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        many = kept(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > PARTNERS).select("a", F.ceil(F.col("n") / PARTNERS).alias("k")), "salts")
        pairs = pairs.select("a", "b").join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1))).alias("salt"))
        left = self.with_sets(pairs.select("a", "salt").distinct(), "a", "x")
        right = self.with_sets(pairs, "b", "y")
        shared = F.size(F.array_intersect("x", "y"))
        holds = 100 * shared >= self.percent * (F.size("x") + F.size("y") - shared)
        return kept(left.join(right, ["a", "salt"]).where(holds).select("a", "b"), "links")

    def settle(self, candidates: DataFrame) -> None:
        """Confirms candidates (a, b, estimate): the likeliest of each b, then the others across components."""
        best = candidates.groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("a"))).alias("m"))
        best = kept(best.select((-F.col("m.a")).alias("a"), "b"), "best")
        self.add(self.confirmed(best))
        rest = kept(self.across(candidates.select("a", "b").join(best, ["a", "b"], "left_anti")), "rest")
        if not rest.isEmpty():
            self.add(self.confirmed(rest))


def find(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = kept(docs.mapInArrow(lean(_sign(words, band_rows(percent))), SIGNED), "signed")
    own = signed.where("set_key is not null and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sig", "keys")]
    classes = kept(own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *firsts), "classes")
    nodes = classes.select("rep", F.col("n_shingles").alias("n"), "sig")
    member = classes.select("rep", F.explode("keys").alias("key"))
    crowd = kept(member.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.count("*").alias("many")).where("centre < last").drop("last"), "crowd")
    crowded = kept(member.join(crowd, "key"), "crowded")

    def likely(pairs: DataFrame) -> DataFrame:
        x = nodes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = nodes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        p = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return kept(p.select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("estimate")).where(F.col("estimate") >= least_estimate(percent)), "candidates")

    links = Links(docs, words, percent)
    star = likely(crowded.where("centre < rep").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    if not star.isEmpty():
        links.need(star.select(F.col("a").alias("rep")).union(star.select("b")).distinct())
        links.settle(star)
    more = _searched(links, links.rooted(crowded.where("many > 2"), "rep", "root"), classes, percent)
    if more is not None:
        links.add(more)
    named = own.select("doc_id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    twice = kept(named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b"), "twice")
    if not twice.isEmpty():  # ids of several texts
        links.add(named.join(twice.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")))
    rows = signed.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "rep"), "set_key", "left")
    rows = links.rooted(rows.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))), "rep", "component_id")
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def _searched(links: Links, rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """Links across components in the buckets (key, rep, centre, root) that hold several, if any."""
    bands = HASHES // band_rows(percent)
    some = kept(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "open")
    if some.isEmpty():
        return None
    members = classes.select("rep", F.col("n_shingles").alias("n"), "sig", "keys")
    rows = kept(rows.select("key", "rep", "centre", "root").join(some, "key").join(members, "rep"), "open_rows")

    def dealt(rows: DataFrame) -> DataFrame:
        """With k, the blocks of each group (key, other)."""
        size = F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES, F.lit(1))
        groups = rows.groupBy("key", "other").agg(F.ceil(size).cast("int").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        return rows.join(kept(groups.select("key", "other", "k"), "groups"), ["key", "other"])

    deals = dealt(rows.withColumn("other", F.lit(0).cast("long")))
    large = deals.where(F.col("k") > bands)
    deals = deals.where(F.col("k") <= bands)
    if not large.isEmpty():
        large = kept(dealt(large.drop("k").withColumn("other", F.explode("keys")).where("other <> key")), "open_rows")
        deals = deals.unionByName(large)
    r = deals.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    r = r.withColumns({"lo": F.least("part", "j"), "hi": F.greatest("part", "j")}).select(*GROUP, *MEMBER)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts(rows.sparkSession), *GROUP).sortWithinPartitions(*GROUP)

    found = kept(grouped(r).mapInArrow(lean(_blocks(percent, False)), r.schema), "likely")
    if found.isEmpty():
        return None
    links.need(found.select("rep").distinct())
    full = links.with_sets(found, "rep", "set").select(*GROUP, *MEMBER, "set")
    return kept(grouped(full).mapInArrow(lean(_blocks(percent, True)), "a long, b long").distinct(), "links")


GROUP, MEMBER = ("key", "other", "lo", "hi"), ("part", "rep", "root", "centre", "n", "sig", "keys")


def _blocks(percent: int, exact: bool):
    """Compares the members of each group of rows, which lie side by side. Not exact: the rows that have
    a likely partner in another component. Exact: the links found with their sets."""
    least = least_estimate(percent)
    wide = HASHES * BITS // 8

    def pairs(key, other, lo, hi, part, rep, root, centre, n, sig, keys):
        """Likely pairs (i, j) across components, each in the first bucket that it shares only."""
        fresh = np.ones(len(key), bool)
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (key, other, lo, hi)])
        start = np.flatnonzero(fresh)
        end = np.repeat(np.append(start[1:], len(key)), np.diff(np.append(start, len(key))))
        at, d = np.arange(len(key)), 1
        while len(at := at[at + d < end[at]]):
            for k in range(0, len(at), 1 << 15):
                i = at[k : k + (1 << 15)]
                j = i + d
                ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                ok &= (rep[i] != centre[i]) & (rep[j] != centre[j])  # pairs with the centre are known
                ok &= (lo[i] == hi[i]) | (part[i] != part[j])
                i, j = i[ok], j[ok]
                x = sig[i] ^ sig[j]
                likely = corrected(((x & 15) != 0).sum(1) + ((x >> 4) != 0).sum(1)) >= least
                i, j = i[likely], j[likely]
                same = keys[i] == keys[j]
                first = same.argmax(1)
                ok = keys[i, first] == key[i]
                same[np.arange(len(i)), first] = False
                second = same.argmax(1)
                ok &= (other[i] == 0) | (same.any(1) & (keys[i, second] == other[i]))
                yield from zip(i[ok].tolist(), j[ok].tolist())
            d += 1

    def compare(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        plain = [t.column(c).to_numpy() for c in (*GROUP, *MEMBER[:5])]
        rows = len(plain[0])
        flat = [t.column(c).chunk(0).flatten().to_numpy() for c in ("sig", "keys")]
        found = pairs(*plain, flat[0].view(np.uint8).reshape(rows, wide), flat[1].reshape(rows, -1))
        if not exact:
            has = np.zeros(rows, bool)
            for i, j in found:
                has[i] = has[j] = True
            return t.filter(pa.array(has)).combine_chunks().to_batches()
        rep, root, sets = plain[5], plain[6], t.column("set").chunk(0)
        parent, links = {x: x for x in root.tolist()}, []

        def top(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        full = [sets[k].values.to_numpy() for k in range(rows)]
        for i, j in found:
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y:
                both = len(full[i]) + len(full[j]) - len(np.unique(np.concatenate([full[i], full[j]])))
                if 100 * both >= percent * (len(full[i]) + len(full[j]) - both):
                    parent[x] = y
                    links.append((int(rep[i]), int(rep[j])))
        return [pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in range(2)], ["a", "b"])]

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last group, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            mark = [t.column(c).to_numpy() for c in GROUP]
            last = np.logical_or.reduce([m != m[-1] for m in mark])
            whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = t.slice(whole).to_batches()
            if whole:
                yield from compare(t.slice(0, whole))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates, with all their columns: of each component the smallest id
    stays. Rows with a null id stay; of rows that repeat an id and stay, each stays."""
    gone = find(docs, words, percent, id_col, text).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


#: DuckDB SQL of find() over documents, with words = 2 and percent = 80: all pairs of distinct sets that share
#: a shingle, on the shingles themselves. For ids that are neither null nor repeated.
SQL = """
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([x || ' ' || w[i + 1] FOR x, i IN w[:-2]]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM s),
c AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM n WHERE n > 0 GROUP BY 1),
e AS (SELECT rep, n, unnest(s) AS x FROM c JOIN s ON s.doc_id = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, root) AS (SELECT a, a FROM g UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.id),
l AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
o AS (SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(l.root, c.rep, n.doc_id) AS component_id FROM n LEFT JOIN c ON c.h = n.h AND n.n > 0 LEFT JOIN l ON l.id = c.rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""
