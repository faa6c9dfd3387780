"""Ranked lexical search: integer scores over postings bucketed by term.

1. Tokenising gives one posting (term, row, doc_id, tf, n) for each term of a document, and one with
   the empty term for its length. Where the terms asked for are few (ASKED_TERMS and ASKED_BYTES, both
   counted) only theirs leave a task; otherwise all do. Postings lie bucketed by term and a salt of the
   document, so a term that a third of all rows hold fills as many buckets as there are partitions.
2. N, L and every term's df and greatest part of a score come from one aggregation.
3. Every item is first scored by its rarest terms alone. The kth best of these sums is a floor under its
   kth best score, for no match scores below 0.
4. Terms whose greatest scores add up to less than the floor cannot bring a document among the k best.
   The other terms are joined with the postings, each match is scored and summed by item and document;
   sums that cannot reach the floor with all that is left are dropped, and only what remains is joined
   with the terms set aside. So frequent words, which make most of the matches, are met by few documents.
5. A window ranks the sums of each item. The result is exact.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower
case. A null or blank text has no term, counts in nothing and is never returned; an item without a term
has no rows. Texts of any length are read whole, in slices. Equal scores rank by doc_id, then by row. Rows
that repeat a doc_id are documents each; rows that repeat an item_id are one item with the terms of all.
Rows with a null doc_id count in the statistics and are not returned; a null item_id is an item. Empty
tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept, lean, parts

#: Terms asked for, and bytes of them, up to which postings of other terms stay in their task, and up to
#: which rows of item terms are broadcast.
ASKED_TERMS, ASKED_BYTES = 200_000, 8 << 20
#: Documents that the terms of the first floor are in, about, for each result asked for.
RARE = 50
#: Bytes of text that are split at once.
SLICE = 1 << 20

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
POSTING = "term string, row long, doc_id long, tf long, n long"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text."""
    text, counts, at = text.translate(_TERM), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


def _posted(asked):
    """Postings of (row, doc_id, text); of the terms in ``asked`` only, where that is given."""

    def run(batches):
        want = None if asked is None else asked.value
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            terms, tf, at, size = [], [], [], []

            def out():
                k = np.array(at, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), b.column(0).take(pa.array(k)), b.column(1).take(pa.array(k)), pa.array(tf, pa.int64()), pa.array(size, pa.int64())], ["term", "row", "doc_id", "tf", "n"])

            for k in range(b.num_rows):
                counts = term_counts(texts[k].as_py() or b"")
                if not counts:
                    continue
                held = list(counts) if want is None else [t for t in counts if t in want]
                n = counts.total()
                terms += [b"", *held]
                tf += [0, *map(counts.__getitem__, held)]
                at += [k] * (len(held) + 1)
                size += [n] * (len(held) + 1)
                if len(at) > 1 << 16:
                    yield out()
                    terms, tf, at, size = [], [], [], []
            yield out()

    return run


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", asked: DataFrame | None = None) -> DataFrame:
    """(term, row, doc_id, tf, n, salt), bucketed and sorted by term; of the terms (term) of ``asked`` only,
    where that is given. The posting of the empty term stands for the whole document."""
    spark, known = docs.sparkSession, None
    if asked is not None:
        size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
        if size["n"] <= ASKED_TERMS and (size["b"] or 0) <= ASKED_BYTES:
            known = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in asked.collect()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    got = rows.mapInArrow(lean(_posted(known)), POSTING).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(parts(spark))).cast("int"))
    if asked is not None and known is None:
        got = got.join(asked.select("term").union(spark.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
    return got.repartition(parts(spark), "term", "salt").sortWithinPartitions("term", "row")


def item_terms(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times)."""
    rows = items.select(F.col(text).cast("string").alias("text"), F.col(id_col).alias("item_id"))

    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.large_binary())
            counts = [term_counts(x.as_py() or b"") for x in texts]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["item_id", "term", "times"])

    kind = dict(rows.dtypes)["item_id"]
    return rows.mapInArrow(run, f"item_id {kind}, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def scored(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of items (item_id, term, times) over postings that hold their terms."""
    spark = index.sparkSession
    whole = index.where("term = ''").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    total, length = whole["n"], whole["l"] or 1
    m = F.expr(f"75L + ((25L * n * {total}L) div {length}L)")
    index = index.where("term <> ''").withColumn("m", m).withColumn("part", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)"))
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1))).cast("long")
    stats = index.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("top")).withColumn("w", weight)
    asks = kept(items.join(stats, "term").where("w > 0").withColumns({"weight": F.col("times") * F.col("w"), "most": F.col("times") * F.col("w") * F.col("top")}), "asks")
    index = index.where("doc_id is not null").select("term", "salt", "row", "doc_id", "part")

    def matched(asks: DataFrame) -> DataFrame:
        """(item_id, row, doc_id, score): sums over the terms of asks."""
        asks = asks.select("item_id", "term", "weight")
        size = asks.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
        if size["n"] <= ASKED_TERMS and (size["b"] or 0) <= ASKED_BYTES:
            hits = index.join(F.broadcast(asks), "term")
        else:
            hits = index.join(asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts(spark) - 1)))), ["term", "salt"])
        return hits.groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("part")).alias("score"))

    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row")

    def kth(sums: DataFrame) -> DataFrame:
        """(item_id, floor): the kth best sum of each item that has k."""
        return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")

    rarest = Window.partitionBy("item_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = asks.withColumn("so_far", F.sum("df").over(rarest) - F.col("df")).where(F.col("so_far") < k * RARE)
    floors = kept(kth(matched(rare)), "floors")
    least = Window.partitionBy("item_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = asks.join(floors, "item_id", "left").withColumn("below", F.sum("most").over(least))
    split = kept(split.withColumn("aside", F.col("below") < F.coalesce("floor", F.lit(0))), "split")
    sums = kept(matched(split.where("not aside")), "sums")
    left = split.where("aside").groupBy("item_id").agg(F.sum("most").alias("left"))
    floors = kth(sums).unionByName(floors).groupBy("item_id").agg(F.max("floor").alias("floor"))
    bounds = kept(floors.join(left, "item_id", "left"), "bounds")
    near = sums.join(bounds, "item_id", "left").where(F.col("score") + F.coalesce("left", F.lit(0)) >= F.coalesce("floor", F.lit(0)))
    near = kept(near.select("item_id", "row", "doc_id", "score"), "near")
    rest = near.select("item_id", "row", "doc_id").join(split.where("aside").select("item_id", "term", "weight"), "item_id")
    rest = rest.join(index.select("term", "row", "part"), ["term", "row"]).select("item_id", "row", "doc_id", (F.col("weight") * F.col("part")).alias("score"))
    full = near.unionByName(rest).groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("score").alias("score")).where("score > 0")
    return full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    asked = kept(item_terms(items), "items")
    return scored(kept(postings(docs, asked=asked.select("term").distinct()), "postings"), asked, k)


#: DuckDB SQL of search() over documents and benchmark, for ids that are neither null nor repeated.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS len FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS n FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // len))))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
