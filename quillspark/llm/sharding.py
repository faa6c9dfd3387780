"""Histogram sort into shards of near-equal bytes, by DataFrame functions alone.

Key order: (big group?, hash of the text, hash of the id). Exact bytes and rows below evenly spaced
candidate boundaries are counted across partitions; only the interval that holds a splitter is
probed again, until it holds a single key. Then one exchange ranks the rows. A group of equal texts
stays whole unless it is over ``share`` of a shard; such big groups form the end of the key order and
are cut by row. Each candidate interval (cell) is ranked by itself, and a big group has cells of its
own in proportion to its rows, so a text that a third of all rows share is dealt over many tasks.

A shard i of n takes keys whose group (or, in big groups, row) starts at bytes total*i/n or more. Size
is the UTF-8 bytes plus 1; null counts as no bytes and equals the empty text for groups and checksum.
Rows equal in text and id are told apart by nothing and rank side by side, and rows with a null id are
ranked as if their id were the word null. Texts of any length count whole. Empty tables give empty
results. Only the id and text columns are read; others may have any name.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BITS = 12  # candidate boundaries of one probing round: 2 ** BITS
WIDTH = 60  # bits of a key hash
#: Rows of one cell of a big group, as a part of all rows.
CELL_PART = 4096


def _hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def _count(rows: DataFrame, *by: str):
    """{key: (bytes, rows, least h2, most h2...)}: at most 2**BITS groups for each open interval."""
    return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def splitters(keys: DataFrame, col: str, goals: dict[int, tuple[int, int]], lo: int, hi_bits: int):
    """For each goal (name: (bytes before the region, target bytes)): the smallest key k in the region
    such that the bytes of keys < k reach the target, with bytes and rows below it. Probing rounds
    narrow the intervals by 2**BITS each, until an interval is one key wide."""
    out: dict[int, tuple[int, int, int]] = {}
    open_: dict[int, tuple[int, int, int, int]] = {g: (0, hi_bits, a, 0) for g, (a, _) in goals.items()}  # prefix, bits left, bytes and rows below
    while open_:
        bits = {b for _, b, _, _ in open_.values()}.pop()
        step = max(0, bits - BITS)
        prefixes = sorted({p for p, _, _, _ in open_.values()})
        rows = keys.where(F.shiftright(col, bits).isin(prefixes)) if bits < hi_bits else keys
        got = defaultdict(list)
        for r in _count(rows.withColumn("b", F.shiftright(col, step)), "b").collect():
            got[r["b"] >> (bits - step)].append((r["b"], r["bytes"], r["rows"]))
        nxt = {}
        for g, (p, _, below, n) in open_.items():
            target = goals[g][1]
            for b, size, rows_ in sorted(got[p]):
                if below + size >= target or (b, size, rows_) == max(got[p]):
                    if step == 0:
                        out[g] = (b + 1, below + size, n + rows_) if below < target else (b, below, n)
                    else:
                        nxt[g] = (b, step, below, n)
                    break
                below, n = below + size, n + rows_
        open_ = nxt
    return out


def shard(docs: DataFrame, shards: int = 16, share: float = 0.01, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), _hash(body).alias("h1"), _hash(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h2"))
    rows = cut(rows)
    top = {r["b"]: (r["bytes"], r["rows"]) for r in _count(rows.withColumn("b", F.shiftright("h1", WIDTH - BITS)), "b").collect()}
    total, count = sum(b for b, _ in top.values()), sum(n for _, n in top.values())
    limit = int(total * share / shards)
    full = [b for b, (size, _) in top.items() if size > limit]
    big = []
    if full:  # at most shards / share groups can be over the limit
        big = sorted((r["h1"], r["bytes"], r["rows"]) for r in _count(rows.where(F.shiftright("h1", WIDTH - BITS).isin(full)), "h1").where((F.col("bytes") > limit) & (F.col("rows") > 1)).collect())
    cell_rows = max(1, count // CELL_PART)
    bits = {h: max(0, min(20, (-(-n // cell_rows) - 1).bit_length())) for h, _, n in big}
    spark = docs.sparkSession
    known = spark.createDataFrame(list(bits.items()) or [(-1, 0)], "h1 long, bits int")
    rows = rows.join(F.broadcast(known), "h1", "left")  # shards / share rows at most
    is_big = F.col("bits").isNotNull()
    small = rows.where(~is_big)
    for h, size, n in big:
        b = h >> (WIDTH - BITS)
        top[b] = (top[b][0] - size, top[b][1] - n)
    rest = sum(b for b, _ in top.values())
    rest_rows = count - sum(n for _, _, n in big)
    goals = {i: -(-total * i // shards) for i in range(1, shards)}
    cuts: dict[int, tuple[bool, int, int, int]] = {}  # shard: big?, h1, h2, rows below
    inner = {i: (0, t) for i, t in goals.items() if t <= rest}
    for i, (k, _, n) in splitters(small, "h1", inner, 0, WIDTH).items():
        cuts[i] = (False, k, 0, n)
    before, ranks = rest, rest_rows
    for h, size, n in big:
        inner = {i: (before, t) for i, t in goals.items() if before < t <= before + size}
        if inner:
            for i, (k, _, m) in splitters(rows.where(F.col("h1") == h), "h2", inner, 0, WIDTH).items():
                cuts[i] = (True, h, k, ranks + m)
        before, ranks = before + size, ranks + n
    # cells: intervals of h1, and of h2 within a big group
    cell = F.struct(F.when(is_big, F.col("h1")).otherwise(F.lit(-1)).cast("long").alias("big"), F.when(is_big, F.expr(f"shiftright(h2, {WIDTH} - bits)")).otherwise(F.shiftright("h1", WIDTH - BITS)).cast("long").alias("part"))
    placed = rows.withColumn("cell", cell)
    first, at = {}, 0
    got = {(-1, b): n for b, (_, n) in top.items() if n}
    if big:
        for r in placed.where(is_big).groupBy("cell").count().collect():
            got[r["cell"]["big"], r["cell"]["part"]] = r["count"]
    for k in sorted(got):
        first[k] = at
        at += got[k]
    starts = spark.createDataFrame([(*k, v) for k, v in first.items()] or [(-2, 0, 0)], "big long, part long, first long").select(F.struct("big", "part").alias("cell"), "first")
    order = Window.partitionBy("cell").orderBy("h1", "h2", "doc_id", "size", "text_crc32")
    ranked = placed.withColumn("in_cell", F.row_number().over(order) - 1).join(F.broadcast(starts), "cell")
    which, base = F.lit(0), F.lit(0).cast("long")
    for i in sorted(cuts):
        b, h1, h2, n = cuts[i]
        past = (is_big & ((F.col("h1") > h1) | ((F.col("h1") == h1) & (F.col("h2") >= h2)))) if b else (is_big | (F.col("h1") >= h1))
        which, base = F.when(past, i).otherwise(which), F.when(past, F.lit(n)).otherwise(base)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), which.cast("int").alias("shard"), (F.col("first") + F.col("in_cell") - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL of shard() over documents, with shards = 16 and share = 0.01. CRC-32 goes byte by byte
#: through the table that eight division steps of each byte give.
SQL = """
WITH RECURSIVE bit(n, c, k) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS tab FROM bit WHERE k = 8),
crc AS (
  SELECT body, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || x)::UBIGINT FOR x IN regexp_extract_all(hex(encode(body)), '..')]),
    lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32
  FROM (SELECT DISTINCT coalesce(text, '') AS body FROM documents), tab),
k AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(text, '') AS body,
         CAST(('0x' || substr(md5(coalesce(text, '')), 1, 15)) AS BIGINT) AS h1,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h2
  FROM documents),
g AS (SELECT *, sum(size) OVER (PARTITION BY h1) > floor((SELECT sum(size) FROM k) * 0.01 / 16) AND count(*) OVER (PARTITION BY h1) > 1 AS big FROM k),
c AS (
  SELECT *, sum(size) OVER (ORDER BY big, h1, CASE WHEN big THEN h2 ELSE 0 END RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            - sum(size) OVER (PARTITION BY big, h1, CASE WHEN big THEN h2 ELSE 0 END) AS start
  FROM g),
s AS (SELECT *, CAST(least(15, floor(start * 16 / (SELECT sum(size) FROM k))) AS INTEGER) AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY big, h1, h2, doc_id) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN crc USING (body)
"""
