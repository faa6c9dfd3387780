"""Symbol graph over edge tables (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def edges_of(chunks: DataFrame) -> DataFrame:
    """One edge for each (fqn, callee) of chunks with an array of calls."""
    return chunks.select(F.col("fqn").alias("src"), F.explode("calls").alias("dst"), F.lit("calls").alias("relation")).distinct()


def last_wins(edges: DataFrame, order: str = "ord") -> DataFrame:
    """A repeated pair keeps its last relation."""
    return edges.groupBy("src", "dst").agg(F.max_by("relation", order).alias("relation"))


def callers(edges: DataFrame, starts: DataFrame, depth: int | None = 2) -> DataFrame:
    """(start, node, depth): nodes that reach a start within depth steps, or all of them if depth is None
    or 99 or more; the start left out. Each round joins the new frontier with the edges, until a
    frontier is empty; seen nodes are left out, so cycles end."""
    spark = edges.sparkSession
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    seen = frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    parts, d = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    while depth is None or depth >= 99 or d < depth:
        d += 1
        step = frontier.withColumnRenamed("node", "to").join(e, "to").select("start", "node", F.lit(d).alias("depth")).distinct()
        frontier = cut(step.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % 8 == 0:  # else a long walk unites as many frontiers as it has steps
            seen = cut(seen.coalesce(parts))
    return seen.where("node <> start")


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes, edges.src == nodes.node, "left_semi").select("src", "dst").distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("importance")).withColumnRenamed("dst", "node")


def node_count(edges: DataFrame) -> DataFrame:
    return edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))


def first_callers(edges: DataFrame, n: int = 2) -> DataFrame:
    w = Window.partitionBy("dst").orderBy("src")
    return edges.select("src", "dst").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("called_by"))


def context(edges: DataFrame) -> DataFrame:
    """(fqn, importance, called_by, n_calls) of every node."""
    e = edges.select("src", "dst").distinct()
    w = Window.partitionBy("dst").orderBy("src")
    first = e.withColumn("n", F.row_number().over(w)).where("n <= 2")  # cut before the exchange, so a hot target is no matter
    first = first.groupBy(F.col("dst").alias("fqn")).agg(F.array_sort(F.collect_list("src")).alias("called_by"))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("fqn"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("fqn"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x"))
    degrees = ends.groupBy("x.fqn").agg(F.sum("x.into").alias("importance"), F.sum("x.out").alias("n_calls"))
    return degrees.join(first, "fqn", "left").select("fqn", "importance", "called_by", "n_calls")


#: About as many calls of one name in a project meet in one group; more are dealt over more groups.
CALLS = 8192


def resolve(edges: DataFrame, nodes: DataFrame, calls: int = CALLS) -> DataFrame:
    """Raw callee names joined with the names of the same project's nodes: (project_id, src, fqn), for edges
    (project_id, src, dst) and nodes (project_id, node_name, fqn). A name that is defined more than once gives
    all of its nodes. Repeated calls and nodes count once before they meet, and the calls of a frequent name are
    dealt over as many groups as their count asks for, each with the nodes of that name."""
    by = ["project_id", "node_name"]
    raw = edges.select("project_id", "src", F.element_at(F.split("dst", "\\."), -1).alias("node_name")).dropna().distinct()
    to = nodes.select(*by, "fqn").dropna().distinct()
    many = raw.groupBy(*by).agg(F.ceil(F.count("*") / calls).cast("int").alias("groups"))
    to = to.join(many, by).select(*by, "fqn", "groups", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("n"))
    raw = raw.join(many.where("groups > 1"), by, "left").withColumn("n", F.pmod(F.xxhash64("src"), F.coalesce("groups", F.lit(1))).cast("int"))
    return raw.drop("groups").join(to.drop("groups"), [*by, "n"]).select("project_id", "src", "fqn").distinct()
