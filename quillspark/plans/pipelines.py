"""Whole plans: index build and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import inference, text
from ..functions.embed import hashing_embedding
from ..operators import chunking, context, files, graph, maintenance, postings, retrieval, substrings
from ..operators.store import Store
from ..storage import kept


#: What every row of the index says of where it comes from and who may see it.
ORIGIN = ["project_id", "tenant_id", "allowed_roles", "sensitivity_level", "branch", "commit_hash", "repository_name"]


#: Groups of files that the rows of a partition of the store are dealt in.
DEAL = 8


def file_chunks(files_: DataFrame, model: str = "hashing", version: str = "1", now: Column | None = None, part: Column | None = None) -> DataFrame:
    """Rows of the index for files (file_path, content, size, ORIGIN): filtered, redacted, chunked, of equal
    chunks of a file the first, embedded and stamped with model, version and time. They are dealt by files, or by
    ``part``, a number of a file, in DEAL groups each, so that they can be written by it without a shuffle more."""
    wanted = files_.where(files.indexable(F.col("file_path"), F.col("size")))
    clean = text.redact(F.coalesce("content", F.lit("")))
    wanted = wanted.select("file_path", clean.alias("content"), (clean != F.coalesce("content", F.lit(""))).alias("has_secrets_redacted"), files.language(F.col("file_path")).alias("language"), *ORIGIN)
    chunks = chunking.chunk_files(files_.sparkSession, wanted)
    by = ["project_id", "file_path", "chunk_hash"]
    if part is not None:
        dealt = {"__part": part, "__group": F.pmod(F.hash("file_path", "project_id"), F.lit(DEAL))}
        chunks, by = chunks.withColumns(dealt).repartition(*dealt), [*dealt, *by]
    first = maintenance.latest(chunks, by, [F.col("start_line")]).drop("__part", "__group")
    stamps = {"embedding_model": F.lit(model), "embedding_model_version": F.lit(version), "indexed_at": F.current_timestamp() if now is None else now}
    return first.withColumn("embedding", hashing_embedding(F.col("content"))).withColumns(stamps)


def deduplicated(chunks: DataFrame) -> DataFrame:
    """Of equal chunks of a project the first, by file and line."""
    return maintenance.latest(chunks, ["project_id", "chunk_hash"], [F.col("file_path"), F.col("start_line")])


def build_index(
    spark: SparkSession, tree: DataFrame, project: str, repository: str, *, tenant: str = "", roles: tuple[str, ...] = ("developer",),
    sensitivity: str = "internal", branch: str = "main", commit: str = "unknown", root: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(chunks, edges) of a file tree (path, content, size); ``retrieve`` searches these chunks. Paths lose
    ``root`` where they begin with it."""
    origin = dict(zip(ORIGIN, [F.lit(project), F.lit(tenant), F.array(*map(F.lit, roles)).cast("array<string>"), F.lit(sensitivity), F.lit(branch), F.lit(commit), F.lit(repository)]))
    path = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 30)).otherwise(F.col("path"))
    chunks = file_chunks(tree.withColumn("file_path", path).withColumns(origin))
    return deduplicated(chunks), graph.edges_of(chunks)


def apply_changes(store: Store, changes: DataFrame, epoch: int, stream: str = "changes") -> None:
    """Brings the stored chunks up to changed files (file_path, content, size, removed, ts, ORIGIN): of each
    file the latest change holds; its old rows go, and what it is now is filtered, redacted, chunked,
    embedded and stored, in one commit of the partitions that the files are in. An epoch that is stored
    already is left out, so a batch may come again after a failure. Changes are read more than once."""
    if store.seen(stream, epoch):
        return
    keys = list(store.keys)
    last = changes
    if changes.groupBy(*keys).count().where("count > 1").limit(1).count():  # else nothing but keys is shuffled for it
        last = kept(maintenance.latest(changes, keys, [F.desc("ts"), F.col("removed")]), "changes")
    touched = sorted(r[0] for r in last.select(store.part()).distinct().collect())  # as many as the store has at most
    if not touched:
        return
    rows = file_chunks(last.where("not removed"), part=store.part())
    held = store.read(touched)
    if held is not None:
        rows = held.join(last.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows)
    store.commit(rows, touched, stream, epoch, dealt=True)


def delta_stream(changes: DataFrame, store: Store, checkpoint: str, stream: str = "changes"):
    """A streaming query that applies all changes that are there, from where its checkpoint ends."""
    write = changes.writeStream.foreachBatch(lambda batch, epoch: apply_changes(store, batch, epoch, stream))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a text model is asked, before the query.
ASK = "Write at most twenty lines of code that answer this question, and nothing else:\n\n"


def hypothetical(queries: DataFrame, load: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """queries with the snippet that a text model writes for each, null where it has none."""
    return queries.withColumn("hypothetical", inference.generated(F.concat(F.lit(ASK), "query"), load))


def searched(asked: DataFrame) -> Column:
    """The text whose vector is searched for: the hypothetical snippet, where there is one, or the normalised query."""
    return F.coalesce(F.nullif("hypothetical", F.lit("")), "normalised") if "hypothetical" in asked.columns else F.col("normalised")


def retrieve(queries: DataFrame, chunks: DataFrame, edges: DataFrame | None = None, k: int = 5, wide: int = 20, budget: int = 3000, threshold: float | None = 0.65, index: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, context, sources, callers, tokens) of requests (query_id, query, projects, roles, vector)
    over chunks (chunk_id, content, project_id, allowed_roles, embedding, file_path, start_line, end_line,
    commit_hash, repository_name, node_name, language). Without a column vector the queries' search text
    (``searched``) is embedded; BM25 and symbols always ask for the query itself.

    Requests see rows of their projects that one of their roles may see, before anything is ranked.
    Dense, BM25 and symbol lists are fused; the ``wide`` best are reranked against the query, and the k best
    of these enter the context while the budget lasts, followed by first callers; edges are (src, dst) of repository::file::name.
    index is a folder of stored postings of these chunks with their access, if there is one; texts are the chunks without
    vectors, where these are joined to them from elsewhere."""
    asked = queries.withColumn("normalised", text.normalise(F.col("query")))
    if "vector" not in queries.columns:
        asked = asked.withColumn("vector", hashing_embedding(searched(asked)))
    asked = asked.withColumn("query", F.col("normalised"))
    body = chunks.withColumnRenamed("chunk_id", "id")
    lists = [
        retrieval.dense(body, asked, wide, threshold, "id", "embedding", access=True, own=True),
        retrieval.bm25(body, asked, "id", "content", wide, access=True) if index is None else postings.search(chunks.sparkSession, index, asked, wide, access=True),
        named(body, asked),
    ]
    fused = retrieval.fuse(lists, wide).join(asked.select("query_id", F.col("normalised").alias("query")), "query_id").withColumnRenamed("score", "relevance")
    parts = (chunks if texts is None else texts).withColumn("id", F.col("chunk_id").cast("string")).drop("chunk_id")
    best = retrieval.rerank(parts.join(retrieval.bounded(fused, asked, wide), "id"), k=k).drop("score")
    place = F.col("start_line"), F.col("end_line")
    best = best.withColumn("content", text.neutralise(F.col("content"), F.col("file_path"), *place))
    used = context.budgeted(best, budget, k)
    block = context.formatted(F.col("repository_name"), F.col("file_path"), *place, F.col("commit_hash"), F.col("language"), F.col("content"))
    rows = used.select("query_id", "rank", "tokens", F.concat_ws("::", "repository_name", "file_path", "node_name").alias("node"), block.alias("block"), context.source_ref(F.col("relevance")).alias("source"))
    each = lambda c: F.transform("r", lambda x: x[c])
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens", "block", "source"))).alias("r"), F.sum("tokens").alias("tokens"))
    out = out.select("query_id", each("block").alias("blocks"), each("source").alias("sources"), "tokens")
    if edges is not None:
        w = Window.partitionBy("query_id").orderBy("rank", "nth")
        first = graph.first_callers(edges).select(F.col("dst").alias("node"), F.posexplode("called_by").alias("nth", "caller"))
        notes = rows.select("query_id", "rank", "node").join(first, "node").withColumn("ord", F.row_number().over(w))
        notes = notes.withColumn("tokens", text.token_estimate(F.concat(F.lit("# Caller: "), "caller", F.lit("\n")))).join(out.select("query_id", (F.lit(budget) - F.col("tokens")).alias("left")), "query_id").where("left > 200")
        taken = context.greedy_callers(notes, F.col("left"))
        names = notes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "caller", "tokens"))).alias("n"))
        names = names.join(taken, "query_id").withColumn("n", F.filter("n", lambda x: F.array_contains(F.col("taken"), x["ord"])))
        spent = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x["tokens"])
        out = out.join(names.select("query_id", F.transform("n", lambda x: x["caller"]).alias("callers"), spent.alias("spent")), "query_id", "left")
        out = out.withColumn("tokens", F.col("tokens") + F.coalesce("spent", F.lit(0)))
    else:
        out = out.withColumn("callers", F.lit(None).cast("array<string>"))
    callers = F.coalesce("callers", F.array().cast("array<string>"))
    notes = F.transform(callers, lambda c: F.concat(F.lit("# Caller: "), c, F.lit("\n")))
    return out.select("query_id", F.array_join(F.concat("blocks", notes), "\n\n---\n\n").alias("context"), "sources", callers.alias("callers"), "tokens")


def named(chunks: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """Ranked list (query_id, rank, id) of the chunks whose name holds a keyword of the query: the first
    k that the request may see for each keyword, keywords in their order."""
    words = asked.select("query_id", "projects", "roles", F.posexplode(text.identifiers(F.col("normalised"))).alias("pos", "keyword"))
    hit = substrings.holding(chunks.select("id", "node_name", "project_id", "allowed_roles"), "node_name", words, "keyword")
    hit = hit.where(retrieval.accessible(*map(F.col, ("project_id", "allowed_roles", "projects", "roles"))))
    of_word = Window.partitionBy("query_id", "pos").orderBy("id")
    hit = hit.withColumn("nth", F.row_number().over(of_word)).where(F.col("nth") <= k)
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "nth"))).select("query_id", "rank", "id")
