"""Context assembly under a token budget, with source references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def formatted(repo: Column, path: Column, start: Column, end: Column, commit: Column, language: Column, content: Column) -> Column:
    head = F.concat(F.lit("# "), repo, F.lit("/"), path, F.lit("  L"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("  commit:"), F.substring(F.coalesce(commit, F.lit("")), 1, 8))
    return F.concat(head, F.lit("\n```"), language, F.lit("\n"), content, F.lit("\n```"))


def source_ref(score: Column) -> Column:
    return F.struct("file_path", "start_line", "end_line", F.substring("commit_hash", 1, 8).alias("commit_hash"), "repository_name", "node_name", "language", F.coalesce(score, F.lit(0.0)).alias("relevance_score"))


def budgeted(ranked: DataFrame, budget: int, top: int = 5, content: str = "content") -> DataFrame:
    """The leading rows of each query (query_id, rank) whose running token sum stays in the budget."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = ranked.where(F.col("rank") <= top).withColumn("tokens", T.token_estimate(F.col(content)))
    return t.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def greedy_callers(callers: DataFrame, budget: Column | int) -> DataFrame:
    """Caller notes (query_id, ord, tokens) taken in order, skipping those that overflow the budget;
    tokens are not negative. The room left only shrinks, so of equal token counts the first ones are
    taken and, after one is skipped, no more: rows beyond the budget's share of their count do not enter
    the array, which is bounded by the budget, save for notes of 0 tokens, all taken."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    w = Window.partitionBy("query_id", "tokens").orderBy("ord")
    note = F.when(F.col("nth") * F.col("tokens") <= budget, F.struct("ord", "tokens"))
    rows = callers.withColumn("nth", F.row_number().over(w)).groupBy("query_id").agg(F.array_sort(F.collect_list(note)).alias("a"), F.first(budget).alias("__budget"))
    start = F.struct(F.col("__budget").cast("long").alias("left"), F.array().cast("array<int>").alias("taken"))
    step = lambda s, x: F.when(x["tokens"] <= s["left"], F.struct((s["left"] - x["tokens"]).alias("left"), F.concat(s["taken"], F.array(x["ord"].cast("int"))).alias("taken"))).otherwise(s)
    got = rows.withColumn("got", F.aggregate("a", start, step))
    return got.select("query_id", "got.taken", "got.left")


#: Fixed value: the line that tells a model to use the history.
HISTORY_NOTE = "Continue this conversation. Use the earlier messages for context."


def transcript(history: Column, prompt: Column) -> Column:
    """A prompt after its history of (role, content) turns; without history the prompt alone."""
    said = F.transform(history, lambda h: F.concat(F.when(h["role"] == "user", "User: ").otherwise("Assistant: "), h["content"]))
    lines = F.concat(F.array(F.lit(HISTORY_NOTE), F.lit("")), said, F.array(F.concat(F.lit("User: "), prompt), F.lit("Assistant:")))
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, prompt).otherwise(F.array_join(lines, "\n"))


def ide_sources(chunks: Column) -> Column:
    """References as an editor shows them: unknown file, line 0 and no snippet where one lacks; null stays."""
    return F.transform(
        chunks,
        lambda c: F.struct(F.coalesce(c["file"], F.lit("unknown")).alias("file"), F.coalesce(c["line_start"], F.lit(0)).alias("lineStart"), F.coalesce(c["line_end"], F.lit(0)).alias("lineEnd"), F.coalesce(c["snippet"], F.lit("")).alias("snippet")),
    )
