"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit.

Null texts count as empty (length 0); an empty table gives an empty histogram. Repeated rows count
each. Only the text column is read; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .shared import lean


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """A one-column DataFrame: the number of tokens of each whole text."""

    def run(batches):
        e = Encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(e.counts(b.column(0)))], [out])

    return docs.select(F.col(text).alias("text")).mapInArrow(lean(run), f"{out} long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs): partial sums on each task come before the shuffle, so it carries at most a
    row for each length and task."""
    return lengths.groupBy(F.col(col).alias("n_tokens")).agg(F.count("*").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of length >= L and totals if every document were cut
    to L tokens. One row for each distinct length (bounded by the longest document, not the rows),
    so the single-partition window is over the histogram alone."""
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("n_tokens") * F.col("docs")
    h = histogram.withColumns({"docs_up_to": F.sum("docs").over(up), "tokens_up_to": F.sum(own).over(up)})
    every = Window.partitionBy()
    h = h.withColumns({"all_docs": F.sum("docs").over(every), "all_tokens": F.sum(own).over(every)})
    return h.select(
        "n_tokens", "docs", "docs_up_to", "tokens_up_to",
        (F.col("all_docs") - F.col("docs_up_to") + F.col("docs")).alias("docs_at_least"),
        (F.col("all_tokens") - F.col("tokens_up_to") + own).alias("tokens_at_least"),
        (F.col("tokens_up_to") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_up_to"))).alias("truncated_tokens"),
        (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"),
    )


def answers(sums: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(kind, at, value) of any context limits (total tokens after truncation, documents that fit)
    and of exact quantiles (least length that at least that share does not exceed)."""
    s = sums
    of = [
        s.agg(F.lit("truncated_tokens").alias("kind"), F.lit(float(m)).alias("at"),
              (F.coalesce(F.sum(F.when(F.col("n_tokens") <= m, F.col("n_tokens") * F.col("docs"))), F.lit(0)) + m * F.coalesce(F.sum(F.when(F.col("n_tokens") > m, F.col("docs"))), F.lit(0))).alias("value"))
        for m in limits
    ] + [
        s.where(F.col("quantile") >= q).agg(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("at"), F.min("n_tokens").alias("value"))
        for q in quantiles
    ]
    out = of[0]
    for x in of[1:]:
        out = out.unionByName(x)
    return out
