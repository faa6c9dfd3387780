"""Retrieval quality: recall, precision and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured(cases: DataFrame, k: int = 5) -> DataFrame:
    """Adds recall, precision and rr to cases with arrays ``expected`` and ``retrieved`` (in order)."""
    top = F.slice("retrieved", 1, k)
    exp = F.array_distinct("expected")
    hits = F.size(F.array_intersect(exp, top))
    first = F.array_min(F.filter(F.transform(top, lambda x, i: F.when(F.array_contains("expected", x), i + 1)), lambda x: x.isNotNull()))
    return cases.withColumns(
        {
            "recall": F.when(F.size(exp) > 0, hits / F.size(exp)).otherwise(0.0),
            "precision": F.when(F.size("retrieved") > 0, hits / F.least(F.lit(k), F.size("retrieved"))).otherwise(0.0),
            "rr": F.coalesce(1 / first, F.lit(0.0)),
        }
    )


def summary(m: DataFrame, target: float = 0.95) -> DataFrame:
    return m.agg(F.count("*").alias("cases"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"), (F.avg("recall") >= target).alias("passed"))


def by_category(m: DataFrame) -> DataFrame:
    return m.groupBy("category").agg(F.count("*").alias("cases"), F.round(F.avg("recall"), 4).alias("recall"))


def failed(m: DataFrame, target: float = 0.95, n: int = 20) -> DataFrame:
    return m.where(F.col("recall") < target).orderBy("case_ord").limit(n)


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """n rows by the hash of seed and id: deterministic on any partitioning."""
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256), id_col).limit(n)


def heuristic_query(name: Column, parent: Column, doc: Column, calls: Column, language: Column) -> Column:
    sentence = F.trim(F.split_part(doc, F.lit("."), F.lit(1)), F.lit("\"' "))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(~has(name) | name.isin("anonymous", "unknown"), None)
        .when(has(parent), F.concat(F.lit("How does "), parent, F.lit("."), name, F.lit(" work in "), language, F.lit("?")))
        .when(has(doc) & (F.length(sentence) > 10), F.concat(sentence, F.lit("?")))
        .when(F.size(calls) > 0, F.concat(F.lit("Where is "), F.get(calls, 0), F.lit(" called in "), language, F.lit("?")))
        .otherwise(F.concat(F.lit("What does the "), name, F.lit(" function do?")))
    )


def category(name: Column, content: Column) -> Column:
    n, c = F.lower(name), F.lower(content)
    return F.when(n.rlike("auth|login|password|token|encrypt"), "security").when(n.rlike("test|spec|assert|mock"), "testing").when(c.rlike("exception|error|raise|panic|throw"), "debugging").otherwise("general")
