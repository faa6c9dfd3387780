"""Model inference over a table: small batches, retries with backoff, and rows that say what went wrong.

A model is what ``load`` returns: a function from a list of texts to a list of vectors. Each worker loads it
once for its name and version. Texts go to it BATCH at a time; a call that raises is tried again after a wait
that doubles, ATTEMPTS times in all, and then its rows come out without a vector and with the error. Every row
comes out once, with the model's name and version and the time of the query. Null texts are not sent.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import ship

BATCH, ATTEMPTS, WAIT = 32, 3, 0.5
#: Rows of which texts and vectors are held at once; whole batches of the model fit in.
ROWS = 1024
Model = Callable[[list[str]], list[list[float]]]
_loaded: dict[tuple[str, str], Model] = {}


def answered(model: Model, texts: list[str], attempts: int, wait: float) -> tuple[list, str | None]:
    """(vectors, None) of a batch, or (nulls, error) when all attempts have failed."""
    for n in range(attempts):
        try:
            got = model(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return list(got), None
        except Exception as e:  # a model may raise anything; the row keeps it
            if n + 1 == attempts:
                return [None] * len(texts), f"{type(e).__name__}: {e}"
            time.sleep(wait * 2**n)
    raise ValueError("attempts must be positive")


def inferred(load: Callable[[], Model], key: tuple[str, str], batch: int, attempts: int, wait: float):
    """The batches of a task (the text is the last column) with vector and error."""

    def run(batches):
        if key not in _loaded:
            _loaded[key] = load()
        model = _loaded[key]
        rows = max(1, ROWS // batch) * batch
        for b in (whole.slice(j, rows) for whole in batches for j in range(0, max(1, whole.num_rows), rows)):
            texts = b.column(b.num_columns - 1).to_pylist()
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            some = [n for n, t in enumerate(texts) if t is not None]
            for at in range(0, len(some), batch):
                mine = some[at : at + batch]
                got, error = answered(model, [texts[n] for n in mine], attempts, wait)
                for n, v in zip(mine, got):
                    vectors[n], errors[n] = v, error
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*b.schema.names[:-1], "embedding", "embedding_error"])

    return run


def embedded(rows: DataFrame, text, load: Callable[[], Model], model: str, version: str, batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """rows with embedding, embedding_error, embedding_model, embedding_model_version and indexed_at; ``text``
    is the column that the model reads."""
    ship(rows.sparkSession)
    schema = ST.StructType([*rows.schema.fields, ST.StructField("embedding", ST.ArrayType(ST.FloatType())), ST.StructField("embedding_error", ST.StringType())])
    got = rows.select("*", text.alias("__text")).mapInArrow(inferred(load, (model, version), batch, attempts, wait), schema)
    return got.withColumns({"embedding_model": F.lit(model), "embedding_model_version": F.lit(version), "indexed_at": F.current_timestamp()})


def generated(prompt: Column, load: Callable[[], Callable[[str], str | None]]) -> Column:
    """What a text model says to each prompt, without blanks at its ends; null where it fails or says nothing and
    where the prompt is null. ``load`` gives the model, once for each task."""

    @F.pandas_udf("string")
    def say(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series([None if p is None else answered(lambda t: [model(t[0])], [p], 1, 0)[0][0] for p in batch], dtype=object)

    return F.nullif(F.regexp_replace(say(prompt), r"^\s+|\s+$", ""), F.lit(""))
