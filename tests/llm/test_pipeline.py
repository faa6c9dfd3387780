"""The pipeline's stages against plain versions of them, on a small table with planted cases."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import packing, queries, toxicity

from .test_near_dedup import expected, noisy
from .test_packing import plain_best_fit
from .test_secrets import base
from .test_toxicity import plain

SF = "/root/testdata/sf0.001"


def masked(text):
    out, end = "", 0
    spans = []
    for s, _, e in base(text):
        if spans and s < spans[-1][1]:
            spans[-1][1] = max(e, spans[-1][1])
        else:
            spans.append([s, e])
    for s, e in spans:
        out, end = out + text[end:s] + "[SECRET]", e
    return out + text[end:]


def test_stages_against_plain_versions(spark, tmp_path):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    planted = [(None, "no id", "en", "s", 5), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "password=hunter2hunter2 and more", "en", "s", 1), (9004, "you idiot moron, pathetic loser, worthless scum", "en", "s", 1)]
    planted += [(9100 + i, t, "en", "s", len(t)) for i, t in enumerate(noisy(3, 3, 6, 2))]
    docs = own.unionByName(spark.createDataFrame(planted, own.schema)).withColumns({"score": F.lit(1), "component_id": F.lit("x")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    lexicon = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if plain(r[1], lexicon) < toxicity.THRESHOLD]
    assert 9004 not in {i for i, _ in rows}
    roots = Counter(expected(rows, 5))
    kept = {i for i, _, root in roots if i == root}
    rows = [r for r in rows if r[0] is None or r[0] in kept]
    assert sum(9100 <= (i or 0) < 9200 for i, _ in rows) < 18
    library = Tokenizer.from_file(queries.VOCABULARY)
    library.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = [*library.encode(masked(t) if t else "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(want)
    by = defaultdict(int)
    for r in out:
        by[r.sequence_id] += r.length
    lengths = [w[3] for w in want]
    assert max(by.values()) <= 1024 and packing.bound(Counter(lengths), 1024) <= len(by) <= plain_best_fit(lengths, 1024)


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
