import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_entry_without_the_training_data_operators(tmp_path):
    """With both folders deleted, with or without the pipeline file, the rest imports and runs."""
    for keep in (False, True):
        copy = tmp_path / str(keep)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(() if keep else ("corpus_pipeline.py",))))
        shutil.rmtree(copy / "quillspark" / "llm", ignore_errors=True)
        code = (
            "import __spark_entry__ as e\n"
            "found = e.queries()\n"
            "assert 'o1_dense_topk' in found and not any(k.startswith('op') and k[2].isdigit() for k in found) and 'pipeline' not in found\n"
            "assert set(e.oracle_sql()) <= set(found)\n"
        )
        if not keep:
            code += (
                "from pyspark.sql import SparkSession\n"
                "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
                "assert found['p12_normalised_hash'](s, '/root/testdata/sf0.001').count() > 0\n"
            )
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr


def test_smoke(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
