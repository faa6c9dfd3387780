"""The index from files to answers: built, kept up by changes, and searched with access rules."""

import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions.embed import hashing_embedding
from quillspark.operators import maintenance
from quillspark.operators.store import Store
from quillspark.plans import pipelines
from quillspark.sources import readers
from quillspark.storage import kept

AUTH = """import hashlib


def hash_password(password: str, salt: str) -> str:
    \"\"\"Digest of a password.\"\"\"
    password = salt + password
    return hashlib.sha256(password.encode()).hexdigest()


class Sessions:
    def open_session(self, user):
        return hash_password(user, "x")
"""
KEY = "sk-" + "a1B2" * 11


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "auth.py").write_text(AUTH)
    (root / "keys.py").write_text(f'def client():\n    api_key = "{KEY}"\n    return api_key\n')
    (root / "geo.py").write_text(catalog.MODULE)
    (root / "copy.py").write_text(catalog.MODULE)
    (root / "yarn.lock").write_text("no")
    return readers.file_tree(spark, str(root)), f"file:{root}/"


@pytest.fixture(scope="module")
def built(spark, tree):
    files, root = tree
    chunks, edges = pipelines.build_index(spark, files, "p", "r", tenant="t", roles=("developer", "auditor"), sensitivity="confidential", branch="main", commit="abc123", root=root)
    return kept(chunks), kept(edges)


def asked(spark, projects=("p",), roles=("developer",), query="How to hash a password with salt", **more):
    q = spark.createDataFrame([(1, query, list(projects), list(roles))], "query_id long, query string, projects array<string>, roles array<string>")
    for name, value in more.items():
        q = q.withColumn(name, F.lit(value))
    return q.withColumn("vector", hashing_embedding(F.coalesce("hypothetical", "query") if more else F.col("query")))


def test_rows_carry_origin_and_access(built):
    chunks, _ = built
    got = {tuple(r) for r in chunks.select("project_id", "tenant_id", "sensitivity_level", "branch", "commit_hash", "repository_name", F.concat_ws(",", "allowed_roles").alias("roles"), "embedding_model", "embedding_model_version").distinct().collect()}
    assert got == {("p", "t", "confidential", "main", "abc123", "r", "developer,auditor", "hashing", "1")}
    assert set(maintenance.PAYLOAD) - set(maintenance.payload(chunks).columns) == set()
    assert {r.file_path for r in chunks.collect()} >= {"auth.py", "keys.py"} and chunks.where("indexed_at is null").count() == 0
    assert chunks.groupBy("chunk_hash").count().where("count > 1").count() == 0


def test_what_was_built_is_found(spark, built):
    chunks, edges = built
    got = pipelines.retrieve(asked(spark), chunks, edges, threshold=0.1).collect()
    assert len(got) == 1 and "auth.py" in {s.file_path for s in got[0].sources} and "hash_password" in got[0].context
    assert "abc123" in got[0].context


@pytest.mark.parametrize("who", [{"projects": ["other"]}, {"roles": ["guest"]}, {"projects": []}, {"roles": []}])
def test_others_see_nothing(spark, built, who):
    assert pipelines.retrieve(asked(spark, **who), *built, threshold=0.1).count() == 0


def test_no_secret_is_stored(spark, built):
    chunks, edges = built
    assert chunks.where(F.contains("content", F.lit(KEY))).count() == 0
    assert {r.file_path for r in chunks.where("has_secrets_redacted").collect()} == {"keys.py"}
    got = pipelines.retrieve(asked(spark, query="client api_key"), chunks, edges, threshold=0.1).first()
    assert KEY not in got.context and "[REDACTED]" in got.context


def test_a_hypothetical_answer_is_searched_for(spark, built):
    """Where a query comes with a text that an answer might be, that is searched for; it is reranked by the query."""
    chunks, edges = built
    plain = pipelines.retrieve(asked(spark, query="zzz qqq"), chunks, edges)
    helped = pipelines.retrieve(asked(spark, query="zzz qqq", hypothetical="def open_session(self, user): return hash_password(user)"), chunks, edges)
    assert plain.count() == 0 and "open_session" in helped.first().context
    without = pipelines.retrieve(asked(spark, hypothetical=None), chunks, edges, threshold=0.1)
    assert "hash_password" in without.first().context


CHANGE = "file_path string, content string, removed boolean, ts int"


def changes(spark, rows, project="p"):
    origin = dict(zip(pipelines.ORIGIN, [F.lit(project), F.lit("t"), F.array(F.lit("developer")), F.lit("internal"), F.lit("main"), F.lit("c"), F.lit("r")]))
    return spark.createDataFrame(rows, CHANGE).withColumn("size", F.length("content").cast("long")).withColumns(origin)


def state(store):
    return sorted((r.file_path, r.node_name, r.content) for r in store.read().collect())


FIRST = [(f"f{i}.py", f"def name{i}():\n    return {i}\n", False, 1) for i in range(12)]
NEXT = [("f1.py", "def changed():\n    pass\n", False, 2), ("f1.py", "def newest():\n    pass\n", False, 3), ("f2.py", None, True, 2), ("f99.py", "def added():\n    pass\n", False, 2), ("f3.lock", "no", False, 2)]


def test_changes_replace_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    pipelines.apply_changes(store, changes(spark, FIRST), 0)
    before = store.manifest()["parts"]
    pipelines.apply_changes(store, changes(spark, NEXT), 1)
    names = {r[1] for r in state(store)}
    assert names == {f"name{i}" for i in range(12) if i not in (1, 2)} | {"newest", "added"}
    after = store.manifest()["parts"]
    touched = {str(r[0]) for r in changes(spark, NEXT).select(store.part()).collect()}
    same = set(before) - touched
    assert same and all(before[p] == after[p] for p in same) and all(before.get(p) != after.get(p) for p in touched & set(after))
    whole = [r for r in FIRST if r[0] not in ("f1.py", "f2.py")] + [NEXT[1], NEXT[3]]
    chunks = pipelines.file_chunks(changes(spark, whole))
    assert state(store) == sorted((r.file_path, r.node_name, r.content) for r in chunks.collect())
    assert store.clean() == len(touched & set(before)) and {r[1] for r in state(store)} == names
    assert store.manifest()["parts"] == after and store.clean() == 0


def test_a_batch_that_fails_before_the_swap_comes_again(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    pipelines.apply_changes(store, changes(spark, FIRST), 0)
    before = state(store)

    def lost(self, manifest):
        raise RuntimeError("the driver was lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_swap", lost)
        with pytest.raises(RuntimeError):
            pipelines.apply_changes(store, changes(spark, NEXT), 1)
    assert state(store) == before
    pipelines.apply_changes(store, changes(spark, NEXT), 1)
    after, manifest = state(store), store.manifest()
    pipelines.apply_changes(store, changes(spark, NEXT), 1)  # a replay after the swap
    pipelines.apply_changes(store, changes(spark, FIRST), 0)
    assert state(store) == after and store.manifest() == manifest
    (tmp_path / "s" / "manifests" / "7").write_text('{"parts": {')  # a writer that was lost halfway
    assert state(store) == after
    pipelines.apply_changes(store, changes(spark, [("f5.py", None, True, 9)]), 2)
    assert "name5" not in {r[1] for r in state(store)}


def test_commits_refuse_rows_of_other_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = pipelines.file_chunks(changes(spark, FIRST))
    with pytest.raises(ValueError):
        store.commit(rows, [0])
    assert store.read() is None


def test_projects_do_not_touch_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    pipelines.apply_changes(store, changes(spark, FIRST[:2]), 0, "a")
    pipelines.apply_changes(store, changes(spark, FIRST[:2], "q"), 0, "b")
    pipelines.apply_changes(store, changes(spark, [("f0.py", None, True, 5)], "q"), 1, "b")
    assert sorted((r.project_id, r.file_path) for r in store.read().collect()) == [("p", "f0.py"), ("p", "f1.py"), ("q", "f1.py")]


def test_files_that_change_once_are_shuffled_once(spark, tmp_path, monkeypatch):
    """contents were shuffled for the latest change of each file, kept, shuffled for equal chunks and again to be written."""
    store, plans, copies = Store(spark, str(tmp_path / "s")), [], []
    commit, copy = Store.commit, pipelines.kept
    monkeypatch.setattr(Store, "commit", lambda self, rows, *a, **b: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), commit(self, rows, *a, **b))[1])
    monkeypatch.setattr(pipelines, "kept", lambda *a: (copies.append(a), copy(*a))[1])
    pipelines.apply_changes(store, changes(spark, FIRST), 0)
    assert plans[0].count("Exchange") == 1 and not copies
    pipelines.apply_changes(store, changes(spark, NEXT), 1)  # a file changes twice in it
    assert len(copies) == 1
    whole = [r for r in FIRST if r[0] not in ("f1.py", "f2.py")] + [NEXT[1], NEXT[3]]
    assert state(store) == sorted((r.file_path, r.node_name, r.content) for r in pipelines.file_chunks(changes(spark, whole)).collect())
    assert all(len(list((tmp_path / "s" / p).glob("*.parquet"))) <= pipelines.DEAL for p in store.manifest()["parts"].values())
