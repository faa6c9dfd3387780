"""Session memory over a stream: clears, and a start from the batch table."""

from quillspark import catalog
from quillspark.streaming import sessions

SF = "/root/testdata/sf0.001"


def say(spark, folder, rows):
    spark.createDataFrame(rows, sessions.SAID).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def take(spark, folder, n=3, history=None):
    stream = spark.readStream.schema(sessions.SAID).parquet(f"{folder}/in")
    start = None if history is None else spark.createDataFrame(history, sessions.SAID)
    sessions.run(sessions.sessions(stream, n, start), f"{folder}/out", f"{folder}/c").awaitTermination()
    return {r.conv_id: ([t.turn for t in r.turns], r.last_turn) for r in sessions.state(spark, f"{folder}/out").collect()}


def test_clears_and_restarts(spark, tmp_path):
    turn = lambda c, t, control=None: (c, t, "user", f"{c}:{t}", control)
    say(spark, tmp_path, [turn(1, t) for t in range(5)] + [turn(2, 0), turn(2, 1, "clear"), turn(2, 2), turn(3, 0)])
    assert take(spark, tmp_path) == {1: ([2, 3, 4], 4), 2: ([2], 2), 3: ([0], 0)}
    say(spark, tmp_path, [turn(1, 5, "clear"), turn(3, 2), turn(3, 1), turn(2, 2), turn(2, 3)])  # 2 says its third turn again
    assert take(spark, tmp_path) == {1: ([], 5), 2: ([2, 3], 3), 3: ([0, 1, 2], 2)}
    say(spark, tmp_path, [turn(1, 6)])
    assert take(spark, tmp_path)[1] == ([6], 6)


def test_start_from_the_batch_table(spark, tmp_path):
    turn = lambda c, t, control=None: (c, t, "user", f"{c}:{t}", control)
    history = [turn(1, t) for t in range(4)] + [turn(2, 0), turn(2, 1, "clear")]
    say(spark, tmp_path, [turn(1, 3), turn(1, 4), turn(2, 2), turn(9, 0)])
    assert take(spark, tmp_path, history=history) == {1: ([2, 3, 4], 4), 2: ([2], 2), 9: ([0], 0)}


def test_all_conversations(spark):
    got = {r.conv_id: r.turns for r in catalog.QUERIES["x6_sessions"](spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        held = want.setdefault(r.conv_id, [])
        held[:] = [] if r.role == "system" and r.turn > 0 else [*held, str(r.turn)][-3:]
    assert {c: ",".join(t) for c, t in want.items()} == got
