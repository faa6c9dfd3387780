"""The webhook stream: what is signed is dispatched, the rest kept apart, and nothing lost or repeated."""

import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.streaming import webhooks

KEY = "k"


def request(n, body, event="push", sign=None):
    raw = body if isinstance(body, bytes) else json.dumps(body).encode()
    mark = "sha256=" + hmac.new(KEY.encode(), raw, hashlib.sha256).hexdigest() if sign is None else sign
    return {"request_id": f"r{n}", "event_type": event, "signature": mark, "body": base64.b64encode(raw).decode()}


def push(n, branch="main"):
    return {"repository": {"id": n, "clone_url": "u"}, "ref": f"refs/heads/{branch}", "after": "c", "commits": [{"added": [f"a{n}.py"], "modified": []}]}


def deliver(folder, name, requests):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in requests))


def outcome(spark, path):
    good = {(r.request_id, r.status) for r in webhooks.jobs(spark, path).collect()}
    bad = {(r.request_id, r.reason) for r in webhooks.quarantine(spark, path).collect()}
    assert len(good) == webhooks.jobs(spark, path).count() and len(bad) == webhooks.quarantine(spark, path).count()
    return good, bad


def test_signed_forged_and_broken(spark, tmp_path):
    body = push(1)
    rows = [
        request(1, body), request(2, body, sign="sha256=" + "0" * 64), request(3, body, sign=""), request(4, b'{"ref": '), request(5, b"\xff\xfe{}"), request(6, b"[1]"), request(7, b""),
        request(8, body, sign=KEY), request(9, push(9, "topic")), request(10, {"commits": []}), request(11, body, event="delete"), request(12, body, event="fork"), request(13, body | {"x": "ü"}, sign="sha256="),
    ]
    rows[5]["body"] = rows[5]["body"] + "!"  # no base64
    deliver(tmp_path / "in", "1.json", rows)
    webhooks.listen(webhooks.inbox(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), KEY).awaitTermination()
    good, bad = outcome(spark, str(tmp_path / "out"))
    assert good == {("r1", "queued"), ("r8", "queued"), ("r9", "skipped:branch_excluded:topic"), ("r10", "skipped:no_changes"), ("r11", "purged"), ("r12", "ignored:fork")}
    assert bad == {("r2", "forged"), ("r3", "unsigned"), ("r4", "broken"), ("r5", "broken"), ("r6", "forged"), ("r7", "broken"), ("r13", "forged")}
    held = {r.request_id: r.body for r in webhooks.quarantine(spark, str(tmp_path / "out")).collect()}
    assert held["r5"] == rows[4]["body"]


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    start = lambda write=webhooks.write_batch: webhooks.listen(webhooks.inbox(spark, str(tmp_path / "in"), 1), path, str(tmp_path / "c"), KEY, write)
    for n in range(3):
        deliver(tmp_path / "in", f"{n}.json", [request(10 * n + k, push(k)) for k in range(5)])
    seen = []

    def lost(batch, epoch, *rest):
        seen.append(epoch)
        if len(seen) == 2:  # written in part, then the driver is lost
            webhooks.checked(batch, KEY).where("request_id like '%1'").select("request_id", "event_type", "status", "job").write.mode("overwrite").parquet(f"{path}/jobs/epoch={epoch}")
            raise RuntimeError("lost")
        webhooks.write_batch(batch, epoch, *rest)

    with pytest.raises(Exception, match="lost"):
        start(lost).awaitTermination()
    start().awaitTermination()
    deliver(tmp_path / "in", "9.json", [request(90, push(1)), request(91, push(1), sign="no")])
    start().awaitTermination()
    start().awaitTermination()
    good, bad = outcome(spark, path)
    assert {r for r, _ in good} == {f"r{10 * n + k}" for n in range(3) for k in range(5)} | {"r90"}
    assert bad == {("r91", "forged")}


def test_all_events_arrive_once(spark):
    found = catalog.QUERIES["s7_webhooks"](spark, "/root/testdata/sf0.001")
    assert found.count() == found.select("request_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert {r.outcome for r in found.select("outcome").distinct().collect()} == {"queued", "purged", "forged", "broken", "unsigned", "skipped:branch_excluded:topic"}
    assert found.where(F.col("outcome") == "queued").where("paths is null").count() == 0
