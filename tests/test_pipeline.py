import json
from datetime import datetime

import pytest
from changeflow.config import HISTORY, EngineConfig, SoftPartitions, TopicConfig
from changeflow.pipeline import Topic, columns_of_map, key_names
from changeflow.sources.frames import UNAVAILABLE as PH
from changeflow.streaming.apply import FRAMES
from pyspark.sql import functions as F

FIELDS = [{"field": "id", "type": "int32"}, {"field": "v", "type": "string"}, {"field": "at", "type": "int64", "name": "io.debezium.time.Timestamp"}]
DAY = 86_400_000


def frames(spark, *changes, topic="db.s.items", table="items", key='{"id": 1}'):
    rows = []
    for i, (op, row) in enumerate(changes):
        value = {"schema": {"fields": [{"field": "after", "type": "struct", "fields": FIELDS}]}, "payload": {"before": row if op == "d" else None, "after": None if op == "d" else row, "op": op, "source": {"db": "db", "schema": "s", "table": table, "ts_ms": 1_700_000_000_000 + i}}}
        rows.append((topic, 0, i, datetime(2025, 1, 1), key.encode() if key else None, json.dumps(value).encode()))
    rows.append((topic, 0, 99, datetime(2025, 1, 1), None, b""))
    return spark.createDataFrame(rows, FRAMES)


def row(k, v, day=0):
    return {"id": k, "v": v, "at": day * DAY}


def run(spark, root, *batches, mode="replication", **settings):
    cfg = TopicConfig("db.s.items", "s", **settings)
    topic = Topic(spark, EngineConfig((cfg,), mode=mode), cfg, str(root))
    return topic, [topic.apply(b, i + 1, F.lit(datetime(1970, 3, 1)).cast("timestamp_ntz")) for i, b in enumerate(batches)]


def content(table):
    return {r.id: r.v for r in table.read().collect()}


def test_merging_by_the_messages_keys(spark, tmp_path):
    topic, done = run(spark, tmp_path, frames(spark, ("c", row(1, "a")), ("c", row(2, "b")), ("u", row(1, PH))), frames(spark, ("d", row(2, "b")), ("u", row(1, PH, 3)), ("c", row(3, "c"))))
    assert content(topic.table("items")) == {1: "a", 3: "c"} and done == [{"items": 1}, {"items": 2}]
    assert {r.id: r["at"] for r in topic.table("items").read().collect()}[1] == datetime(1970, 1, 4)
    assert topic.apply(frames(spark, ("c", row(9, "late"))), 2) == {"items": None} and 9 not in content(topic.table("items"))


def test_soft_deletes_several_steps_and_another_name(spark, tmp_path):
    topic, done = run(spark, tmp_path, frames(spark, ("c", row(1, "a"))), frames(spark, ("d", row(1, "zero"))), soft_delete=True, multi_step_flushes=1, table="things")
    assert [list(d) for d in done] == [["things"]] * 2 and done[0]["things"] is None
    assert [(r.id, r.v, r["__cf_delete"]) for r in topic.table("things").read().collect()] == [(1, "a", True)]


def test_append_only_and_history(spark, tmp_path):
    batches = (frames(spark, ("c", row(1, "a")), ("u", row(1, "b"))), frames(spark, ("d", row(1, "b"))))
    topic, _ = run(spark, tmp_path / "append", *batches, append_only=True)
    assert sorted((r.v, r["__cf_delete"]) for r in topic.table("items").read().collect()) == [("b", False), ("b", True)]
    topic, done = run(spark, tmp_path / "history", *batches, mode=HISTORY, db_updated_at=True)
    t = topic.table("items__history").read()
    assert sorted((r.v, r["__cf_operation"]) for r in t.collect()) == [("a", "c"), ("b", "d"), ("b", "u")] and "__cf_db_updated_at" in t.columns
    assert topic.apply(batches[1], 2) == {"items__history": None} and t.count() == 3


def test_soft_partitions(spark, tmp_path):
    soft = SoftPartitions("at", "monthly", 2)
    topic, done = run(spark, tmp_path, frames(spark, ("c", row(1, "a", 0)), ("c", row(2, "b", 59))), soft_partitions=soft)
    assert sorted(done[0]) == ["items_1970_03", "items_default"] and content(topic.table("items_default")) == {1: "a"}
    with pytest.raises(Exception, match="future"):
        topic.apply(frames(spark, ("c", row(3, "a", 400))), 2, F.lit(datetime(1970, 3, 1)).cast("timestamp_ntz"))


def test_documents_and_tracking(spark, tmp_path):
    doc = lambda k, op="c": {"payload": {"before": None, "after": json.dumps({"_id": {"$oid": k}, "n": {"$numberLong": "5"}, "deep": {"x": [1]}}), "op": op, "source": {"db": "d", "collection": "docs", "ts_ms": 1}}}
    f = spark.createDataFrame([("t", 0, i, datetime(2025, 1, 1), None, json.dumps(doc(k)).encode()) for i, k in enumerate(["a", "b", "a"])], FRAMES)
    cfg = TopicConfig("t", "s", format="document", keys_override=("_id",), full_table_name=False)
    topic = Topic(spark, EngineConfig((cfg,)), cfg, str(tmp_path))
    topic.apply(f, 1)
    assert sorted((r["_id"], r.n, r.deep) for r in topic.table("docs").read().collect()) == [("a", "5", '{"x":[1]}'), ("b", "5", '{"x":[1]}')]
    event = lambda i: {"event": "click", "timestamp": "2025-01-01T00:00:00Z", "messageID": f"m{i}", "properties": {"plan": "x"}}
    f = spark.createDataFrame([("e", 0, i, datetime(2025, 1, 1), f"m{i}".encode(), json.dumps(event(i)).encode()) for i in range(3)], FRAMES)
    cfg = TopicConfig("e", "s", format="tracking", keys_override=("id",))
    topic = Topic(spark, EngineConfig((cfg,)), cfg, str(tmp_path))
    topic.apply(f, 1)
    assert sorted((r.id, r.plan) for r in topic.table("click").read().collect()) == [("m0", "x"), ("m1", "x"), ("m2", "x")]


def test_names_in_keys_and_maps(spark):
    keys = [b'{"a": 1, "b": 2}', b'{"schema": {}, "payload": {"c": 1}}', b"Struct{d=1,e=x}", None, b'{"__dbz__physicalTableIdentifier": "t"}']
    assert key_names(spark.createDataFrame([(k,) for k in keys], "msg_key binary")) == ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(1, {"x": "1"}), (2, {"y": None}), (3, None)], "i int, row map<string,string>")
    assert [tuple(r) for r in columns_of_map(df).orderBy("i").collect()] == [(1, "1", None), (2, None, None), (3, None, None)]
