"""Stream state over several micro-batches, held against plain Python."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexispan.streaming import jobs as SJ
from lexispan.streaming import terms as ST
from lexispan.streaming.sinks import drain, in_slices, latest
from lexispan.streaming.store import VersionedStore

START = datetime(2024, 1, 1)


def observations(spark, rows):
    """Rows of (slice, hour, term, target)."""
    data = [("d", term, i, START + timedelta(hours=h), target, 5, 0.9, "", s) for i, (s, h, term, target) in enumerate(rows)]
    schema = "doc_id string, term_id string, seq long, observed_at timestamp, target string, frequency long, candidate_score double, review_reason string, slice int"
    return spark.createDataFrame(data, schema)


def decisions(rows):
    return {r["term_id"]: (r["observations"], r["decision"], r["target_term"]) for r in rows.collect()}


def test_term_comes_back_as_new(spark):
    """Promoted in the first batch; not seen for the lifetime, it starts anew with another target."""
    rows = observations(spark, [
        (0, 0, "a", "x"), (0, 1, "a", "x"), (0, 1, "b", "y"), (0, 2, "b", "y"), (1, 5, "b", "z"), (1, 10, "filler", "f"), (2, 12, "a", "w"), (2, 12, "c", "")
    ])
    stream = ST.stream_term_memory(in_slices(rows, "slice", 3), 6 * 3600)
    every = drain(stream, "update").cache()
    assert decisions(latest(every, ["doc_id", "term_id"])) == {
        "a": (1, "keep", ""), "b": (3, "promote", "y"), "c": (0, "keep", ""), "filler": (1, "keep", "")
    }
    assert {(r["term_id"], r["batch_id"]) for r in every.where("decision = 'promote'").collect()} == {("a", 0), ("b", 0), ("b", 1)}


def test_without_lifetime_nothing_is_forgotten(spark):
    rows = observations(spark, [(0, 0, "a", "x"), (1, 500, "filler", "f"), (2, 900, "a", "x")])
    stream = ST.stream_term_memory(in_slices(rows, "slice", 3), None)
    assert decisions(latest(drain(stream, "update"), ["doc_id", "term_id"]))["a"] == (2, "promote", "x")


@pytest.mark.parametrize("slices", [1, 3])
def test_counting_does_not_depend_on_batches(spark, slices):
    """A repeat within the lifetime of the last sight does not count, one outside does."""
    hours = {"k": [0, 1, 5, 20, 21, 40], "m": [3, 9.5, 15], "n": [39]}
    rows = [("d", "t", k, START + timedelta(hours=h), min(int(h * slices / 41), slices - 1)) for k, hs in hours.items() for h in hs]
    data = spark.createDataFrame(rows, "doc_id string, term_id string, observation_key string, observed_at timestamp, slice int")
    stream = ST.counted_observations(in_slices(data, "slice", slices), 6 * 3600)
    counted = defaultdict(list)
    for r in drain(stream, "append").withColumn("h", (F.col("at_ms") / 1000 - F.unix_timestamp(F.lit(START))) / 3600).collect():
        counted[r["observation_key"]].append(r["h"])
    assert {k: sorted(v) for k, v in counted.items()} == {"k": [0, 20, 40], "m": [3, 9.5], "n": [39]}


def test_newest_payload_wins_whatever_comes_first(spark):
    rows = [("j", 2, START, {"a": "late", "b": "only"}, 0), ("j", 1, START, {"a": "early", "c": "c"}, 1), ("j", 3, START, {"b": "last"}, 2)]
    data = spark.createDataFrame(rows, "job_id string, event_id long, ts timestamp, data map<string,string>, slice int")
    found = latest(drain(SJ.job_payload_stream(in_slices(data, "slice", 3)), "update"), ["job_id", "key"])
    assert {(r["key"], r["value"]) for r in found.collect()} == {("a", "late"), ("b", "last"), ("c", "c")}


def test_versions_of_batches(spark):
    store = VersionedStore(spark)
    assert store.read() is None
    store.write(spark.range(3), 0)
    orphan = store.prepare(spark.range(99))
    store.write(spark.range(5), 4)
    store.write(spark.range(77), 4)
    assert store.read().count() == 5 and store.read(4).count() == 3 and store.read(0) is None and store.batches() == [0, 4]
    with pytest.raises(OSError):
        store.commit(4, orphan)
    assert store.read().count() == 5


def test_upserts_with_and_without_a_failure(spark):
    from lexispan.checks.stream_checks import sliced_events, upserted_memory

    sliced = sliced_events(spark, "/root/testdata/sf0.001")
    rows = [sorted(map(str, upserted_memory(spark, sliced, fail).collect())) for fail in ((), (0, 2))]
    assert rows[0] == rows[1] and rows[0]


def test_a_long_stream_is_waited_for(spark, monkeypatch):
    """However long the input takes; only a caller's own limit ends a stream."""
    from pyspark.sql.streaming.query import StreamingQuery

    waits, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: (waits.append(timeout), wait(self, timeout))[1])
    rows = observations(spark, [(0, 0, "a", "x")])
    assert drain(ST.stream_term_memory(in_slices(rows, "slice", 1), None), "update").count() == 1 and waits == [None]


def test_observations_share_slots(spark):
    """Calls into Python go by slots, not by keys; nulls and large numbers stay what they are."""
    rows = [("d" if i % 5 else None, 2**60 + i % 50 if i % 7 else None, i % 3, START + timedelta(hours=i % 30, days=3 * (i % 2))) for i in range(600)]
    data = spark.createDataFrame(rows, "doc_id string, term_id long, observation_key int, observed_at timestamp")
    data = data.withColumn("slice", (F.col("observed_at") >= F.lit(START + timedelta(days=3))).cast("int"))
    stream = ST.counted_observations(in_slices(data, "slice", 2), 6 * 3600, slots=2)
    assert "_slot" in stream._jdf.queryExecution().analyzed().toString()
    found = drain(stream, "append")
    assert [(f.name, f.dataType.simpleString()) for f in found.schema][:4] == [("doc_id", "string"), ("term_id", "bigint"), ("observation_key", "int"), ("at_ms", "bigint")]
    want, last = [], {}
    for *key, at in sorted(rows, key=lambda r: r[3]):
        seen = last.get(tuple(key))
        if seen is None or at - seen > timedelta(hours=6):
            want.append((*key, at))
        last[tuple(key)] = at
    got = found.select("doc_id", "term_id", "observation_key", F.timestamp_millis("at_ms")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_ids_out_of_the_order_of_time_lose_nothing(spark, tmp_path):
    """Copies of events with shifted ids: every slice by id covers all times, one by time does not."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(c * 40 + i, START + timedelta(hours=6 * i), c, "view", float(i % 3), "{}") for c in range(4) for i in range(40)]
    data = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    data.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["streamed_observation_lifetimes"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    twin = db.execute(entry.oracle_sql()["streamed_observation_lifetimes"])
    order = [d[0] for d in twin.description]
    want = sorted(twin.fetchall())
    assert sorted(map(tuple, found.select(*order).collect())) == want and len({r[0] for r in want}) == 4
