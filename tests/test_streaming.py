"""Debouncing and latest answers as streams equal their batch forms."""

import datetime as dt

from fellway.operators.search import debounced
from fellway.streaming.keystrokes import debounced_stream, latest_answers

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def run(spark, frame, name, folder):
    frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).start().processAllAvailable()
    return spark.table(name)


def test_debounce(spark, tmp_path):
    inputs = [("a", at(0), "w"), ("a", at(100), "we"), ("a", at(900), "wel"), ("b", at(50), "x"), ("a", at(60_000), "end"), ("b", at(60_000), "end")]
    for k, chunk in enumerate((inputs[:4], inputs[4:], [("z", at(200_000), "late")], [("z", at(400_000), "later")])):
        spark.createDataFrame(chunk, "session string, ts timestamp, query string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("session string, ts timestamp, query string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = {(r.session, r.query) for r in run(spark, debounced_stream(stream), "debounced", f"{tmp_path}-check").collect()}
    batch = spark.createDataFrame([(*x, k) for k, x in enumerate(inputs)], "session string, ts timestamp, query string, event_id int")
    expected = {(r.session, r.query) for r in debounced(batch).collect()}
    assert expected == {("a", "we"), ("a", "wel"), ("a", "end"), ("b", "x"), ("b", "end")}
    assert expected <= got


def test_latest_answers_over_a_long_time(spark, tmp_path):
    """An old answer that arrives minutes, and windows, later does not replace a newer one."""
    schema = "session string, ts timestamp, sequence int, answer string"
    chunks = [
        [("a", at(0), 2, "new"), ("a", at(10), 1, "old"), ("b", at(0), 1, "only")],
        [("a", at(59_999), 3, "newer"), ("b", at(70_000), 1, "again")],
        [("a", at(61_000), 2, "late"), ("b", at(600_000), 5, "five")],
        [("a", at(3_000_000), 1, "very late"), ("z", at(20_000_000), 1, "end")],
        # Long idle: the session is forgotten, and begins anew.
        [("z", at(20_000_001), 2, "end")], [("a", at(20_000_002), 1, "anew"), ("z", at(20_000_003), 1, "no")],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, chunk in enumerate(chunks):
            spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        found = []
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = latest_answers(source).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").foreachBatch(lambda df, n: found.extend((n, *r) for r in df.collect())).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [(r[1], r[2], r[3]) for r in sorted(found) if r[1] != "z"]
    assert sorted(got) == sorted([("a", 2, "new"), ("b", 1, "only"), ("a", 3, "newer"), ("b", 5, "five"), ("a", 1, "anew")])
    assert [g for g in got if g[0] == "a"] == [("a", 2, "new"), ("a", 3, "newer"), ("a", 1, "anew")]
