"""Readers and sinks on real files; streaming state against the batch form."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sentrylens import session
from sentrylens.operators import history
from sentrylens.sources import alerts as S
from sentrylens.sources import sinks
from sentrylens.streaming import history_stream as H


def test_alert_lines_skip_broken_and_lift_scalars(spark, tmp_path):
    full = {"timestamp": "2026-07-08T20:22:28Z", "rule": {"id": "1", "level": 5, "groups": ["a", "b"], "mitre": {"tactic": "Impact"}},
            "agent": {"name": "n"}, "data": {"http": {"url": "/x"}}}
    other = {"@timestamp": "2026-07-08T20:22:28+0000", "rule": {"id": "2", "groups": "solo"}, "data": {"win": {"eventdata": {"commandLine": "c"}}}}
    lines = [json.dumps(full), "", "   ", '{"rule": {"id": "9"', "not json", json.dumps(other), '{"rule": 3, "full_log": "odd"}']
    (tmp_path / "web_alerts.json").write_text("\n".join(lines))
    rows = S.with_scenario(S.read_alerts(spark, str(tmp_path)), "_alerts.json")
    flat = {r.rule_id: r for r in S.flatten(rows, ["scenario"]).collect()}
    assert set(flat) == {"1", "2", None}
    assert flat["1"].rule_groups == ["a", "b"] and flat["1"].tactics == ["Impact"] and flat["1"].url == "/x"
    assert flat["2"].rule_groups == ["solo"] and flat["2"].command == "c" and flat["2"].ts == flat["1"].ts
    assert flat[None].full_log == "odd" and flat["1"].scenario == "web"


def test_marker_log_in_two_encodings(spark, tmp_path):
    text = ">>> 2026-07-08T20:22:28Z START | T1 dirb\nnoise\n>>> 2026-07-08T20:23:28Z BASELINE | quiet\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text(text, encoding="utf-16")
    a = S.read_markers(spark, str(tmp_path / "a.txt")).drop("ord").collect()
    b = S.read_markers(spark, str(tmp_path / "b.txt"), "UTF-16").drop("ord").collect()
    assert a == b and [(r.kind, r.technique) for r in a] == [("START", "T1"), ("BASELINE", "quiet")]


def test_window_csv_and_id_set(spark, tmp_path):
    (tmp_path / "w.csv").write_text("scenario,attack,start,end\ns,scan,1.5,2.25\n")
    w = S.read_windows(spark, str(tmp_path / "w.csv")).first()
    assert (w.scenario, w.start_us, w.end_us) == ("s", 1_500_000, 2_250_000)
    (tmp_path / "ids.txt").write_text(" 1 \n\n2\n1\n")
    assert sorted(r.id for r in S.read_idset(spark, str(tmp_path / "ids.txt")).collect()) == ["1", "2"]


def test_split_sink_has_one_folder_per_part(spark, tmp_path):
    df = spark.range(4).select(F.col("id").cast("double").alias("f"), (F.col("id") % 2).alias("y"),
                               F.when(F.col("id") < 3, "train").otherwise("test").alias("split"))
    path = str(tmp_path / "split")
    sinks.write_split(df, path, ["f"])
    back = spark.read.parquet(path)
    assert back.columns == ["f", "y", "split"] and back.filter("split = 'train'").count() == 3


def _alerts(spark):
    rows = [("a" if i % 3 else "b", i, (i // 2) * 20_000_000, float(i % 13), f"r{i % 4}", f"ip{i % 5}", i % 2 == 0, i % 7 == 0, i % 5 == 0)
            for i in range(90)]
    return spark.createDataFrame(rows, "agent string, row_id long, us long, level double, rule_id string, srcip string, auth boolean, scan boolean, brute boolean")


def _run(stream, path, mode="append"):
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", path + "_log").trigger(availableNow=True).start(path)
    q.awaitTermination()


def _arrive(parts, path):
    """Each part is a file of its own, in this order."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)


def _streamed(spark, path, schema, out, late, **kw):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    with H.rocksdb_state(spark):
        _run(H.stream_history(stream, late, **kw), out)
    return spark.read.schema(H.OUTPUT_SCHEMA).parquet(out)


def _end(df):
    """A row of another agent, so late that the watermark passes all others."""
    return df.limit(1).withColumns({"agent": F.lit("end"), "us": F.lit(4_000_000_000_000_000)})


def _history(df, order):
    item = history.history_item(*[F.col(c) for c in ("us", "level", "rule_id", "srcip", "auth", "scan", "brute")])
    return history.agent_history(df, ["agent"], order, "us", item).select("agent", "row_id", "us", *H.FEATURES)


@pytest.mark.parametrize("parts,arrow_rows", [(1, 10_000), (3, 7), (7, 10_000)])
def test_streaming_history_does_not_depend_on_cuts_or_disorder(spark, tmp_path, parts, arrow_rows):
    df = _alerts(spark).withColumn("us", F.col("us") + 1_000_000_000_000_000)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _arrive([df.filter(F.col("row_id") % parts == i).orderBy(F.rand(3)) for i in range(parts)] + [_end(df)], source)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, arrow_rows)
    try:
        got = _streamed(spark, source, df.schema, out, "30 days")
    finally:
        spark.conf.set(name, before)
    batch = _history(df, ["us", "row_id"])
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_streaming_history_drops_late_rows_and_forgets_silent_agents(spark, tmp_path):
    day = 86_400_000_000
    schema = "agent string, row_id long, us long, level double, rule_id string, srcip string, auth boolean, scan boolean, brute boolean"

    def rows(*items):
        return spark.createDataFrame([(a, i, None if d is None else int(d * day), 12.0, "r", "s", False, False, False) for a, i, d in items], schema)

    parts = [rows(("a", 1, 10), ("a", 2, 10.0001), ("b", 3, None)), rows(("b", 4, 20)), rows(("a", 5, 1), ("a", 6, 20.5)), rows(("b", 7, 60)), rows(("z", 9, 70))]
    for forget, high in ((None, [999.0, 8.64, 10.4999 * 86400]), (5, [999.0, 8.64, 999.0])):
        source, out = str(tmp_path / f"in{forget}"), str(tmp_path / f"out{forget}")
        _arrive(parts, source)
        got = {r.row_id: r for r in _streamed(spark, source, parts[0].schema, out, "1 hour", forget_days=forget).collect()}
        assert set(got) == {1, 2, 3, 4, 6, 7}  # 5 came behind the watermark, 9 still waits
        seen = [got[i].time_since_last_high for i in (1, 2, 6)]
        assert got[3].us is None and got[3].time_since_last_high == 999.0
        assert seen[:2] == pytest.approx(high[:2]) and seen[2] in (pytest.approx(high[2]), 999.0)
        assert (got[6].high_sev_ratio_20 == 0.0) == (forget is not None)


def test_checkpoint_folder_is_refused_off_one_machine_and_released(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: "")

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Cluster)
    path = session.staged(spark.range(3)).inputFiles()[0]
    local = os.path.dirname(path.removeprefix("file://"))
    assert os.path.isdir(local)
    session.release_tables(spark)
    assert not os.path.isdir(local)


def test_windowed_streams_drop_nothing_before_the_watermark(spark, tmp_path):
    df = _alerts(spark).select("agent", F.timestamp_micros("us").alias("ts"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    _run(H.stream_counts(stream, "agent", late="1 second", window="1 minute"), out)
    closed = spark.read.parquet(out)
    want = df.groupBy(F.window("ts", "1 minute"), "agent").agg(F.count(F.lit(1)).alias("n"))
    assert closed.count() > 10 and closed.select("window", "agent", "n").exceptAll(want.select("window", "agent", "n")).isEmpty()
    assert H.stream_rounds(stream, "agent").isStreaming
