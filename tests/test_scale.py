"""What a task or a micro-batch takes does not grow with the input."""

import glob
import math

import pytest
from pyspark.sql import functions as F

from sentrylens.functions import weblog
from sentrylens.operators import history, models
from sentrylens.plans import q_features
from sentrylens.session import pin_settings
from sentrylens.streaming import history_stream


def test_parts_of_a_fit():
    assert models.fit_parts(0, 8, 8) == models.fit_parts(500, 8, 1) == 1
    assert models.fit_parts(480_000, 12, 8) == 2 and models.fit_parts(480_000, 12, 1) == 12
    assert models.fit_parts(100 * models.MOST_ROWS, 12, 3) == 100


def test_train_rows_are_dealt_evenly_to_tasks_of_bounded_size(spark, monkeypatch):
    seen = []

    class Trees:
        def __init__(self, **kw):
            pass

        def fit(self, rows):
            seen.append(rows.rdd.glom().map(len).collect())

    monkeypatch.setattr(models, "GBTClassifier", Trees)
    monkeypatch.setattr(models, "MOST_ROWS", 20)
    train = spark.range(400).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("y"), F.col("id").alias("a"))
    fits = [models.Fit("one", ("a",)), models.Fit("two", ("a",), seed=7)]
    models.fit_many({"split": train}, fits)
    assert [len(s) for s in seen] == [20, 20]
    assert all(sum(s) == 400 and max(s) <= 40 for s in seen)


@pytest.mark.parametrize("text", ["", "aaaa", "aabb", "ab\né€", "x\U0001f600\U0001f600y" * 50, "the quick brown fox " * 500])
def test_entropy_counts_characters_in_one_pass(spark, text):
    rows = spark.createDataFrame([(text,), (None,)], "text string").select("text", weblog.char_entropy(F.col("text")).alias("e"))
    assert "array_distinct" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r["text"]: r["e"] for r in rows.collect()}
    shares = [text.count(c) / len(text) for c in set(text)]
    assert got[text] == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9) and got[None] == 0.0


def test_a_slice_arrives_in_as_many_files_as_its_rows_need(spark, tmp_path, monkeypatch):
    pin_settings(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    n = events.count()
    for rows, files in ((10 * n, 1), (n // 6 + 1, 2)):
        monkeypatch.setattr(q_features, "_FILE_ROWS", rows)
        path, schema, per = q_features._arriving(spark, str(tmp_path), 3)
        assert per == files and len(glob.glob(f"{path.removeprefix('file:')}/part-*")) <= 3 * per + 1
        assert spark.read.schema(schema).parquet(path).filter("row_id is not null").count() == n


def test_streaming_agents_share_the_state_of_their_group(spark, tmp_path):
    rows = [
        (None if i % 40 == 7 else f"a{i % 40}", i, 1_000_000_000_000_000 + i // 3 * 30_000_000, float(i % 13), f"r{i % 4}", f"ip{i % 5}", i % 2 == 0, i % 7 == 0, i % 5 == 0)
        for i in range(1200)
    ]
    df = spark.createDataFrame(rows, "agent string, row_id long, us long, level double, rule_id string, srcip string, auth boolean, scan boolean, brute boolean")
    end = df.limit(1).withColumns({"agent": F.lit("end"), "us": F.lit(4_000_000_000_000_000)})
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (df.filter("row_id % 2 = 0"), df.filter("row_id % 2 = 1"), end):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with history_stream.rocksdb_state(spark):
        run = (
            history_stream.stream_history(stream, "30 days", groups=4).writeStream.format("parquet")
            .option("checkpointLocation", out + "_log").trigger(availableNow=True).start(out)
        )
        run.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators) <= 50  # 41 agents held thirty rows each
    item = history.history_item(*[F.col(c) for c in ("us", "level", "rule_id", "srcip", "auth", "scan", "brute")])
    want = history.agent_history(df, ["agent"], ["us", "row_id"], "us", item).select("agent", "row_id", "us", *history_stream.FEATURES)
    got = spark.read.schema(history_stream.OUTPUT_SCHEMA).parquet(out)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
