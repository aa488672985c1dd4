from pyspark.sql import functions as F

from lexarium.streaming import records as S

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_first_seen(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    live = stream(spark, tmp_path, e.union(e))
    S.drain(S.first_seen(live, "ts", F.col("event_id")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def test_window_counts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    live = S.window_counts(stream(spark, tmp_path, e), "ts", ["event_type"])
    S.drain(live, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.d, r.event_type): r.n for r in e.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    # the last window stays open until the watermark has passed it
    last = max(d for d, _ in want)
    assert got == {k: n for k, n in want.items() if k[0] < last}
