import uuid

import numpy as np
from pyspark.sql import functions as F

from lamina.functions import rng
from lamina.plans import catalogue
from lamina.streaming import streams

SF = "/root/testdata/sf0.001"


def test_draw_stream_equals_formula(spark):
    got = streams.drained(streams.draws(spark, 37, seed=7, stream=3, total=300, rate=120), f"d{uuid.uuid4().hex}").orderBy("draw").collect()
    want = rng.indices(rng.values(7, np.arange(300), 3), np.full(300, 37))
    assert [(r.draw, r.entry) for r in got] == list(enumerate(want.tolist()))


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    out = streams.drained(streams.windowed(stream), f"w{uuid.uuid4().hex}", "complete")
    got = {(r.start, r.event_type): (r.n, round(r.total, 4)) for r in out.collect()}
    want = {(r.start, r.event_type): (r.n, r.total) for r in catalogue.QUERIES["st_windowed_counts"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in want)


def test_meter_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "key string, t long, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "m"))
    got = streams.drained(streams.meter(stream, "key", "t", "v"), f"m{uuid.uuid4().hex}", "update").orderBy(F.desc("n")).first()
    assert (got.n, got["median"], got["mean"], got.maximum, got.global_mean) == (30, 19.0, 19.5, 29.0, 14.5)
