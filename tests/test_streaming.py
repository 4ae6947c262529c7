"""Streams give what the batch operators give, whatever the order of arrival within the delay."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.operators import performance
from weftline.streaming import lab

START = datetime(2026, 1, 1)


def streamed(spark, tmp_path, rows, schema, of, mode, parts=4):
    """Rows in `parts` files, one a batch, through the stream `of`; what the sink holds at the end."""
    folder = tmp_path / "in"
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"t{random.randrange(10**9)}"
    query = of(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_finished_requests(spark, tmp_path):
    rng = random.Random(4)
    events = []
    for page in range(5):
        for request in range(12):
            at = rng.randrange(50_000)
            for k in range(rng.randint(1, 4)):
                at += rng.randrange(1, 900)
                ended = rng.random() < 0.5
                events.append((page, request, START + timedelta(milliseconds=at), ended, None if ended else f"u{page}-{request}-{k}", None if ended else "script", rng.choice([None, 10.4, 0.0, 99.6]) if ended else None))
    # Arrival differs from time by less than the delay.
    events.sort(key=lambda e: e[2] + timedelta(milliseconds=rng.randrange(20_000)))
    events += [(99, 0, START + timedelta(hours=1), False, "last", "x", None)]
    schema = "page long, request long, at timestamp, ended boolean, url string, type string, bytes double"
    got = sorted(map(tuple, streamed(spark, tmp_path, events, schema, lambda s: lab.finished_requests(s, "30 seconds"), "append").collect()), key=str)
    df = spark.createDataFrame(events, schema).withColumn("at", F.unix_micros("at"))
    batch = performance.finished_requests(df.filter("not ended").select("page", "request", "at", "url", "type"), df.filter("ended").select("page", "request", "at", "bytes"))
    assert got == sorted(((r.page, r.request, r.url, r.type, r.bytes) for r in batch.collect()), key=str) and len(got) > 10


def test_capped_sessions(spark, tmp_path):
    rng = random.Random(5)
    shifts = [(page, START + timedelta(milliseconds=1 + rng.randrange(60_000)), rng.random()) for page in range(6) for _ in range(40)]
    shifts = list({(p, at): (p, at, v) for p, at, v in shifts}.values())
    rng.shuffle(shifts)
    shifts += [(99, START + timedelta(hours=2), 0.5)]
    got = streamed(spark, tmp_path, shifts, "page long, at timestamp, value double", lambda s: lab.capped_sessions(s, 1000, 5000, "2 minutes"), "update").filter("page < 99").groupBy("page").agg(F.max("worst").alias("worst"))
    df = spark.createDataFrame(shifts, "page long, at timestamp, value double").filter("page < 99").withColumn("ms", F.unix_millis("at"))
    batch = performance.capped_sessions(df, "page", "ms", "value", 1000, 5000)
    assert {r.page: round(r.worst, 9) for r in got.collect()} == {r.page: round(r.worst, 9) for r in batch.collect()}
