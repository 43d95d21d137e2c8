"""Windowed operators give the same rows on a stream as on a table."""

import pytest
from pyspark.sql import functions as F

from mietwerk.streaming import windows
from tests.conftest import SMALL


def drained(spark, stream, name):
    # a last late event closes all windows before it
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


@pytest.mark.parametrize("name,apply,key", [
    ("tumbled", lambda e: windows.tumbling(e, "1 hour"), "start"),
    ("slid", lambda e: windows.sliding(e, "2 hours", "1 hour"), "start"),
    ("met", lambda e: windows.sessions(e, "30 minutes"), "start"),
])
def test_stream_equals_table(spark, tmp_path, name, apply, key):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    place = str(tmp_path / "events")
    table.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(place)
    streamed = drained(spark, apply(spark.readStream.schema(table.schema).parquet(place)), name).toPandas()
    whole = apply(table).toPandas()
    assert len(streamed) and set(map(tuple, streamed.astype(str).values)) <= set(map(tuple, whole.astype(str).values))
    last = streamed[key].max()
    closed = whole[whole[key] < last - __import__("pandas").Timedelta("3h")]
    assert set(map(tuple, closed.astype(str).values)) <= set(map(tuple, streamed.astype(str).values))


def test_first_seen_drops_repeats(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet").limit(200)
    place = str(tmp_path / "twice")
    table.unionByName(table).coalesce(1).write.parquet(place)
    stream = windows.first_seen(spark.readStream.schema(table.schema).parquet(place), ["event_id"])
    assert drained(spark, stream, "firsts").select(F.count("*"), F.count_distinct("event_id")).first()[:] == (200, 200)
