import random
from datetime import datetime, timedelta

from rolesift.operators.state import sent_in_history
from rolesift.streaming.suppression import notify_stream

SCHEMA = "vacancy_key string, seen_at timestamp"


def test_stream_sends_what_the_history_sends(spark, tmp_path):
    rng, start = random.Random(5), datetime(2026, 1, 1)
    rows = sorted(((f"k{rng.randrange(3)}", start + timedelta(minutes=rng.randrange(30 * 1440))) for _ in range(300)), key=lambda r: r[1])
    rows += [("late", start + timedelta(days=60))]
    landed = str(tmp_path / "landed")
    for i in range(0, 301, 100):
        spark.createDataFrame(rows[i : i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed)
    query = (
        notify_stream(stream, 7).writeStream.format("memory").queryName("sent").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # the key 'late' comes long after all notices have ended: only its own is left in the state
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 1
    want = sent_in_history(spark.createDataFrame(rows, SCHEMA), ["vacancy_key"], "seen_at", 7)
    assert sorted(map(tuple, spark.sql("SELECT * FROM sent").collect())) == sorted((r["vacancy_key"], r["seen_at"]) for r in want.collect())
