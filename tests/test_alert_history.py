"""Alert histories: known answers, and streams with late and repeated checks against the table."""

import datetime as dt
import json
import os
import random

from cinderpath.streaming import alert_history as H

T = 1_700_000_000_000


def _told(df):
    return sorted(((r.key, r.at - T, r.status, r.value) for r in df.collect()), key=repr)


def test_known_answers(spark):
    checks = [(0, True, 1.0), (50, True, 2.0), (60, False, 0.0), (70, True, 3.0), (100, True, 4.0), (300, True, 5.0), (310, None, None), (310, False, 1.5)]
    rows = [("a", T + at, b, v) for at, b, v in checks] + [(None, T, True, 1.0), ("b", None, True, 1.0), ("c", T, True, None), ("d", T, False, 1.0)]
    got = _told(H.history(spark.createDataFrame(rows, "key string, at long, broken boolean, value double"), 100, 150, T + 1000))
    assert got == sorted(
        [
            ("a", 0, "FIRING", 1.0),
            ("a", 60, "RESOLVED", 0.0),  # 70 is within the cooldown of 0
            ("a", 100, "FIRING", 4.0),
            ("a", 250, "RESOLVED", None),  # silence
            ("a", 300, "FIRING", 5.0),
            ("a", 310, "RESOLVED", 1.5),
            ("c", 0, "FIRING", None),
            ("c", 150, "RESOLVED", None),
        ],
        key=repr,
    )
    assert H.history(spark.createDataFrame([], "key string, at long, broken boolean, value double")).count() == 0


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), T + rng.randrange(0, 400) * 1000, rng.random() < 0.5, float(rng.randrange(9))) for _ in range(150)]
    rows += rows[:20] + [("end", T + 10_000_000, False, 0.0)]
    files = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 50_000))  # up to 50 seconds late
    (tmp_path / "in").mkdir()
    for i in range(4):
        part = files[i * 45 : (i + 1) * 45]
        text = "\n".join(json.dumps({"key": k, "ts": dt.datetime.fromtimestamp(at / 1000, dt.UTC).isoformat(), "broken": b, "value": v}) for k, at, b, v in part)
        (tmp_path / "in" / f"{i}.json").write_text(text)
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # the stream takes the oldest first
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    try:
        source = spark.readStream.schema("key string, ts timestamp, broken boolean, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = H.history_stream(source, 30_000, 20_000, "60 seconds").writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        out.format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination(200)
    finally:
        spark.conf.set(provider, before)
    want = _told(H.history(spark.createDataFrame(rows, "key string, at long, broken boolean, value double"), 30_000, 20_000, T + 9_000_000))
    assert len(want) > 20 and _told(spark.read.schema(H._OUT).parquet(str(tmp_path / "out"))) == want
