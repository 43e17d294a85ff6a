"""Keys that the watermark bounds are held in buckets: the state is read and written once a bucket, and keys stay apart."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthlake.streaming import incremental

SCHEMA = "url_anuncio string, seq bigint, at timestamp, price double"
START = datetime(2024, 1, 1)
DELAY = 60
BUCKETS = 8


def put(folder, number, rows):
    lines = [{"url_anuncio": u, "seq": s, "at": (START + timedelta(minutes=m)).isoformat() + "Z", "price": p} for u, s, m, p in rows]
    (folder / f"{number}.json").write_text("\n".join(map(json.dumps, lines)))
    os.utime(folder / f"{number}.json", (1_700_000_000 + number,) * 2)  # files are read in this order


def expected(batches, rank):
    """What goes out of one batch after the other, with the keys that are still held."""
    held, out, mark = {}, [], 0

    def go():
        for u in [u for u, (first, _) in held.items() if first + DELAY <= mark]:
            out.append(held.pop(u)[1][:2])

    for rows in batches:
        for row in rows:
            if row[2] > mark:
                first, best = held.get(row[0], (row[2], row))
                held[row[0]] = (min(first, row[2]), min(best, row, key=rank))
        go()
        mark = max(mark, max(r[2] for r in rows) - DELAY)
    go()
    return sorted(out), held


def nulls_first(v):
    return (v is not None, v)


@pytest.mark.parametrize("order", [["price", "seq"], ["at", "seq"]])
def test_state_is_written_once_a_bucket_and_keys_stay_apart(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(incremental, "BUCKETS", BUCKETS, raising=False)
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(5)
    batches, seq = [], 0
    for start in (0, 30, 75, 230, 235, 290):
        rows = []
        for _ in range(300):
            seq += 1
            rows.append((f"u{rng.randrange(120)}", seq, start + rng.randrange(1, 45), rng.choice([None, 1.5, 2.5, 3.5])))
        batches.append([*rows, ("last", seq, start + 45, None)])
    for i, rows in enumerate(batches):
        put(folder, i, rows)
    stream = incremental.listing_stream(spark, str(folder), SCHEMA, multi_line=False, max_files=1)
    query = incremental.ingest(
        stream, str(tmp_path / "out"), str(tmp_path / "mark"), order=order, event_time="at", delay=f"{DELAY} minutes"
    )
    query.awaitTermination()
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    at = {"price": lambda r: nulls_first(r[3]), "at": lambda r: r[2]}[order[0]]
    want, held = expected(batches, lambda r: (at(r), r[1]))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("url_anuncio", "seq").collect())
    assert got == want and len(held) > BUCKETS
    assert len(written) == len(batches) and max(written) <= 2 * BUCKETS  # of up to 121 keys: a row and a timer a bucket


@pytest.mark.parametrize("buckets", [1, 1 << 16])
def test_a_key_goes_when_the_watermark_reaches_its_time_alone_or_beside_others(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(incremental, "BUCKETS", buckets, raising=False)
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, 1, [("a", 1, 1, 1.0), ("b", 2, 2, 1.0), ("c", 3, 3, 1.0), ("z", 4, 2 + 2 * DELAY, 1.0)])  # the watermark gets to b's time
    stream = incremental.listing_stream(spark, str(folder), SCHEMA, multi_line=False)
    incremental.ingest(
        stream, str(tmp_path / "out"), str(tmp_path / "mark"), order=["seq"], event_time="at", delay=f"{DELAY} minutes"
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sort_array(F.collect_list("url_anuncio")).alias("u")).first().u
    assert got == ["a", "b"]
