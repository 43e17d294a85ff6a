"""JSON arrays cut into splits, against the standard parser."""

import json
import random

import pytest

from hearthlake.sources import json_arrays, readers
from pyspark.sql import types as T


@pytest.fixture
def small_splits(spark):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "a", "é", "\U0001F600", "\n", "}{", '\\"']) for _ in range(rng.randrange(8)))
    if kind == 3:
        return rng.choice([None, True, 1.5, -3, 10**12])
    if kind < 6:
        return {random_value(rng, 9) if rng.random() < 0 else f"k{i}}}": random_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_records_of_random_arrays(spark, tmp_path, small_splits):
    rng, want = random.Random(3), {}
    for i in range(25):
        items = [{"n": k, "v": random_value(rng), "w": random_value(rng)} for k in range(rng.choice([0, 1, 3, 40]))]
        text = json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if items and i % 5 == 0:
            text, items = rng.choice([text[: rng.randrange(1, len(text) - 1)], text + "]", text.replace('"n"', 'n"', 1)]), []  # does not close
        elif items and i % 5 == 1:
            text, items = json.dumps(items[0]) + rng.choice(["", "\n"]), items[:1]
        (tmp_path / f"{i:02}.json").write_bytes(rng.choice([b"", b"\xef\xbb\xbf", b" \n"]) + text.encode())
        want |= {(f"{i:02}", k): item for k, item in enumerate(items)}
    rows = json_arrays.records(spark, str(tmp_path)).collect()
    got = {(r.file[-7:-5], r.record): json.loads(r.text) for r in rows}
    assert len(rows) == len(got) and got == want
    assert json_arrays._cut(spark, [str(tmp_path)]).select("file", "split").distinct().count() > 60


def test_rows_equal_the_whole_file_reader(spark, tmp_path, small_splits):
    rng = random.Random(8)
    items = [{"url_anuncio": f"u{i}", "titulo": random_value(rng, 3), "bairro": rng.choice(["x", None])} for i in range(200)]
    items[7]["long"] = "y" * 1000 + '}"{'  # a record over many splits
    (tmp_path / "a.json").write_text(json.dumps(items))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("url_anuncio", "titulo", "bairro", "long")])
    whole = readers.read_listings(spark, str(tmp_path / "a.json"), schema).collect()
    split = json_arrays.read_json_arrays(spark, str(tmp_path / "a.json"), schema).orderBy("record_no")
    assert [tuple(r)[:4] for r in split.collect()] == [tuple(r) for r in whole]
    assert [r.record_no for r in split.collect()] == list(range(200))
    (tmp_path / "empty.json").write_text("")
    assert json_arrays.read_json_arrays(spark, str(tmp_path / "empty.json"), schema).count() == 0


def test_small_splits_share_tasks(spark, tmp_path, small_splits):
    items = [{"url_anuncio": f"u{i}", "titulo": '}, {"' * (i % 3)} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(items))
    cut = json_arrays._cut(spark, [str(tmp_path / "a.json")])
    splits = cut.select("split").distinct().count()
    assert splits > 100 and cut.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    rows = json_arrays.records(spark, str(tmp_path / "a.json")).orderBy("record").collect()
    assert [json.loads(r.text) for r in rows] == items and [r.record for r in rows] == list(range(400))
