"""Incremental ingestion with state that the watermark bounds."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.catalog import model_queries
from hearthlake.streaming import incremental

SCHEMA = "url_anuncio string, seq bigint, at timestamp, descricao_completa string, extra map<string,string>"
START = datetime(2024, 1, 1)


def put(folder, name, rows):
    lines = [
        {"url_anuncio": u, "seq": s, "at": (START + timedelta(minutes=m)).isoformat() + "Z", "descricao_completa": f"text {s} com piscina", "extra": {"m": str(m)}}
        for u, s, m in rows
    ]
    (folder / name).write_text("\n".join(map(json.dumps, lines)))


def test_late_copies_compete_within_the_delay_and_state_goes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    target, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = incremental.listing_stream(spark, str(folder), SCHEMA, multi_line=False)
        query = incremental.ingest(stream, target, mark, order=["seq"], event_time="at", delay="60 minutes")
        query.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]

    one = [("a", 5, 0), ("a", 9, 1), ("b", 7, 2), ("", 1, 3), (None, 1, 3), ("c", 8, 50)]
    two = [("a", 3, 20), ("b", 8, 4), ("b", None, 40), ("c", 2, 70), ("d", 1, 90), ("e", 4, 100)]
    put(folder, "1.json", one)
    run()
    put(folder, "2.json", two)
    run()
    put(folder, "3.json", [("a", 1, 30), ("z", 1, 600)])  # behind the watermark (40): late; z moves the watermark to 540
    held = run()
    put(folder, "4.json", [("z", 0, 601), ("y", 1, 2000)])
    held = run()
    got = {r.url_anuncio: (r.seq, r.extra["m"]) for r in spark.read.parquet(target).collect()}
    everything = spark.createDataFrame([r for r in one + two + [("z", 1, 600), ("z", 0, 601)] if r[0]], "u string, s bigint, m int")
    want = everything.groupBy("u").agg(F.min_by(F.struct("s", "m"), F.struct("s")).alias("w")).collect()
    assert got == {r.u: (r.w.s, str(r.w.m)) for r in want}
    assert held[-1] <= 4  # of all keys only y, as one row and its timer


def test_extraction_of_first_copies(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "1.json", [("a", 2, 0), ("b", 1, 1), ("a", 1, 2), ("w", 0, 500)])
    stream = incremental.listing_stream(spark, str(folder), SCHEMA, multi_line=False)
    target = str(tmp_path / "out")
    incremental.extract_stream(
        stream, target, str(tmp_path / "mark"), ["piscina"], order=["seq"], event_time="at", delay="60 minutes"
    ).awaitTermination()
    rows = spark.read.parquet(target).select(vocab.URL, F.col("extraction.flags")["piscina"].alias("p")).collect()
    assert sorted(tuple(r) for r in rows) == [("a", True), ("b", True)]


def test_a_table_streams_from_one_file_or_from_a_folder_of_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i} the and {i}" if i % 4 else "short") for i in range(40)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "documents.parquet", index=False)
    for kind in ("parts", "one"):
        got = {r.url_anuncio: r.the_and for r in model_queries.stream_extract(spark, str(tmp_path / kind)).collect()}
        assert got == {str(i): i % 2 == 1 for i in range(20)}
