"""Every pipeline stage against a brute-force version on its own input, and the registered queries."""

from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from hearthlake.llm import language, neardup, private


@pytest.fixture(scope="module")
def sf_dir(clashing, benchmark_items, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    clashing.write.parquet(f"{folder}/documents.parquet")
    benchmark_items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def bag(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_stages_match_brute_force(spark, sf_dir, corpus):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "private_data", "bpe"]

    model = language.fit(docs.where(~language.held_out(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)))))
    ready = model.compressors()
    told = spark.createDataFrame(stages["language_id"](spark, docs, sf_dir).collect(), docs.schema)
    assert told.columns == columns

    def clear(text):
        words = language.distinct_words(text or "")
        sizes = sorted(len(z.compress(words + language.FILLER)) for _, z in ready)
        return bool(words) and sizes[1] - sizes[0] >= max(1, language.NARROW * sizes[0])

    assert bag(told.collect(), *columns) == bag([r for r in docs.collect() if clear(r.text)], *columns)

    alone = spark.createDataFrame(stages["near_duplicates"](spark, told, sf_dir).collect(), docs.schema)
    rows = told.collect()
    classes = brute.near_classes([(i, r.text) for i, r in enumerate(rows)], neardup.words)
    texts = Counter(classes[i] for i in range(len(rows)))
    stayed = [next(i for i, r in enumerate(rows) if r == s) for s in alone.collect()]
    assert sorted(classes[i] for i in stayed) == sorted(texts)
    for s in alone.collect():  # the smallest id of a group stays
        mine = [r.doc_id for i, r in enumerate(rows) if classes[i] == classes[next(j for j, x in enumerate(rows) if x == s)]]
        assert s.doc_id == min((x for x in mine if x is not None), default=None)

    clean = spark.createDataFrame(stages["decontamination"](spark, alone, sf_dir).collect(), docs.schema)
    want = [r for r in alone.collect() if not brute.leaks(r.text, corpus[1])[1]]
    assert bag(clean.collect(), *columns) == bag(want, *columns) and len(want) < alone.count()

    safe = spark.createDataFrame(stages["private_data"](spark, clean, sf_dir).collect(), docs.schema)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in private.find(clean, private.fit(clean)).collect()}
    for r in safe.collect():
        before = next(x for x in clean.collect() if x.doc_id == r.doc_id)
        assert set(brute.base_spans(before.text)) <= set(spans[r.doc_id])
        assert r.text == brute.masked(before.text, spans[r.doc_id]) and r.n_chars == len(r.text)
    assert safe.columns == columns and safe.count() == clean.count() and any("[PHONE]" in r.text for r in safe.collect())

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for r in stages["bpe"](spark, safe, sf_dir).collect():
        text = next(x.text for x in safe.collect() if x.doc_id == r.doc_id)
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in whole) == sorted(r.doc_id for r in safe.collect())


def test_stages_on_an_empty_table(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names
    assert {"op3_host_quality", "op7_benchmark_leaks", "op8_chat_format"} <= set(__spark_entry__.oracle_sql())
