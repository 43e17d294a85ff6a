import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from brute import prose  # noqa: E402


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) rows with copies, near copies, leaks, personal data, nulls and odd texts."""
    rng = random.Random(5)
    items = [(i, prose(rng, "en", 25)) for i in range(6)] + [(6, "Short item here"), (7, None), (8, ""), (None, prose(rng, "en", 12))]
    texts = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = prose(rng, lang, rng.choice([3, 30, 80, 200]))
        if i % 10 == 1:
            text += f" write to me{i}@mail.example.com or +1 (905) 555-{1000 + i}, 10.0.{i}.7 "
        if i % 10 == 2:
            text += " " + items[i % 6][1].upper() + "\nend"
        texts.append((text, lang))
    base = prose(rng, "en", 120).split()
    for k in range(12):  # near copies, some with more edits
        words = list(base)
        for _ in range(k // 3):
            words[rng.randrange(len(words))] = "edited" + str(k)
        texts.append((" ".join(words), "en"))
    texts += [texts[0]] * 5 + [("", "en"), (None, "en"), ("  \n ", None), ("!!!", "fr"), ("12345 67890", "en"), (texts[3][0], None)]
    texts += [("card 999 4242424242424242 x", "en"), ("a short item here, too", "en"), ("é\U0001F600 me@x.org \U0001F600", "fr")]
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5][0], None, None, None)]
    return rows, items


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def benchmark_items(spark, corpus):
    return spark.createDataFrame(corpus[1], "item_id long, text string")


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = "ids decoded score lang_pred margin rejected n_words n_hit hit_items hit_words spans base_spans key bands kept class_id _doc _row _source".split()
    return docs.select("*", *[F.lit("x").alias(n) for n in names])
