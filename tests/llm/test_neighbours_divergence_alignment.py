"""Quality by neighbours, source divergences and tokenizer alignment, against brute force and on odd tables."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthlake.llm import alignment, divergence, neighbours
from hearthlake.llm.bpe import byte_symbols

FILES = alignment.Files(
    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    public_tokenizers.path("piece_bpe_32k.model"),
)

# 11 quality by neighbours


def labelled(n):
    rng = random.Random(21)
    rows = []
    for i in range(n):
        text = brute.prose(rng, rng.choice(["en", "fr"]), rng.choice([5, 40, 120]))
        bad = i % 4 == 0
        if bad:
            text = [text.upper() + "!!", " ".join([text.split()[0]] * 40), text.replace(" ", " | "), "\n".join([text] * 5)][i // 4 % 4]
        rows.append((i, text, int(not bad)))
    return rows


def test_quality_is_learned_from_neighbours(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 3] + [(None, 1), (5, None), (1, 1), (999999, 0)], "doc_id long, quality int")
    model = neighbours.fit(docs, labels)
    got = {r.doc_id: r.score for r in neighbours.score(docs, model, keep=["doc_id"]).collect()}
    held = [(got[i] >= 0.5) == bool(q) for i, _, q in rows if i % 3 == 0]
    assert sum(held) >= 0.97 * len(held) and all(0 <= s <= 1 for s in got.values())


def test_votes_match_all_cosines():
    rows = labelled(200)
    found = neighbours.counts([t for _, t, _ in rows])
    model = neighbours.train(found, np.array([q for *_, q in rows]), 7)
    texts = [t for _, t, _ in labelled(60)] + ["", None, rows[3][1], "word " * 200_000]
    place = model.placed(neighbours.counts(texts))
    share = np.mean([q for *_, q in rows])
    for text, at, score in zip(texts, place, model.score(texts), strict=True):
        near = [round(float(x), 4) for x in model.voters @ at]
        last = sorted(near)[-7]
        votes = [(max(c, 1e-4) ** 4 / (share if q else 1 - share), q) for c, (*_, q) in zip(near, rows, strict=True) if c >= last]
        assert score == pytest.approx(sum(w * q for w, q in votes) / sum(w for w, _ in votes), abs=2e-3), text
    assert model.score([texts[5]]) == [model.score(texts)[5]]  # alone or in a block
    again = neighbours.counts(texts[:10])
    neighbours.forget()
    assert (again == neighbours.counts(texts[:10])).all()


def test_counted_terms_match_a_plain_count():
    text = "Well, well THEN!\nwell 12 | é well\nwell 12 | é well"
    want = Counter()
    for word in text.split():
        code = neighbours.word_terms(word)
        want[code // neighbours.HASHED] += 1
        want[code % neighbours.HASHED] += 1
    for term in neighbours.text_terms(text.split(), len(set(text.split())), text):
        want[term] += neighbours.WEIGHT
    got = neighbours.counts([text])[0]
    assert {i: c for i, c in enumerate(got.tolist()) if c} == want
    assert neighbours.shape_term("Well,") != neighbours.shape_term("WELL,")
    assert neighbours.word_terms("Well") == neighbours.hashed("well") * neighbours.HASHED + neighbours.shape_term("Aa")


def test_quality_on_odd_tables(spark, docs, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = neighbours.fit(clashing, labels)
    wide = neighbours.score(clashing, model)
    assert wide.count() == clashing.count() and dict(wide.dtypes)["score"] == "double"
    plain = {(r.doc_id, r.score) for r in neighbours.score(docs, model, keep=["doc_id"]).collect()}
    assert {(r.doc_id, r.score) for r in wide.collect()} == plain
    for none in (neighbours.fit(docs.limit(0), labels), neighbours.fit(docs, labels.limit(0))):
        assert {r.score for r in neighbours.score(docs, none).collect()} == {0.5}
    ones = neighbours.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in neighbours.score(docs, ones).collect()} == {1.0}
    assert neighbours.score(docs.limit(0), model).count() == 0
    hot = docs.limit(1).withColumn("doc_id", F.lit(1).cast("long")).crossJoin(spark.range(500)).drop("id")
    assert len(neighbours.fit(hot, labels).voters) == 1  # one key teaches once


# 12 source divergence


def divergences_of(rows, least, top):
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = brute.letter_terms(text)
        documents[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = sorted(s for x, s in counts if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}  # noqa: B023

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize(("held", "entries", "block"), [(1_000_000, 1_000_000, 1_024), (50, 40, 2), (1, 7, 1)])
def test_divergences_match_brute_force(spark, docs, corpus, held, entries, block):
    odd = [("Ünï é_É x", "en", "src0"), (None, None, None), ("", "en", "quiet"), ("", "none", "a"), ("zz", "none", "b"), ("tie tie", "", "src1")]
    rows = [(r[1], r[2], r[3]) for r in corpus[0]] + odd
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    found = divergence.divergences(df, min_documents=4, top=9, held=held, entries=entries, block=block)
    assert sorted(tuple(r) for r in found.collect()) == divergences_of(rows, 4, 9)


def test_pair_sums_do_not_depend_on_their_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    counts, total = rng.integers(0, 4, (50, 7)), rng.integers(500, 900, 7)
    row, col = np.nonzero(counts)
    p = divergence.shares(counts, total)
    want = np.abs(p[:, 2:5, None] - p[:, None, :]).sum(0)
    for cells in (1, 20, 10_000):
        monkeypatch.setattr(divergence, "CELLS", cells)
        assert (divergence.pair_sums(row, col, counts[row, col], 50, total, range(2, 5)) == want).all()


def test_divergence_shares_are_exact():
    rng = random.Random(5)
    for _ in range(2000):
        total = rng.randrange(5, 10 ** rng.randrange(1, 16))
        count = rng.randrange(0, max(1, total - 4))
        got = divergence.shares(np.array([count]), np.array([total]))[0]
        assert got == 1 + 1_000_000_000 * (count + 5) // total


def test_divergences_on_odd_tables(spark, docs, clashing):
    plain = sorted(tuple(r) for r in divergence.divergences(docs, min_documents=3).collect())
    assert sorted(tuple(r) for r in divergence.divergences(clashing, min_documents=3).collect()) == plain
    assert divergence.divergences(docs.limit(0)).count() == 0
    long = spark.createDataFrame([("alpha beta " * 200_000, "en", "a"), ("beta " * 3, "en", "b"), ("beta", "en", "b")], docs.select("text", "lang", "source").schema)
    rows = [tuple(r) for r in divergence.divergences(long, min_documents=2).collect()]
    assert {(r[1], r[2], r[3]) for r in rows} == {("a", "pair", "b"), ("b", "pair", "a")} and all(r[4] == 0 for r in rows)


# 13 alignment


class Plain:
    """Both tokenizers by their libraries, and links by comparing byte ranges."""

    def __init__(self):
        self.a = Tokenizer.from_file(FILES.byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES.pieces)
        self.value = {s: b for b, s in enumerate(byte_symbols())}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.value[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
             for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        raw = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == raw == b"".join(t for _, t in b) else ([], [])

    def aligned(self, text):
        ranges = []
        for side in self.tokens(text):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            ranges.append(out)
        a, b = ranges
        groups, low = [], 0
        for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in ranges))
            low = cut
        links = [(i, j) for i, s, e in a for j, x, y in b if s < y and x < e]
        return len(a), len(b), len(groups), ";".join(groups), links


def alignments_of(texts):
    plain = Plain()
    found = [plain.aligned(t) for t in texts]
    count = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), groups)
        for n_a, n_b, n_groups, groups, links in found
    ]


ODD = [
    None, "", " ", "a", "▁x", "x▁y", "<s> a </s> <unk> <|endoftext|>", "\0 nul \0", "é\U0001F600 ﬁ é", "日本語テキスト", "a  b   c\n\n\td", "\r\n",
    "aaaaaaaa" * 40, "same words again and again, same words again", "same words again and again, same words again", "1234567890 3.14", "﻿bom", "İstanbul ſ",
]


@pytest.mark.parametrize("entries", [6_000_000, 40])
def test_alignment_matches_plain_tokenizers(spark, corpus, entries):
    texts = [(r[1] or "")[:400] if r[1] is not None else None for r in corpus[0][:60]] + ODD
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `block` string").repartition(3)
    rows = sorted(alignment.align(df, FILES, ["doc_id", "block"], entries=entries).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts))) and rows[0].block == "x"
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows]
    assert got == alignments_of(texts)


def test_alignment_of_random_texts():
    rng, plain, pair = random.Random(9), Plain(), alignment._pair(FILES)
    parts = ["the", " ", "  ", "ing", "é", "日", "▁", "\n", "x", "'s", "́", "12", "<0x41>", "\U0001F600", "\t", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    got = alignment.align_texts(pair, texts)
    links = defaultdict(list)
    for t, a, b in zip(got.text.tolist(), got.a.tolist(), got.b.tolist(), strict=True):
        links[t].append((a, b))
    for i, text in enumerate(texts):
        n_a, n_b, n_groups, groups, want = plain.aligned(text)
        assert (got.n_a[i], got.n_b[i], got.n_groups[i], got.groups[i], sorted(links[i])) == (n_a, n_b, n_groups, groups, sorted(want)), text


def test_postings_hold_documents_and_link_counts():
    rng = np.random.default_rng(2)
    block, want = alignment.Block(), {}
    for pair, documents in ((7, alignment.DENSE + 500), (9, alignment.DENSE - 1), (11, 3), (12, 60_000), (1 << 33, 1)):
        members = np.sort(rng.choice(alignment.DOCUMENTS, documents, False))
        links = rng.choice([1, 1, 1, 2, 5, 300], documents) if pair != 11 else np.array([1, 1, 70_000])
        block.add(np.full(links.sum(), pair), np.repeat(members, links))
        want[pair] = dict(zip(members.tolist(), links.tolist(), strict=True))
    found = block.postings()
    width = found["documents"].to_numpy()
    assert found["pair"].to_pylist() == sorted(want) and width.tolist() == [len(want[p]) for p in sorted(want)]
    assert max(len(m) for m in found["members"].to_pylist()) <= alignment.DOCUMENTS // 8
    for cut in (slice(0, 5), slice(1, 4), slice(2, 3)):
        row, low, links = alignment.entries_of(width[cut], found["members"][cut], found["planes"][cut])
        got = defaultdict(dict)
        for r, d, n in zip(row.tolist(), low.tolist(), links.tolist(), strict=True):
            got[sorted(want)[cut][r]][d] = n
        assert got == {p: want[p] for p in sorted(want)[cut]}


def test_alignment_on_odd_tables(spark, docs, clashing):
    assert alignment.align(docs.limit(0), FILES, ["doc_id"]).count() == 0
    plain = Counter((r.doc_id, r.count_sum, r.groups) for r in alignment.align(docs, FILES, ["doc_id"]).collect())
    assert Counter((r.doc_id, r.count_sum, r.groups) for r in alignment.align(clashing, FILES, ["doc_id", "ids", "key"]).collect()) == plain
    long = ["word " * 60_000 + " " * 60_000 + "end", "a" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    library, model = Plain().a, Plain().b
    digests = alignment.align(df, FILES, ["doc_id"], carry=lambda g: F.md5(g)).collect()
    for r in digests:
        assert (r.n_a, r.n_b) == (len(library.encode(" " + long[r.doc_id]).ids), len(model.encode(long[r.doc_id]))) and len(r.groups) == 32
        assert r.n_links == r.n_a + r.n_b - r.n_groups


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in (11, 12, 13):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "op12_source_divergence" in __spark_entry__.oracle_sql()
