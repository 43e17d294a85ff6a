"""Quality by nearest neighbours: labelled texts in a latent-semantic space vote by their cosine with every document."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import with_python
from hearthlake.llm.toxicity import sample

#: Labelled texts of each label that the fit reads; they are also the voters.
LABELLED = 1_500
#: Numbers that terms are hashed to, and dimensions of the latent space.
HASHED, LATENT = 4_096, 64
#: Neighbours that vote, and the power of the cosine that a vote weighs. Cosines are compared in steps of 10^-DIGITS.
NEIGHBOURS, POWER, DIGITS = 15, 4, 4
#: Documents that meet the voters at once.
BLOCK = 256
#: Words whose terms a task remembers.
CACHED_WORDS = 200_000
#: Where a share of a text's words or lines passes from one term to the next, and how often such a term counts.
SHARES, WEIGHT = (0.001, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9), 2
PIECE = 1_000_000

_CLASSES = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "9")]
_SEED = 7


def hashed(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % HASHED


@lru_cache(maxsize=10_000)
def shape_term(shape: str) -> int:
    for run, sign in _CLASSES:
        shape = run.sub(sign, shape)
    return hashed("shape " + shape[:8])


def word_terms(word: str) -> int:
    """The two terms of a word between blanks, in one number: its spelling and its shape (runs of a class as one sign)."""
    core = word.rstrip(".,;:!?")
    shape = word
    if core.isalpha():  # the usual shapes, without a search; letters of any script
        if core.islower():
            shape = "a" + word[len(core) :]
        elif core[1:].islower():
            shape = "Aa" + word[len(core) :]
    return hashed(core.lower()) * HASHED + shape_term(shape)


def text_terms(words: list[str], kinds: int, text: str) -> list[int]:
    """Terms of the whole text: how many words, and what share repeats the word before, is distinct, or is in repeated lines."""
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {
        "follows itself": sum(map(operator.eq, words, words[1:])) / n,
        "distinct": kinds / n,
        "repeated lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    out = [hashed(f"words {len(words).bit_length()}")]
    for name, share in shares.items():
        out += [hashed(f"{name} {i}") for i in range(1 + sum(share >= s for s in SHARES))]
    return out


_known: dict[str, int] = {}


def forget() -> None:
    _known.clear()


def counts(texts: list[str | None]) -> np.ndarray:
    """Term counts of whole texts, one row each; a null text is empty, and an empty text has the terms of no words."""
    rows, codes, times, own_rows, own = [], [], [], [], []
    for i, text in enumerate(texts):
        words = (text or "").split()
        bag = Counter(words)
        if len(_known) > CACHED_WORDS:
            forget()
        for w in bag:
            if w not in _known:
                _known[w] = word_terms(w)
        rows.append(len(bag))
        codes += map(_known.__getitem__, bag)
        times += bag.values()
        more = text_terms(words, len(bag), text or "")
        own_rows.append(len(more))
        own += more
    at = np.repeat(np.arange(len(texts)) * HASHED, rows)
    code, n = np.array(codes, np.int64), np.array(times, np.float64)
    places = [at + code // HASHED, at + code % HASHED, np.repeat(np.arange(len(texts)) * HASHED, own_rows) + np.array(own, np.int64)]
    weights = [n, n, np.full(len(own), WEIGHT, np.float64)]
    flat = np.bincount(np.concatenate(places), np.concatenate(weights), len(texts) * HASHED)
    return flat.reshape(len(texts), HASHED).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def latent_axes(rows: np.ndarray, axes: int, passes: int = 4) -> np.ndarray:
    """The first right singular vectors by a randomised range finder with power passes."""
    start = np.random.default_rng(_SEED).standard_normal((rows.shape[1], axes + 10)).astype(np.float32)
    range_ = rows @ start
    for _ in range(passes):
        q, _ = np.linalg.qr(range_)
        z, _ = np.linalg.qr(rows.T @ q)
        range_ = rows @ z
    q, _ = np.linalg.qr(range_)
    return np.linalg.svd(q.T @ rows, full_matrices=False)[2][:axes].T.copy()


@dataclass
class NeighbourModel:
    """Term weights, axes of the latent space, and the voters in it with their labels and weights."""

    idf: np.ndarray
    axes: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    neighbours: int

    def placed(self, found: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(found) * self.idf) @ self.axes)

    def vote(self, rows: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest voters, and all that are as near as the last of them."""
        if not len(self.voters):
            return np.full(len(rows), 0.5)
        cosine = np.round(rows @ self.voters.T, DIGITS)
        k = min(self.neighbours, len(self.voters))
        last = np.partition(cosine, -k, axis=1)[:, -k, None]
        row, voter = np.nonzero(cosine >= last)
        weight = np.maximum(cosine[row, voter], 10.0**-DIGITS).astype(np.float64) ** POWER * self.weights[voter]
        total = np.bincount(row, weight, len(rows))
        return np.round(np.bincount(row, weight * self.labels[voter], len(rows)) / total, 9)

    def score(self, texts: list[str | None]) -> list[float]:
        out = [self.vote(self.placed(counts(texts[i : i + BLOCK]))) for i in range(0, len(texts), BLOCK)]
        return np.concatenate(out).tolist() if out else []


def train(found: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS) -> NeighbourModel:
    """Space and voters from term counts; either label weighs as much as the other in all."""
    idf = (np.log((1 + len(found)) / (1 + (found > 0).sum(0))) + 1).astype(np.float32)
    rows = unit(np.log1p(found) * idf)
    axes = latent_axes(rows, LATENT) if len(rows) else np.zeros((HASHED, LATENT), np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    return NeighbourModel(idf, axes, unit(rows @ axes), labels, 1 / np.maximum(share, 1e-9)[labels], neighbours)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED,
    neighbours: int = NEIGHBOURS,
) -> NeighbourModel:
    """Learn from about `labelled` rows of `labels` for each of the labels 0 and 1, chosen by a hash of the key.

    Texts stay on the executors: the driver gets their term counts, HASHED numbers a text at most. Rows with
    a null key, label or text teach nothing; repeated labels count once, and of documents with one key the least text.
    Without labels all scores are 0.5; with one label only, all votes are for it.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("_label")).distinct()
    chosen = sample(known.where("_label = 0"), labelled, key).unionByName(sample(known.where("_label = 1"), labelled, key))
    texts = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key)
    once = texts.groupBy(key, "_label").agg(F.min(text).alias("_text"))

    def work(rows: list) -> dict:
        found = counts(rows)
        terms = [np.flatnonzero(row) for row in found]
        return {
            "terms": [t.astype("<u2").tobytes() for t in terms],
            "times": [row[t].astype("<f4").tobytes() for row, t in zip(found, terms, strict=True)],
        }

    taken = with_python(once, "_text", "terms binary, times binary", work, ["_label"])
    rows = sorted((r._label, bytes(r.terms), bytes(r.times)) for r in taken.collect())
    found = np.zeros((len(rows), HASHED), np.float32)
    for i, (_, terms, times) in enumerate(rows):
        found[i, np.frombuffer(terms, "<u2")] = np.frombuffer(times, "<f4")
    return train(found, np.array([r[0] for r in rows], np.int64), neighbours)


def score(df: DataFrame, model: NeighbourModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with the score of its whole texts, 0 to 1; null and empty texts are scored as texts without words.

    The voters are broadcast: two samples of bounded size in LATENT numbers each. A document meets all of them.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(texts: list) -> dict:
        return {"score": shared.value.score(texts)}

    return with_python(df, text, "score double", work, keep, PIECE, after=forget)
