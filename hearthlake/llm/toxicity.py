"""Toxicity by non-negative positive-unlabelled learning: a linear numpy classifier over words and their beginnings."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import checkpointed, with_python

#: Bounds of the fit: confirmed examples and unlabelled texts that are read on the driver.
POSITIVES, UNLABELLED = 3_000, 12_000
#: Lengths of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6)
#: A feature gets a weight if it is in so many sampled texts, and its shares differ by so many standard errors.
MIN_TEXTS, CONTRAST = 5, 6.0
STEPS, RATE, PENALTY = 300, 0.05, 1e-4

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def features(text: str | None) -> set[str]:
    """The lower-cased words of a whole text and their beginnings: insults take endings.

    Each is one feature if it occurs, and a second one, marked by +, if it occurs twice or more.
    """
    seen = Counter(_WORDS.findall(text.lower())) if text else Counter()
    starts: Counter = Counter()
    for w, times in seen.items():
        for n in PREFIXES:
            if len(w) > n:
                starts[w[:n] + "*"] += times
    seen.update(starts)
    return {*seen, *[f + "+" for f, times in seen.items() if times > 1]}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in features(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """About `rows` rows of `df`, chosen by a hash of `key`: the same ones whatever the row order."""
    total = max(1, df.count())
    share = min(1.0, rows / total)
    span = 1 << 31
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(span)) < int(span * share))


def nn_risk_step(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Risk and its slopes by the scores, with logistic loss.

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]). Where the second part is below zero
    the classifier has fitted the unlabelled texts too far, and the step goes up that part instead.
    """
    positive = prior * np.logaddexp(0, -z_p).mean()
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    d_p, d_u = -prior * s_p / len(z_p), s_u / len(z_u)
    if negative < 0:
        return positive, -d_p, -d_u
    return positive + negative, d_p - prior * (1 - s_p) / len(z_p), d_u


class Sparse:
    """Rows of feature numbers, each with the weight 1."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, d: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, d[self.row], size)


def telling(p: Sparse, u: Sparse, size: int) -> np.ndarray:
    """Numbers of the features whose share of texts differs between the samples by CONTRAST standard errors."""
    n_p, n_u = np.bincount(p.col, minlength=size), np.bincount(u.col, minlength=size)
    share = (n_p + n_u) / (p.n + u.n)
    error = np.sqrt(share * (1 - share) * (1 / p.n + 1 / u.n)) + 1e-12
    z = (n_p / p.n - n_u / u.n) / error
    return np.flatnonzero((n_p + n_u >= MIN_TEXTS) & (np.abs(z) >= CONTRAST))


def descend(p: Sparse, u: Sparse, names: list[str], prior: float) -> ToxicityModel:
    """Weights of the features `names`, by whose places the rows of both samples are given."""
    size = len(names)
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        _, d_p, d_u = nn_risk_step(p.dot(w) + b, u.dot(w) + b, prior)
        grad = np.append(p.back(d_p, size) + u.back(d_u, size) + PENALTY * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return ToxicityModel(dict(zip(names, w.tolist(), strict=True)), float(b))


def train(positive: list[str], unlabelled: list[str], prior: float) -> ToxicityModel:
    """Fit on texts at hand; without confirmed examples or unlabelled texts no score is above 0.5."""
    if not positive or not unlabelled:
        return ToxicityModel({}, -2.0)
    number: dict[str, int] = {}

    def numbered(texts: list[str]) -> list[np.ndarray]:
        return [np.array([number.setdefault(f, len(number)) for f in features(t)], np.int32) for t in texts]

    parts = numbered(positive), numbered(unlabelled)
    chosen = telling(Sparse(parts[0]), Sparse(parts[1]), len(number))
    place = np.full(len(number) + 1, -1)
    place[chosen] = np.arange(len(chosen))
    p, u = (Sparse([x[x >= 0] for x in (place[r] for r in part)]) for part in parts)
    names = list(number)
    return descend(p, u, [names[i] for i in chosen.tolist()], prior)


def chosen_features(rows: DataFrame, n_p: int, n_u: int) -> DataFrame:
    """Rows (feature) that `telling` keeps, from rows (positive, features): counts combine on the map side."""
    counts = rows.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")
    )
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    error = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12
    z = (F.col("p") / n_p - F.col("u") / n_u) / error
    return counts.where((F.col("p") + F.col("u") >= MIN_TEXTS) & (F.abs(z) >= CONTRAST)).select("feature")


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None,
) -> ToxicityModel:
    """Learn from rows of `labels` whose label is 1 and from texts of `docs` without regard to labels.

    Both samples are bounded by their parameters and chosen by a hash of the key; of documents with one key the least text is read. Features
    are found, and chosen, on the executors: the driver gets the chosen ones, each in MIN_TEXTS sampled texts at least, and their
    numbers for each text, never a text. The class prior is the share
    of ones among the labels given (0.05 where there are none), kept within 0.01 and 0.5. Rows with
    a null key, label or text teach nothing; repeated labels count once.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label).distinct()
    if prior is None:
        rate = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
        prior = min(0.5, max(0.01, 0.05 if rate is None else rate))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    # at most the documented number of ids, up to the scatter of the hash
    confirmed = sample(known.where(F.col(label) == 1).select(F.col(key).alias("key")), positives, "key")
    samples = [
        (True, texts.join(F.broadcast(confirmed), "key", "left_semi")), (False, sample(texts, unlabelled, "key")),
    ]
    once = [rows.groupBy("key").agg(F.min("text").alias("text")).select(F.lit(kind).alias("positive"), "text") for kind, rows in samples]

    def work(rows: list) -> dict:
        return {"features": [sorted(features(t)) for t in rows]}

    found = with_python(once[0].unionByName(once[1]), "text", "features array<string>", work, ["positive"])
    found = checkpointed(found)
    sizes = {r["positive"]: r["n"] for r in found.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, -2.0)
    names = sorted(r[0] for r in chosen_features(found, sizes[True], sizes[False]).collect())
    place = {f: i for i, f in enumerate(names)}

    def placed(rows: list) -> dict:
        return {"places": [sorted(place[f] for f in row if f in place) for row in rows]}

    held = with_python(found, "features", "places array<int>", placed, ["positive"]).where(F.size("places") > 0)
    rows = sorted((r["positive"], list(r["places"])) for r in held.collect())

    def side(kind: bool) -> Sparse:
        mine = [np.array(x, np.int32) for k, x in rows if k is kind]
        return Sparse(mine + [np.zeros(0, np.int32)] * (sizes[kind] - len(mine)))  # texts without any chosen feature

    return descend(side(True), side(False), names, prior)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with the score of its whole texts, 0 to 1; null and empty texts get the score of the bias alone."""
    def work(texts: list) -> dict:
        return {"score": [model.score(t) for t in texts]}

    return with_python(df, text, "score double", work, keep)
