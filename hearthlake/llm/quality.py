"""Quality rules per document, and host verdicts from failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import checkpointed, with_python

WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: A host is rejected when the shrunk failure rate of any rule is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_DOCUMENTS = (1.0, 1e6)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text; NULL has no words and no lines with words."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # splits bytes at exactly the ASCII white space
    chars = len(text) - sum(text.count(c) for c in WHITE_SPACE)
    lines = [x for x in text.split("\n") if x.strip(WHITE_SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(windows)) < len(windows):
        seen, inside = Counter(windows), bytearray(len(words))
        for i, w in enumerate(windows):
            if seen[w] > 1:
                inside[i : i + 3] = b"\1\1\1"
        covered = inside.count(1)
    return (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), len(lines), covered)


def measured(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` with the MEASURES of its whole texts; columns of those names are replaced."""
    def work(texts: list) -> dict:
        rows = zip(*[measure(t) for t in texts], strict=True)
        return dict(zip(MEASURES, map(list, rows), strict=True))

    return with_python(df, text, ", ".join(f"{m} bigint" for m in MEASURES), work, keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rule failures of a measured document, by the rule's name; a text without words fails only `short`."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 100 * F.col("n_symbols") > 10 * words,
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (words > 0) & ((chars < 3 * words) | (chars > 10 * words)),
    }


def host_verdicts(docs: DataFrame, host: str = "host", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, the shrunk failure rate of each rule, host_rejected.

    The prior of a rule is the beta distribution with the mean and variance of the hosts' rates
    (hosts weighted by their documents); its weight stays within PRIOR_DOCUMENTS, and without
    variance, as with a single host, it is the largest. Only the prior comes to the driver. Counts combine on the map side, so a hot
    host moves one row per task. Rows without a host form one host.
    """
    names = list(rules())
    hosts = docs.groupBy(host).agg(
        F.count(F.lit(1)).alias("documents"), *[F.count_if(rule).alias(f"n_{n}") for n, rule in rules().items()]
    )
    # one row of sums for the prior: mean, and variance as the mean square less the squared mean
    row = hosts.agg(F.sum("documents").alias("documents"), *[
        F.struct(F.sum(f"n_{n}").alias("n"), F.sum(F.col(f"n_{n}") ** 2 / F.col("documents")).alias("squares")).alias(n)
        for n in names
    ]).first()
    low, high = PRIOR_DOCUMENTS
    out = hosts
    for n in names:
        mean = row[n].n / row.documents if row.documents else 0.0
        variance = row[n].squares / row.documents - mean * mean if row.documents else 0.0
        weight = min(max(mean * (1 - mean) / variance - 1, low), high) if variance > 1e-12 else high
        out = out.withColumn(f"rate_{n}", (F.col(f"n_{n}") + mean * weight) / (F.col("documents") + weight))
    rates = [F.col(f"rate_{n}") for n in names]
    return out.select(F.col(host), "documents", *rates, (F.greatest(*rates) > limit).alias("host_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "host", keep: list[str] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """`docs` (or its columns `keep`) with the measures, base_failed, host_rejected and kept.

    A document is not kept if it fails the base rules, or if its host is rejected and it fails any
    rule itself. Measures are taken once and checkpointed. Repeated rows are judged alike and count
    as often as they occur; an empty table gives no rows.
    """
    new = {*MEASURES, "base_failed", "host_rejected", "kept", "_host"}
    names = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    rows = docs.withColumn("_host", F.col(host))
    done = checkpointed(measured(rows, text, [*names, "_host"]))
    verdicts = host_verdicts(done, "_host", limit).select(F.col("_host").alias("_of"), "host_rejected")
    soft = F.lit(False)
    for rule in rules().values():
        soft = soft | rule
    return (
        done.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & soft))
        .drop("_host", "_of")
    )
