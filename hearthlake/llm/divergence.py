"""Divergence of sources within a language, from stripes of term counts that the mappers fold themselves."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlake.llm.common import checkpointed, give_back, pieces, small_batches

#: A term counts in a language if it is in so many of its documents.
MIN_DOCUMENTS = 30
#: Ranks of the terms that set a source apart.
TOP = 50
#: Entries of a task's stripes, (term) and (term, source), before they are spilled.
HELD = 1_000_000
#: Entries of merged stripes that one task compares, and sources whose rows of the pair matrix it holds.
SLICE, BLOCK = 1_000_000, 1_024
#: Cells of a dense block of terms by sources.
CELLS = 1_000_000
PIECE = 1_000_000

#: ASCII letters in lower case, everything else in ASCII a blank, bytes from 128 on as they are.
_TERMS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

STRIPES = "lang string, term string, documents bigint, stripe array<struct<source: string, n: bigint>>"
STRIPE = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))


def terms(raw: bytes) -> list[bytes]:
    """The lower-cased terms of a text in UTF-8: runs of ASCII letters and of characters beyond ASCII."""
    return raw.translate(_TERMS).split()


class Stripes:
    """(lang, term) -> document frequency and counts by source, folded whole document by whole document."""

    def __init__(self) -> None:
        self.documents: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}

    def fold(self, lang: str, source: str, raw: bytes) -> None:
        found = terms(raw)
        self.counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        self.documents.setdefault(lang, Counter()).update(set(found))

    def entries(self) -> int:
        held = sum(map(len, self.documents.values()))
        return held + sum(len(c) for by_source in self.counts.values() for c in by_source.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes as rows, sources of a language that has no terms under the term ''; empties the stripes."""
        for lang, by_source in self.counts.items():
            documents = self.documents[lang]
            place = {t: i for i, t in enumerate(documents)}
            sources = list(by_source)
            at = np.concatenate([np.fromiter((place[t] for t in c), np.int64, len(c)) for c in by_source.values()])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by_source.values()])
            who = np.repeat(np.arange(len(sources)), [len(c) for c in by_source.values()])
            order = np.argsort(at, kind="stable")
            # one more row, of the term '', holds every source
            width = np.append(np.bincount(at, minlength=len(documents)), len(sources))
            offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
            who = np.concatenate([who[order], np.arange(len(sources))]).astype(np.int32)
            n = np.concatenate([n[order], np.zeros(len(sources), np.int64)])
            names = pa.DictionaryArray.from_arrays(pa.array(who), pa.array(sources, pa.string())).cast(pa.string())
            stripe = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([names, pa.array(n)], ["source", "n"]))
            words = pa.array([*documents, b""], pa.binary()).cast(pa.string())
            langs = pa.array([lang]).take(pa.array(np.zeros(len(words), np.int64)))
            counted = pa.array(np.append(np.fromiter(documents.values(), np.int64, len(documents)), 0))
            batch = pa.RecordBatch.from_arrays([langs, words, counted, stripe], ["lang", "term", "documents", "stripe"])
            yield from (batch.slice(i, 50_000) for i in range(0, len(batch), 50_000))
        self.__init__()


def folded(docs: DataFrame, text: str, lang: str, source: str, held: int) -> DataFrame:
    """Stripes of each task, spilled whenever they hold `held` entries."""
    small_batches(docs.sparkSession)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in batches:
            for part in pieces(batch.column(2), PIECE):
                rows = batch.slice(part.start, part.stop - part.start)
                columns = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).cast(pa.binary()).to_pylist()
                for row in zip(*columns, strict=True):
                    stripes.fold(*row)
                if stripes.entries() >= held:
                    yield from stripes.spill()
        yield from stripes.spill()
        give_back()

    return docs.select(*parts).mapInArrow(run, STRIPES)


def merged(stripes: DataFrame, min_documents: int) -> DataFrame:
    """One stripe for each kept term of a language, and one of all its sources for the term ''.

    Counts are first added by (language, term, source), where sums combine on the map side, so the stripe
    of a frequent term is put together from one row a source, not from one a task.
    """
    flat = stripes.select("lang", "term", "documents", F.posexplode("stripe").alias("at", "entry")).select(
        "lang", "term", "entry.source", "entry.n", F.when(F.col("at") == 0, F.col("documents")).otherwise(0).alias("documents")
    )
    added = flat.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    whole = added.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("stripe")
    )
    return whole.where((F.col("documents") >= min_documents) | (F.col("term") == ""))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / total), exactly: long division by thousands stays within 64 bits."""
    rest, out = counts + 5, np.zeros(np.broadcast(counts, total).shape, np.int64)
    out += rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def pair_sums(row: np.ndarray, col: np.ndarray, count: np.ndarray, rows: int, total: np.ndarray, mine: range) -> np.ndarray:
    """The sum of |p - q| over `rows` terms, for each source of `mine` and each source at all.

    Entries (row, col, count) are in order of their row. Terms go through in dense blocks of CELLS cells.
    """
    size = len(total)
    sums = np.zeros((len(mine), size), np.int64)
    step = max(1, CELLS // size)
    for at in range(0, rows, step):
        low, high = np.searchsorted(row, [at, at + step])
        dense = np.zeros((min(step, rows - at), size), np.int64)
        dense[row[low:high] - at, col[low:high]] = count[low:high]
        p = shares(dense, total)
        for i, source in enumerate(mine):
            sums[i] += np.abs(p - p[:, source : source + 1]).sum(0)
    return sums


def leading(col: np.ndarray, value: np.ndarray, spelled: np.ndarray, top: int) -> np.ndarray:
    """Numbers of the `top` entries of each source: largest value first, ties by spelling."""
    order = np.lexsort((spelled, -value, col))
    ordered = col[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < top]


def compared(stripes: pa.Table, sources: pa.Table, mine: slice, top: int) -> pa.Table:
    """Divergences that some stripes of a language give, for one block of its sources in order.

    `sources` has every source of the language with its count N of kept terms, and the language's V. Rows `pair`
    are part sums for a source of the block and each source behind it; rows `term` the leading terms of its sources.
    """
    names = sorted(sources.column("source").to_pylist(), key=str.encode)
    number = {s: i for i, s in enumerate(names)}
    n = np.zeros(len(names), np.int64)
    n[[number[s] for s in sources.column("source").to_pylist()]] = sources.column("N").to_numpy()
    smooth = 5 * sources.column("V")[0].as_py()
    mine = range(len(names))[mine]

    words = [t.encode() for t in stripes.column("term").to_pylist()]
    lists = pa.concat_arrays(stripes.column("stripe").chunks) if len(words) else pa.array([], STRIPE)
    entries = lists.flatten()
    row = np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy())
    coded = entries.field("source").dictionary_encode()
    col = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    count = entries.field("n").to_numpy()
    sums = pair_sums(row, col, count, len(words), n + smooth, mine)
    first, second = np.nonzero(np.arange(len(names)) > np.array(mine)[:, None])

    overall = np.zeros(len(words), np.int64)
    np.add.at(overall, row, count)
    here = (count > 0) & (col >= mine.start) & (col < mine.stop)
    row, col, count = row[here], col[here], count[here]
    gain = shares(count, (n + smooth)[col]) - shares(overall[row], n.sum() + smooth)
    row, col, gain = row[gain > 0], col[gain > 0], gain[gain > 0]
    spelled = np.empty(len(words), np.int64)
    spelled[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = leading(col, gain, spelled[row], top)

    by_number, by_row = pa.array(names, pa.string()), pa.array(words, pa.binary()).cast(pa.string())
    return pa.table({
        "source": pa.concat_arrays([by_number.take(pa.array(first + mine.start)), by_number.take(pa.array(col[best]))]),
        "part": pa.array(["pair"] * len(first) + ["term"] * len(best), pa.string()),
        "item": pa.concat_arrays([by_number.take(pa.array(second)), by_row.take(pa.array(row[best]))]),
        "value": pa.array(np.concatenate([sums[first, second], gain[best]]), pa.int64()),
    })


def divergences(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS,
    top: int = TOP, held: int = HELD, entries: int = SLICE, block: int = BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language lie apart, and by which terms.

    p of a term in a group is 1 + floor(10^9 (count + 5) / (N + 5 V)), N the group's count of kept terms, V the kept terms of the
    language. Part `pair`: for each other source of the language the sum of |p - q| over the kept terms, 0 without any. Part
    `term`: the `top` terms that occur in the source and have p above the language's q, with p - q. Ranks go from the largest
    value, ties by item in UTF-8 order.

    Null text, lang and source are ''. Empty texts have no terms, but their source is one of its language; repeated rows count as
    often as they occur; an empty table has no rows; other columns are not read. Merged stripes are checkpointed; a language is
    dealt by the hash of the term into tasks of about `entries` entries, and by `block` sources.
    """
    kept = checkpointed(merged(folded(docs, text, lang, source, held), min_documents))
    flat = kept.select("lang", "term", F.explode("stripe").alias("e")).select("lang", "term", "e.source", "e.n")
    sources = flat.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    langs = kept.groupBy("lang").agg(
        F.count_if(F.col("term") != "").alias("V"),
        F.ceil(F.sum(F.size("stripe")) / F.lit(entries)).cast("int").alias("slices"),
        F.ceil(F.sum(F.when(F.col("term") == "", F.size("stripe")).otherwise(0)) / F.lit(block)).cast("int").alias("blocks"),
    )
    dealt = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    left = kept.where(F.col("term") != "").join(langs, "lang").select(
        "lang", "term", "stripe", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), dealt
    )
    right = sources.join(langs, "lang").select(
        "lang", "source", "N", "V", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "blocks"
    ).select(F.col("lang").alias("_lang"), "source", "N", "V", F.col("slice").alias("_slice"), dealt.alias("_block"))

    def work(key: tuple, stripes: pa.Table, group: pa.Table) -> pa.Table:
        number = key[2].as_py()
        found = compared(stripes, group, slice(number * block, (number + 1) * block), top)
        return found.add_column(0, "lang", pa.array([key[0].as_py()], pa.string()).take(pa.array([0] * len(found), pa.int64())))

    parts = left.groupBy("lang", "slice", "block").cogroup(right.groupBy("_lang", "_slice", "_block")).applyInArrow(
        work, "lang string, source string, part string, item string, value bigint"
    )
    parts = checkpointed(parts)
    one_way = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source", "item"), ("item", "source"))])
    pairs = one_way.select("lang", "value", F.explode(ways).alias("way")).select(
        "lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    leads = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pairs, leads)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
