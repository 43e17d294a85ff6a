"""Near-duplicates by weighted Jaccard similarity of word shingles: BagMinHash, bands, exact multiset overlap.

Texts with the same words are one node from the start, so a group of copies of any size is one row.
Candidates share a band; each is held against one hub of its bucket, and what that leaves apart is held
against the other members unless the triangle inequality or the signatures rule the pair out. Links are
verified on the whole shingle multisets, and groups are the connected components.
"""

from __future__ import annotations

import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import checkpointed, compacted, with_python

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8, 0.9999 at 0.85.
ROWS, BANDS = 6, 24
#: Components of the longer signature of texts that hubs leave apart, of which one mixed bit each is kept.
SKETCH = 2048
#: Pairs whose sketches differ in more bits are left out. A pair at 0.8 differs in 205 of 2048 bits on average,
#: with a standard deviation of 13.6; 266 bits are 4.5 of them away, which loses under a hundredth of what the
#: bands miss. Pairs below 0.7 rarely pass.
MAX_DIFFERENT_BITS = 266

#: Rows of keys, and rows with a shingle set or bands, that one task reads from a checkpoint.
ROWS_PER_TASK, TEXTS_PER_TASK = 1_000_000, 20_000
#: Components and shingles that a worker keeps in one matrix of signatures.
SIGNATURE_CELLS = 1 << 18
#: A character that is neither ASCII white space nor punctuation.
SOME_WORD = r"[^\x20\x09-\x0D!-/:-@\[-`{-~]"

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: well spread 64 bits from any 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def times(n: int, by: np.uint64) -> np.uint64:
    return np.uint64(n * int(by) & 0xFFFFFFFFFFFFFFFF)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text: what ASCII white space and punctuation leave."""
    return text.lower().encode().translate(_PUNCTUATION).split() if text else []


def key_of(ws: list[bytes]) -> bytes:
    """128 bits that stand for a word sequence."""
    return xxhash.xxh3_128_digest(b" ".join(ws))


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(ws: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their multiplicities. Fewer words than `size` are one shingle."""
    if not ws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.array([hashes[w] for w in ws], np.uint64)
    n = max(1, len(h) - size + 1)
    rolled = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(size, len(h))):
        rolled = mixed(rolled * _GOLDEN + h[i : i + n])
    return np.unique(rolled, return_counts=True)


def elements(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    if len(counts) == 0 or counts.max() == 1:
        return values
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(values, counts) + nth.astype(np.uint64) * _GOLDEN)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash signatures (documents x m, of 64 bits) of weighted sets with whole-number weights.

    Weights are cut into the levels (0,1], (1,2], (2,4], (4,8], ... Each level of an element is a Poisson
    process of its width as rate; a point has a time, a component, and a place in the level found by
    halving it again and again, so a level that a weight covers in part keeps the points at or below the
    weight. A component's value is its earliest point over all elements. Points come in order of time, and
    a process ends when its time passes the largest value of its document, so the work is about the number
    of elements plus m log m. Components agree with the probability of the weighted Jaccard similarity.
    """
    values = np.full((len(bags), m), np.inf)
    owners, seeds, rates, lows, tops = [], [], [], [], []
    for d, (hashes, counts) in enumerate(bags):
        if not len(hashes):
            continue
        level, low, width, alive = 0, 0, 1, np.ones(len(hashes), bool)
        while alive.any():
            h = hashes[alive]
            seeds.append(mixed(h + times(level, _MIX1)))
            owners.append(np.full(len(h), d))
            rates.append(np.full(len(h), float(width)))
            lows.append(np.full(len(h), low))
            tops.append(counts[alive])
            level, low, width = level + 1, low + width, width if level == 0 else width * 2
            alive = counts > low
    if not owners:
        return values.view(np.int64)
    owner, seed, rate, low, top = (np.concatenate(x) for x in (owners, seeds, rates, lows, tops))
    time, step = np.zeros(len(owner)), 0
    flat = values.reshape(-1)
    while len(owner):
        step += 1
        draw = mixed(seed + times(step, _GOLDEN))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate
        alive = time < values.max(axis=1)[owner]
        owner, seed, rate, low, top, time, draw = (x[alive] for x in (owner, seed, rate, low, top, time, draw))
        spot = mixed(draw ^ _MIX2)
        place = low + 1 + ((spot >> np.uint64(32)).astype(np.float64) / 4294967296.0 * rate).astype(np.int64)
        hit = place <= top
        component = (spot & np.uint64(0xFFFFFFFF)) % np.uint64(m)
        np.minimum.at(flat, owner[hit] * m + component[hit].astype(np.int64), time[hit])
    return values.view(np.int64)


def by_parts(bags: list[tuple[np.ndarray, np.ndarray]], m: int, reduce) -> np.ndarray:
    """`reduce(signatures)` of all documents, some at a time, so that no matrix grows with the batch."""
    out, start, size = [], 0, 0
    for i, (hashes, _) in enumerate(bags):
        size += m + len(hashes)
        if size >= SIGNATURE_CELLS or i == len(bags) - 1:
            out.append(reduce(signatures(bags[start : i + 1], m)))
            start, size = i + 1, 0
    return np.concatenate(out)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket id per band of ROWS components, the band's number included."""
    part = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN), part.shape[:2]).copy()
    for r in range(ROWS):
        out = mixed(out * _GOLDEN + part[:, :, r])
    return out.view(np.int64)


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """One mixed bit of each component, packed into 64-bit numbers; a pair's bits agree with probability (1 + J) / 2."""
    bits = (mixed(signature.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def signed(docs: DataFrame, text: str, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """Columns `keep` with key and bands of the whole text, both null without words."""
    def work(texts: list) -> dict:
        hashes, keys, bags = WordHashes(), [], []
        for t in texts:
            ws = words(t)
            keys.append(key_of(ws) if ws else None)
            bags.append(shingles(ws, hashes, size))
        bands = by_parts(bags, ROWS * BANDS, bands_of)
        return {"key": keys, "bands": [b if k else None for k, b in zip(keys, bands, strict=True)]}

    return with_python(docs, text, "key binary, bands array<bigint>", work, keep)


def shingle_sets(docs: DataFrame, text: str, size: int = SHINGLE) -> DataFrame:
    """(key, bag): the elements of each row's shingle multiset."""
    def work(texts: list) -> dict:
        hashes, keys, bags = WordHashes(), [], []
        for t in texts:
            ws = words(t)
            keys.append(key_of(ws) if ws else None)
            bags.append(shingles(ws, hashes, size))
        return {"key": keys, "bag": [elements(*b).view(np.int64) for b in bags]}

    return with_python(docs, text, "key binary, bag array<bigint>", work, [])


def sketches(bags: DataFrame) -> DataFrame:
    """(key, sketch): the bits of a longer signature, taken over the elements of the multiset."""
    def work(rows: list) -> dict:
        sets = [np.sort(np.array(r, np.int64).view(np.uint64)) for r in rows]
        return {"sketch": list(by_parts([(s, np.ones(len(s), np.int64)) for s in sets], SKETCH, sketch_of))}

    return with_python(bags, "bag", "sketch array<bigint>", work, ["key"])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle multisets given as sets of elements."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with their exact similarity, one shuffle per side; a hot hub is split as a skewed join."""
    left = bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.distinct().join(left, "a").join(right, "b").select(
        "a", "b", similarity(F.col("bag_a"), F.col("bag_b")).alias("similarity")
    )


def components(edges: DataFrame) -> DataFrame:
    """(key, component) of every node with an edge (a, b); a component is named by its smallest key.

    Large-star and small-star steps in turn, until nothing changes: each links nodes to the smallest
    neighbour known, by grouped minima with map-side combine and a join, so no neighbourhood is ever
    collected. Every round is checkpointed.
    """
    now = compacted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), ROWS_PER_TASK)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = compacted(small.where("u <> v").distinct(), ROWS_PER_TASK)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()
    )


def links(nodes: DataFrame, texts: DataFrame, text: str, threshold: float, size: int) -> DataFrame:
    """Verified links (a, b, similarity) between the keys of `nodes` (key, bands, first)."""
    rows = nodes.select("key", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = compacted(rows.join(sizes, "bucket"), ROWS_PER_TASK)
    # the hub of a bucket is the member that meets most others over all bands: in a group, its least edited text
    fame = live.groupBy("key").agg(F.sum("n").alias("fame"))
    hubs = live.join(fame, "key").groupBy("bucket").agg(F.max(F.struct("fame", "key")).alias("best")).select(
        "bucket", F.col("best.key").alias("hub")
    )
    members = compacted(live.join(hubs, "bucket").select("bucket", "key", "hub"), ROWS_PER_TASK)
    wanted = fame.join(nodes.select("key", "first"), "key").select("key", F.col("first").alias("_id"))
    same = texts.join(wanted.select("_id").distinct(), texts["_doc"].eqNullSafe(F.col("_id")), "left_semi")
    found = shingle_sets(same, text, size).groupBy("key").agg(F.any_value("bag").alias("bag"))
    bags = compacted(found.join(wanted, "key", "left_semi"), TEXTS_PER_TASK)
    to_hub = compacted(verified(members.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")), bags), ROWS_PER_TASK)
    close = F.col("similarity") >= threshold
    groups = components(to_hub.where(close))
    # what the hubs leave apart: members of one bucket in different components
    far = 1 - F.col("similarity")
    placed = (
        members.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
        .join(to_hub.select(F.col("a").alias("key"), F.col("b").alias("hub"), far.alias("far")), ["key", "hub"], "left")
        .select("bucket", "key", "component", F.coalesce("far", F.lit(0.0)).alias("far"), F.col("key") == F.col("hub"))
        .toDF("bucket", "key", "component", "far", "is_hub")
    )
    mixed_buckets = placed.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.max(F.when(F.col("is_hub"), F.col("component"))).alias("main"),
    ).where("low <> high").select("bucket", "main")
    left_apart = compacted(placed.join(mixed_buckets, "bucket").where(~F.col("is_hub")), ROWS_PER_TASK)
    drawn = sketches(bags.join(left_apart.select("key").distinct(), "key", "left_semi"))
    apart = compacted(left_apart.join(drawn, "key"), TEXTS_PER_TASK)
    x = apart.where(F.col("component") != F.col("main")).alias("x")
    y = apart.alias("y")
    bits = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    # both sides outside the hub's component: each pair once
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))
    rest = x.join(y, (
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & once
        & (F.abs(F.col("x.far") - F.col("y.far")) <= 1 - threshold + 1e-9) & (bits <= MAX_DIFFERENT_BITS)
    )).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    late = verified(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), bags)
    return to_hub.where(close).unionByName(late.where(close))


def classes(rows: DataFrame, text: str, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(_doc, key) of every row, and (key, text_class, class_id, winner) of every word sequence.

    `winner` marks the word sequence of a group that holds its smallest id; ties go to the smallest key.
    """
    done = checkpointed(signed(rows, text, ["_doc"], size))
    nodes = compacted(done.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("_doc").alias("first"), F.any_value("bands").alias("bands")
    ), TEXTS_PER_TASK)
    near = components(links(nodes, rows, text, threshold, size))
    names = nodes.select("key", "first").join(near, "key", "left").withColumn("component", F.coalesce("component", "key"))
    order = F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("key"))
    best = names.groupBy("component").agg(F.min(order).alias("best"))
    return done.select("_doc", "key"), names.join(best, "component").select(
        "key", F.col("first").alias("text_class"), F.col("best.first").alias("class_id"), (F.col("key") == F.col("best.key")).alias("winner")
    )


def groups(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, size: int = SHINGLE
) -> DataFrame:
    """One row per document: doc, text_class, class_id, kept.

    `text_class` is the smallest id with the same words, `class_id` the smallest id of the group of near
    copies, `kept` marks the rows with that id and its words. Texts without words (null, empty,
    punctuation) are alone and kept. Texts of fewer words than a shingle are one shingle. Repeated rows
    are copies of each other and carry the same result. A class without any id has a null class_id. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias(text))
    done, found = classes(rows, text, threshold, size)
    alone = F.col("key").isNull()
    return done.join(found, "key", "left").select(
        F.col("_doc").alias(doc),
        F.when(alone, F.col("_doc")).otherwise(F.col("text_class")).alias("text_class"),
        F.when(alone, F.col("_doc")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("winner") & F.col("_doc").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def keep_one(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, size: int = SHINGLE
) -> DataFrame:
    """The rows of `docs` that stay: one of each group, with all columns; rows without words all stay.

    Of repeated rows one stays. Only ids and keys are compared across the table; whole rows move once,
    to meet the winners of their groups.
    """
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias(text))
    _, found = classes(rows, text, threshold, size)
    winners = found.where("winner").select(F.col("class_id").alias("_id"), F.col("key").alias("_key"))
    some = F.coalesce(F.col(text).rlike(SOME_WORD), F.lit(False))
    packed = docs.where(some).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc).alias("_doc"), F.col(text).alias("_text"))

    def work(texts: list) -> dict:
        return {"key": [key_of(words(t)) for t in texts]}

    keyed = with_python(packed, "_text", "key binary", work, ["_row", "_doc"])
    stay = keyed.join(winners, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    return stay.dropDuplicates(["_doc", "key"]).select("_row.*").unionByName(docs.where(~some))
