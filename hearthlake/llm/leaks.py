"""Benchmark decontamination: word windows of test items held against every window of the training texts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import let

#: Consecutive words of a window; an item of fewer words is one window of its own length.
WINDOW = 10
#: What separates words once A-Z is lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word in the original writing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmark windows up to this number, and up to these bytes of windows and their ids, are one hash set in every
#: task; more are joined by shuffle. An id counts as its text and ID_BYTES, what an array element takes.
SET_WINDOWS = 200_000
SET_BYTES = 50_000_000
ID_BYTES = 16
#: Slots of the hash set per window: one probe in sixteen finds an occupied slot by chance.
SLOTS = 16
HITS = "array<struct<at:int,length:int>>"


def words(text: Column) -> Column:
    """Lower-cased words of a whole text; none for NULL."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATOR), "")


def positions(ws: Column, length: Column | int) -> Column:
    """Where a window of `length` words can start, from 1."""
    last = F.size(ws) - F.lit(length) + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def benchmark_rows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct rows (window, length, item): the words joined by a space, and an id as text, NULL where there is none.

    A NULL text has no windows.
    """
    ws = F.col("ws")
    length = F.least(F.size(ws), F.lit(window))
    cut = let(ws, lambda w: F.transform(positions(w, F.least(F.size(w), F.lit(window))), lambda i: F.array_join(F.slice(w, i, window), " ")))
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("ws"))
        .where(F.size("ws") > 0)
        .select("item", length.alias("length"), F.explode(cut).alias("window"))
        .distinct()
    )


def benchmark_windows(rows: DataFrame) -> DataFrame:
    """Distinct windows (window, length, items). An item without an id marks words but is not listed."""
    return rows.groupBy("window", "length").agg(F.sort_array(F.collect_list("item")).alias("items"))


def set_sizes(rows: DataFrame) -> tuple[dict[int, int], int]:
    """Windows by length, and the bytes that all windows and their ids take in a hash set."""
    ids = F.sum(F.coalesce(F.octet_length("item") + ID_BYTES, F.lit(0)).cast("bigint"))
    each = rows.groupBy("window", "length").agg((ids + F.octet_length("window") + ID_BYTES).alias("bytes"))
    found = each.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    return {r.length: r.n for r in found}, sum(r.bytes for r in found)


def slot_of(ws: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(ws), F.lit(slots).cast("bigint")).cast("int") + 1


def hash_set(windows: DataFrame, slots: int) -> Column:
    """One row's array of `slots` buckets (window, items), NULL where empty, as a scalar subquery."""
    spark = windows.sparkSession
    entry = F.struct("window", "items")
    buckets = windows.groupBy(slot_of(F.split("window", " "), slots).alias("slot")).agg(F.collect_list(entry).alias("bucket"))
    every = spark.range(1, slots + 1).select(F.col("id").cast("int").alias("slot"))
    return (
        every.join(buckets, "slot", "left")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "bucket"))).alias("all"))
        .select(F.transform("all", lambda x: x["bucket"])).scalar()
    )


def probed(ws: Column, table: Column, lengths: list[int], slots: int) -> Column:
    """struct(n_words, hits, items) of a text; hits are (at, length), each verified word by word.

    Ids are looked up once for each distinct window that is hit.
    """
    def bucket(s: Column, ws: Column) -> Column:
        return s["table"][slot_of(ws, slots) - 1]

    def of(s: Column, length: int) -> Column:
        def words_at(i: Column) -> Column:
            return F.slice(s["ws"], i, length)

        def verified(i: Column) -> Column:
            return let(
                F.struct(bucket(s, words_at(i)).alias("b"), F.array_join(words_at(i), " ").alias("w")),
                lambda x: F.transform(
                    F.filter(x["b"], lambda e: e["window"] == x["w"]),
                    lambda e: F.struct(i.alias("at"), F.lit(length).alias("length"), e["window"].alias("window")),
                ),
            )

        near = F.filter(positions(s["ws"], length), lambda i: bucket(s, words_at(i)).isNotNull())
        return F.flatten(F.transform(near, verified))

    def listed(s: Column, hits: Column) -> Column:
        def of_window(w: Column) -> Column:
            return F.flatten(F.transform(F.filter(bucket(s, F.split(w, " ")), lambda e: e["window"] == w), lambda e: e["items"]))

        return F.flatten(F.transform(F.array_distinct(F.transform(hits, lambda h: h["window"])), of_window))

    def whole(s: Column) -> Column:
        return let(F.concat(*[of(s, n) for n in lengths]), lambda hits: F.struct(
            F.size(s["ws"]).alias("n_words"),
            F.transform(hits, lambda h: F.struct(h["at"].alias("at"), h["length"].alias("length"))).alias("hits"),
            listed(s, hits).alias("items"),
        ))

    return let(F.struct(ws.alias("ws"), table.alias("table")), whole)


def joined(docs: DataFrame, ws: Column, rows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for a benchmark beyond the set's bounds: windows meet by a shuffle on their text.

    Texts are keyed by the digest of their words, so a repeated text is looked up once. Ids stay one
    a row: they meet the distinct windows that a text hits, and are put together for each text alone.
    """
    keyed = docs.withColumn("_ws", ws).withColumn("_key", F.sha2(F.array_join("_ws", " "), 256))
    texts = keyed.groupBy("_key").agg(F.first("_ws").alias("_ws"))

    def windows_of(n: int):
        return lambda w: F.transform(positions(w, n), lambda i: F.struct(
            i.alias("at"), F.lit(n).alias("length"), F.array_join(F.slice(w, i, n), " ").alias("window")
        ))

    cut = F.concat(*[let(F.col("_ws"), windows_of(n)) for n in lengths])
    hits = texts.select("_key", F.inline(cut)).join(rows.select("window", "length").distinct(), ["window", "length"])
    found = hits.groupBy("_key").agg(F.collect_list(F.struct("at", "length")).alias("_hits"))
    ids = (
        hits.select("_key", "window", "length").distinct()
        .join(rows.where("item IS NOT NULL"), ["window", "length"])
        .groupBy("_key").agg(F.collect_set("item").alias("_ids"))
    )
    return (
        keyed.join(found.join(ids, "_key", "left"), "_key", "left")
        .withColumn("_found", F.struct(
            F.size("_ws").alias("n_words"), F.coalesce("_hits", F.array().cast(HITS)).alias("hits"),
            F.coalesce("_ids", F.array().cast("array<string>")).alias("items"),
        ))
        .drop("_key", "_ws", "_hits", "_ids")
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, set_windows: int = SET_WINDOWS, set_bytes: int = SET_BYTES,
) -> DataFrame:
    """`docs` with n_words, n_hit (words inside a window of a test item), hit_items and hit_words.

    hit_items are the distinct ids as text, sorted; hit_words the sorted word numbers, from 1. Each
    row depends on itself alone: NULL and empty texts have no words and no hits, an empty benchmark
    gives no hits, repeated rows the same result. Columns named like the new ones are replaced.
    Only distinct window lengths (at most `window`), their counts and bytes come to the driver.
    """
    rows = benchmark_rows(benchmark, item, item_text, window)
    counts, size = set_sizes(rows)
    lengths = sorted(counts)
    kept = docs.drop("_found", "_set", "n_words", "n_hit", "hit_items", "hit_words")
    ws = words(F.col(text))
    if not lengths:
        found = kept.withColumn("_found", F.struct(F.size(ws).alias("n_words"), F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items")))
    elif sum(counts.values()) <= set_windows and size <= set_bytes:
        slots = SLOTS * sum(counts.values())
        # the optimiser moves the subquery into the one expression that uses it, so no row carries the set
        found = kept.withColumn("_set", hash_set(benchmark_windows(rows), slots)).withColumn(
            "_found", probed(ws, F.col("_set"), lengths, slots)
        ).drop("_set")
    else:
        found = joined(kept, ws, rows, lengths)
    hits = F.col("_found.hits")
    inside = F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1)))
    return (
        found.withColumns({
            "n_words": F.col("_found.n_words").cast("bigint"),
            "hit_words": F.array_sort(F.array_distinct(inside)),
            "hit_items": F.array_sort(F.array_distinct("_found.items")),
        })
        .withColumn("n_hit", F.size("hit_words").cast("bigint"))
        .drop("_found")
    )


def without_hits(text: Column, hit_words: Column) -> Column:
    """A text without its hit words and the separators before them; texts without hits come back as they are."""
    parts = F.struct(F.split(text, WORD).alias("gaps"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("ws"), hit_words.alias("hit"))
    rest = let(parts, lambda p: F.concat(
        F.array_join(F.transform(
            F.filter(F.sequence(F.lit(0), F.size(p["ws"]) - 1), lambda i: ~F.array_contains(p["hit"], i + 1)),
            lambda i: F.concat(p["gaps"][i], p["ws"][i]),
        ), ""),
        p["gaps"][F.size(p["ws"])],
    ))
    return F.when(F.size(hit_words) > 0, rest).otherwise(text)
