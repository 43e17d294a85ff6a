"""Incremental ingestion and extraction with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from hearthlake import vocab
from hearthlake.operators.extraction import Extractor, extract_attributes
from hearthlake.operators.linkage import first_wins
from hearthlake.sources.readers import EXTRACTION_SCHEMA, LISTING_SCHEMA

#: Keyed state of own processors lives in RocksDB, on the executors' disks.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Groups of keys whose state goes to and from Python together: a call to the state costs more than reading or writing some ten rows.
BUCKETS = 1 << 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def listing_stream(
    spark: SparkSession, folder: str, schema: T.StructType = LISTING_SCHEMA,
    multi_line: bool = True, max_files: int | None = None, file_format: str = "json",
) -> DataFrame:
    """Stream of listings from files as they land."""
    reader = spark.readStream.schema(schema)
    if file_format == "json":
        reader = reader.option("multiLine", multi_line)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(file_format).load(folder)


def first_seen(
    stream: DataFrame, key: str = vocab.URL, event_time: str | None = None, delay: str | None = None
) -> DataFrame:
    """First row per key; later copies lose, as in the batch merge.

    Keyed state is kept for good unless an event-time column and a delay bound it; then copies are
    recognised inside that delay only.
    """
    keyed = stream.where(F.col(key).isNotNull() & (F.col(key) != ""))
    if event_time and delay:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return keyed.dropDuplicates([key])


class FirstInOrder(StatefulProcessor):
    """Holds the least row of each key of a bucket, and hands it on when the watermark passes its earliest copy's time plus the delay.

    Rows hold a struct `copy` of `key`, `expires`, the milliseconds from which the key may go, `row`, and the fields o0, o1, ... that
    order them, NULL first as in batch sorting. The state of a key is one such struct, the state of a bucket the array of them. A bucket
    has one timer, at the least `expires` of its keys. State is read and written once a bucket and batch, since every call to it waits
    for an answer; columns are few for the like reason.
    """

    def __init__(self, order: list[T.DataType]) -> None:
        self.held_type = T.StructType([
            T.StructField("key", T.StringType()), T.StructField("expires", T.LongType()), T.StructField("row", T.StringType()),
            *[T.StructField(f"o{i}", kind) for i, kind in enumerate(order)],
        ])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", T.StructType([T.StructField("held", T.ArrayType(self.held_type))]))

    def _held(self) -> dict[str, tuple]:
        state = self.best.get()
        return {} if state is None else {row[0]: tuple(row[1:]) for row in state[0]}

    def _hold(self, held: dict[str, tuple]) -> None:
        self.best.update(([(key, *rest) for key, rest in held.items()],))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self._held()
        timer = min((h[0] for h in held.values()), default=None)
        for row in rows:
            k, expires, *best = row["copy"].values()
            known = held.get(k)
            if known is None or _rank(best[1:]) < _rank(known[2:]):
                held[k] = (expires if known is None else min(expires, known[0]), *best)
            elif expires < known[0]:
                held[k] = (expires, *known[1:])
        least = min(h[0] for h in held.values())
        if least != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(least)
        self._hold(held)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        kept = {k: h for k, h in held.items() if h[0] > now}
        if kept:
            self.handle.registerTimer(min(h[0] for h in kept.values()))
            self._hold(kept)
        else:
            self.best.clear()
        yield Row(rows=[h[1] for k, h in held.items() if k not in kept])

    def close(self) -> None:
        pass


def _rank(values: Iterable) -> list[tuple]:
    return [(v is not None, v) for v in values]


def first_in_order(stream: DataFrame, key: str, order: list[str], event_time: str, delay: str) -> DataFrame:
    """First row per key in `order` among the copies of a key, with state that the watermark bounds.

    A key is held from its first copy on until the watermark, which runs `delay` behind the latest event time, has passed the
    time of its earliest copy by `delay`; then its winner is written once and the state goes. Copies that come while it is held compete by
    `order`, whatever the batch they come in; rows behind the watermark are late and dropped; a copy after that begins the key anew. Rows without a key or
    time are discarded. A key's state is one row. Keys are held in BUCKETS groups by their hash, whatever the number of tasks; a
    checkpoint goes on only under the number it began with. Needs the RocksDB state store, which is set for the session if another one is.
    """
    stream.sparkSession.conf.set(STATE_STORE, ROCKS)
    usable = F.col(key).isNotNull() & (F.col(key) != "") & F.col(event_time).isNotNull()
    marked = stream.where(usable).withWatermark(event_time, delay)
    expires = F.unix_millis(F.col(event_time) + F.expr(f"INTERVAL {delay}"))
    # rows travel as text, so that maps and nested columns pass the state store unchanged
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), {"timestampFormat": MICROS, "ignoreNullFields": "true"})
    # times rank as numbers: the state hands them back without their zone
    times = {f.name for f in stream.schema.fields if isinstance(f.dataType, T.TimestampType)}
    ranks = [(F.unix_micros(c) if c in times else F.col(c)).alias(f"o{i}") for i, c in enumerate(order)]
    copy = F.struct(F.col(key).cast("string").alias("key"), expires.alias("expires"), row.alias("row"), *ranks)
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")
    packed = marked.select(bucket.alias("bucket"), event_time, copy.alias("copy"))
    first = packed.groupBy("bucket").transformWithState(
        FirstInOrder([T.LongType() if c in times else stream.schema[c].dataType for c in order]), "rows array<string>", "Append", "EventTime"
    ).select(F.explode("rows").alias("row"))
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields])
    return first.select(F.from_json("row", kind, {"timestampFormat": MICROS}).alias("row")).select("row.*")


def ingest(
    stream: DataFrame, target: str, checkpoint: str, key: str = vocab.URL, once: bool = True,
    order: list[str] | None = None, event_time: str | None = None, delay: str | None = None,
) -> StreamingQuery:
    """Append first-seen listings to a Parquet table; the checkpoint makes it resumable.

    With `order`, `event_time` and `delay` the first row in that order wins among the copies that come within the
    delay, in keyed state that the watermark bounds; see `first_in_order`. With `order` alone the first row wins inside a
    micro-batch and earlier batches win over later ones, for good: the table itself is the state, one folder per batch,
    so nothing grows in memory and a batch that is run again writes the same rows, but each batch reads the table's keys. Without `order`, keyed state
    decides, which `event_time` and `delay` bound; which copy of a micro-batch wins is then left open.
    """
    if order and event_time and delay:
        first = first_in_order(stream, key, order, event_time, delay)
        writer = first.writeStream.format("parquet").outputMode("append").option("path", target)
    elif order:
        writer = stream.writeStream.foreachBatch(lambda df, i: append_new(df, i, target, key, order))
    else:
        writer = first_seen(stream, key, event_time, delay).writeStream.format("parquet").outputMode("append").option("path", target)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_new(batch: DataFrame, batch_id: int, target: str, key: str, order: list[str]) -> None:
    """Write the first row of each key that no other batch has written, into the batch's own folder."""
    rows = first_wins(batch, key, order)
    if _exists(batch.sparkSession, target):
        schema = T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])
        known = batch.sparkSession.read.schema(schema).parquet(target).where(F.col("batch_id") != batch_id)
        rows = rows.join(known.select(key).distinct(), key, "left_anti").select(*batch.columns)
    rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def _exists(spark: SparkSession, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _sink(spark: SparkSession, target: str) -> DataFrame | None:
    if not _exists(spark, target):
        return None
    schema = T.StructType([
        T.StructField(vocab.URL, T.StringType()),
        T.StructField("extraction", T.StructType([f for f in EXTRACTION_SCHEMA.fields if f.name != vocab.URL])),
        T.StructField("batch_id", T.LongType()),
    ])
    return spark.read.schema(schema).parquet(target)


def extract_pending(
    batch: DataFrame, batch_id: int, target: str, terms: list[str],
    extractor: Extractor | None = None, batch_size: int = 6, order: list[str] | None = None,
) -> None:
    """Extract the listings whose URL is not in the sink yet, one output folder per batch.

    Of several listings of a URL the first in `order` is read; without `order` the texts decide, not
    time. The folder is overwritten, and its own earlier content is not counted as seen, so a batch
    that is run again writes the same rows.
    """
    spark = batch.sparkSession
    text = F.col(vocab.DESCRIPTION)
    first = F.min_by(text, F.struct(*order)) if order else F.min(text)
    todo = batch.where(F.col(vocab.URL).isNotNull()).groupBy(vocab.URL).agg(first.alias(vocab.DESCRIPTION))
    done = _sink(spark, target)
    if done is not None:
        seen = done.where(F.col("batch_id") != batch_id).select(vocab.URL).distinct()
        todo = todo.join(seen, vocab.URL, "left_anti")
    found = extract_attributes(todo, terms, extractor, batch_size=batch_size)
    found.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def extract_stream(
    stream: DataFrame, target: str, checkpoint: str, terms: list[str],
    extractor: Extractor | None = None, batch_size: int = 6, once: bool = True, order: list[str] | None = None,
    event_time: str | None = None, delay: str | None = None,
) -> StreamingQuery:
    """Resumable extraction: each micro-batch handles only URLs without a stored extraction.

    With `order`, `event_time` and `delay` bounded state decides which listings are new, and a batch does not read the
    sink: a listing is extracted once, from its first copy within the delay.
    """
    if order and event_time and delay:
        rows = stream.select(vocab.URL, vocab.DESCRIPTION, *dict.fromkeys([*order, event_time]))
        first = first_in_order(rows, vocab.URL, order, event_time, delay).select(vocab.URL, vocab.DESCRIPTION)

        def extract(df: DataFrame, i: int) -> None:
            found = extract_attributes(df, terms, extractor, batch_size=batch_size)
            found.write.mode("overwrite").parquet(f"{target}/batch_id={i}")

        writer = first.writeStream.foreachBatch(extract).option("checkpointLocation", checkpoint)
    else:
        writer = (
            stream.select(vocab.URL, vocab.DESCRIPTION, *(order or [])).writeStream
            .foreachBatch(lambda df, i: extract_pending(df, i, target, terms, extractor, batch_size, order))
            .option("checkpointLocation", checkpoint)
        )
    return (writer.trigger(availableNow=True) if once else writer).start()
