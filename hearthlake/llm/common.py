"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hearthlake.session import ensure_checkpoint_dir

#: Arrow batches between Spark and Python: 8 MB unless the session sets another size than Spark's default.
BATCH_SETTING, BATCH_BYTES, UNSET_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", {"67108864b", "64m", "64MB"}
#: Bytes of text that a Python stage works on at once; one longer text makes a piece of its own.
PIECE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder, so that a lost executor does not change them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compacted(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint read in partitions of about `rows` rows, as many as the cluster's cores at least.

    Many passes over a small frame then cost few tasks and shuffle files; a large one keeps its partitions.
    """
    kept = checkpointed(df)
    return kept.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // rows)))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, also where lambdas in `body` use it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0).cast("bigint"))


def give_back() -> None:
    """Return what Arrow and the allocator hold without need to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(column: pa.Array, limit: int) -> Iterator[slice]:
    """Consecutive slices of a column with about `limit` bytes of text, or ids, each; of a struct its last field counts."""
    if pa.types.is_struct(column.type):
        column = column.field(column.type.num_fields - 1)
    if pa.types.is_list(column.type):
        sizes = pc.multiply(pc.list_value_length(column), 4)
    else:
        sizes = pc.binary_length(column)
    start = total = 0
    for i, size in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        total += size
        if total >= limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(column):
        yield slice(start, len(column))


def small_batches(session: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES, unless the session sets a size of its own."""
    if session.conf.get(BATCH_SETTING) in UNSET_BATCH:
        session.conf.set(BATCH_SETTING, BATCH_BYTES)


def with_python(
    df: DataFrame,
    source: str,
    new: str,
    work: Callable[[list], dict[str, Iterable]],
    keep: list[str] | None = None,
    limit: int = PIECE_BYTES,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """`df`, or its columns `keep`, with the columns of the DDL `new`, computed by `work` from `source`.

    `work` gets pieces of about `limit` bytes. Other columns travel as Arrow arrays; a column
    of `df` that is named like a new one is replaced. A row depends on itself alone, so a lost task
    is simply run again. At the end of a task `after` is called and the worker, which waits for other
    tasks, gives its free memory back.
    """
    added = T.StructType.fromDDL(new)
    names = {n.lower() for n in added.names}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and (keep is None or f.name in keep)]
    small_batches(df.sparkSession)
    given = "_source"
    while given in {f.name.lower() for f in kept}:
        given += "_"
    schema = T.StructType([*kept, *added.fields])
    arrow = to_arrow_schema(schema)
    passed = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from computed(batches)
        if after:
            after()
        give_back()

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(passed), limit):
                rows = batch.slice(part.start, part.stop - part.start)
                got = work(rows.column(passed).to_pylist())
                arrays = [c.cast(arrow.field(i).type) for i, c in enumerate(rows.columns[:passed])]
                arrays += [pa.array(got[f.name], type=arrow.field(f.name).type) for f in added.fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(source).alias(given)).mapInArrow(run, schema)
