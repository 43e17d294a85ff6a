"""An append-only store of extractions: one folder per run, readable once it is committed; failed batches stay pending."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake import vocab
from hearthlake.operators.extraction import Extractor, attempt_extractions
from hearthlake.sources.readers import EXTRACTION_SCHEMA

#: A run's folder: its number, whether earlier runs count no more, and a part of its own, as two runs may begin at once.
RUN = "run-{number:08d}-{kind}-{own}"
#: The file that the committer leaves in a folder once all of it is written.
MARKER = "_SUCCESS"

STORE_SCHEMA = T.StructType([
    T.StructField(vocab.URL, T.StringType()),
    T.StructField("extraction", T.StructType([f for f in EXTRACTION_SCHEMA.fields if f.name != vocab.URL])),
    T.StructField("error", T.StringType()),
])


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def runs(spark: SparkSession, store: str) -> list[str]:
    """Folders of the committed runs since the last reset, in order. A run that was ended half-way has no marker and counts for nothing."""
    path, files = _path(spark, store)
    if not files.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())
    done = [n for n in names if files.exists(_path(spark, f"{store}/{n}/{MARKER}")[0])]
    last = max((i for i, n in enumerate(done) if n.split("-")[2] == "reset"), default=0)
    return [f"{store}/{n}" for n in done[last:]]


def _rows(spark: SparkSession, store: str, answered: bool) -> DataFrame:
    folders = runs(spark, store)
    if not folders:
        return spark.createDataFrame([], T.StructType([*STORE_SCHEMA.fields, T.StructField("run", T.LongType())]))
    schema = T.StructType([*STORE_SCHEMA.fields, T.StructField("answered", T.BooleanType())])
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/run-(\d+)-", 1).cast("bigint")
    parts = None
    for folder in folders:  # folders are partitioned by `answered` below their own names
        rows = spark.read.schema(schema).parquet(folder).where(F.col("answered") == answered).withColumn("run", number)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.drop("answered")


def read(spark: SparkSession, store: str) -> DataFrame:
    """(url, extraction, run) of everything extracted since the last reset; a URL that two runs at once have written counts once."""
    rows = _rows(spark, store, True).select(vocab.URL, "extraction", "run")
    return rows if len(runs(spark, store)) < 2 else rows.withColumn("_x", F.to_json("extraction")).groupBy(vocab.URL).agg(
        F.min_by(F.struct("extraction", "run"), F.struct("run", "_x")).alias("_row")
    ).select(vocab.URL, "_row.*")


def failures(spark: SparkSession, store: str) -> DataFrame:
    """(url, error, run): the latest error of each URL that no run has extracted since the last reset."""
    found = _rows(spark, store, False).groupBy(vocab.URL).agg(F.max_by(F.struct("error", "run"), F.struct("run", "error")).alias("_row"))
    done = _rows(spark, store, True).select(vocab.URL)
    return found.join(done, vocab.URL, "left_anti").select(vocab.URL, "_row.*")


def pending(listings: DataFrame, store: str) -> DataFrame:
    """Listings whose URL has no extraction in the store; only the store's URLs are read."""
    done = _rows(listings.sparkSession, store, True).select(vocab.URL)
    return listings.where(F.col(vocab.URL).isNotNull()).join(done, vocab.URL, "left_anti")


def extract_pending(
    listings: DataFrame, store: str, terms: list[str], extractor: Extractor | None = None, batch_size: int = 6,
    reset: bool = False, first: int | None = None,
) -> str:
    """Extract what is pending into a folder of its own, and return the folder.

    Earlier runs are not written again. Answers and failures are split into parts of the folder; batches that raised or answered unreadably
    are pending for the next run. `reset` starts over without deleting; `first` takes so many listings in URL order.
    """
    spark = listings.sparkSession
    todo = listings.where(F.col(vocab.URL).isNotNull()) if reset else pending(listings, store)
    if first is not None:
        todo = todo.orderBy(vocab.URL).limit(first)
    path, files = _path(spark, store)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    number = 1 + max((int(n.split("-")[1]) for n in names if n.startswith("run-")), default=0)
    folder = f"{store}/{RUN.format(number=number, kind='reset' if reset else 'more', own=uuid.uuid4().hex[:8])}"
    tried = attempt_extractions(todo, terms, extractor, batch_size=batch_size)
    tried.withColumn("answered", F.col("error").isNull()).write.partitionBy("answered").parquet(folder)
    return folder
