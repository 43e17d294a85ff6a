"""Token counts of flat token files: a vectorised search for end-of-document ids, stitched by a prefix scan."""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlake.llm.common import small_batches, with_python
from hearthlake.session import ensure_checkpoint_dir

#: Files hold little-endian 16-bit numbers: a token id plus one, and 0 at the end of each document.
SEPARATOR = 0
BYTES = 2
LINE_END = "\0" * BYTES
#: A document begins with its key, when keys are written: 64 bits in numbers of 15 bits plus one, never 0.
KEY_NUMBERS = 5
#: Numbers of a block that is searched at once.
BLOCK = 1 << 20
#: Runs of white space that the library does not split.
LONG_RUN = 50_000

#: What the text reader drops at the beginning of a file.
BOM = b"\xef\xbb\xbf"

_RUNS = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) + 1 >= 1 << (8 * BYTES):
        raise ValueError(f"ids of {path} do not fit the files' numbers")
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text. The library's splitter runs out of stack in very long runs of white space; such texts are split here."""
    if len(text) < LONG_RUN or not _RUNS.search(text):
        return encoding.encode_ordinary(text)
    return [i for piece in regex.findall(encoding._pat_str, text) for i in encoding._encode_single_piece(piece)]


def key_numbers(key: int) -> np.ndarray:
    value = key & 0xFFFFFFFFFFFFFFFF
    return np.array([(value >> (15 * i) & 0x7FFF) + 1 for i in range(KEY_NUMBERS)], "<u2")


def key_of(numbers: list[int]) -> int:
    value = sum(n - 1 << 15 * i for i, n in enumerate(numbers))
    return value - (1 << 64) if value >> 63 else value


def token_bytes(docs: DataFrame, ranks: str, pattern: str, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """One column `value`: the file's bytes of each document, without its separator.

    Null and empty texts have no tokens. A null key is written as the smallest 64-bit number.
    """
    keyed = docs.select(
        F.col(text).alias("text"), F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("bigint").alias("key") if key else F.lit(None).cast("bigint").alias("key")
    ).select(F.struct("key", "text").alias("row"), "text")

    def work(rows: list) -> dict:
        encoding = _encoding(ranks, pattern)
        out = []
        for row in rows:
            ids = np.array(encode(encoding, row["text"] or ""), np.int64) + 1
            head = b"" if row["key"] is None else key_numbers(row["key"]).tobytes()
            out.append(head + ids.astype("<u2").tobytes())
        return {"value": out}

    return with_python(keyed, "row", "value binary", work, [])


def write_files(spark: SparkSession, values: DataFrame, folder: str | None = None) -> str:
    """Write one flat file per task, each document followed by the separator; returns the folder.

    The text writer puts a row's bytes down as they are and ends them with the separator's bytes, so
    a file is a plain run of numbers. Without `folder`, one below the shared checkpoint folder is made.
    """
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    values.select(F.col("value").cast("string").alias("value")).write.option("lineSep", LINE_END).text(folder)
    return folder


def records(spark: SparkSession, folder: str, mark: str) -> DataFrame:
    """The files' bytes cut behind each byte `mark`, as rows (file, split, size, bytes) in order within a split.

    The text reader deals a large file over tasks and hands on bytes as they are. It says where a split begins,
    but not where in the file a row lies: that comes out of the prefix scan over the rows' lengths.
    """
    rows = spark.read.option("lineSep", mark).text(folder)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("bytes")
    )


def joined(rows: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Binary values laid end to end with the mark behind each, and where each ends."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + 1)
    out = np.full(ends[-1] if len(ends) else 0, ord(mark), np.uint8)
    if offsets[-1] > offsets[0]:
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return out, ends


def runs_of(data: np.ndarray, odd: int, head: int, separator: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Starts and stops of the runs between separators, and their first `head` numbers in hexadecimal.

    `odd` is 1 where the numbers begin at the second byte. One vectorised comparison finds all separators.
    """
    numbers = np.frombuffer(data, "<u2", max(0, len(data) - odd) // BYTES, odd)
    at = odd + BYTES * np.flatnonzero(numbers == separator)
    starts, stops = np.append(0, at + BYTES), np.append(at, len(data))
    if not head:
        return starts, stops, [""] * len(starts)
    raw, length = data.tobytes(), BYTES * head
    return starts, stops, [raw[a : min(a + length, b)].hex() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def pieces(found: DataFrame, block: int, head: int = 0, separator: int = SEPARATOR, mark: str = "\n") -> DataFrame:
    """Rows (file, split, size, block, odd, piece, ends, bytes, head): the runs between the separators of each block.

    A block is a run of whole records of a split, of about `block` numbers, so no separator lies across two.
    Whether its numbers begin at its first or second byte depends on what lies before it, so both
    readings are taken; the scan keeps the right one. `ends` says whether a separator closes the piece; the last piece of
    a block goes on in the next.
    """
    schema = "file string, split bigint, size bigint, block bigint, odd int, piece bigint, ends boolean, bytes bigint, head string"

    def told(file: str, split: int, size: int, number: int, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        for odd in (0, 1):
            starts, stops, heads = runs_of(data, odd, head, separator)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), *[pa.array(np.full(n, x, np.int64)) for x in (split, size, number)],
                 pa.array(np.full(n, odd, np.int32)), pa.array(np.arange(n)), pa.array(np.arange(n) < n - 1), pa.array(stops - starts),
                 pa.array(heads, pa.string())],
                names=["file", "split", "size", "block", "odd", "piece", "ends", "bytes", "head"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number, held, size = None, 0, [], 0
        for batch in batches:
            files = batch.column(0).dictionary_encode()
            splits = batch.column(1).to_numpy()
            same = (np.diff(files.indices.to_numpy()) == 0) & (np.diff(splits) == 0)
            bounds = [0, *(np.flatnonzero(~same) + 1).tolist(), len(batch)]
            for start, stop in zip(bounds, bounds[1:], strict=False):
                key = batch.column(0)[start].as_py(), int(splits[start]), batch.column(2)[start].as_py()
                if key != here:
                    if held:
                        yield from told(*here, number, np.concatenate(held))
                    here, number, held, size = key, 0, [], 0
                data, ends = joined(batch.column(3).slice(start, stop - start), mark)
                at = 0
                while at < len(data):  # up to the first record's end that fills the block
                    full = np.searchsorted(ends, at + block * BYTES - size)
                    cut = int(ends[full]) if full < len(ends) else len(data)
                    held.append(data[at:cut])
                    size += cut - at
                    at = cut
                    if full < len(ends):
                        yield from told(*here, number, np.concatenate(held))
                        number, held, size = number + 1, [], 0
        if held:
            yield from told(*here, number, np.concatenate(held))

    return found.mapInArrow(run, schema)


def scan(spark: SparkSession, folder: str, head: int = 0, block: int = BLOCK, separator: int = SEPARATOR) -> DataFrame:
    """One row per document of the files: (file, document, ids, head), documents numbered from 0 in each file.

    A file may be of any size: its splits are read by as many tasks. A prefix scan over the blocks of a file adds up their bytes, which
    tells where numbers begin, and their separators; a piece belongs to the
    document with the number of separators before it, so a document cut by block boundaries is the sum of its
    pieces. Text after the last separator of a file is a document without an end and is counted if it
    has any ids; an odd last byte is no id. Empty files and folders without files of a table give no rows.
    """
    if separator % 256 == BOM[-1]:
        raise ValueError("the low byte of the separator is the last of a byte order mark")
    mark = next(m for m in "\n\v\f" if ord(m) not in (separator % 256, separator // 256))  # no byte of a separator
    small_batches(spark)
    runs = pieces(records(spark, folder, mark), block, head, separator, mark)
    even = F.col("odd") == 0
    sizes = runs.groupBy("file", "split", "block").agg(
        F.sum(F.when(even, F.col("bytes") + F.when(F.col("ends"), BYTES).otherwise(0))).alias("size"),
        F.count_if(even & F.col("ends")).alias("ended_even"), F.count_if(~even & F.col("ends")).alias("ended_odd"),
        F.max("size").alias("whole"),
    )
    # the text reader drops three bytes that look like a byte order mark at a file's beginning
    file, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("split", "block")
    sizes = sizes.withColumn("lost", F.when(F.sum("size").over(file) < F.col("whole"), len(BOM)).otherwise(0))
    # and a mark stands behind a last row that has none in the file
    beyond = F.when(F.lead("block").over(order).isNull(), F.sum("size").over(file) + F.col("lost") - F.col("whole")).otherwise(0)
    sizes = sizes.withColumn("beyond", beyond)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    read = sizes.withColumn("odd", ((F.col("lost") + F.coalesce(F.sum("size").over(before), F.lit(0))) % BYTES).cast("int"))
    ended = F.when(F.col("odd") == 0, F.col("ended_even")).otherwise(F.col("ended_odd"))
    begins = (F.col("split") == 0) & (F.col("block") == 0) & (F.col("lost") > 0)
    offsets = read.select("file", "split", "block", "odd", begins.alias("begins"), "beyond", F.coalesce(F.sum(ended).over(before), F.lit(0)).alias("before"))
    cut = F.col("begins") & (F.col("piece") == 0)
    placed = runs.join(offsets, ["file", "split", "block", "odd"]).withColumns({
        "document": F.col("before") + F.col("piece"), "bytes": F.col("bytes") + F.when(cut, len(BOM)).otherwise(0) - F.when(F.col("ends"), 0).otherwise(F.col("beyond")),
        "head": F.concat(F.when(cut, BOM.hex()).otherwise(""), "head"),
    })
    firsts = F.array_sort(F.collect_list(F.when(F.col("head") != "", F.struct("split", "block", "head"))))
    whole = placed.groupBy("file", "document").agg(
        F.floor(F.sum("bytes") / BYTES).alias("ids"), F.max("ends").alias("ended"),
        F.array_join(F.transform(firsts, lambda x: x["head"]), "").alias("hex"),
    ).where("ended OR ids > 0")
    place = F.sequence(F.lit(0), F.least(F.lit(head), F.floor(F.length("hex") / (2 * BYTES))).cast("int") - 1)
    numbers = F.transform(place, lambda i: F.conv(  # little-endian
        F.concat(F.substring("hex", i * 4 + 3, F.lit(2)), F.substring("hex", i * 4 + 1, F.lit(2))), 16, 10
    ).cast("int"))
    first = F.when(F.length("hex") >= 2 * BYTES, numbers).otherwise(F.array().cast("array<int>"))
    return whole.select("file", "document", "ids", (first if head else F.lit(None).cast("array<int>")).alias("head"))


def counts(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(key, file, document, n_tokens) of every document of files written with keys."""
    found = scan(spark, folder, KEY_NUMBERS, block)
    value = F.lit(0).cast("bigint")
    for i in range(KEY_NUMBERS):
        value = value.bitwiseOR(F.shiftleft((F.col("head")[i] - 1).cast("bigint"), 15 * i))
    return found.select(
        F.nullif(value, F.lit(-(1 << 63))).alias("key"), F.element_at(F.split("file", "/"), -1).alias("file"), "document",
        (F.col("ids") - KEY_NUMBERS).alias("n_tokens"),
    )
