"""JSON arrays read by several tasks: brackets and strings are scanned in splits, and a prefix scan tells where each one begins.

A reader of whole files takes one task for an array file. Here the text reader cuts files behind each `}` and deals them over
tasks. A split alone does not say whether it begins inside a string, or how deep; but what it does to either is
known for both cases, so one small row per split, added up in order, gives every split its beginning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlake.session import pack_small_splits

#: Rows of the text reader end here; every object does too.
MARK = "}"
_QUOTE, _BACKSLASH, _CLOSE = ord('"'), ord("\\"), ord("}")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1


def _cut(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (file, split, size, text) in order within a split; a task takes several splits where they are small."""
    rows = spark.read.option("lineSep", MARK).text(paths)
    meta = F.col("_metadata")
    return pack_small_splits(rows.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"),
        F.col("value").cast("binary").alias("text"),
    ))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(file, split, size, bytes) of consecutive rows, the mark put back behind each."""
    for batch in batches:
        files, splits = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        change = np.flatnonzero((np.diff(files.indices.to_numpy()) != 0) | (np.diff(splits) != 0)) + 1
        bounds = [0, *change.tolist(), len(batch)] if len(batch) else []
        for start, stop in zip(bounds, bounds[1:], strict=False):
            raw = MARK.encode().join([*batch.column(3).slice(start, stop - start).to_pylist(), b""])
            yield batch.column(0)[start].as_py(), int(splits[start]), batch.column(2)[start].as_py(), np.frombuffer(raw, np.uint8)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Whether each byte is a quote that no backslash escapes. A run begins behind a mark, so no escape reaches into it."""
    quote = data == _QUOTE
    if (data == _BACKSLASH).any():
        place = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(data != _BACKSLASH, place, -1))
        at = np.flatnonzero(quote & (place > 0))
        quote[at] = (at - 1 - plain[at - 1]) % 2 == 0
    return quote


def _depths(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Whether each byte is outside strings, the depth behind it relative to the run's beginning, and whether the run ends inside one."""
    seen = np.cumsum(_quotes(data))
    outside = (seen + inside) % 2 == 0
    ends = int((seen[-1] + inside) % 2) if len(seen) else inside
    return outside, np.cumsum(np.where(outside, _STEP[data], 0)), ends


class Start(NamedTuple):
    """How a split begins: inside a string, at what depth, and after how many records. `base` is the depth around records."""

    inside: int
    depth: int
    records: int
    base: int


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its bytes, its first sign, and for either beginning whether it ends inside a string, its change of depth, and
    how many objects close at which relative depth."""
    def told() -> pa.RecordBatch:
        names = ["file", "split", "size", "bytes", "first"]
        values = [[v] for v in (*here, taken, first)]
        for k in (0, 1):
            names += [f"ends{k}", f"delta{k}", f"closed{k}"]
            values += [[ends[k]], [delta[k]], [list(closed[k].items())]]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.map_(pa.int64(), pa.int64())) if n[:6] == "closed" else pa.array(v) for n, v in zip(names, values, strict=True)], names)

    here, taken, first, ends, delta, closed = None, 0, "", [0, 1], [0, 0], [Counter(), Counter()]
    for file, split, size, data in _runs(batches):
        if (file, split, size) != here:
            if here:
                yield told()
            here, taken, first, ends, delta, closed = (file, split, size), 0, "", [0, 1], [0, 0], [Counter(), Counter()]
        taken += len(data)
        first = first or data.tobytes().strip()[:1].decode("utf-8", "replace")
        for k in (0, 1):
            outside, depth, after = _depths(data, ends[k])
            levels, times = np.unique(depth[outside & (data == _CLOSE)] + delta[k], return_counts=True)
            closed[k].update(dict(zip(levels.tolist(), times.tolist(), strict=True)))
            ends[k], delta[k] = after, delta[k] + (int(depth[-1]) if len(depth) else 0)
    if here:
        yield told()


def _starts(rows: list[Row]) -> dict[tuple[str, int], Start | None]:
    """The beginning of every split; None in files whose strings and brackets do not all close."""
    out: dict[tuple[str, int], Start | None] = {}
    files: dict[str, list[Row]] = {}
    for row in sorted(rows, key=lambda r: (r["file"], r["split"])):
        files.setdefault(row["file"], []).append(row)
    for file, splits in files.items():
        inside = depth = records = 0
        base = 1 if next((r["first"] for r in splits if r["first"]), "") == "[" else 0
        found = {}
        for r in splits:
            found[file, r["split"]] = Start(inside, depth, records, base)
            records += r[f"closed{inside}"].get(base - depth, 0)
            depth, inside = depth + r[f"delta{inside}"], r[f"ends{inside}"]
        taken = sum(r["bytes"] for r in splits)
        if taken < splits[0]["size"]:
            taken += 3  # the text reader drops a byte order mark
        beyond = taken - splits[0]["size"]  # the mark behind a last row that has none in the file
        whole = not inside and depth + beyond == 0
        out |= {split: start if whole else None for split, start in found.items()}
    return out


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, text): the objects of JSON arrays, or single objects, numbered from 0 in each file.

    A file whose strings or brackets do not close has no records, as for a reader of whole files. Only one row per split
    comes to the driver. A record that lies across splits is put together from its parts.
    """
    rows = _cut(spark, [paths] if isinstance(paths, str) else list(paths))
    effect = "file string, split bigint, size bigint, bytes bigint, first string, " + ", ".join(
        f"ends{k} bigint, delta{k} bigint, closed{k} map<bigint,bigint>" for k in (0, 1)
    )
    starts = spark.sparkContext.broadcast(_starts(rows.mapInArrow(_effects, effect).collect()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list[tuple[int, str, bytes]]) -> pa.RecordBatch:
            number, part, text = zip(*found, strict=True)
            n = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array([here[0]] * n), pa.array(number, pa.int64()), pa.array(part, pa.string()), pa.array([here[1]] * n, pa.int64()),
                 pa.array(text, pa.binary()).cast(pa.string(), safe=False)],
                names=["file", "record", "part", "split", "text"],
            )

        here, state, held, begun = None, None, [], False
        for file, split, _, data in _runs(batches):
            if (file, split) != here:
                if here and state and held:
                    yield told([(state.records, "inner" if not begun else "first", b"".join(held))])
                if (file, split) not in starts.value:
                    raise RuntimeError(f"{file} was split otherwise when it was scanned; its size or the session's split size has changed")
                here, state, held = (file, split), starts.value[file, split], []
                begun = False  # whether the record that is open began in this split
            if state is None:
                continue
            outside, depth, after = _depths(data, state.inside)
            depth = depth + state.depth
            objects = outside & (np.abs(_STEP[data]) == 1) & ((data == _CLOSE) | (data == ord("{")))
            opens = np.flatnonzero(objects & (data != _CLOSE) & (depth == state.base + 1))
            closes = np.flatnonzero(objects & (data == _CLOSE) & (depth == state.base))
            raw, found, number = data.tobytes(), [], state.records
            at_open = 0
            for stop in closes.tolist():
                if state.depth > state.base and not found and number == state.records:  # it was open before
                    found.append((number, "whole" if begun else "last", b"".join(held) + raw[: stop + 1]))
                    held = []
                else:
                    found.append((number, "whole", raw[opens[at_open] : stop + 1]))
                    at_open += 1
                number += 1
            if at_open < len(opens):
                held, begun = [raw[opens[at_open] :]], True
            elif state.depth > state.base and not len(closes):
                held.append(raw)
            if found:
                yield told(found)
            state = Start(after, int(depth[-1]) if len(depth) else state.depth, number, state.base)
        if here and state and held:
            yield told([(state.records, "first" if begun else "inner", b"".join(held))])

    parts = rows.mapInArrow(work, "file string, record bigint, part string, split bigint, text string")
    cut = parts.where("part <> 'whole'").groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "").alias("text")
    )
    return parts.where("part = 'whole'").select("file", "record", "text").unionByName(cut)


def read_json_arrays(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of `schema` from JSON arrays of any size, with source_file and record_no, which give their order.

    A record that does not parse gives no row.
    """
    bad = T.StructField("_bad", T.StringType())
    parsed = F.from_json("text", T.StructType([*schema.fields, bad]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = records(spark, paths).select(parsed.alias("_row"), F.col("file").alias("source_file"), F.col("record").alias("record_no"))
    return rows.where(F.col("_row._bad").isNull()).select(*[F.col("_row")[f.name].alias(f.name) for f in schema.fields], "source_file", "record_no")
