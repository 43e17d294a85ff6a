"""Alignment of two tokenizers over the same bytes, scored by an inverted index of token pairs with document bitmaps."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from hearthlake.llm.bpe import byte_symbols
from hearthlake.llm.common import checkpointed, give_back, pieces, remove, small_batches
from hearthlake.session import ensure_checkpoint_dir

#: Documents of a block, numbered in 16 bits, and entries (pair, document) after which a block ends early.
DOCUMENTS, ENTRIES = 1 << 16, 6_000_000
#: From so many members on a container is a bitset of DOCUMENTS bits, which is then smaller than their numbers.
DENSE = DOCUMENTS // 16
PIECE = 1_000_000
#: The rank library's splitter takes stack for runs of white space: longer texts are searched for longer runs.
LONG_RUN = 50_000
#: Characters of which all versions of Unicode say the same, so that both libraries split alike.
SETTLED = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*\Z")

_RUNS = re.compile(rf"\s{{{LONG_RUN}}}")


class Files(NamedTuple):
    """Places of the two tokenizers' files; `ranks` holds the same vocabulary as `byte_level`, split by `pattern`."""

    byte_level: str
    ranks: str
    pattern: str
    pieces: str


class Pair:
    """Both tokenizers, the bytes of their tokens, and how their ids are written."""

    def __init__(self, files: Files) -> None:
        self.files = files
        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        with open(files.byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = {x["content"]: x["id"] for x in spec["added_tokens"]} | spec["model"]["vocab"]
        value = {s: b for b, s in enumerate(byte_symbols())}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.model = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.model.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        # what an id looks like: of A before another, of A before B, of B before another, of B at a group's end
        ends = [(self.a_bytes, ","), (self.a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";")]
        self.written = np.array([f"{i}{end}" for ids, end in ends for i in range(len(ids))], object)

    def piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @cached_property
    def library(self) -> Tokenizer:
        found = Tokenizer.from_file(self.files.byte_level)
        found.encode_special_tokens = True
        return found

    def encode_a(self, text: str) -> list[int]:
        settled = text.isascii() or SETTLED.match(text)
        if settled and (len(text) < LONG_RUN or not _RUNS.search(text)):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int], int]]:
        """Ids of A and of B, and the bytes of a space and the text; empty where the bytes of either differ from these."""
        out = []
        for text, b in zip(texts, self.model.encode([t or "" for t in texts], num_threads=1), strict=True):
            if not text:
                out.append(([], [], 0))
                continue
            a, raw = self.encode_a(" " + text), b" " + text.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b, len(raw)) if same else ([], [], 0))
        return out


@lru_cache(maxsize=2)
def _pair(files: Files) -> Pair:
    """A worker's own tokenizers, read once."""
    return Pair(files)


class Aligned(NamedTuple):
    """Texts laid end to end: counts by text, the groups as text, and the links as (text, A id, B id)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align_texts(pair: Pair, texts: list[str | None]) -> Aligned:
    """Cut the tokens of each text where tokens of both end, and link those whose bytes overlap.

    Two tokens that overlap do so in one run of bytes between neighbouring ends of any token, and each such
    run lies in one token of each: a link is an end. Ends are marks over the bytes, found for all texts at once.
    """
    coded = pair.encode(texts)
    n_a, n_b, size = (np.array(x, np.int64) for x in zip(*((len(a), len(b), n) for a, b, n in coded), strict=True))
    ids_a, ids_b = (np.array([i for row in coded for i in row[k]], np.int64) for k in (0, 1))
    end_a, end_b = np.cumsum(pair.a_length[ids_a]), np.cumsum(pair.b_length[ids_b])
    stop = np.cumsum(size)
    mark_a, mark_b = np.zeros(size.sum() + 1, bool), np.zeros(size.sum() + 1, bool)
    mark_a[end_a], mark_b[end_b] = True, True
    common = mark_a & mark_b
    upto_a, upto_b, upto_common = (np.cumsum(m, dtype=np.int32) for m in (mark_a, mark_b, common))
    ends = np.flatnonzero(mark_a | mark_b)
    before = ends - 1  # the run's last byte; tokens that end at or before it are done
    link_a, link_b = upto_a[before], upto_b[before]
    n_groups = np.diff(upto_common[stop], prepend=0)
    n_links = np.diff(np.searchsorted(ends, stop, "right"), prepend=0)

    # A token's place in the written groups: its number in its own list, and how many of the other list come before
    edges = np.append(0, np.flatnonzero(common))
    at_a = np.arange(len(ids_a)) + upto_b[edges[upto_common[end_a - 1]]]
    closes_a, closes_b = common[end_a], common[end_b]
    at_b = np.arange(len(ids_b)) + upto_a[edges[upto_common[end_b - 1] + 1]]
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    kinds_a, kinds_b = len(pair.a_bytes), len(pair.b_bytes)
    order[at_a] = ids_a + kinds_a * closes_a
    order[at_b] = 2 * kinds_a + ids_b + kinds_b * closes_b
    written = pair.written[order].tolist()
    cuts = np.append(0, np.cumsum(n_a + n_b)).tolist()
    groups = ["".join(written[i:j])[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]
    return Aligned(n_a, n_b, n_groups, groups, np.repeat(np.arange(len(texts)), n_links), ids_a[link_a], ids_b[link_b])


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of these lengths that follow each other in `data`."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Block:
    """Postings of up to DOCUMENTS documents: entries (pair, document) with the number of links."""

    def __init__(self) -> None:
        self.documents, self.entries = 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, pairs: np.ndarray, documents: np.ndarray) -> None:
        keys = np.sort(pairs << 16 | documents)
        starts, links = run_lengths(keys)
        self.parts.append((keys[starts], links))
        self.entries += len(starts)

    def postings(self) -> dict[str, pa.Array]:
        """pair, documents, members, planes.

        `members` holds the documents' numbers in the block: sorted 16-bit numbers, or a bitset where that is smaller.
        `planes` holds the links of each member less one, bit by bit: plane k has bit k of every member, the highest
        plane is the last that has any bit, so a pair that is linked once in each of its documents has none.
        """
        keys = np.concatenate([k for k, _ in self.parts])
        more = np.concatenate([n for _, n in self.parts]) - 1
        order = np.argsort(keys, kind="stable")
        keys, more = keys[order], more[order]
        pairs, low = keys >> 16, (keys & 0xFFFF).astype("<u2")
        starts, width = run_lengths(pairs)

        of = np.repeat(np.arange(len(starts)), width)
        rank = np.arange(len(keys)) - starts[of]
        plane_bytes = width + 7 >> 3
        planes = np.frexp(np.maximum.reduceat(more, starts).astype(np.float64))[1] if len(keys) else width
        length = plane_bytes * planes
        bits = np.zeros(length.sum(), np.uint8)
        begin = np.cumsum(length) - length
        for k in range(int(planes.max(initial=0))):
            on = np.flatnonzero(more >> k & 1)
            place = begin[of[on]] + k * plane_bytes[of[on]] + (rank[on] >> 3)
            bits += np.bincount(place, 1 << (rank[on] & 7), len(bits)).astype(np.uint8)

        size = np.minimum(2 * width, DOCUMENTS // 8)
        if (width >= DENSE).any():
            data = np.zeros(size.sum(), np.uint8)
            first = np.cumsum(size) - size
            sparse = width[of] < DENSE
            spot = first[of[sparse]] + 2 * rank[sparse]
            data[spot], data[spot + 1] = low[sparse] & 0xFF, low[sparse] >> 8
            for i in np.flatnonzero(width >= DENSE):
                members = np.zeros(DOCUMENTS, np.uint8)
                members[low[starts[i] : starts[i] + width[i]]] = 1
                data[first[i] : first[i] + size[i]] = np.packbits(members, bitorder="little")
        else:
            data = low.view(np.uint8)
        return {
            "pair": pa.array(pairs[starts]), "documents": pa.array(width), "members": binaries(data, size), "planes": binaries(bits, length),
        }


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column laid end to end, and the start of each value."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets[:-1]


def entries_of(width: np.ndarray, members: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, links) of every member of some postings: bitmaps and planes read back."""
    row = np.repeat(np.arange(len(width)), width)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
    raw, first = _bytes_of(members)
    low = np.zeros(len(row), np.int64)
    sparse = width[row] < DENSE
    spot = first[row[sparse]] + 2 * rank[sparse]
    low[sparse] = raw[spot] | raw[spot + 1].astype(np.int64) << 8
    begin = np.cumsum(width) - width
    for i in np.flatnonzero(width >= DENSE):
        bits = np.unpackbits(raw[first[i] : first[i] + DOCUMENTS // 8], bitorder="little")
        low[begin[i] : begin[i] + width[i]] = np.flatnonzero(bits)

    raw, first = _bytes_of(planes)
    plane_bytes = width + 7 >> 3
    length = np.diff(np.append(first, first[-1] + len(planes[-1].as_py()))) if len(width) else width
    count = length // np.maximum(plane_bytes, 1)
    links = np.ones(len(row), np.int64)
    for k in range(int(count.max(initial=0))):
        on = np.flatnonzero(count[row] > k)
        byte = raw[first[row[on]] + k * plane_bytes[row[on]] + (rank[on] >> 3)]
        links[on] += (byte >> (rank[on] & 7) & 1).astype(np.int64) << k
    return row, low, links


POSTING = "pair bigint, documents bigint, members binary, planes binary"
SCORE = "block bigint, document bigint, n_links bigint, n_best bigint, count_sum bigint"


def indexed(df: DataFrame, files: Files, text: str, row: Column, entries: int) -> DataFrame:
    """Rows of two kinds from one pass: documents (pair is null) with their counts and groups, and postings by block.

    Blocks are numbered by task and end after DOCUMENTS documents or `entries` entries.
    """
    small_batches(df.sparkSession)
    given = df.select(row.alias("row"), F.col(text).alias("text"))
    schema = T.StructType([
        *T.StructType.fromDDL("block bigint, document bigint").fields, T.StructField("row", given.schema["row"].dataType),
        *T.StructType.fromDDL(f"n_a bigint, n_b bigint, n_groups bigint, groups string, {POSTING}").fields,
    ])
    arrow = to_arrow_schema(schema)

    def batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def closed(block: Block, number: int) -> Iterator[pa.RecordBatch]:
        found = block.postings()
        n = len(found["pair"])
        whole = batch(n, {"block": pa.array(np.full(n, number)), **found})
        yield from (whole.slice(i, 100_000) for i in range(0, n, 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files)
        b_bits = (len(pair.b_bytes) - 1).bit_length()
        number, block = TaskContext.get().partitionId() << 32, Block()
        for rows in batches:
            for part in pieces(rows.column(1), PIECE):
                for at in range(part.start, part.stop, DOCUMENTS):
                    some = rows.slice(at, min(part.stop, at + DOCUMENTS) - at)
                    if block.parts and (block.documents + len(some) > DOCUMENTS or block.entries >= entries):
                        yield from closed(block, number)
                        number, block = number + 1, Block()
                    got = align_texts(pair, some.column(1).to_pylist())
                    n = len(some)
                    yield batch(n, {
                        "block": pa.array(np.full(n, number)), "document": pa.array(np.arange(n) + block.documents), "row": some.column(0),
                        "n_a": pa.array(got.n_a), "n_b": pa.array(got.n_b), "n_groups": pa.array(got.n_groups),
                        "groups": pa.array(got.groups, pa.string()),
                    })
                    block.add(got.a << b_bits | got.b, got.text + block.documents)
                    block.documents += n
        if block.parts:
            yield from closed(block, number)
        give_back()

    return given.mapInArrow(run, schema)


def pair_counts(postings: DataFrame, b_bits: int) -> DataFrame:
    """(pair, count, best): documents that hold a pair linked, and whether that is its A id's most.

    A pair's bitmaps of different blocks have no document in common, so the bits of all of them together, which is what
    ORing them gives, are the sum of their popcounts.
    """
    counts = postings.groupBy("pair").agg(F.sum("documents").alias("count")).withColumn("a", F.shiftright("pair", b_bits))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def scores(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Links, links with an A id's best partner, and the sum of the counts of the links, for each document of each block.

    Postings meet their pair's count, and bring it back to the documents of their block, one block after another.
    """
    small_batches(postings.sparkSession)
    met = postings.join(counts, "pair").select("block", "documents", "members", "planes", "count", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros((3, DOCUMENTS), np.int64)

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(sums[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), current)), pa.array(at), *[pa.array(s[at]) for s in sums]],
                names=["block", "document", "n_links", "n_best", "count_sum"],
            )

        for batch in batches:
            block = batch.column(0).to_numpy()
            starts, lengths = run_lengths(block)
            for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                if current is not None and block[start] != current:
                    yield told()
                    sums[:] = 0
                current = block[start]
                rows = batch.slice(start, n)
                row, low, links = entries_of(rows.column(1).to_numpy(), rows.column(2), rows.column(3))
                count = rows.column(4).to_numpy()[row]
                best = rows.column(5).to_numpy(zero_copy_only=False)[row]
                np.add.at(sums[0], low, links)
                np.add.at(sums[1], low, links * best)
                np.add.at(sums[2], low, links * count)
        if current is not None:
            yield told()

    return met.repartition("block").sortWithinPartitions("block").mapInArrow(run, SCORE)


def align(
    docs: DataFrame, files: Files, keep: list[str], text: str = "text", carry: Callable[[Column], Column] | None = None,
    entries: int = ENTRIES,
) -> DataFrame:
    """The columns `keep` of each row, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    A encodes a space and the text, B the text, which gets a space from its model; special tokens in texts are plain text. Offsets
    where tokens of both end cut them into groups, written `a1,a2|b1;a3|b2`. A link is a pair of occurrences whose bytes
    overlap; its count is in how many rows of the table its ids are linked. n_best are the links whose count is the highest of their A
    id, ties included, count_sum is the sum of all links' counts. `carry` turns the written groups into what is kept of them, a digest for
    example, before anything is stored.

    Null and empty texts, and texts that the tokens of A or B do not spell, have no tokens: zeros and ''. Repeated rows are
    documents of their own; an empty table has no rows; columns beside `keep` are not read. Documents and postings are written
    once to the shared checkpoint folder, so numbers of documents hold whatever is lost, and removed in the end.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    b_bits = (sentencepiece.SentencePieceProcessor(model_file=files.pieces).get_piece_size() - 1).bit_length()
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    try:
        found = indexed(docs, files, text, row, entries)
        found.withColumn("groups", carry(F.col("groups")) if carry else F.col("groups")).write.parquet(folder)
        stored = spark.read.parquet(folder)
        postings = stored.where(F.col("pair").isNotNull()).select("block", "pair", "documents", "members", "planes")
        told = scores(postings, pair_counts(postings, b_bits))
        texts = stored.where(F.col("pair").isNull()).select("block", "document", "row", "n_a", "n_b", "n_groups", "groups")
        sums = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
        whole = texts.join(told, ["block", "document"], "left")
        return checkpointed(whole.select("row.*", "n_a", "n_b", "n_groups", *sums, "groups"))
    finally:
        remove(spark, folder)
