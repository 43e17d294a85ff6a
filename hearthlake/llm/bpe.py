"""Byte-pair encoding as a bounded-lookahead transducer, and decoding as an incremental state machine.

Reads tokenizer files of the BPE kind with a word-end suffix (`word_bpe_49k.json`): the merges, the
added tokens and the byte table come from the file; a file with another normaliser or splitter is refused.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hearthlake.llm.common import with_python

#: Characters that a text is read in. Longer texts go through in pieces of this length.
BUFFER = 65_536
#: Where a text beyond PLAIN_BELOW is cut.
BLANKS = " \n\u3000"
#: Words whose ids a task remembers.
CACHED_WORDS = 150_000
#: Words of up to so many symbols are merged by searching them, which is faster there than a heap.
SHORT = 48
#: Below this code point no character changes under NFC, and the character classes of all Unicode versions agree.
PLAIN_BELOW = "ɐ"

# The text rules that the tokenizer file states.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]

_WORDS = regex.compile(SPLIT)
_LETTERS = regex.compile(r"\p{L}+")
_OTHERS = regex.compile(r"[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a token boundary after which no further text can move that boundary.

    Merges apply in order. Say two continuations of a text agree up to a boundary `d` symbols before
    the end of what is known, and then start with tokens x and y. Only a merge (u, v) whose v is x or
    y can take that boundary away, and moves it left by the length of u; from then on the parts start
    with u or uv. `reach[t]` bounds d for a part that starts with t, so one pass over the merges is
    enough. Each merge must come after those that make its parts; otherwise this raises ValueError.
    """
    made: dict[str, int] = {}
    reach: dict[str, int] = {}
    for rank, (u, v) in enumerate(merges):
        if u + v in made:
            raise ValueError(f"two merges make {u + v!r}")
        made[u + v] = rank
    for rank, (u, v) in enumerate(merges):
        if made.get(u, -1) >= rank or made.get(v, -1) >= rank:
            raise ValueError(f"merge {rank} comes before one that makes its parts")
        far = max(reach.get(u, 0), length[u] + reach.get(v, 0))
        reach[u] = far
        reach[u + v] = max(reach.get(u + v, 0), far)
    return max(reach.values(), default=0)


def at_blanks(text: str, buffer: int) -> Iterator[str]:
    """A text in parts of at most `buffer` characters, cut before blanks; only a run without blanks is longer.

    A blank is part of no word and composes with nothing before it, so neither NFC nor the splitter sees the cut.
    """
    at, size = 0, len(text)
    while size - at > buffer:
        cut = max(text.rfind(c, at + 1, at + buffer + 1) for c in BLANKS)
        if cut < 0:
            cut = min((i for c in BLANKS if (i := text.find(c, at + buffer + 1)) >= 0), default=size)
        yield text[at:cut]
        at = cut
    if at < size:
        yield text[at:]


class _Words(dict):
    """Ids by word; those of a word that is not held are computed, and held if `find` says so."""

    def __init__(self, find: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> list[int]:
        return self.find(word)


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        patterns = [
            x["pattern"].get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if "pattern" in x
        ]
        if model["type"] != "BPE" or kinds != NORMALISERS or patterns != [SPLIT]:
            raise ValueError(f"{path} is not a word-end BPE with the known text rules")
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, {t: len(t.removesuffix(self.suffix)) for t in self.vocab})
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.controls = re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.symbols = byte_symbols()
        self.path = path
        # plain words, and pieces spelled in byte symbols: two tables, as one may look like the other
        self.words: dict[str, list[int]] = _Words(self.remembered)
        self.spelled_words: dict[str, list[int]] = {}

    def forget(self) -> None:
        self.words.clear()
        self.spelled_words.clear()

    @cached_property
    def library(self) -> Tokenizer:
        """The library's text rules, for texts beyond PLAIN_BELOW; its merges are not used."""
        return Tokenizer.from_file(self.path)

    def spelled(self, piece: str) -> list[str]:
        return [self.symbols[b] for b in piece.encode()]

    def merged(self, parts: list[str]) -> list[str]:
        """Apply the merges in order of rank, each from left to right."""
        if len(parts) > SHORT:
            return self.merged_long(parts)
        ranks, none = self.ranks, len(self.ranks)
        found = [ranks.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def merged_long(self, parts: list[str]) -> list[str]:
        """The same by a heap of (rank, place) over a linked list: n log n steps for n symbols."""
        ranks, size = self.ranks, len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if not parts[i] or j >= size or ranks.get((parts[i], parts[j])) != rank:
                continue  # a part of it has been merged since
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := ranks.get((parts[k], parts[i]))) is not None:
                heappush(heap, (r, k))
        return [p for p in parts if p]

    def settled(self, held: list[str], out: list[int]) -> list[str]:
        """Append the ids of the tokens that no further symbols can change; returns the symbols behind them."""
        stable, done = len(held) - 1 - self.lookahead, 0  # the last symbol's word end is not known yet
        for token in self.merged(held[:-1]) if stable > 0 else []:
            if done + len(token) > stable:
                break
            out.append(self.vocab[token])
            done += len(token)
        return held[done:]

    def word(self, symbols: list[str]) -> list[int]:
        symbols[-1] += self.suffix
        return [self.vocab[t] for t in self.merged(symbols)]

    def remembered(self, word: str) -> list[int]:
        ids = self.word(self.spelled(word))
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def stream(self, run, text: str, at: int, step: int, out: list[int]) -> int:
        """Ids of the word of class `run` that starts at `at`, read `step` characters at a time.

        Keeps the symbols whose tokens can still change, at most `lookahead` plus one token and one
        step. Returns where the word ends.
        """
        held: list[str] = []
        while True:
            found = run.match(text, at, min(len(text), at + step))
            end = found.end() if found else at
            held += self.spelled(text[at:end])
            if end < at + step or end == len(text):
                out += self.word(held)
                return end
            at = end
            held = self.settled(held, out)

    def plain(self, text: str, out: list[int], buffer: int) -> None:
        """Append the ids of a text that is below PLAIN_BELOW, in pieces of `buffer` characters."""
        at, known, size = 0, self.words.__getitem__, len(text)
        while at < size:
            stop = min(size, at + buffer)
            if stop == size:
                pieces, after = _WORDS.findall(text, at, stop), size
            else:
                cut = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
                if cut > at:
                    pieces, after = _WORDS.findall(text, at, cut), cut
                else:  # no white space in a whole buffer: the first word alone, however long
                    found = _WORDS.search(text, at, stop)
                    if not found:
                        at = stop
                        continue
                    limit = min(size, found.start() + max(buffer, 4))
                    found = _WORDS.match(text, found.start(), limit)
                    if found.end() < limit or limit == size:
                        pieces, after = [found.group()], found.end()
                    else:  # a run of letters or of other characters that goes on
                        run = _LETTERS if _LETTERS.match(text, found.start(), limit) else _OTHERS
                        pieces, after = [], self.stream(run, text, found.start(), buffer, out)
            out.extend(chain.from_iterable(map(known, pieces)))
            at = after

    def segment(self, text: str, out: list[int], buffer: int) -> None:
        if not text:
            return
        if max(text) < PLAIN_BELOW:
            self.plain(text.lower(), out, buffer)
            return
        for part in at_blanks(text, buffer):
            if max(part) < PLAIN_BELOW:
                self.plain(part.lower(), out, buffer)
            else:
                self.beyond(part, out, buffer)

    def beyond(self, text: str, out: list[int], buffer: int) -> None:
        """Append the ids of a part of a text by the library's text rules."""
        text = self.library.normalizer.normalize_str(text)
        known = self.spelled_words
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            ids = known.get(piece)
            if ids is None and len(piece) > buffer:
                held: list[str] = []
                for at in range(0, len(piece), buffer):
                    held = self.settled(held, out) + list(piece[at : at + buffer])
                ids = self.word(held)
            elif ids is None:
                ids = self.word(list(piece))
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids

    def encode(self, text: str | None, buffer: int = BUFFER) -> list[int]:
        out: list[int] = []
        at = 0
        for control in self.controls.finditer(text or ""):
            self.segment(text[at : control.start()], out, buffer)
            out.append(self.added[control.group()])
            at = control.end()
        self.segment((text or "")[at:], out, buffer)
        return out


class Decoder:
    """Text of a stream of ids; `push` returns what has become certain.

    A file without a decoder of its own joins the tokens by one space. With `words`, bytes are put
    together to UTF-8 text, word ends become spaces, and a broken sequence becomes U+FFFD once it is
    known to be broken.
    """

    def __init__(self, path: str, words: bool = False) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["decoder"] is not None:
            raise ValueError("files with a decoder of their own are not known")
        self.words, self.suffix = words, spec["model"]["end_of_word_suffix"]
        self.controls = {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()} | self.controls
        self.bytes = {s: b for b, s in enumerate(byte_symbols())}
        self.reset()

    def reset(self) -> None:
        self.started = False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        tokens = [t for t in map(self.tokens.get, ids) if t is not None]
        if not tokens:
            return ""
        if not self.words:
            lead, self.started = " " if self.started else "", True
            return lead + " ".join(tokens)
        out = []
        for i, token in zip(ids, map(self.tokens.get, ids), strict=True):
            if i in self.controls:
                out += [self.utf8.decode(b"", True), token]
                self.utf8.reset()
            elif token is not None:
                word = token.endswith(self.suffix)
                spelled = token.removesuffix(self.suffix) if word else token
                out.append(self.utf8.decode(bytes(self.bytes[c] for c in spelled), word))
                if word:
                    self.utf8.reset()
                    out.append(" ")
        return "".join(out)

    def text(self, ids: list[int], step: int) -> str:
        """The whole text of `ids`, pushed `step` at a time."""
        parts = [self.push(ids[i : i + step]) for i in range(0, len(ids), step)]
        return "".join([*parts, self.finish()])

    def finish(self) -> str:
        rest = self.utf8.decode(b"", True) if self.words else ""
        self.reset()
        return rest


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """A worker's own encoder: read once, with its word cache kept between batches of a task."""
    return Encoder(path)


@lru_cache(maxsize=2)
def _decoder(path: str, words: bool) -> Decoder:
    return Decoder(path, words)


def encode(
    df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None,
    buffer: int = BUFFER,
) -> DataFrame:
    """`df`, or its columns `keep`, with the token ids of its whole texts as an array of ints.

    Null and empty texts have no ids. Added tokens in a text become their ids. Memory per worker is
    one piece of the table plus a bounded word cache; a text of any length is read through `buffer`
    characters, except that a run without blanks that has characters beyond PLAIN_BELOW is normalised whole. Repeated rows get the same ids; a column named like `ids` is replaced.
    """
    def work(texts: list) -> dict:
        encoder = _encoder(tokenizer)
        return {ids: [encoder.encode(t, buffer) for t in texts]}

    return with_python(df, text, f"`{ids}` array<int>", work, keep, after=lambda: _encoder(tokenizer).forget())


def decode(
    df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded", words: bool = False, step: int = 4096
) -> DataFrame:
    """`df` with the text of its ids, read `step` ids at a time; null ids give an empty text, unknown ids nothing."""
    def work(rows: list) -> dict:
        decoder = _decoder(tokenizer, words)
        return {text: [decoder.text(row or [], step) for row in rows]}

    return with_python(df, ids, f"`{text}` string", work)


def round_trip(
    df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
    keep: list[str] | None = None, step: int = 4096,
) -> DataFrame:
    """`encode` and then `decode` in one pass over the rows, as one Python stage."""
    def work(texts: list) -> dict:
        encoder, decoder = _encoder(tokenizer), _decoder(tokenizer, False)
        rows = [encoder.encode(t) for t in texts]
        return {ids: rows, decoded: [decoder.text(row, step) for row in rows]}

    new = f"`{ids}` array<int>, `{decoded}` string"
    return with_python(df, text, new, work, keep, after=lambda: _encoder(tokenizer).forget())
