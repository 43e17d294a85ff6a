"""Personal data: labelers vote on candidate spans, EM weighs the labelers and trains the span classifier.

Everything that touches texts is built from DataFrame functions. The driver sees only counts of vote
patterns, whose number is bounded by the labelers and not by the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake.llm.common import let

KINDS = ["email", "ip", "card", "phone"]

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Base patterns. `\G` and the look-behinds skip starts that would fail like the run's first one, and
#: possessive loops do not give back what the next character cannot match: the matches are those of the
#: plain patterns, in time linear in the text and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, for which the classifier decides: shapes that the base patterns swallow or do not know.
LOOSE = {
    "email": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|3[47][0-9]{13})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A text without any of these has no candidate of the kind; the shortest card candidate has 15 digits.
TRIGGERS = {"email": "@|(?i)[\\[(]\\x20?at\\x20?[\\])]", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "(?<![0-9])[0-9](?:[\\x20-]?[0-9]){14}", "phone": "[0-9]{4}|\\+[0-9]"}

# Gazetteers and context words of the labelers.
TOP_DOMAINS = r"(?i)\.\s?(com|org|net|edu|gov|info|io|eu|de|at|ch|fr|be|es|mx|ar|it|nl|pt|br|uk|ie|us|ca|au|jp|cn|in|pl|se|no|dk|fi)$"
DIAL_CODES = r"^\+?(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]?|^\(?[2-9][0-9]{2}"
ISSUERS = r"^(3[47]|4|5[1-5]|2[2-7]|6)"
CUES = r"(?i)\b(e-?mail|mail|contact|correo|courriel|kontakt|tel|telephone|phone|call|fax|mobile|cell|tel[eé]fono|t[eé]l[eé]phone|telefon|handy|card|visa|mastercard|karte|tarjeta|carte|ip|host|server|address|adresse|direcci[oó]n)\b[^\n]{0,12}$"
AGAINST = r"(?i)\b(version|release|v|isbn|issn|doi|section|figure|fig|table|page|chapter|order|invoice|serial|sku|model|part|ticket|token|hash|key|password)\b[^\n]{0,6}$"

VOTES = ["valid", "listed", "cue", "against", "edge", "base"]
#: Where the classifier has learned nothing yet: pseudo-counts of every vote, for and against.
PSEUDO = 2.0
ROUNDS, STEPS, RATE = 40, 400, 0.5
#: Matches whose lengths are added up together.
BLOCK = 64
SPAN = "struct<start:int,end:int,s:string,before:string,after:string>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def passes(kind: str, s: Column) -> Column:
    """Whether a base match is personal data by the base rules."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(digits(s))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", digits(s))
    return n.between(8, 15)


def scan(text: Column, pattern: str, valid) -> Column:
    """Matches for which `valid(s)` holds, leftmost and non-overlapping, with code point offsets.

    Splitting and extracting see the same matches, so lengths of gaps and matches add up to offsets.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, n: a + n)

    def offsets(p: Column) -> Column:
        """Adds the lengths of gap and match, and their sums before each block: an offset adds one block at most."""
        lengths = F.transform(p["found"], lambda s, i: F.length(p["gaps"][i]) + F.length(s))
        sums = let(lengths, lambda x: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(x, b * BLOCK + 1, BLOCK))
        ))
        before = let(sums, lambda x: F.transform(x, lambda _, b: total(F.slice(x, 1, b))))
        return let(F.struct(p.alias("p"), lengths.alias("lengths"), before.alias("blocks")), spans)

    def spans(q: Column) -> Column:
        gaps, found = q["p"]["gaps"], q["p"]["found"]

        def span(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = q["blocks"][block] + total(F.slice(q["lengths"], block * BLOCK + 1, i - block * BLOCK)) + F.length(gaps[i])
            return F.struct(
                start.alias("start"), (start + F.length(found[i])).alias("end"), found[i].alias("s"),
                F.right(gaps[i], F.lit(40)).alias("before"), F.left(gaps[i + 1], F.lit(1)).alias("after"),
            )

        return F.transform(q["p"]["good"], span)

    def chosen(p: Column) -> Column:
        good = F.filter(F.sequence(F.lit(0), F.size(p["found"]) - 1), lambda i: valid(p["found"][i]))
        whole = F.struct(F.split(text, pattern).alias("gaps"), p["found"].alias("found"), good.alias("good"))
        return F.when(F.size(p["found"]) > 0, let(whole, lambda q: F.when(F.size(q["good"]) > 0, offsets(q)).otherwise(none))).otherwise(none)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), chosen)


def votes(kind: str, c: Column, base: bool) -> list[Column]:
    """What each labeler says of a candidate: 1 for, -1 against, 0 nothing. Order of VOTES."""
    s = c["s"]
    n = F.length(digits(s))

    def sign(yes: Column) -> Column:
        return F.when(yes, 1).otherwise(-1)

    if kind == "email":
        valid, listed = sign(s.rlike(r"[A-Za-z]{2,}$")), F.when(s.rlike(TOP_DOMAINS), 1).otherwise(0)
    elif kind == "ip":
        valid = sign(s.contains(":") | s.rlike(r"^(?:[1-9]?[0-9]{1,2}|[0-9]{3})(?:\.[0-9]{1,3}){3}$"))
        listed = F.when(s.rlike(r"^(0|255)\."), -1).otherwise(1)
    elif kind == "card":
        valid, listed = sign(F.call_function("luhn_check", digits(s)) & n.between(13, 19)), sign(digits(s).rlike(ISSUERS))
    else:
        valid, listed = sign(n.between(8, 15)), F.when(s.rlike(DIAL_CODES), 1).otherwise(0)
    edge = sign(~c["before"].rlike(r"[\p{L}\p{N}]$") & ~c["after"].rlike(r"[\p{L}\p{N}]"))
    return [
        valid, listed, F.when(c["before"].rlike(CUES), 1).otherwise(0), F.when(c["before"].rlike(AGAINST), -1).otherwise(0),
        edge, F.lit(1 if base else 0),
    ]


def candidates(df: DataFrame, text: str) -> DataFrame:
    """`df` with arrays base_<kind> and loose_<kind> of candidate spans of its whole texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")

    def where_triggered(kind: str, value: Column) -> Column:
        return F.when(whole.rlike(TRIGGERS[kind]), value).otherwise(none)

    found = df.withColumns({
        f"_{name}_{kind}": where_triggered(kind, scan(whole, patterns[kind], valid))
        for kind in KINDS
        for name, patterns, valid in (
            ("base", BASE, lambda s, kind=kind: passes(kind, s)), ("loose", LOOSE, lambda s: F.lit(True)),
        )
    })
    every = F.concat(*[F.col(f"_base_{k}") for k in KINDS])

    def undecided(loose: Column) -> Column:
        """Candidates that overlap no base span of any kind."""
        def free(b: Column) -> Column:
            return F.filter(loose, lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))

        return F.when(F.size(loose) > 0, let(every, free)).otherwise(loose)

    return found.withColumns({f"_loose_{k}": undecided(F.col(f"_loose_{k}")) for k in KINDS})


@dataclass
class SpanModel:
    """Weights of the final classifier: by kind, and by labeler and vote; reliabilities are the labelers' as EM found them."""

    kinds: dict[str, float]
    weights: dict[str, dict[int, float]]
    reliabilities: dict[str, float]

    def accepts(self, kind: str, said: list[Column]) -> Column:
        z = F.lit(self.kinds[kind])
        for name, vote in zip(VOTES, said, strict=True):
            w = self.weights[name]
            z = z + F.when(vote > 0, w[1]).when(vote < 0, w[-1]).otherwise(w[0])
        return z >= 0


def weigh(patterns: dict[tuple, int]) -> SpanModel:
    """EM over counted (kind, votes): vote probabilities given truth, then a logistic classifier on the posteriors.

    Pseudo-counts say that labelers are more often right than wrong, which keeps the classes from
    swapping and defines the result for few or no candidates.
    """
    rows = [(k[0], k[1:], n) for k, n in sorted(patterns.items())]
    post = [1 / (1 + math.exp(-sum(v))) for _, v, _ in rows]
    table: dict = {}
    for _ in range(ROUNDS):
        prior = {k: [PSEUDO, PSEUDO] for k in KINDS}
        table = {(i, v, y): PSEUDO * (2 if v == (1 if y else -1) else 1) for i in range(len(VOTES)) for v in (-1, 0, 1) for y in (0, 1)}
        for (kind, said, n), p in zip(rows, post, strict=True):
            prior[kind][1] += n * p
            prior[kind][0] += n * (1 - p)
            for i, v in enumerate(said):
                table[i, v, 1] += n * p
                table[i, v, 0] += n * (1 - p)
        total = {(i, y): sum(table[i, v, y] for v in (-1, 0, 1)) for i in range(len(VOTES)) for y in (0, 1)}
        post = []
        for kind, said, _ in rows:
            odds = math.log(prior[kind][1] / prior[kind][0])
            odds += sum(math.log(table[i, v, 1] / total[i, 1]) - math.log(table[i, v, 0] / total[i, 0]) for i, v in enumerate(said))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    right = {
        name: (table[i, 1, 1] + table[i, -1, 0]) / sum(table[i, v, y] for v in (-1, 1) for y in (0, 1))
        for i, name in enumerate(VOTES)
    }
    # the classifier starts from the votes themselves and learns from posteriors, weighted by counts
    kinds = dict.fromkeys(KINDS, -1.0)
    weights = {name: {-1: -1.0, 0: 0.0, 1: 1.0} for name in VOTES}
    scale = sum(math.sqrt(n) for _, _, n in rows) or 1.0
    for _ in range(STEPS):
        by_kind, by_vote = dict.fromkeys(KINDS, 0.0), {name: {-1: 0.0, 0: 0.0, 1: 0.0} for name in VOTES}
        for (kind, said, n), p in zip(rows, post, strict=True):
            z = kinds[kind] + sum(weights[name][v] for name, v in zip(VOTES, said, strict=True))
            slope = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * math.sqrt(n) / scale
            by_kind[kind] += slope
            for name, v in zip(VOTES, said, strict=True):
                by_vote[name][v] += slope
        for k in KINDS:
            kinds[k] += RATE * by_kind[k]
        for name in VOTES:
            for v in (-1, 0, 1):
                weights[name][v] += RATE * by_vote[name][v]
    return SpanModel(kinds, weights, right)


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (kind, one column per labeler, n): how often each pattern of votes occurs in the whole table."""
    cand = candidates(docs.select(F.col(text).alias("text")), "text")

    def said(kind: str, base: bool):
        return lambda c: F.struct(
            F.lit(kind).alias("kind"), *[v.alias(n) for n, v in zip(VOTES, votes(kind, c, base), strict=True)]
        )

    arrays = [
        F.transform(F.col(f"_{name}_{kind}"), said(kind, name == "base")) for kind in KINDS for name in ("base", "loose")
    ]
    rows = cand.select(F.inline(F.concat(*arrays)))  # no filter on the array: it would be pushed down and computed twice
    return rows.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, text: str = "text") -> SpanModel:
    """Weigh the labelers over every candidate of the table; an empty table gives the starting weights' model."""
    found = vote_patterns(docs, text).collect()
    return weigh({(r.kind, *[r[v] for v in VOTES]): r.n for r in found})


def find(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """`docs` with base_spans and spans, arrays of (kind, start, end) in the order of KINDS, then by start.

    Offsets are code points, ends exclusive. Base spans always stay; the classifier adds others.
    Each row depends on its own whole text: NULL and empty texts have no spans, repeated rows the
    same ones. Columns of `docs` with these names are replaced.
    """
    kept = docs.drop("base_spans", "spans", *[f"_{n}_{k}" for n in ("base", "loose") for k in KINDS])

    def shown(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    cand = candidates(kept, text)

    def accepted(kind: str):
        return lambda c: model.accepts(kind, votes(kind, c, False))

    added = {k: F.filter(F.col(f"_loose_{k}"), accepted(k)) for k in KINDS}
    return cand.select(
        *[F.col(f"`{c}`") for c in kept.columns],
        F.concat(*[shown(k, F.col(f"_base_{k}")) for k in KINDS]).alias("base_spans"),
        F.concat(*[F.array_sort(F.concat(shown(k, F.col(f"_base_{k}")), shown(k, added[k]))) for k in KINDS]).alias("spans"),
    )


def counted(spans: Column, kind: str) -> Column:
    """How many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(c: Column, acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.array_join(F.slice(c, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), "")
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"]).alias("out"),
        )

    def rest(c: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, start, lambda acc, s: step(c, acc, s), lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.array_join(F.slice(c, acc["at"] + 1, F.size(c)), "")
        ))

    return F.when(F.size(spans) > 0, let(F.split(text, ""), rest)).otherwise(text)
