"""Batch attribute extraction: response parsing on Spark, with a pluggable text-to-JSON step."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.arrays import let
from hearthlake.functions.text import plain_text, usable_description

#: texts of a batch, vocabulary -> JSON text {"resultados": [...]}
Extractor = Callable[[list[str], list[str]], str]


def flag_key(term: str) -> str:
    return term.replace(" ", "_")


# --- one record --------------------------------------------------------------------------------

def default_record(terms: list[str]) -> Column:
    """What a listing gets when nothing was extracted."""
    flags = [F.lit(x) for t in dict.fromkeys(flag_key(t) for t in terms) for x in (t, False)]
    return F.struct(
        F.lit(vocab.EXTRACTION_ENUMS["posicao_solar"][1]).alias("posicao_solar"),
        F.lit(None).cast("bigint").alias("distancia_praia_m"),
        F.lit(vocab.EXTRACTION_ENUMS["status_construcao"][1]).alias("status_construcao"),
        F.lit(vocab.EXTRACTION_ENUMS["tipo_unidade"][1]).alias("tipo_unidade"),
        F.array().cast("array<string>").alias("diferenciais_unicos"),
        (F.create_map(*flags) if flags else F.create_map().cast("map<string,boolean>")).alias("flags"),
    )


def _field(item: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(item, f"$['{quoted}']", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*)$")


def _truth(value: Column) -> Column:
    """TRUE/FALSE for a JSON boolean or text, NULL for everything else."""
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(
        _kind(value) == "STRING", F.lower(_text_of(value)).isin(vocab.TRUE_WORDS)
    )


def _truthy(value: Column) -> Column:
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(
        _kind(value) == "STRING", _text_of(value) != ""
    ).otherwise(F.lit(False))


def sanitize(item: Column, terms: list[str]) -> Column:
    """Record from one result object: allow-listed enums, non-negative distance, clean extras and flags."""
    def enum(name: str) -> Column:
        allowed, default = vocab.EXTRACTION_ENUMS[name]
        said = F.trim(F.lower(_text_of(_field(item, name))))
        cased = F.concat(F.upper(F.substring(said, 1, 1)), said.substr(F.lit(2), F.length(said)))
        return F.when(cased.isin(allowed), cased).otherwise(F.lit(default))

    distance = _field(item, "distancia_praia_m")
    metres = F.when(_is_number(distance), F.try_variant_get(distance, "$", "double"))
    extras = F.try_variant_get(_field(item, "diferenciais_unicos"), "$", "array<variant>")
    texts = F.transform(
        F.filter(extras, lambda x: _kind(x) == "STRING"), lambda x: F.trim(_text_of(x))
    )
    clean = F.transform(F.filter(texts, lambda x: F.length(x) > 2), lambda x: F.lower(x))

    def flag(term: str) -> Column:
        by_key, by_term = _field(item, flag_key(term)), _field(item, term)
        return F.coalesce(F.when(_truthy(by_key), _truth(by_key)).otherwise(
            _truth(by_term) if flag_key(term) != term else _truth(by_key)
        ), F.lit(False))

    unique = list({flag_key(t): t for t in terms}.values())
    flags = [x for t in unique for x in (F.lit(flag_key(t)), flag(t))]
    return F.struct(
        enum("posicao_solar").alias("posicao_solar"),
        F.when(metres >= 0, F.floor(metres).cast("bigint")).alias("distancia_praia_m"),
        enum("status_construcao").alias("status_construcao"),
        enum("tipo_unidade").alias("tipo_unidade"),
        F.coalesce(clean, F.array().cast("array<string>")).alias("diferenciais_unicos"),
        (F.create_map(*flags) if flags else F.create_map().cast("map<string,boolean>")).alias("flags"),
    )


# --- one batch ---------------------------------------------------------------------------------

def aligned_items(response: Column, size: Column) -> Column:
    """Array of (item_no, item): which batch position each result speaks for.

    The result's own `id_lote` counts when it is a whole number inside the batch, else its place in
    the list. Results beyond the batch are ignored.
    """
    results = F.coalesce(
        F.try_variant_get(F.try_parse_json(response), "$.resultados", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    def own_number(x: Column) -> Column:
        whole = _kind(_field(x, "id_lote")).isin("BIGINT", "INT")
        number = F.try_variant_get(x, "$.id_lote", "bigint")
        return F.when(whole & number.between(0, size - 1), number)

    placed = F.transform(results, lambda x, i: F.named_struct(
        F.lit("item_no"), F.coalesce(own_number(x), i.cast("bigint")), F.lit("item"), x
    ))
    return F.filter(placed, lambda p: p["item_no"] < size)


def align_batches(df: DataFrame, urls: str, response: str, terms: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows (url, extraction, answered), and the batch's columns `keep`, from batches of an array of URLs and one response.

    A batch row carries its own items, so alignment is done in place: no join, no shuffle. The last
    result for a position counts; positions without one get the default record.
    """
    size = F.size(urls)
    items = aligned_items(F.col(response), size)
    rows = df.select(F.posexplode(urls).alias("item_no", vocab.URL), items.alias("_items"), *(keep or []))
    mine = F.filter("_items", lambda p: p["item_no"] == F.col("item_no"))
    picked = rows.select(vocab.URL, F.try_element_at(mine, F.lit(-1))["item"].alias("_item"), *(keep or []))
    return picked.select(
        vocab.URL, *(keep or []),
        F.when(F.col("_item").isNotNull(), sanitize(F.col("_item"), terms)).otherwise(default_record(terms)).alias("extraction"),
        F.col("_item").isNotNull().alias("answered"),
    )


def batch_warnings(df: DataFrame, urls: str, response: str) -> DataFrame:
    """One row: batches, items, and batches in which no item got a result."""
    size = F.size(urls)
    items = F.size(aligned_items(F.col(response), size))
    return df.agg(
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("items"),
        F.count_if((items == 0) & (size > 0)).alias("empty_batches"),
    )


# --- the extraction job ------------------------------------------------------------------------

def readable(response: Column) -> Column:
    """Whether an answer is a JSON object whose `resultados`, if there, is an array of objects only."""
    parsed = F.try_parse_json(response)
    told = F.try_variant_get(parsed, "$.resultados", "variant")
    items = F.try_variant_get(parsed, "$.resultados", "array<variant>")
    objects = F.forall(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.startswith(_kind(x), F.lit("OBJECT")))
    listed = told.isNull() | (F.startswith(_kind(told), F.lit("ARRAY")) & objects)
    return F.coalesce(F.startswith(_kind(parsed), F.lit("OBJECT")) & listed, F.lit(False))


def ask_in_batches(
    df: DataFrame, extractor: Extractor, terms: list[str], text: str = vocab.DESCRIPTION,
    batch_size: int = 6,
) -> DataFrame:
    """Rows (urls, response, error): the extractor sees whole texts, `batch_size` at a time.

    Batches are cut inside each partition, so nothing is shuffled for them. A batch whose extractor raises has no
    response, but the error's text; the others go on.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = []
            for start in range(0, len(frame), batch_size):
                batch = frame.iloc[start:start + batch_size]
                answer, error = None, None
                try:
                    answer = extractor(batch["text"].tolist(), terms)
                except Exception as e:  # noqa: BLE001 - whatever a plugged-in extractor raises leaves its batch pending
                    error = f"{type(e).__name__}: {e}"
                asked.append((batch["url"].tolist(), answer, error))
            yield pd.DataFrame(asked, columns=["urls", "response", "error"])

    cells = df.select(F.col(vocab.URL).alias("url"), F.col(text).alias("text"))
    return cells.mapInPandas(run, "urls array<string>, response string, error string")


def attempt_extractions(
    df: DataFrame, terms: list[str], extractor: Extractor | None = None,
    text: str = vocab.DESCRIPTION, batch_size: int = 6,
) -> DataFrame:
    """Rows (url, extraction, error) of every listing with a URL, from one call of the extractor per batch.

    A batch that raised or answered unreadably has an error and no extractions: its listings stay pending. In a readable answer, positions
    without a result get the default record. Listings without a usable text get the default and skip the extractor. Without an extractor,
    flags come from the words of the text by built-in expressions.
    """
    known = df.where(F.col(vocab.URL).isNotNull())
    usable = usable_description(text)
    none = F.lit(None).cast("string").alias("error")
    if extractor is None:
        record = F.when(usable, keyword_record(text, terms)).otherwise(default_record(terms))
        return known.select(vocab.URL, record.alias("extraction"), none)
    asked = ask_in_batches(known.where(usable), extractor, terms, text, batch_size)
    problem = F.when(~readable(F.col("response")), F.coalesce("error", F.lit("unreadable answer")))
    told = align_batches(asked.withColumn("error", problem), "urls", "response", terms, ["error"])
    answers = told.select(vocab.URL, F.when(F.col("error").isNull(), F.col("extraction")).alias("extraction"), "error")
    return answers.unionByName(known.where(~usable).select(vocab.URL, default_record(terms).alias("extraction"), none))


def extract_attributes(
    df: DataFrame, terms: list[str], extractor: Extractor | None = None,
    text: str = vocab.DESCRIPTION, batch_size: int = 6,
) -> DataFrame:
    """Rows (url, extraction) of the listings that `attempt_extractions` got an answer for."""
    tried = attempt_extractions(df, terms, extractor, text, batch_size)
    return tried.where(F.col("error").isNull()).select(vocab.URL, "extraction")


def keyword_record(text: Column | str, terms: list[str]) -> Column:
    """Extraction record read off the text itself: a flag is set when its words occur. The text is made plain once per row."""
    from hearthlake.functions.text import slug_name

    unique = list(dict.fromkeys(flag_key(t) for t in terms))

    def record(plain: Column) -> Column:
        def first_of(name: str) -> Column:
            allowed, default = vocab.EXTRACTION_ENUMS[name]
            case = None
            for value in allowed:
                hit = plain.rlike(r"\b" + value.lower() + r"\b")
                case = F.when(hit, value) if case is None else case.when(hit, value)
            return case.otherwise(F.lit(default))

        metres = F.regexp_extract(plain, r"(\d+)\s*(?:m|metros)\s+(?:da|do|ate a)\s+(?:praia|mar)\b", 1).try_cast("bigint")
        flags = [
            x for t in unique
            for x in (F.lit(t), F.contains(plain, F.lit(slug_name(t).replace("_", " "))))
        ]
        return F.struct(
            first_of("posicao_solar").alias("posicao_solar"),
            metres.alias("distancia_praia_m"),
            first_of("status_construcao").alias("status_construcao"),
            first_of("tipo_unidade").alias("tipo_unidade"),
            F.array().cast("array<string>").alias("diferenciais_unicos"),
            (F.create_map(*flags) if flags else F.create_map().cast("map<string,boolean>")).alias("flags"),
        )

    return let(plain_text(text), record)


def keyword_extractor(texts: list[str], terms: list[str]) -> str:
    """A minimal pluggable extractor: flags by substring. Shows the contract; runs without a network."""
    results = []
    for i, text in enumerate(texts):
        low = text.lower()
        results.append({"id_lote": i, **{flag_key(t): t.replace("_", " ") in low for t in terms}})
    return json.dumps({"resultados": results}, ensure_ascii=False)


# --- vocabulary discovery ----------------------------------------------------------------------

def term_ranking(terms: DataFrame, term: str = "term") -> DataFrame:
    """Rows (term, cnt): cleaned terms longer than two characters, counted per occurrence."""
    clean = F.lower(F.trim(term))
    return (
        terms.where(F.length(F.trim(term)) > 2).groupBy(clean.alias("term"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def response_terms(df: DataFrame, response: str) -> DataFrame:
    """Terms named by discovery responses: resultados[].atributos_encontrados[], texts only."""
    results = F.try_variant_get(F.try_parse_json(F.col(response)), "$.resultados", "array<variant>")
    found = df.select(F.explode(results).alias("_r")).select(
        F.explode(F.try_variant_get("_r", "$.atributos_encontrados", "array<variant>")).alias("_t")
    )
    return found.where(_kind(F.col("_t")) == "STRING").select(_text_of(F.col("_t")).alias("term"))


def discover_terms(df: DataFrame, text: str = vocab.DESCRIPTION, words: int = 2) -> DataFrame:
    """Terms of the usable texts themselves: each listing's distinct words and word pairs, ranked.

    Same contract as the ranking of discovered attributes, over every text in full.
    """
    tokens = F.filter(F.split(plain_text(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    grams = F.filter(tokens, lambda t: F.length(t) > 2)
    if words > 1:
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("_t") - 1, F.lit(1))),
            lambda i: F.concat_ws("_", F.try_element_at("_t", i), F.try_element_at("_t", i + 1)),
        )
        grams = F.concat(F.filter("_t", lambda t: F.length(t) > 2), F.when(F.size("_t") > 1, pairs).otherwise(F.array().cast("array<string>")))
    usable = df.where(usable_description(text)).select(tokens.alias("_t"))
    return term_ranking(usable.select(F.explode(F.array_distinct(grams if words > 1 else F.filter("_t", lambda t: F.length(t) > 2))).alias("term")))


# --- per-portal master -------------------------------------------------------------------------

def with_extractions(
    listings: DataFrame, extractions: DataFrame, terms: list[str], order: list[str] | None = None
) -> DataFrame:
    """Left join on URL; listings without an extraction get the default record.

    Of several extractions of a URL the last one in `order` counts. Without `order` there must be one
    per URL; if there are more, the choice is by their JSON text and does not follow time.
    """
    rank = F.struct(*order) if order else F.to_json("extraction")
    one = extractions.groupBy(vocab.URL).agg(F.max_by("extraction", rank).alias("extraction"))
    joined = listings.join(one, vocab.URL, "left")
    return joined.withColumn("extraction", F.coalesce("extraction", default_record(terms)))


def or_scraped_flags(flags: Column, scraped: Column) -> Column:
    """OR scraped amenities into extracted flags that exist; other scraped names are left alone."""
    bare = F.transform(scraped, lambda n: F.regexp_replace(n, "^" + vocab.SCRAPED_FLAG_PREFIX, ""))
    return F.transform_values(flags, lambda k, v: v | F.array_contains(bare, k))


def flatten_extraction(df: DataFrame, terms: list[str], column: str = "extraction") -> DataFrame:
    """Extraction record as plain columns, one per flag term."""
    unique = list(dict.fromkeys(flag_key(t) for t in terms))
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    enums = ["posicao_solar", "distancia_praia_m", "status_construcao", "tipo_unidade", "diferenciais_unicos"]
    return df.select(
        *rest,
        *[F.col(f"{column}.{c}").alias(c) for c in enums],
        *[F.col(f"{column}.flags")[t].alias(t) for t in unique],
    )
