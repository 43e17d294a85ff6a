"""The column functions for SQL users: temporary SQL functions whose bodies are the very expressions of the Python ones.

    from hearthlake.functions import sql
    sql.register(spark)
    spark.sql("SELECT parse_price(preco_venda), place_from_url(url_anuncio) FROM listings")

Spark inlines a SQL function into the query that calls it, so a call is as optimised as the expression itself: no Python, and filters on its
result are simplified as usual.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions import arrays, numbers, text


class SqlFunction(NamedTuple):
    """Parameters with their types, and the expression of columns named like them."""

    parameters: dict[str, str]
    body: Callable[..., Column]


def _of(body: Callable[..., Column], *kinds: str, **named: str) -> SqlFunction:
    """A function of one text, or of parameters of the given names and types."""
    return SqlFunction(named or {f"x{i}" if i else "x": kind for i, kind in enumerate(kinds or ("string",))}, body)


def _address(part: str) -> Callable[[Column, Column], Column]:
    return lambda street, place: text.split_address(street, place)[part]


def _prose(field: str) -> Callable[[Column], Column]:
    return lambda x: text.field_from_prose(text.plain_text(x), field)


FUNCTIONS: dict[str, SqlFunction] = {
    # numbers
    "parse_price": _of(numbers.parse_price),
    "parse_number": _of(numbers.parse_number),
    "is_numeric_text": _of(numbers.is_numeric),
    "money_to_int": _of(numbers.money_to_int),
    "first_decimal": _of(numbers.first_decimal),
    "usable_area": _of(numbers.usable_area, area="string", total="string"),
    "first_int": _of(numbers.first_int),
    "parse_fee": _of(numbers.parse_fee),
    "log_price": _of(numbers.log_price, "double"),
    "price_per_area": _of(numbers.price_per_area, price="double", area="double"),
    "card_price": _of(numbers.card_price),
    "card_leading_int": _of(numbers.card_leading_int),
    "card_suites": _of(numbers.card_suites),
    # texts
    "fold_text": _of(text.fold_text),
    "strip_accents": _of(text.strip_accents),
    "slug_text": _of(text.slug_text),
    "plain_text": _of(text.plain_text),
    "title_case": _of(text.title_case),
    "usable_description": _of(text.usable_description),
    "substantial_text": _of(text.substantial_text),
    "clip_text": _of(text.clip_text),
    "category_value": _of(text.category_value),
    # places and identity
    "resolve_place": _of(text.resolve_place, address="string", given="string"),
    "place_of_address": _of(text.resolve_place, address="string"),
    "place_slug_from_url": _of(text.place_slug_from_url),
    "place_from_url": _of(text.place_from_url),
    "listing_id": _of(text.listing_id),
    "clean_address": _of(text.clean_address),
    "address_street": _of(_address("rua"), street="string", place="string"),
    "address_number": _of(_address("numero"), street="string", place="string"),
    "address_place": _of(_address("bairro"), street="string", place="string"),
    "label_key": _of(text.label_key),
    "clean_label_value": _of(text.clean_label_value, value="string", label="string"),
    # tokens and flags
    "comma_tokens": _of(text.comma_tokens),
    "comma_tokens_of_two": _of(text.comma_tokens, a="string", b="string"),
    "amenity_only": _of(text.amenity_only, "array<string>"),
    "scraped_flag_name": _of(text.scraped_flag_name),
    "flag_slug": _of(text.flag_slug),
    "canonical_flag": _of(lambda x: text.canonical_slug(text.flag_slug(x))),
    "canonical_term": _of(text.canonical_term),
    "json_string_array": _of(arrays.json_string_array),
    "union_sorted": _of(arrays.union_sorted, a="array<string>", b="array<string>"),
    # prose
    **{f"{field}_from_prose": _of(_prose(field)) for field in vocab.PROSE_FIELDS},
}


#: A string literal, which is left alone, or the call of a function that is named like an operator.
_CALL = re.compile(r"""'(?:\\.|[^'\\])*'|(?<![\w`])(<=>|<=|>=|==|=|<|>|!|\+|-|\*|/|%|&|\||\^|and|or|in|not|div)\(""")


def body_text(column: Column) -> str:
    """SQL text of an expression. Spark writes operators as calls, whose names SQL wants quoted."""
    return _CALL.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], column._jc.node().sql())


def statement(spark: SparkSession, name: str, prefix: str = "") -> str:
    """CREATE TEMPORARY FUNCTION for one function; the result's type is what Spark makes of the expression."""
    function = FUNCTIONS[name]
    body = function.body(*[F.col(p) for p in function.parameters])
    given = spark.range(0).select(*[F.lit(None).cast(kind).alias(p) for p, kind in function.parameters.items()])
    result = given.select(body).schema[0].dataType.simpleString()
    parameters = ", ".join(f"{p} {kind}" for p, kind in function.parameters.items())
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body_text(body)}"


def register(spark: SparkSession, names: list[str] | None = None, prefix: str = "") -> list[str]:
    """Register the functions `names`, or all, as temporary SQL functions of the session; returns what they are called."""
    names = list(FUNCTIONS) if names is None else names
    for name in names:
        spark.sql(statement(spark, name, prefix))
    return [prefix + n for n in names]
