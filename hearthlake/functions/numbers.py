"""Locale-aware number parsing as `Column -> Column` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake import vocab

#: One number and nothing else; no names for infinity or NaN, and no '12d'.
NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NON_NEGATIVE_SHAPE = r"^[+]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PLAIN_DECIMAL_SHAPE = r"^(\d+\.?\d*|\.\d+)$"


def _as_text(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def strip_space(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def to_double(text: Column, shape: str = NUMBER_SHAPE) -> Column:
    """Strict text-to-double: NULL unless the whole text is one number.

    The text is referred to once, so nested parsers stay small enough for generated code.
    """
    return F.regexp_extract(text, shape, 0).try_cast("double")


def _decimal_mark(text: Column, thousands: str) -> Column:
    """Comma as decimal mark if there is one, else dots dropped where `thousands` matches."""
    return (
        F.when(F.contains(text, F.lit(",")), F.translate(text, ",.", "."))
        .when(text.rlike(thousands), F.translate(text, ".", ""))
        .otherwise(text)
    )


def parse_price(col: Column | str) -> Column:
    """Currency text. Dots are thousands marks only when every later part has three characters.

    Tokens that mean "no value" are no numbers and come out NULL like any other word.
    """
    text = F.regexp_replace(_as_text(col), r"(?U)^\s+|\s+$|R\$| ", "")
    return to_double(_decimal_mark(text, r"^[^.]*(\.[^.]{3})+$"), NON_NEGATIVE_SHAPE)


def parse_number(col: Column | str) -> Column:
    """Measure text such as '85,5 m²'. The minus sign is lost with the other non-digits."""
    kept = F.regexp_replace(_as_text(col), r"[^\d,.]", "")
    return to_double(_decimal_mark(kept, r"\.[^.]{3}$"))


def is_numeric(col: Column | str) -> Column:
    return parse_number(col).isNotNull()


def money_to_int(col: Column | str) -> Column:
    """Digits before the first comma, as a whole amount."""
    digits = F.regexp_replace(F.substring_index(_as_text(col), ",", 1), r"[^0-9]", "")
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def first_decimal(col: Column | str) -> Column:
    """First run of digits and dots; comma is the decimal mark when there is one."""
    text = _as_text(col)
    plain = F.when(F.contains(text, F.lit(",")), F.translate(text, ",.", ".")).otherwise(text)
    return to_double(F.regexp_extract(plain, r"[\d.]+", 0), PLAIN_DECIMAL_SHAPE)


def usable_area(area: Column | str, total_area: Column | str) -> Column:
    """Living area; total area stands in when it is missing or zero."""
    total = first_decimal(total_area)
    return F.coalesce(F.nullif(first_decimal(area), F.lit(0.0)), F.nullif(total, F.lit(0.0)))


def first_int(col: Column | str) -> Column:
    """First digit run, 0 when there is none."""
    found = F.regexp_extract(_as_text(col), r"\d+", 0).try_cast("bigint")
    return F.coalesce(found, F.lit(0).cast("bigint"))


def parse_fee(col: Column | str) -> Column:
    """Currency text in which an exemption means zero, not missing."""
    exempt = F.lower(strip_space(_as_text(col))) == vocab.FEE_EXEMPT
    return F.when(exempt, F.lit(0.0)).otherwise(parse_price(col))


def log_price(col: Column | str) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.when(value > 0, F.ln(value))


def price_per_area(price: Column | str, area: Column | str) -> Column:
    price = F.col(price) if isinstance(price, str) else price
    area = F.col(area) if isinstance(area, str) else area
    return F.when(area > 0, price / area)


# --- card-level parsers with -1 for "not given" -----------------------------------------------

def card_price(col: Column | str) -> Column:
    kept = F.regexp_replace(_as_text(col), r"[^\d.,]", "")
    return F.coalesce(to_double(F.translate(kept, ",.", "."), PLAIN_DECIMAL_SHAPE), F.lit(-1.0))


def card_leading_int(col: Column | str) -> Column:
    found = F.regexp_extract(strip_space(_as_text(col)), r"^(\d+)", 1).try_cast("bigint")
    return F.coalesce(found, F.lit(-1).cast("bigint"))


def card_suites(col: Column | str) -> Column:
    return first_int(col)


def card_features(labels: Column | str) -> dict[str, Column]:
    """Route an array of labels such as '3 quartos' to area, bedrooms, bathrooms and garages."""
    labels = F.col(labels) if isinstance(labels, str) else labels

    def kind(label: Column) -> Column:
        text = F.lower(label)
        return (
            F.when(F.contains(text, F.lit("área útil")) | F.contains(text, F.lit("área total")), "area")
            .when(F.contains(text, F.lit("quarto")), "quartos")
            .when(F.contains(text, F.lit("banheiro")), "banheiros")
            .when(F.contains(text, F.lit("garagens")), "garagens")
        )

    def last_of(name: str) -> Column:
        hits = F.filter(labels, lambda x: kind(x) == name)
        return card_leading_int(F.try_element_at(hits, F.lit(-1)))

    return {name: last_of(name) for name in ("area", "quartos", "banheiros", "garagens")}
