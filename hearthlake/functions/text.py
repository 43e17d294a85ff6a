"""Text normalisers, place and identity resolvers, token and prose extractors."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlake import vocab
from hearthlake.functions.numbers import strip_space


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read many times, computed once per row.

    A plain projection would be copied into every filter that is pushed below it; a one-element
    explode is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


# --- normalisers -------------------------------------------------------------------------------

def fold_text(col: Column | str) -> Column:
    """Linkage normaliser: lower case, listed accents folded, separators and runs of space to ' '."""
    text = F.lower(F.coalesce(_col(col).cast("string"), F.lit("")))
    folded = F.translate(
        text,
        vocab.FOLD_FROM + vocab.FOLD_SEPARATORS,
        vocab.FOLD_TO + " " * len(vocab.FOLD_SEPARATORS),
    )
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def strip_accents(col: Column | str) -> Column:
    """Drop every combining mark, composed or not."""
    plain = F.translate(_col(col), vocab.ACCENTED, vocab.UNACCENTED)
    return F.regexp_replace(plain, r"\p{Mn}", "")


def slug_text(col: Column | str) -> Column:
    """Identifier form: no accents, no punctuation, spaces to '_'."""
    text = strip_space(F.lower(strip_accents(F.coalesce(_col(col).cast("string"), F.lit("")))))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", "_")


def slug_name(name: str) -> str:
    """`slug_text` for a column name, which only the driver holds."""
    marks_off = "".join(
        c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn"
    )
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", marks_off.lower().strip()))


def plain_text(col: Column | str) -> Column:
    """Prose form: lower case, no accents, single spaces."""
    text = F.lower(strip_accents(F.coalesce(_col(col).cast("string"), F.lit(""))))
    return F.regexp_replace(text, r"(?U)\s+", " ")


def title_case(col: Column | str) -> Column:
    """Capitalise after every non-letter, so that "d'agua" becomes "D'Agua"."""
    pieces = F.split(F.lower(_col(col)), r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))),
        "",
    )


# --- predicates --------------------------------------------------------------------------------

def usable_description(col: Column | str, min_chars: int = 10) -> Column:
    """True where the trimmed text is long enough and not the not-found sentinel."""
    text = strip_space(F.coalesce(_col(col), F.lit("")))
    return (F.length(text) >= min_chars) & (text != vocab.NO_DESCRIPTION)


def substantial_text(col: Column | str, more_than: int = 40) -> Column:
    return F.length(plain_text(col)) > more_than


def contains_flag(col: Column | str, needle: str) -> Column:
    """Case-insensitive substring test; missing text is False."""
    return F.coalesce(F.contains(F.lower(_col(col)), F.lit(needle.lower())), F.lit(False))


# --- places and identity -----------------------------------------------------------------------

def match_gazetteer(
    folded: Column, gazetteer: list[str] | None = None, longest_match: bool = False
) -> Column:
    """First gazetteer entry contained in an already folded address, underscores for spaces.

    `longest_match=True` tries longer names first, so 'bessa norte' is no longer hidden by 'bessa'.
    """
    names = list(vocab.GAZETTEER if gazetteer is None else gazetteer)
    if longest_match:
        names = sorted(names, key=lambda n: (-len(n), n))
    if not names:
        return F.lit(None).cast("string")
    case = F.when(F.contains(folded, F.lit(names[0])), names[0].replace(" ", "_"))
    for name in names[1:]:
        case = case.when(F.contains(folded, F.lit(name)), name.replace(" ", "_"))
    return case


def place_from_folded(
    address: Column,
    given: Column | None = None,
    gazetteer: list[str] | None = None,
    longest_match: bool = False,
) -> Column:
    """Place from already folded texts; the gazetteer test refers to the address many times, so
    callers with a frame at hand should fold into a column first, see `with_place`."""
    first_long_word = F.nullif(F.regexp_extract(address, r"(?:^| )([^ ]{4,})", 1), F.lit(""))
    candidates = [
        match_gazetteer(address, gazetteer, longest_match), first_long_word,
        F.lit(vocab.UNKNOWN_PLACE),
    ]
    if given is not None:
        informative = (given != "") & ~given.isin(vocab.UNINFORMATIVE_PLACES)
        candidates.insert(0, F.when(informative, F.translate(given, " ", "_")))
    return F.coalesce(*candidates)


def resolve_place(
    address: Column | str,
    given: Column | str | None = None,
    gazetteer: list[str] | None = None,
    longest_match: bool = False,
) -> Column:
    """Given place if it says anything, else gazetteer hit, else first long word of the address."""
    folded = None if given is None else fold_text(given)
    return place_from_folded(fold_text(address), folded, gazetteer, longest_match)


def with_place(
    df: DataFrame, out: str, address: Column | str, given: Column | str | None = None, **options
) -> DataFrame:
    """Add the resolved place; each text is folded once."""
    own = F.lit("") if given is None else fold_text(given)
    folded = bind_column(df, "_folded", F.struct(fold_text(address).alias("address"), own.alias("given")))
    place = place_from_folded(
        F.col("_folded.address"), None if given is None else F.col("_folded.given"), **options
    )
    return folded.withColumn(out, place).drop("_folded")


def place_slug_from_url(url: Column | str, city_slug: str = "pb-joao-pessoa") -> Column:
    pattern = re.escape(city_slug).replace(r"\-", "-") + r"-(.+?)-(?:[\d.,]+m2-)?rs\d+"
    found = F.nullif(F.regexp_extract(F.lower(_col(url)), pattern, 1), F.lit(""))
    return F.trim(F.replace(found, F.lit("-"), F.lit(" ")))


def place_name(slug: Column, names: dict[str, str] | None = None) -> Column:
    """Canonical spelling of a place slug, title case for the rest."""
    pairs = vocab.PLACE_NAMES if names is None else names
    if not pairs:
        return title_case(slug)
    known = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(known, slug), title_case(slug))


def place_from_url(
    url: Column | str, city_slug: str = "pb-joao-pessoa", names: dict[str, str] | None = None
) -> Column:
    return place_name(place_slug_from_url(url, city_slug), names)


def listing_id(url: Column | str) -> Column:
    """'prop-' plus the id in the URL; a hash of the URL where it carries none."""
    found = F.nullif(F.regexp_extract(_col(url), r"/id-(\d+)", 1), F.lit(""))
    return F.concat(F.lit("prop-"), F.coalesce(found, F.sha2(_col(url), 256)))


def split_address(street: Column | str, place: Column | str) -> dict[str, Column]:
    """Street, number and place of a card address; the comma counts only after a street word."""
    street, place = _col(street), _col(place)
    both = street.isNotNull() & place.isNotNull()
    parts = F.split(street, ",")
    is_street = F.contains(street, F.lit(",")) & (
        F.contains(street, F.lit("Avenida")) | F.contains(street, F.lit("Rua"))
    )
    name = F.when(is_street, F.trim(parts[0])).otherwise(F.trim(street))
    number_text = F.trim(F.try_element_at(parts, F.lit(2)))
    number = F.when(is_street & number_text.rlike(r"^\d+$"), number_text.try_cast("bigint"))
    unknown = F.lit("Não informado")
    return {
        "rua": F.when(both & (name != "Endereço indisponível"), name).otherwise(unknown),
        "numero": F.coalesce(F.when(both, number), F.lit(-1).cast("bigint")),
        "bairro": F.when(both, F.split(place, ",")[0]),
    }


def clean_address(col: Column | str) -> Column:
    """Address text without the 'address unavailable' lead."""
    return strip_space(F.regexp_replace(_col(col), r"(?iU)^endereço\s+indisponível", ""))


def clean_label_value(value: Column, label: Column) -> Column:
    """Value of a labelled cell: the label prefix off, 'm²' off for areas."""
    known = r"(?iU)^(área útil|área total|quartos|suítes|banheiros|garagens)\s*"
    has_label = F.startswith(F.lower(value), F.lower(label)) & (F.length(label) > 0)
    by_label = strip_space(
        F.when(has_label, value.substr(F.length(label) + 1, F.length(value))).otherwise(value)
    )
    by_word = strip_space(F.regexp_replace(value, known, ""))
    cleaned = F.when((by_label == "") | (by_label == value), by_word).otherwise(by_label)
    kept = F.when(cleaned == "", value).otherwise(cleaned)
    is_area = F.contains(label_key(label), F.lit("area"))
    return F.when(is_area, strip_space(F.regexp_replace(kept, r"(?i)m²", ""))).otherwise(kept)


def label_key(label: Column) -> Column:
    return F.translate(F.lower(label), "- ", "__")


def clip_text(col: Column | str, max_chars: int | None = None, missing: str = "sem descricao disponivel") -> Column:
    """Stand-in for unusable text; clips only when the caller asks for a length."""
    text = strip_space(F.coalesce(_col(col), F.lit("")))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return F.when(usable_description(text), text).otherwise(F.lit(missing))


# --- tokens and flags --------------------------------------------------------------------------

def comma_tokens(*cols: Column | str) -> Column:
    """Trimmed lower-case tokens of one or more comma lists, empties dropped."""
    joined = F.concat_ws(",", *[_col(c) for c in cols])
    tokens = F.transform(F.split(joined, ","), lambda t: F.lower(strip_space(t)))
    return F.filter(tokens, lambda t: t != "")


def amenity_only(tokens: Column) -> Column:
    """Drop tokens that count rooms or state a size."""
    return F.filter(tokens, lambda t: ~_contains_any(t, vocab.NON_AMENITY_WORDS))


def scraped_flag_name(token: Column) -> Column:
    return F.concat(F.lit(vocab.SCRAPED_FLAG_PREFIX), F.translate(token, " -", "__"))


def keyword_flag(tokens: Column, description: Column | str, name: str) -> Column:
    """One of the boolean property fields: a listed token, or a keyword in the description."""
    words, keywords = vocab.KEYWORD_FLAGS[name]
    in_tokens = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return F.coalesce(in_tokens, F.lit(False)) | _contains_any(
        F.lower(F.coalesce(_col(description), F.lit(""))), keywords
    )


def canonical_term(term: Column) -> Column:
    """Apply the ordered synonym rules to a slug; an unmatched term stays itself."""
    case = None
    for rule in vocab.SYNONYM_RULES:
        hit = _contains_any(term, rule.words)
        if rule.along_with:
            hit = hit & _contains_any(term, rule.along_with)
        value = term if rule.canonical is None else F.lit(rule.canonical)
        case = F.when(hit, value) if case is None else case.when(hit, value)
    return case.otherwise(term)


def flag_slug(name: Column) -> Column:
    return slug_text(F.regexp_replace(name, "^" + vocab.SCRAPED_FLAG_PREFIX, ""))


def canonical_slug(slug: Column) -> Column:
    """Canonical name of a flag slug, exceptions first."""
    return F.when(slug.isin(vocab.SYNONYM_EXCEPTIONS), slug).otherwise(canonical_term(slug))


def with_canonical_flag(df: DataFrame, name: str, out: str = "canonical") -> DataFrame:
    """Add the canonical name of a flag from any of its generators; the slug is computed once."""
    slugged = bind_column(df, "_slug", flag_slug(F.col(name)))
    return slugged.withColumn(out, canonical_slug(F.col("_slug"))).drop("_slug")


def canonical_flag_name(name: str) -> str:
    """`with_canonical_flag` for a column name, which only the driver holds."""
    slug = slug_name(name.removeprefix(vocab.SCRAPED_FLAG_PREFIX))
    if slug in vocab.SYNONYM_EXCEPTIONS:
        return slug
    for rule in vocab.SYNONYM_RULES:
        related = not rule.along_with or any(w in slug for w in rule.along_with)
        if related and any(w in slug for w in rule.words):
            return slug if rule.canonical is None else rule.canonical
    return slug


def category_value(col: Column | str) -> Column:
    return slug_text(F.coalesce(_col(col).cast("string"), F.lit(vocab.UNKNOWN_PLACE)))


# --- prose -------------------------------------------------------------------------------------

def prose_pattern(unit_words: str) -> str:
    """Count or number word right before one of the unit words; leading zeros stay outside the group."""
    return r"0*(\d+|" + "|".join(vocab.NUMBER_WORDS) + r")\s*(?:" + unit_words + r")\b"


def number_from_prose(plain: Column, unit_words: str, low: int, high: int) -> Column:
    """First mention only; a count outside [low, high] is NULL, with no second try."""
    counts = {str(n): float(n) for n in range(low, high + 1)}
    counts |= {w: float(n) for w, n in vocab.NUMBER_WORDS.items() if low <= n <= high}
    lookup = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    return F.try_element_at(lookup, F.regexp_extract(plain, prose_pattern(unit_words), 1))


def field_from_prose(plain: Column, name: str) -> Column:
    unit_words, low, high = vocab.PROSE_FIELDS[name]
    return number_from_prose(plain, unit_words, low, high)
