"""SQL text of the oracle's scalar rules, written from the rules and not from the Spark code."""

from __future__ import annotations

from hearthlake import vocab

NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
PLAIN = r"(\d+\.?\d*|\.\d+)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def number(x: str, shape: str = NUMBER) -> str:
    return f"CASE WHEN regexp_full_match({x}, '{shape}') THEN try_cast({x} AS DOUBLE) END"


def price(x: str) -> str:
    s = f"replace(replace({strip(x)}, 'R$', ''), ' ', '')"
    comma = f"replace(replace({s}, '.', ''), ',', '.')"
    joined = f"replace({s}, '.', '')"
    grouped = rf"len(list_filter(string_split({s}, '.')[2:], lambda p: len(p) <> 3)) = 0 AND contains({s}, '.')"
    v = f"CASE WHEN contains({s}, ',') THEN {number(comma)} WHEN {grouped} THEN {number(joined)} ELSE {number(s)} END"
    return f"CASE WHEN ({v}) >= 0 THEN ({v}) END"


def measure(x: str) -> str:
    s = rf"regexp_replace({x}, '[^0-9,.]', '', 'g')"
    comma = f"replace(replace({s}, '.', ''), ',', '.')"
    joined = f"replace({s}, '.', '')"
    last3 = f"contains({s}, '.') AND len(string_split({s}, '.')[-1]) = 3"
    return f"CASE WHEN contains({s}, ',') THEN {number(comma)} WHEN {last3} THEN {number(joined)} ELSE {number(s)} END"


def money(x: str) -> str:
    return f"try_cast(nullif(regexp_replace(string_split({x}, ',')[1], '[^0-9]', '', 'g'), '') AS BIGINT)"


def decimal(x: str) -> str:
    s = f"CASE WHEN contains({x}, ',') THEN replace(replace({x}, '.', ''), ',', '.') ELSE {x} END"
    return number(rf"regexp_extract({s}, '[0-9.]+', 0)", PLAIN)


def integer(x: str) -> str:
    return rf"coalesce(try_cast(nullif(regexp_extract({x}, '\d+', 0), '') AS BIGINT), 0)"


def fee(x: str) -> str:
    return f"CASE WHEN lower({strip(x)}) = 'isento' THEN 0.0::DOUBLE ELSE {price(x)} END"


def fold(x: str) -> str:
    src = vocab.FOLD_FROM + vocab.FOLD_SEPARATORS
    dst = vocab.FOLD_TO + " " * len(vocab.FOLD_SEPARATORS)
    return rf"trim(regexp_replace(translate(lower(coalesce({x}, '')), '{src}', '{dst}'), '\s+', ' ', 'g'))"


def slug(x: str) -> str:
    s = strip(f"lower(strip_accents(coalesce({x}, '')))")
    return rf"regexp_replace(regexp_replace({s}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', '_', 'g')"


def plain(x: str) -> str:
    return rf"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '\s+', ' ', 'g')"


def tokens(*xs: str) -> str:
    parts = "concat_ws(',', " + ", ".join(xs) + ")"
    return f"list_filter(list_transform(string_split({parts}, ','), lambda t: lower(trim(t))), lambda t: t <> '')"


def place_url(x: str) -> str:
    pattern = r"pb-joao-pessoa-(.+?)-(?:[\d.,]+m2-)?rs\d+"
    return f"nullif(trim(replace(regexp_extract(lower({x}), '{pattern}', 1), '-', ' ')), '')"


def title(x: str) -> str:
    """Title case for slugs of letters, digits and spaces."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def gazetteer(folded: str) -> str:
    whens = " ".join(
        f"WHEN contains({folded}, {quoted(n)}) THEN {quoted(n.replace(' ', '_'))}" for n in vocab.GAZETTEER
    )
    return f"CASE {whens} END"


def place(address: str, given: str | None = None) -> str:
    f = fold(address)
    word = f"list_filter(string_split({f}, ' '), lambda w: len(w) > 3)[1]"
    own = "NULL"
    if given:
        g = fold(given)
        own = f"CASE WHEN {g} <> '' AND {g} NOT IN {in_list(vocab.UNINFORMATIVE_PLACES)} THEN replace({g}, ' ', '_') END"
    return f"coalesce({own}, {gazetteer(f)}, {word}, 'nao_informado')"


def synonym(x: str) -> str:
    """The ordered rules as nested tests."""
    out = []
    for r in vocab.SYNONYM_RULES:
        test = "(" + " OR ".join(f"{x} LIKE '%{w.replace('_', chr(92) + '_')}%' ESCAPE '\\'" for w in r.words) + ")"
        if r.along_with:
            test += " AND (" + " OR ".join(f"{x} LIKE '%{w}%'" for w in r.along_with) + ")"
        out.append(f"WHEN {test} THEN " + (x if r.canonical is None else quoted(r.canonical)))
    return f"CASE {' '.join(out)} ELSE {x} END"


def flag(x: str) -> str:
    s = slug(f"regexp_replace({x}, '^comodidade_', '')")
    return f"CASE WHEN {s} IN {in_list(vocab.SYNONYM_EXCEPTIONS)} THEN {s} ELSE {synonym(s)} END"


def prose(text: str, field: str) -> str:
    units, low, high = vocab.PROSE_FIELDS[field]
    words = "|".join(vocab.NUMBER_WORDS)
    found = rf"regexp_extract({text}, '(\d+|{words})\s*(?:{units})\b', 1)"
    cases = " ".join(f"WHEN '{w}' THEN {float(n)}" for w, n in vocab.NUMBER_WORDS.items())
    value = f"CASE {found} {cases} ELSE try_cast(nullif({found}, '') AS DOUBLE) END"
    return f"CASE WHEN ({value}) BETWEEN {low} AND {high} THEN ({value}) END"


def numeric_text(x: str) -> str:
    return number(f"trim({x})")


def avg_rank(value: str, partition: str = "") -> str:
    p = f"PARTITION BY {partition} " if partition else ""
    q = f"PARTITION BY {partition}, {value}" if partition else f"PARTITION BY {value}"
    return f"(rank() OVER ({p}ORDER BY {value}) + (count(*) OVER ({q}) - 1) / 2.0)::DOUBLE"


def md5_number(x: str, seed: int = vocab.SEED) -> str:
    return f"('0x' || substr(md5('{seed}|' || {x}), 1, 8))::UBIGINT::BIGINT"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
