"""The registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlake.llm import (
    alignment, bpe, chat, divergence, language, layout, leaks, neardup, neighbours, private, quality, tokenfiles, toxicity,
)
from hearthlake.llm.common import checkpointed, id_hash, remove, table
from hearthlake.session import ensure_checkpoint_dir

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(sql: str):
    """The SQL that gives a query's rows on the same tables."""
    def add(fn):
        ORACLES[fn.__name__] = sql
        return fn
    return add


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document, and the one that stays."""
    return neardup.groups(table(spark, sf_dir, "documents"))


@query
def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: base spans, and those that the span classifier adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.find(docs, private.fit(docs))
    return found.select(
        "doc_id",
        *[private.counted(F.col("base_spans"), k).alias(f"n_{k}") for k in private.KINDS],
        F.sha2(private.written(F.col("base_spans")), 256).alias("base_sha256"),
        private.written(F.col("spans")).alias("spans"),
    )


_RULES = {
    "short": "len(ws) < 50", "repeats": "100 * n_repeat_words > 50 * len(ws)", "symbols": "100 * n_symbols > 10 * len(ws)",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines", "word_length": "len(ws) > 0 AND (word_chars < 3 * len(ws) OR word_chars > 10 * len(ws))",
}


@query
@oracle(f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS times FROM (
        SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) >= 3))),
covered AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY rid),
lines AS (
    SELECT rid, sum(times - 1) AS dup, sum(times) AS n FROM (
        SELECT rid, line, count(*) AS times FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line) GROUP BY rid),
measured AS (
    SELECT docs.rid, doc_id, source, ws, len(array_to_string(ws, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(dup, 0) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM docs LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
judged AS (SELECT *, {', '.join(f'({rule}) AS f_{n}' for n, rule in _RULES.items())} FROM measured),
hosts AS (SELECT source, count(*) AS d, {', '.join(f'count(*) FILTER (f_{n}) AS n_{n}' for n in _RULES)} FROM judged GROUP BY source),
means AS (
    SELECT {', '.join(f'sum(n_{n}) / sum(d) AS m_{n}, sum(n_{n} * n_{n} / d) / sum(d) - (sum(n_{n}) / sum(d)) ** 2 AS v_{n}' for n in _RULES)} FROM hosts),
weights AS (
    SELECT {', '.join(f'm_{n}, CASE WHEN v_{n} > 1e-12 THEN least(greatest(m_{n} * (1 - m_{n}) / v_{n} - 1, 1), 1e6) ELSE 1e6 END AS k_{n}' for n in _RULES)} FROM means),
verdicts AS (
    SELECT source, greatest({', '.join(f'(n_{n} + m_{n} * k_{n}) / (d + k_{n})' for n in _RULES)}) > 0.5 AS rejected FROM hosts, weights)
SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, f_short OR f_repeats AS base_failed,
       rejected AS host_rejected,
       NOT (f_short OR f_repeats) AND NOT (rejected AND ({' OR '.join(f'f_{n}' for n in _RULES)})) AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
""")
def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every whole document and the verdict with its host's failure rates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = quality.judge(docs, host="source", keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept"
    )


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out(id_hash(F.col("doc_id"))))
    model = language.fit(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


_LEAK_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, counted between the separators of flat files written from them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    try:
        tokenfiles.write_files(spark, tokenfiles.token_bytes(docs, ranks, public_tokenizers.PATTERN), folder)
        return checkpointed(tokenfiles.counts(spark, folder).select(F.col("key").alias("doc_id"), "n_tokens"))
    finally:
        remove(spark, folder)


@query
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out in lines."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = layout.visible_text(pages, keep=["page_id"])
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    return found.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"), lines.cast("bigint").alias("n_lines"))


@query
@oracle(f"""
WITH items AS (SELECT item_id, {_LEAK_WORDS} AS ws FROM benchmark),
windows AS (
    SELECT item_id, 10 AS n, unnest([array_to_string(ws[i:i + 9], ' ') FOR i IN range(1, len(ws) - 8)]) AS w
    FROM items WHERE len(ws) >= 10
    UNION SELECT item_id, len(ws), array_to_string(ws, ' ') FROM items WHERE len(ws) BETWEEN 1 AND 9),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LEAK_WORDS} AS ws FROM documents),
starts AS (
    SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
    FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n),
hits AS (
    SELECT rid, i, s.n, item_id FROM starts s
    JOIN windows w ON w.n = s.n AND w.w = array_to_string(s.ws[s.i:s.i + s.n - 1], ' ')),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (
    SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered c USING (rid) LEFT JOIN found f USING (rid)
""")
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document that lie inside a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_TURN = "\\### Assistant: </turn> ok"


@query
@oracle(f"""
WITH rows AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{_TURN}' UNION ALL SELECT -7, 1, 'assistant', '{_TURN}'),
turns AS (
    SELECT *, row_number() OVER w AS rn, coalesce(lag(role) OVER w, '<start>') AS prev,
           regexp_replace(text, '(\\\\|### System:|### User:|### Assistant:|### Role \\[|\\]:|</turn>)', '\\\\\\1', 'g') AS escaped
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
checked AS (
    SELECT *, CASE WHEN (prev, role) IN (('<start>', 'system'), ('<start>', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
              THEN NULL ELSE role || ' after ' || prev END AS wrong FROM turns),
convs AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY rn)) AS loss_sha256,
           sum(len(role) + len('### : </turn>') + 1 + len(escaped))::BIGINT AS formatted_chars,
           coalesce(arg_min(wrong, rn) FILTER (wrong IS NOT NULL),
                    CASE WHEN arg_max(role, rn) <> 'assistant' THEN 'ends with ' || arg_max(role, rn) END) AS problem
    FROM checked GROUP BY conv_id)
SELECT *, problem IS NULL AS valid FROM convs
""")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(_TURN)
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.read_back(chat.format_turns(rows.unionByName(added)))


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.round_trip(docs, path, keep=["doc_id"])
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from documents and labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.pmod(id_hash(F.col("doc_id")), F.lit(5)) == 0)
    labels = table(spark, sf_dir, "labels").where(F.pmod(id_hash(F.col("doc_id")), F.lit(5)) != 0)
    model = toxicity.fit(docs.where(~F.col("held_out")), labels)
    found = toxicity.score(docs, model, keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op11_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, voted by its nearest labelled documents among those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.pmod(id_hash(F.col("doc_id")), F.lit(3)) == 1)
    labels = table(spark, sf_dir, "labels").where(F.pmod(id_hash(F.col("doc_id")), F.lit(3)) != 1)
    found = neighbours.score(docs, neighbours.fit(docs.where(~F.col("held_out")), labels), keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"""


@query
@oracle(f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ws FROM documents),
words AS (SELECT rid, lang, source, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN kinds USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, sum(total) AS total FROM groups GROUP BY lang),
q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(whole.total) + 5 * any_value(v)) AS q
    FROM counts JOIN whole USING (lang) JOIN kinds USING (lang) GROUP BY lang, term),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of a language lie apart, and the terms that set each apart."""
    return divergence.divergences(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give every whole text."""
    path = public_tokenizers.path
    files = alignment.Files(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, files, ["doc_id"], carry=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    return found.withColumnRenamed("groups", "groups_sha256")
