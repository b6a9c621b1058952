"""The registered queries of this subpackage, over the given tables, and their DuckDB SQL where it can be had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, exact_dedup, html_extract, language_id, language_model, line_dedup, packing, quality_rules, sentencepieces, simhash, top_search, whitening
from .common import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.items_of(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.apply_policy(stored(book.drop("text"), "ledger"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    return chat_format.digests(chat_format.windows(turns.unionByName(planted)))


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: ``lang`` is the declaration and ``source`` the host."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("text", F.col("lang").alias("language")))
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return language_id.identify(rows, model).withColumnRenamed("id", "doc_id")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: declared markup language, host and its suffix, and the text outside tags; the model is that of the documents."""
    model = language_id.train(table(spark, sf_dir, "documents").select("text", F.col("lang").alias("language")))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|head|nav|footer)\b.*?</\1>", " "), r"<[^>]*>?", " ")
    declared = F.nullif(F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), body.alias("text"), declared.alias("declared"), host.alias("host"))
    return language_id.identify(rows, model).withColumnRenamed("id", "page_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_search.top_k(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(stored(quality_rules.ledger(table(spark, sf_dir, "documents").select("text")).drop("text"), "ledger"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_model": op4_language_model,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_windows": op7_chat_windows,
    "op8_sentencepieces": op8_sentencepieces,
    "op9_language_id": op9_language_id,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_top_search": op12_top_search,
    "op13_collocations": op13_collocations,
    "page_language_id": page_language_id,
    "quality_ablation": quality_ablation,
}

_BASE, _STRICT = quality_rules.BASE.mask, quality_rules.STRICT.mask
_LEDGER = quality_rules.LEDGER_SQL.replace("{table}", "documents")

ORACLE_SQL = {
    "op3_quality_rules": f"{_LEDGER} SELECT *, (fail_bits & {_BASE}) <> 0 AS base_failed, (fail_bits & {_STRICT | _BASE}) = 0 AS kept, '{quality_rules.STRICT.name}' AS policy, CAST({quality_rules.STRICT.version} AS BIGINT) AS policy_version FROM ledger",
    "quality_ablation": f"{_LEDGER}, rules AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', {1 << list(quality_rules.RULES).index(r)})" for r in quality_rules.STRICT.rules)
    + f""") AS r(rule, bit))
SELECT rule, CAST(sum(CASE WHEN (fail_bits & bit) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
  CAST(sum(CASE WHEN (fail_bits & {_STRICT}) = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_regained
FROM ledger CROSS JOIN rules GROUP BY rule""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
w AS (SELECT doc_id, i, t, lead(i) OVER o AS j, lead(t) OVER o AS u FROM l WHERE regexp_matches(t, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i AS first, j AS last, t || chr(10) || u AS s FROM w WHERE j IS NOT NULL
  UNION ALL SELECT doc_id, i, i, t FROM w WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) > 50),
g AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, first) AS r FROM b),
o AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM g WHERE r > 1),
q AS (SELECT doc_id, count(*) AS n_removed_chunks FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM o) WHERE prior IS NULL OR prior <> i - 1 GROUP BY doc_id),
s AS (SELECT l.doc_id, min(l.text) AS old, count(*) AS n_lines, string_agg(CASE WHEN o.i IS NULL THEN l.t END, chr(10) ORDER BY l.i) AS new,
  count(o.i) AS n_removed_lines FROM l LEFT JOIN o ON l.doc_id = o.doc_id AND l.i = o.i GROUP BY l.doc_id)
SELECT s.doc_id, CASE WHEN n_removed_lines = 0 THEN old ELSE coalesce(new, '') END AS text, CAST(CASE WHEN old IS NULL THEN 0 ELSE n_lines END AS BIGINT) AS n_lines, n_removed_lines, coalesce(q.n_removed_chunks, 0) AS n_removed_chunks
FROM s LEFT JOIN q ON q.doc_id = s.doc_id""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_chat_windows": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens FROM t),
p AS (SELECT *, row_number() OVER o AS pos, sum(tokens) OVER o AS e,
  first_value(CASE WHEN role = 'system' THEN tokens ELSE 0 END) OVER o AS sys
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, greatest(0, e - tokens - sys) AS start,
  length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) + length(role) + 24 AS chars FROM p),
s AS (SELECT *, CASE WHEN pos = 1 AND sys > 0 THEN 0 ELSE 2 * floor(start / 1536) + CASE WHEN floor(start / 1536) <> floor((start + tokens - 1) / 1536) THEN 1 ELSE 0 END END AS span FROM q),
f AS (SELECT conv_id, span, min(pos) AS first_pos, min(start) AS first_start, max(sys) AS sys FROM s GROUP BY conv_id, span),
again AS (SELECT s.conv_id, sum(s.chars) AS chars FROM f JOIN s ON s.conv_id = f.conv_id AND s.pos < f.first_pos
  AND ((s.pos = 1 AND f.sys > 0) OR (s.pos >= f.first_pos - 2 AND f.first_start - s.start <= 512 - f.sys)) GROUP BY s.conv_id),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS loss, sum(chars) AS chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(c.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars FROM c LEFT JOIN again USING (conv_id)""",
    "op12_top_search": r"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(c AS DOUBLE)) for c in embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
    "op13_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS z(size) WHERE len(ws) >= size),
f AS (SELECT lang, size, g, count(*) AS a FROM (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM s) GROUP BY lang, size, g HAVING count(*) >= 30),
c AS (SELECT lang, size, g, a, string_split(g, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT c.*, unnest(range(1, size)) AS k FROM c),
m AS (SELECT k.lang, k.g, k.k, k.a, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * k.a) // (l.a + r.a) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.size = k.k AND l.g = array_to_string(k.ws[1 : k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.size = k.size - k.k AND r.g = array_to_string(k.ws[k.k + 1 : k.size], ' ')),
b AS (SELECT lang, g, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM m) WHERE o = 1),
x AS (SELECT lang, a, ws, size, m, unnest(range(1, size - m + 2)) AS i FROM c CROSS JOIN (VALUES (2), (3)) AS z(m) WHERE m < size),
y AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS g, max(a) AS longer FROM x GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.g)) AS rank FROM b LEFT JOIN y ON y.lang = b.lang AND y.g = b.g WHERE y.longer IS NULL OR 100 * y.longer < 80 * b.a)
SELECT o.lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN total ON total.lang = o.lang WHERE rank <= 2000""",
}
