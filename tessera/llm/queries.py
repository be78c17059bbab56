"""The queries of the training-data operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    found = plan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10, scale=1024.0)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode, ids_digest

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return pieces.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), decoded.alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, held_out, identify

    documents = table(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), fit(documents))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_set").alias("languages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE_RULES, MORE_RULES, cascade, order

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    show = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return cascade(documents, order(documents, MORE_RULES, show=show, base=BASE_RULES), show=show, base=BASE_RULES)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A conversation about the template itself, which op11_chat_format adds to the table.
_CONTROL_CONV, _CONTROL_TEXT = -7, r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chat, read_chat
    from .common import materialise

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = [(_CONTROL_CONV, turn, role, _CONTROL_TEXT) for turn, role in enumerate(("user", "assistant"))]
    turns = turns.unionByName(spark.createDataFrame(control, "conv_id long, turn long, role string, text string"))
    return read_chat(materialise(format_chat(turns)))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_url_filter": op2_url_filter,
    "op3_topk": op3_topk,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_chat_format": op11_chat_format,
    "op12_divergence": op12_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The words of url_filter.WORDS as one RE2 pattern over host + path.
_WORDS = r"(^|[^A-Za-z0-9])(spam|spam[-._]farm|cheap[-._]pills|online[-._]casino|casino|free[-._]porn|porn|xxx|viagra|payday[-._]loans|warez|phishing)([^A-Za-z0-9]|$)"

def _license_sql() -> str:
    from .license_scan import PHRASES, TEMPLATES, THRESHOLD, stride_of

    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
           regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS lw
    FROM documents),
phrases (phrase, label) AS (VALUES {phrases}),
spots AS (
    SELECT doc_id, label, i - 1 AS place
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), phrases
    WHERE ws[i] = split_part(phrase, ' ', 1) AND array_to_string(ws[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
base AS (SELECT doc_id, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM spots GROUP BY doc_id),
templates (k, label, words) AS (VALUES {templates}),
tokens AS (SELECT DISTINCT k, label, unnest(string_split(words, ' ')) AS t FROM templates),
sizes AS (SELECT k, label, count(*) AS n FROM tokens GROUP BY k, label),
placed AS (SELECT doc_id, k, i, t FROM (SELECT doc_id, lw[i] AS t, i FROM (SELECT doc_id, lw, unnest(range(1, len(lw) + 1)) AS i FROM d)) JOIN tokens USING (t)),
held AS (SELECT a.doc_id, a.i, a.k, count(DISTINCT b.t) AS n FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i BETWEEN a.i AND a.i + {2 * stride_of() - 1} GROUP BY a.doc_id, a.i, a.k),
passed AS (SELECT doc_id, label, held.n / sizes.n AS share FROM held JOIN sizes USING (k) WHERE held.n >= ceil({THRESHOLD} * sizes.n - 1e-9)),
both_ AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
    FROM (SELECT doc_id, label, share FROM passed UNION ALL SELECT doc_id, label, 1.0 FROM spots) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, f AS first_word, l AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(both_.labels, '') AS labels, coalesce(CAST(share AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN both_ USING (doc_id)
"""


def _escaped(c: str) -> str:
    return rf"replace(replace(replace(replace({c}, '\', '\\'), '### ', '#\## '), '<turn>', '<\turn>'), '</turn>', '<\/turn>')"


ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.vec_id, n.c) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
""",
    "op12_divergence": r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS w FROM d),
kept AS (SELECT lang, w, count(*) AS n FROM t GROUP BY lang, w HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, w, count(*) AS n FROM t SEMI JOIN kept USING (lang, w) GROUP BY lang, source, w),
groups AS (
    SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sizes.n, 0) AS lang_n, coalesce(own.n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) own USING (lang, source)),
dense AS (
    SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (lang_n + 2 * v) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
above AS (SELECT lang, source, w AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM above) WHERE rank <= 10
""",
    "op11_chat_format": rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {_CONTROL_CONV}, turn, role, '{_CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) t (turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(18 + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op3_topk": """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op7_license_scan": _license_sql(),
    "op2_url_filter": rf"""
WITH parts AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
rules (rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
    SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
    FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY page_id)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN action
            WHEN host = '' OR regexp_matches(host || path, '{_WORDS}') THEN 'block' ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fit USING (page_id)
""",
    "op9_quality": r"""
WITH base AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spot AS (
    SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM base)),
again AS (SELECT doc_id, i FROM spot QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base),
lines AS (
    SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d, count(*) FILTER (WHERE regexp_matches(l, '^[\x20\x09-\x0D]*[*•-]')) AS bullets, count(*) FILTER (WHERE regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS cut
    FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pairs AS (SELECT doc_id, count(*) * max(length(a) + length(b)) AS chars FROM (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM base)) GROUP BY doc_id, a, b),
top AS (SELECT doc_id, max(chars) AS chars FROM pairs GROUP BY doc_id),
bare AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM base) WHERE NOT regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]') GROUP BY doc_id),
figures AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
           coalesce(bullets, 0) AS n_bullets, coalesce(cut, 0) AS n_cut, coalesce(top.chars, 0) AS top_chars, coalesce(bare.n, 0) AS n_bare
    FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN bare USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words
            OR 5 * n_bare > n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_cut > 3 * n_lines OR 5 * top_chars > word_chars) AS kept
FROM judged
""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
""",
}
