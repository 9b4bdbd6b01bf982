"""The registered queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.byte_bpe import encode_documents
from tablewright.llm.embedding_dedup import near_vectors
from tablewright.llm.exact_dedup import exact_duplicates
from tablewright.llm.hard_negatives import hard_negatives
from tablewright.llm.language import fit_language_model, held_out, identify
from tablewright.llm.packing import pack_documents
from tablewright.llm.prefix_trie import borrow_heads, prefix_trie, turns_of
from tablewright.llm.secrets import find_secrets, span_text
from tablewright.llm.simhash import near_duplicates
from tablewright.llm.substring_dedup import remove_repeated_passages
from tablewright.llm.suffix_dedup import remove_repeats
from tablewright.llm.toxicity import fit_severity, severity
from tablewright.llm.warc import archive_and_audit


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(_table(spark, folder, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic, 2 toxic in a text of low quality."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    model = fit_severity(docs, labels.select(F.col("doc_id").cast("long"), grade.alias("grade")))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(F.col("text"), model).alias("s"))
    return found.select("doc_id", "s.severity", "s.p_toxic", "s.toxic")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(_table(spark, folder, "documents"), shingle_words=3, radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(_table(spark, folder, "documents"), length=50, with_kept=False)
    return found.drop("spans", "kept")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs, into="spans")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = fit_language_model(docs, train=~held_out(F.col("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = identify(rows, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    spec = Path(tokenizer or public_tokenizers.path("word_bpe_49k.json")).read_text()
    return pack_documents(_table(spark, folder, "documents"), spec, end_id=2, with_ids=False).drop("ids")


def op8_byte_bpe(spark: SparkSession, folder: str, ranks: str | None = None) -> DataFrame:
    import public_tokenizers

    data = Path(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    docs = _table(spark, folder, "documents")
    return encode_documents(docs, data, public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"), threshold=0.98)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_and_audit(_table(spark, folder, "pages"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), is_anchor=F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation c begins with the first crc32(c) % 6 turns of conversation c - c % 100."""
    turns, members = borrow_heads(
        turns_of(_table(spark, folder, "conversations")),
        base=lambda c: c - c % 100,
        head=lambda c: F.crc32(c.cast("string").cast("binary")) % 6,
        most=5,
    )
    return prefix_trie(turns, members).drop("prefix")


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeated_passages(_table(spark, folder, "documents"), window=35, with_kept=False)
    return found.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

def _spans_sql(kind: str, place: int, pattern: str, test: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{kind}' AS kind, {place} AS place, gap_chars + match_chars AS s,
           gap_chars + match_chars + length(m) AS e, m
    FROM (SELECT doc_id, unnest(ms) AS m,
                 unnest([list_sum([length(x) for x in gaps[1:i]]) for i in range(1, len(ms) + 1)])::BIGINT AS gap_chars,
                 unnest([coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) for i in range(1, len(ms) + 1)])::BIGINT
                     AS match_chars
          FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms,
                       string_split_regex(t, '{quoted}') AS gaps FROM d))
    WHERE {test}"""


_KEYWORDS = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
_ASSIGN = _KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ASSIGN_TEST = "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8"
_HIGH = "list_filter(range(1, length(m) - 18), lambda i: list_aggregate(string_split(m[i:i + 19], ''), 'entropy') >= bits)"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans_sql("assign", 0, _ASSIGN, _ASSIGN_TEST)}
    UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]{12,}")}
    UNION ALL {_spans_sql("hex", 2, "[0-9a-f]{32,}")}),
candidate AS (
    SELECT *, CASE WHEN regexp_matches(m, '^[0-9A-Fa-f]+$') AND regexp_matches(m, '[0-9]')
                        AND regexp_matches(m, '[A-Fa-f]') THEN 3.0001
                   WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]')
                        AND regexp_matches(m, '[a-z]') THEN 3.8001 END::DOUBLE AS bits
    FROM ({_spans_sql("entropy", 3, "[A-Za-z0-9+/=_-]{20,}")})
    WHERE NOT regexp_matches(lower(m), 'example|sample|dummy|placeholder|redacted|changeme')
      AND NOT regexp_matches(m, '^sha(256|384|512)-')
      AND NOT regexp_matches(lower(m), '0123456789|abcdefghij|zyxwvutsrq')),
free AS (
    SELECT * FROM candidate c WHERE bits IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND b.e > c.s)),
found AS (
    SELECT doc_id, kind, place, s, e FROM base
    UNION ALL
    SELECT doc_id, kind, place, s + list_min(high) - 1, s + list_max(high) + 19
    FROM (SELECT *, {_HIGH} AS high FROM free) WHERE len(high) > 0),
listed AS (
    SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access,
           count(*) FILTER (WHERE place = 2) AS n_hex,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE place < 3) AS base,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
    FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""

OP9_SQL = """
WITH RECURSIVE link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
found AS (SELECT vec_id, least(vec_id, coalesce(min(b), vec_id)) AS component_id
          FROM embeddings LEFT JOIN reach ON a = vec_id GROUP BY vec_id),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM found LEFT JOIN counted ON a = vec_id
"""

_NODES = """SELECT archive, node // 16 AS node, min(first) AS first, max(last) AS last,
    sha256(string_agg(first || ':' || last || ':' || hash, ',' ORDER BY node)) AS hash
FROM {} GROUP BY archive, node // 16"""

OP10_SQL = f"""
WITH n AS (SELECT greatest(1, (count(*) + 999) // 1000) AS n FROM pages),
made AS (
    SELECT page_id, ('0x' || substr(md5(page_id || ' ' || u), 1, 7))::BIGINT % n AS archive,
           concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: resource', 'WARC-Record-ID: <urn:page:' || page_id || '>',
               'WARC-Target-URI: ' || u, 'WARC-Date: 2000-01-01T00:00:00Z', 'Content-Type: text/html; charset=utf-8',
               'Content-Length: ' || octet_length(encode(h)), '', h, '', '') AS r
    FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '[' || chr(13) || chr(10) || ']', '', 'g') AS u,
                 coalesce(html, '') AS h FROM pages), n),
leaf AS (
    SELECT page_id, archive, row_number() OVER w - 1 AS record_no,
           coalesce(sum(octet_length(encode(r))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
               AS record_offset,
           octet_length(encode(r)) AS record_length, sha256(r) AS record_sha256
    FROM made WINDOW w AS (PARTITION BY archive ORDER BY page_id)),
l0 AS (SELECT archive, record_no AS node, record_offset AS first, record_offset + record_length AS last,
              record_sha256 AS hash FROM leaf),
l1 AS ({_NODES.format("l0")}), l2 AS ({_NODES.format("l1")}), l3 AS ({_NODES.format("l2")})
SELECT leaf.*, l3.hash AS archive_root, true AS intact
FROM leaf JOIN l3 ON l3.archive = leaf.archive AND l3.node = 0
"""

OP11_SQL = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) for x in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (
    SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.id % 50 = 0 AND len(a.v) = len(b.v) AND NOT (a.id = b.id AND a.label = b.label)),
positive AS (
    SELECT a, b, score FROM pair WHERE same
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w::INTEGER AS rank, n.b AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)
QUALIFY rank <= 3
"""

# The CRC takes each character, then eight shifts (-1).
OP12_SQL = """
WITH RECURSIVE turn AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
    SELECT c, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([
               [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(c::VARCHAR, '')])),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h
    FROM (SELECT c, max(pos) AS n FROM turn GROUP BY c)),
lent AS (SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS m FROM conv a LEFT JOIN conv b ON b.c = a.c - a.c % 100),
seq AS (
    SELECT l.c, t.pos - l.h + l.m AS d, role, text FROM lent l JOIN turn t ON t.c = l.c AND t.pos > l.h
    UNION ALL SELECT l.c, t.pos, role, text FROM lent l JOIN turn t ON t.c = l.c - l.c % 100 AND t.pos <= l.m),
step AS (
    SELECT c, 0::BIGINT AS d, '' AS q, NULL::VARCHAR AS above, 0::BIGINT AS chars FROM conv
    UNION ALL
    SELECT s.c, s.d, md5(p.q || ' ' || octet_length(encode(s.role)) || ':' || s.role || s.text), p.q, length(s.text)
    FROM step p JOIN seq s ON s.c = p.c AND s.d = p.d + 1),
flagged AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM step),
node AS (
    SELECT q, min(c) AS conv_id, min(d) AS depth, min(above) AS above, count(*) AS n_convs, min(chars) AS chars,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM flagged GROUP BY q),
kids AS (SELECT above AS q, count(*) AS n_children FROM node WHERE above IS NOT NULL GROUP BY above),
up AS (
    SELECT q AS top, q, above FROM node
    UNION ALL SELECT n.q, up.q, n.above FROM up JOIN node n ON n.q = up.above),
below AS (
    SELECT up.top AS q, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
    FROM up JOIN node USING (q) LEFT JOIN kids USING (q) GROUP BY up.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM node n JOIN below USING (q) LEFT JOIN kids USING (q) LEFT JOIN node p ON p.q = n.above
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
passage AS (
    SELECT doc_id, unnest([md5(array_to_string(w[i:i + 34], ' ')) for i in range(1, len(w) - 33)]) AS p,
           unnest(range(1, len(w) - 33)) AS i
    FROM d WHERE len(w) >= 35),
twice AS (SELECT doc_id, i FROM passage WHERE p IN (SELECT p FROM passage GROUP BY p HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM twice),
judged AS (SELECT doc_id, j, word, g.j IS NOT NULL AS cut FROM word LEFT JOIN gone g USING (doc_id, j)),
run AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM judged),
told AS (
    SELECT doc_id, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
           string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT cut) AS kept
    FROM run GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN told USING (doc_id)
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secrets": op5_secrets,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op5_secrets": OP5_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_substring_dedup": OP13_SQL,
}
