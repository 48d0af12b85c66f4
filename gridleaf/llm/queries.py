"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridleaf.llm.pretoken import default_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.language_id import held_out, identify, learn

    documents = table(spark, sf_dir, "documents")
    found = identify(documents, learn(documents, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.quality_crf import fit, held_out, score

    documents = table(spark, sf_dir, "documents")
    found = score(documents, fit(documents, table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: When page 0 was captured, how far captures lie apart, and when each page is asked for again.
CAPTURE_0, CAPTURE_STEP, AGAIN_AFTER = 1_704_067_200, 60, 30 * 86_400


def page_archive(row: tuple) -> bytes:
    """A WARC file of a page (html, page_id, url): a full capture, and a later not-modified revisit.

    Every 11th capture is a failure (503), every 7th has no ETag, every 14th no date either.
    """
    import datetime
    import hashlib
    from email.utils import formatdate

    from gridleaf.llm.warc import NOT_MODIFIED, Http, Record

    html, page_id, url = row
    page, body = page_id or 0, (html or "").encode()
    at = CAPTURE_0 + CAPTURE_STEP * page
    tags = [("ETag", f'"{hashlib.md5(body).hexdigest()}"')] if page % 7 else []
    tags += [("Last-Modified", formatdate(at, usegmt=True))] if page % 14 else []

    def record(kind: str, when: int, http: Http, reason: str, *fields: tuple[str, str]) -> bytes:
        date = datetime.datetime.fromtimestamp(when, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        named = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}:{page}>"), ("WARC-Date", date), *([("WARC-Target-URI", url)] if url else []), *fields, ("Content-Type", "application/http; msgtype=response")]
        return Record(named, http.to_bytes(reason)).to_bytes()

    full = Http(200 if page % 11 else 503, [("Content-Type", "text/html; charset=utf-8"), *tags, ("Cache-Control", "max-age=60"), ("Content-Length", str(len(body)))], body)
    again = Http(304, [*tags, ("Cache-Control", "max-age=600"), ("Content-Length", "0"), ("Vary", "Accept")])
    return record("response", at, full, "OK" if page % 11 else "Unavailable") + record("revisit", at + AGAIN_AFTER, again, "Not Modified", ("WARC-Profile", NOT_MODIFIED))


def _op4_sql() -> str:
    """Features, tuning, testing and verdicts of operator 4 with its default parameters."""
    from gridleaf.llm import quality_rules as r

    blanks = r"[ \t\n\x0b\f\r]"
    measures = " UNION ALL ".join(f"SELECT doc_id, band, tune, quality, '{rule.name}' AS rule, {rule.measure.replace('/', '::DOUBLE /')} AS m FROM rated" for rule in r.RULES)
    every = " UNION ALL ".join(f"SELECT doc_id, '{rule.name}' AS rule, {rule.measure.replace('/', '::DOUBLE /')} AS m FROM b WHERE NOT base_failed" for rule in r.RULES)
    grid = ", ".join(f"('{rule.name}', {i}, {c}::DOUBLE)" for rule in r.RULES for i, c in enumerate(rule.cutoffs))
    ladder = ", ".join(f"({i}, {share}::DOUBLE, {looser})" for i, (share, looser) in enumerate(r.LADDER))
    band = " + ".join(f"CASE WHEN n_words > {b} THEN 1 ELSE 0 END" for b in r.BANDS)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{blanks}+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS l FROM t),
x AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
y AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM x) WHERE n > 1),
z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM y) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(z.n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::BIGINT AS n_letters,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_same_word,
  coalesce(list_max(list_transform(w, lambda x: octet_length(encode(x)))), 0)::BIGINT AS longest_word FROM w LEFT JOIN z USING (doc_id)),
b AS (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words AS base_failed, {band} AS band FROM f),
k AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
rated AS (SELECT b.*, quality, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {r.TUNE_PART} = 0 AS tune FROM b JOIN k USING (doc_id) WHERE NOT base_failed),
m AS ({measures}),
g AS (SELECT * FROM (VALUES {grid}) v(rule, i, cutoff)), s AS (SELECT * FROM (VALUES {ladder}) v(level, share, looser)),
n AS (SELECT band, count(*) AS n FROM rated WHERE tune AND quality = 1 GROUP BY band),
c AS (SELECT m.band, g.rule, g.i, g.cutoff, count(*) FILTER (m.m > g.cutoff) AS hit FROM m JOIN g ON g.rule = m.rule WHERE m.tune AND m.quality = 1 GROUP BY ALL),
set AS (SELECT level, band, rule, cutoff FROM (SELECT s.level, s.looser, c.band, c.rule, c.cutoff, row_number() OVER p AS k, count(*) OVER (PARTITION BY s.level, c.band, c.rule) AS m
  FROM c JOIN n ON n.band = c.band JOIN s ON c.hit <= s.share * n.n WINDOW p AS (PARTITION BY s.level, c.band, c.rule ORDER BY c.i)) WHERE k = least(looser + 1, m)),
bad AS (SELECT DISTINCT set.level, m.doc_id FROM m JOIN set ON set.band = m.band AND set.rule = m.rule AND m.m > set.cutoff WHERE NOT m.tune),
u AS (SELECT s.level, q.band, count(*) FILTER (quality = 1) AS clean, count(*) FILTER (quality <> 1) AS other,
  count(*) FILTER (quality = 1 AND bad.doc_id IS NOT NULL) AS k, count(*) FILTER (quality <> 1 AND bad.doc_id IS NOT NULL) AS j
  FROM s CROSS JOIN (SELECT * FROM rated WHERE NOT tune) q LEFT JOIN bad ON bad.level = s.level AND bad.doc_id = q.doc_id GROUP BY ALL),
e AS (SELECT *, clean > k AND (SELECT sum(exp(lgamma(clean + 1.0) - lgamma(i + 1.0) - lgamma(clean - i + 1.0) + i * ln(0.05) + (clean - i) * ln(0.95))) FROM (SELECT unnest(range(0, k + 1)) AS i)) <= 0.05 / {len(r.BANDS) + 1} AS ok FROM u),
o AS (SELECT *, bool_and(ok) OVER (PARTITION BY band ORDER BY level) AS passed, j::DOUBLE / greatest(other, 1) - k::DOUBLE / greatest(clean, 1) AS gain FROM e),
best AS (SELECT band, level FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY gain DESC, level) AS r FROM o WHERE passed) WHERE r = 1),
rej AS (SELECT DISTINCT a.doc_id FROM ({every}) a JOIN b USING (doc_id) JOIN best ON best.band = b.band JOIN set ON set.band = b.band AND set.level = best.level AND set.rule = a.rule AND a.m > set.cutoff)
SELECT b.* EXCLUDE (band), NOT base_failed AND rej.doc_id IS NULL AS kept FROM b LEFT JOIN rej USING (doc_id)
"""


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.shared import written
    from gridleaf.llm.warc import map_records, resolve

    pages = table(spark, sf_dir, "pages").select("html", "page_id", "url")
    found = resolve(written(map_records(pages, page_archive), "records"))
    page = [F.regexp_extract(c, "([0-9]+)>$", 1).cast("long") for c in ("record_id", "refers_to")]
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\n"))), "")
    return found.select(page[0].alias("page_id"), "canonical", "verdict", page[1].alias("refers_to"), "body_bytes", "body_sha256", headers.alias("headers"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages
), q AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^(www[0-9]*|m)\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|sid|phpsessid|jsessionid)(=.*)?$'))), '&') AS query
  FROM p
), c AS (
  SELECT page_id, html, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical,
    CASE WHEN page_id % 7 <> 0 THEN '"' || md5(html) || '"' END AS etag,
    CASE WHEN page_id % 14 <> 0 THEN strftime(make_timestamp((1704067200 + 60 * page_id) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') END AS modified
  FROM q
), m AS (
  SELECT a.page_id, max(b.page_id) AS refers FROM c a JOIN c b ON a.canonical = b.canonical AND b.page_id % 11 <> 0 AND b.page_id < a.page_id + 43200 GROUP BY a.page_id
), v AS (
  SELECT a.page_id, a.canonical, m.refers, b.html, a.etag, a.modified, b.etag AS b_etag, b.modified AS b_modified,
    CASE WHEN m.refers IS NULL THEN 'missing'
         WHEN a.etag IS NOT NULL AND b.etag IS NOT NULL THEN CASE WHEN a.etag = b.etag THEN 'resolved' ELSE 'mismatch' END
         WHEN a.modified IS NOT NULL AND b.modified IS NOT NULL THEN CASE WHEN a.modified = b.modified THEN 'resolved' ELSE 'mismatch' END
         ELSE 'unverified' END AS verdict
  FROM c a LEFT JOIN m USING (page_id) LEFT JOIN c b ON b.page_id = m.refers
)
SELECT page_id, canonical, verdict, refers AS refers_to,
  CASE WHEN ok THEN octet_length(encode(html))::BIGINT END AS body_bytes,
  CASE WHEN ok THEN sha256(html) END AS body_sha256,
  CASE WHEN ok THEN 'content-type: text/html; charset=utf-8' || chr(10)
    || CASE WHEN b_etag IS NOT NULL THEN 'etag: ' || coalesce(etag, b_etag) || chr(10) ELSE '' END
    || CASE WHEN b_modified IS NOT NULL THEN 'last-modified: ' || coalesce(modified, b_modified) || chr(10) ELSE '' END
    || 'cache-control: max-age=600' || chr(10) || 'content-length: ' || octet_length(encode(html)) || chr(10)
    || CASE WHEN b_etag IS NULL AND etag IS NOT NULL THEN 'etag: ' || etag || chr(10) ELSE '' END
    || CASE WHEN b_modified IS NULL AND modified IS NOT NULL THEN 'last-modified: ' || modified || chr(10) ELSE '' END
    || 'vary: Accept' || chr(10) END AS headers
FROM (SELECT *, verdict IN ('resolved', 'unverified') AS ok FROM v)
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.chat import read_back, render_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(render_turns(rows.unionByName(added)))


#: A field is escaped if it holds a control string, a backslash that would escape what follows, or one at its end.
OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS o,
    CASE WHEN regexp_matches(role, '</?s>|\[/?INST\]|\\[\\<\[]|\\$') THEN length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\])', '-\1', 'g')) ELSE length(role) END AS r,
    CASE WHEN regexp_matches(text, '</?s>|\[/?INST\]|\\[\\<\[]|\\$') THEN length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\])', '-\1', 'g')) ELSE length(text) END AS x
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY o)) AS loss_sha256,
  sum(r + x + length('<s>[INST][/INST]</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.tree_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), default_path("byte_bpe_multi_50k.tiktoken"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm import token_file
    from gridleaf.llm.shared import scratch

    folder = scratch(spark, "op8")
    token_file.write(table(spark, sf_dir, "documents"), folder, default_path("byte_bpe_50k.json"))
    return token_file.read(spark, folder, digest_only=True)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.decontaminate import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(list_transform(regexp_split_to_array(lower(replace(text, chr(160), ' ')), '[ \t\n\x0b\f\r]+'),
    lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT id, count(*) AS size FROM s WHERE kind = 'i' GROUP BY id),
h AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM s d JOIN s i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, shared::BIGINT AS shared, size::BIGINT AS size, shared / size::DOUBLE AS containment FROM h JOIN n ON n.id = item_id WHERE shared >= 0.8 * size
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.simhash import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))


def op13_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridleaf.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_quality_crf, op4_quality_rules, op5_warc_revisits, op6_chat_format, op7_byte_bpe, op8_token_ids, op9_decontaminate, op10_simhash, op11_importance, op12_align_tokens, op13_jump_shards)}

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": _op4_sql(), "op5_warc_revisits": OP5_SQL, "op6_chat_format": OP6_SQL, "op9_decontaminate": OP9_SQL}
