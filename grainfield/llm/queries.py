"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, line_dedup, lm_score, metric_join, mixing, near_dup, secrets, toxicity
from .common import cut, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    got = chat_format.conversations(rows).withColumn("back", chat_format.read_back(F.col("formatted")))
    learned = F.concat_ws("", F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]))
    return got.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[SYS]', ''))) // 5 + (length(text) - length(replace(text, '[/SYS]', ''))) // 6
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '[OUT]', ''))) // 5 + (length(text) - length(replace(text, '[ROLE]', ''))) // 6
    + (length(text) - length(replace(text, '[/ROLE]', ''))) // 7 + (length(text) - length(replace(text, '[/END]', ''))) // 6
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) END AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((before IS NULL AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'))
  AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
FROM sized GROUP BY conv_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.kept_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.first AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_topic(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).drop("text")
    return mixing.mixed(cut(docs), ["source", "lang", "topic"], "tokens", mixing.targets(spark), rate=mixing.RATE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Documents stand for repositories and sources for their owners.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("repository"), F.col("source").alias("owner"))
    got = secrets.secrets(docs)
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    many = lambda part, name: F.size(F.filter("spans", lambda x: x[part] == name)).cast("long").alias(f"n_{name}")
    return got.select(
        "doc_id",
        *[many("kind", k) for k, *_ in secrets.BASE],
        F.sha2(said(F.filter("spans", lambda x: x["kind"] != "reuse")), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        many("verdict", "live"),
        many("verdict", "example"),
    )


def _found_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their spans, in SQL: what lies before a match are the gaps and matches before it."""
    return f"""SELECT doc_id, source, '{kind}' AS kind, i, v AS value, coalesce(CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) AS BIGINT), 0) + coalesce(CAST(list_sum(list_transform(found[:i - 1], lambda x: length(x))) AS BIGINT), 0) AS start, length(w) AS n
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS w, unnest(vals) AS v FROM (SELECT doc_id, source, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS vals
    FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{pattern}'))) WHERE length(v) >= {least}"""


_KINDS_SQL = " UNION ALL ".join(_found_sql(k, p.replace("'", "''"), g, n) for k, p, g, n in secrets.BASE)
_BARE_SQL = _found_sql("reuse", "[A-Za-z0-9+/_.=-]{12,}", 0, 12)
OP5_SQL = rf"""
WITH base AS (SELECT *, start + n AS stop, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS place FROM ({_KINDS_SQL})),
judged AS (SELECT value, CASE WHEN count(DISTINCT coalesce(source, '')) > 2 OR count(DISTINCT doc_id) > 4 THEN 'example'
  WHEN len(list_distinct(string_split(value, ''))) >= 8 THEN 'live' ELSE 'weak' END AS verdict FROM base GROUP BY value),
runs AS (SELECT doc_id, start, regexp_replace(value, '\.+$', '') AS kept FROM ({_BARE_SQL})),
tails AS (SELECT DISTINCT doc_id, start + skip AS start, start + length(kept) AS stop, substr(kept, skip + 1) AS value FROM (
  SELECT *, unnest([0, length(kept) - length(string_split(kept, '=')[-1]), length(kept) - length(string_split(kept, '/')[-1])]) AS skip FROM runs)),
reuse AS (SELECT t.* FROM tails t JOIN judged j ON j.value = t.value AND j.verdict = 'live' WHERE length(t.value) >= 12 AND regexp_matches(t.value, '[0-9]') AND regexp_matches(t.value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.stop AND t.start < b.stop)),
widest AS (SELECT * FROM reuse t WHERE NOT EXISTS (SELECT 1 FROM reuse o WHERE o.doc_id = t.doc_id AND o.start < t.start AND o.stop >= t.stop)),
spans AS (SELECT doc_id, kind, start, stop, place, verdict FROM base JOIN judged USING (value) UNION ALL SELECT doc_id, 'reuse', start, stop, 3, 'live' FROM widest),
said AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM spans),
out AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY start, place) FILTER (kind <> 'reuse') AS base,
  string_agg(said, ',' ORDER BY start, place) AS spans, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM said GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN out o USING (doc_id)
"""


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.stupid_backoff(table(spark, sf_dir, "documents"), order=3, leave_out=True)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, words=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 2], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)
"""


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id
"""

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_lm_score": op6_lm_score,
    "op7_html_extract": op7_html_extract,
    "op8_near_dup": op8_near_dup,
    "op9_decontaminate": op9_decontaminate,
    "op10_metric_join": op10_metric_join,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_secret_scan": OP5_SQL,
    "op8_near_dup": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_metric_join": OP10_SQL,
}
