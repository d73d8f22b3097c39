"""The operators as queries over whole tables; SQL beside those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelwright.llm import bpe, divergence, exact, katz, minhash, mixing, neighbours, quality, repair, secrets, suffixes, toxicity, warc
from labelwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored, _ = katz.score(docs, ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    whole = bpe.decode(ids, path, id_bytes="id_bytes")
    return whole.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("id_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.without_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "anomaly")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of responses come from their decoded payloads, those of revisits from headers."""
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    held = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(held, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(held, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLES["op8_warc"] = """WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
  f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
  SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
    CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
  FROM p LEFT JOIN f USING (d)"""


@query
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.rank < 3)
    count = lambda rank: F.size(F.filter("spans", lambda s: s.rank == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(turns, repair.damaged(turns))


def _sql_crc32(text: str) -> str:
    """CRC-32 of ASCII text: each byte is folded in, then seven more shifts by one bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    shift = "(xor(crc, b) >> 1)"
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], {bits}),
      lambda crc, b: CASE WHEN xor(crc, b) & 1 = 1 THEN xor({shift}, 3988292384) ELSE {shift} END), 4294967295)"""


def _sql_least(*ways: str) -> str:
    """Of ways written as nine digits of cost and then the edits."""
    return f"least({', '.join(ways)})"


def _sql_more(way: str, cost: str, edit: str) -> str:
    return f"printf('%09d', left({way}, 9)::INT + {cost}) || substring({way}, 10) || '{edit}'"


_WAY = "900000000"
ORACLES["op11_repair"] = f"""WITH RECURSIVE k AS (SELECT *, {_sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
    FROM conversations),
  r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
      CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
      unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
  n AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, role, text, left(role, 1) AS ini,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM r),
  f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
      lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS two, count(*) OVER (PARTITION BY conv_id) AS m FROM n),
  w AS (SELECT c, 0::BIGINT AS i, '000000000' AS e, '{_WAY}' AS s, '{_WAY}' AS u, '{_WAY}' AS a FROM f GROUP BY c
    UNION ALL SELECT c, i,
      {_sql_more('e', '3', 'D')},
      least({_sql_more('s', '3', 'D')}, CASE WHEN stays AND ini = 's' THEN {_sql_more('e', 'cut', 'K')} ELSE '{_WAY}' END),
      least({_sql_more('u2', '3', 'D')}, CASE WHEN stays THEN least({', '.join(_sql_more(x, 'cut + 2', 'R') for x in ('e', 's', 'a2'))}) ELSE '{_WAY}' END,
        CASE WHEN stays AND ini = 'u' THEN least({', '.join(_sql_more(x, 'cut', 'K') for x in ('e', 's', 'a2'))}) ELSE '{_WAY}' END),
      least({_sql_more('a2', '3', 'D')}, CASE WHEN stays THEN {_sql_more('u2', 'cut + 2', 'R')} ELSE '{_WAY}' END,
        CASE WHEN stays AND ini = 'a' THEN {_sql_more('u2', 'cut', 'K')} ELSE '{_WAY}' END)
    FROM (SELECT *, least(a, {_sql_more('u2', '2', 'I')}) AS a2 FROM (SELECT f.c, f.i, f.ini, w.e, w.s, w.u, w.a,
        fault NOT IN (1, 2) AS stays, (fault = 3)::INT AS cut,
        {_sql_least('w.u', *(_sql_more(x, '2', 'I') for x in ('w.e', 'w.s', 'w.a')))} AS u2
      FROM w JOIN f ON f.c = w.c AND f.i = w.i + 1))),
  z AS (SELECT DISTINCT f.c, f.conv_id, f.m, least(w.e, w.a, {_sql_more('w.u', '2', 'I')}, {_sql_more('w.s', '4', 'II')},
      {_sql_more('w.e', '4', 'II')}) AS way FROM w JOIN f ON f.c = w.c AND w.i = f.m),
  x AS (SELECT c, way[9 + j] AS edit, j, sum((way[9 + j] <> 'I')::INT) OVER (PARTITION BY c ORDER BY j) AS i,
      sum((way[9 + j] <> 'D')::INT) OVER (PARTITION BY c ORDER BY j) AS k
    FROM (SELECT c, way, unnest(range(1, length(way) - 8)) AS j FROM z)),
  y AS (SELECT x.*, f.role, f.text, max((x.edit = 'K' AND f.ini = 's')::INT) OVER (PARTITION BY x.c) AS has_s
    FROM x LEFT JOIN f ON f.c = x.c AND f.i = x.i WHERE x.edit <> 'D'),
  lines AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END
      || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM y GROUP BY c),
  g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 1)::INT) AS blank,
      sum((fault = 2)::INT) AS duplicate, sum((fault = 3)::INT) AS truncated,
      coalesce(sum((two NOT IN ('su', 'ua', 'au'))::INT), 0) AS illegal FROM f GROUP BY c),
  o AS (SELECT z.conv_id, g.*, left(way, 9)::INT AS cost, substring(way, 10) AS audit, coalesce(t, '') AS t
    FROM z JOIN g USING (c) LEFT JOIN lines USING (c)),
  every AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT every.conv_id, {', '.join(f'coalesce({x}, 0)::BIGINT AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))},
    coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
  FROM every LEFT JOIN o ON every.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query
def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLES["op12_exact"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
  g AS (SELECT *, count(*) OVER (PARTITION BY s) AS group_size,
    first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM g"""


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLES["op13_divergence"] = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(text, '') AS text FROM documents),
  t AS (SELECT i, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
  grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
    FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
  s AS (SELECT lang, source, sum(n) AS total, count(*) AS v, sum(lang_n) AS lang_total FROM grid GROUP BY lang, source),
  p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS p,
      (1 + 1000000000::HUGEINT * (lang_n + 1) // (lang_total + v))::BIGINT AS q
    FROM grid JOIN s USING (lang, source)),
  pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
  ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
  SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_places(name: str, pattern: str) -> str:
    """Matches of a pattern with their places, from what lies between them."""
    return f"""{name} AS (SELECT doc_id, f[i] AS s,
      coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a
    FROM (SELECT doc_id, regexp_extract_all(t, {_sql(pattern)}) AS f, string_split_regex(t, {_sql(pattern)}) AS b,
        unnest(range(1, len(regexp_extract_all(t, {_sql(pattern)})) + 1)) AS i FROM d))"""


_ALLOWED = "|".join(f"(?:{pattern})" for pattern in secrets.ALLOWED)
ORACLES["op10_secrets"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  {_sql_places('assigned', secrets.ASSIGN)},
  {_sql_places('accessed', secrets.ACCESS)},
  {_sql_places('hexed', secrets.HEX[:-1] + '{32,}')},
  {_sql_places('runs', secrets.CANDIDATE[:-1] + '{20,}')},
  base AS (SELECT doc_id, a, 0 AS k, a + length(s) AS e FROM assigned
      WHERE length(regexp_extract(s, {_sql(secrets.ASSIGN)}, 2)) >= 8
    UNION ALL SELECT doc_id, a, 1, a + length(s) FROM accessed WHERE length(s) >= 16
    UNION ALL SELECT doc_id, a, 2, a + length(s) FROM hexed WHERE length(s) >= 32),
  cut AS (SELECT doc_id, a, string_split_regex(s, {_sql(_ALLOWED)}) AS b, regexp_extract_all(s, {_sql(_ALLOWED)}) AS f
    FROM runs WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, {_sql(secrets.NOT_WORDS)})),
  pieces AS (SELECT doc_id, b[i] AS s, a + coalesce(list_sum(list_transform(b[1:i - 1], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a
    FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM cut)),
  windows AS (SELECT doc_id, a + i AS a, substring(s, i + 1, {secrets.WINDOW}) AS w
    FROM (SELECT *, unnest(range(0, length(s) - {secrets.WINDOW - 1})) AS i FROM pieces WHERE length(s) >= {secrets.WINDOW})),
  hits AS (SELECT doc_id, a FROM windows WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')
    AND log2({secrets.WINDOW}) - list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda n: n * log2(n)))
      / {secrets.WINDOW} >= CASE WHEN regexp_matches(w, '^[0-9A-Fa-f]+$') THEN {secrets.CLASSES['hex']}
        WHEN regexp_matches(w, '^[0-9A-Za-z]+$') THEN {secrets.CLASSES['alnum']} ELSE {secrets.CLASSES['token']} END - 1e-9),
  marked AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id ORDER BY a) <= {secrets.WINDOW}
      THEN 0 ELSE 1 END AS fresh FROM hits),
  islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM marked),
  added AS (SELECT doc_id, min(a) AS a, 3 AS k, max(a) + {secrets.WINDOW} AS e FROM islands GROUP BY doc_id, island),
  every AS (SELECT * FROM base UNION ALL SELECT * FROM added x WHERE NOT EXISTS (
      SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.a < x.e AND x.a < b.e)),
  written AS (SELECT doc_id, a, k, ['assign', 'access', 'hex', 'entropy'][k + 1]||':'||a||':'||e AS one FROM every),
  joined AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
      count(*) FILTER (WHERE k = 2) AS n_hex, coalesce(string_agg(one, ',' ORDER BY a, k) FILTER (WHERE k < 3), '') AS base,
      string_agg(one, ',' ORDER BY a, k) AS spans FROM written GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
    coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM d LEFT JOIN joined USING (doc_id)"""
