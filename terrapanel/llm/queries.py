"""Registered queries: each operator with production parameters over its whole table.

The operators keep their own outputs (texts, spans, files); a query derives its
digest columns from them.  ``ORACLES`` holds DuckDB SQL where SQL can express
the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import (
    conversation_repair, embed_neardup, hard_negatives, license_scan, line_runs, minhash_bottomk, packing, pairwise_quality, pivot_search,
    pivotal_mix, preference_chat, secret_layers, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


# all pairs by exact cosine; the hashing finds every pair of these tables, whose links lie far above the threshold
ORACLES["op1_embedding_neardup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
deg AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.node = e.vec_id LEFT JOIN deg d ON d.u = e.vec_id
"""


@_query
def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op3_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_chat.preference_pairs(_table(spark, sf_dir, "conversations"))
    done = preference_chat.format_preferences(pairs)
    out = [F.col("row.conv_id"), F.col("row.chosen_id"), F.col("row.rejected_id"), F.col("n_prompt_turns"), F.col("prompt")]
    for side in ("chosen", "rejected"):
        segments = F.col(f"{side}_completion")
        out += [F.array_join(segments["text"], "").alias(f"{side}_text"),
                F.array_join(F.filter(segments, lambda x: x["loss"])["text"], "").alias(f"{side}_loss_text")]
    return done.select(*out)


_RENDER = "array_to_string(list_transform({0}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"
_LOSS = "array_to_string(list_transform(list_filter({0}, lambda t: coalesce(t.role = 'assistant', false)), lambda t: coalesce(t.text, '') || '<|end|>' || chr(10)), '')"
ORACLES["op3_preference_chat"] = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
v AS (SELECT *, turns[1] AS opening, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS said FROM c),
f AS (SELECT opening, min(conv_id) AS chosen_id FROM v GROUP BY opening HAVING count(*) > 1),
p AS (
  SELECT v.conv_id, f.chosen_id, v.conv_id AS rejected_id, k.turns AS chosen, v.turns AS rejected
  FROM v JOIN f ON f.opening = v.opening AND f.chosen_id <> v.conv_id JOIN c k ON k.conv_id = f.chosen_id
  UNION ALL
  SELECT v.conv_id, v.conv_id, NULL, v.turns,
         CASE WHEN len(said) = 0 THEN turns[1:len(turns) - 1]
              ELSE list_concat(list_concat(turns[1:said[-1] - 1],
                   [{{'role': 'assistant', 'text': CASE WHEN len(said) > 1 THEN coalesce(turns[said[-2]].text, '') ELSE '' END}}]),
                   turns[said[-1] + 1:len(turns)]) END
  FROM v LEFT JOIN f ON f.opening = v.opening WHERE f.chosen_id IS NULL OR f.chosen_id = v.conv_id),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1,
                     least(len(chosen), len(rejected))) AS n FROM p),
r AS (SELECT *, chosen[n + 1:len(chosen)] AS c_rest, rejected[n + 1:len(rejected)] AS r_rest FROM n)
SELECT conv_id, chosen_id, rejected_id, n AS n_prompt_turns, {_RENDER.format('chosen[1:n]')} AS prompt,
       {_RENDER.format('c_rest')} AS chosen_text, {_LOSS.format('c_rest')} AS chosen_loss_text,
       {_RENDER.format('r_rest')} AS rejected_text, {_LOSS.format('r_rest')} AS rejected_loss_text
FROM r
"""


@_query
def op4_bottomk_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bottomk.near_duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op4_bottomk_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
i AS (SELECT doc_id, unnest(sh) AS g FROM s),
often AS (SELECT g FROM i GROUP BY g HAVING count(*) > 1),
j AS (SELECT i.doc_id, i.g FROM i JOIN often USING (g)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM j a JOIN j b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other),
comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN comp c ON c.node = n.doc_id
"""


@_query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"))
    records = warc.read_archives(spark, manifest, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> {0}) & 31) + 1, 1)"
ORACLES["op5_warc"] = f"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, n, min(page_id) AS first FROM p GROUP BY sha, n)
SELECT page_id, p.n AS payload_bytes,
       array_to_string(list_transform(list_transform(range(8), lambda i: ('0x' || substr(sha, (1 + 5 * i)::INT, 5))::BIGINT),
         lambda n: {' || '.join(_BASE32.format(b) for b in (15, 10, 5, 0))}), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM p JOIN g USING (sha, n)
"""


@_query
def op6_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


ORACLES["op6_pivot_search"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_runs.dedup_lines(_table(spark, sf_dir, "documents"))
    return lines.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.docs > 1 AND k.doc_id <> o.first, false) AS drop
  FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drop), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_known")


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


ORACLES["op8_license_scan"] = rf"""
WITH known(sentence, sid) AS (VALUES {_values([(license_scan.normal_text(s), i) for i, s in license_scan.SENTENCES])}),
rules(name, ids) AS (VALUES {_values([(name, ','.join(ids)) for name, ids in license_scan.RULES])}),
covers(more, less) AS (VALUES {_values(list(license_scan.COVERS))}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, 'lines' AS cut, regexp_split_to_array(text, '[\r\n]+') AS s FROM d
  UNION ALL
  SELECT doc_id, 'stops', string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'),
    '[ \t\r\n]+', ' ', 'g'), '([.!?;:]) ', '\1' || chr(1), 'g'), chr(1)) FROM d),
e AS (SELECT doc_id, cut, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM c),
k AS (
  SELECT e.doc_id, e.cut, e.pos, known.sid FROM e JOIN known ON known.sentence =
    trim(regexp_replace(translate(e.sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))),
q AS (SELECT doc_id, cut, ',' || string_agg(sid, ',' ORDER BY pos) || ',' AS ids, count(*) AS n FROM k GROUP BY doc_id, cut),
h AS (SELECT DISTINCT doc_id, name FROM q JOIN rules ON contains(q.ids, ',' || rules.ids || ',')),
x AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM covers JOIN h o ON o.name = covers.more WHERE o.doc_id = h.doc_id AND covers.less = h.name)),
l AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM x GROUP BY doc_id),
i AS (SELECT doc_id, string_agg(sid, ',' ORDER BY sid) AS sentence_ids FROM (SELECT DISTINCT doc_id, sid FROM k) GROUP BY doc_id),
m AS (SELECT doc_id, max(n) AS n_known FROM q GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n_known, 0) AS n_known
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@_query
def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query
def op10_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = pairwise_quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = pairwise_quality.score(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", pairwise_quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= pairwise_quality.CUT).cast("int").alias("predicted"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _table(spark, sf_dir, "conversations")
    done = conversation_repair.repair(conversation_repair.damage(whole))
    key = conversation_repair.conv_key(F.col("conv_id")).alias("c")
    out = whole.select("conv_id", key).distinct()
    out = out.join(done.report.select("*", key).drop("conv_id"), "c", "left")
    out = out.join(conversation_repair.digests(done).select(key, "repaired_sha256"), "c", "left")
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _plus(way: str, cost: str, edit: str) -> str:
    """A way, nine digits of cost before its audit, with one more edit; null stays null."""
    return f"(lpad((substr({way}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{edit}')"


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384 + 0 * y))), 4294967295)"""
_INSERTED = f"""least(u, {_plus('e', '5', 'I')}, {_plus('s', '5', 'I')}, {_plus('a', '5', 'I')})"""
ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text), copy) AS i FROM damaged),
f AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM o),
g AS (
  SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, blank OR again AS gone,
         CASE WHEN cut THEN 5 ELSE 0 END AS more, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
ways(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, {_plus("'000000000'", '5', 'I')}, {_plus("'000000000'", '10', 'II')} FROM g
  UNION ALL
  SELECT conv_id, i, e, s, u, least(a, {_plus('u', '5', 'I')}) FROM (
    SELECT conv_id, i, e, s, {_INSERTED} AS u, a FROM (
      SELECT g.conv_id, g.i, {_plus('w.e', '2', 'D')} AS e,
        least({_plus('w.s', '2', 'D')}, CASE WHEN NOT gone AND ini = 's' THEN {_plus('w.e', 'more', 'K')} END) AS s,
        least({_plus('w.u', '2', 'D')},
          CASE WHEN NOT gone AND ini = 'u' THEN least({', '.join(_plus(f'w.{x}', 'more', 'K') for x in 'esa')})
               WHEN NOT gone THEN least({', '.join(_plus(f'w.{x}', 'more + 1', 'R') for x in 'esa')}) END) AS u,
        least({_plus('w.a', '2', 'D')},
          CASE WHEN NOT gone AND ini = 'a' THEN {_plus('w.u', 'more', 'K')} WHEN NOT gone THEN {_plus('w.u', 'more + 1', 'R')} END) AS a
      FROM ways w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i + 1))),
ends AS (
  SELECT conv_id, substr(w, 1, 9)::BIGINT AS cost, substr(w, 10) AS audit
  FROM (SELECT conv_id, arg_max(least(e, a), i) AS w FROM ways GROUP BY conv_id)),
letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS k FROM ends WHERE audit <> ''),
placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS n
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
kept AS (
  SELECT p.conv_id, p.k, p.n, p.edit, g.role, CASE WHEN p.edit = 'I' THEN '' ELSE g.text END AS text,
         max((p.edit = 'K' AND g.ini = 's')::INT) OVER (PARTITION BY p.conv_id) AS off
  FROM placed p LEFT JOIN g ON p.edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i WHERE p.edit <> 'D'),
hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h
  FROM kept GROUP BY conv_id),
stats AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN hashes ON hashes.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@_query
def op13_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_layers.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in secret_layers.KINDS], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"), "unread")


@_query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, min(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         any_value(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other, q.label = c.label AS same, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE r <= 5 AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
