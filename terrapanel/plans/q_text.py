"""Registered queries: text outputs, grounding checks, PII and encoding rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from terrapanel.functions.bands import risk_band
from terrapanel.functions.labels import METRIC_LABEL, METRIC_TITLE, label_rows, lookup, metric_key_expr
from terrapanel.functions.text import (EMAIL_RE, IBAN_RE, PERSON_NAME_RE, REPLACEMENT_CHAR, email_count, has_email,
                                       json_sorted, looks_like_person)
from terrapanel.operators import text as X
from terrapanel.operators import trend as T
from terrapanel.operators.window import latest_rows
from terrapanel.plans import q_quality
from terrapanel.plans.catalog import Ctx, query
from terrapanel.plans.q_trend import LONG_SQL, MEASURES, _ci_sql


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def PYSTR(x: str) -> str:  # noqa: N802  (SQL text builder)
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = floor({x}) AND abs({x}) < 1e16 "
            f"THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END)")


def GROUND_SQL(src: str, key: str) -> str:  # noqa: N802
    """Grounding columns in SQL over ``src(key..., answer, context)``."""
    return f"""gn AS (SELECT {key}, [CAST(x AS DOUBLE) for x in regexp_extract_all(answer, '(-?\\d+\\.?\\d*)', 1)] AS a,
                   [CAST(x AS DOUBLE) for x in regexp_extract_all(context, '(-?\\d+\\.?\\d*)', 1)] AS c FROM {src}),
gu AS (SELECT {key}, [n for n in a if len([x for x in c if abs(n - x) <= 0.5]) = 0] AS miss FROM gn),
gr AS (SELECT {key}, len(miss) = 0 AS grounded, CAST(len(miss) AS INT) AS n_unmatched,
              array_to_string([{PYSTR('v')} for v in miss], ', ') AS unmatched,
              CASE WHEN len(miss) > 0 THEN CAST(len(miss) AS VARCHAR)
                   || ' numeric value(s) in this answer could not be verified against the source data ('
                   || array_to_string([{PYSTR('v')} for v in miss[1:5]], ', ') || '). Treat with caution.' END AS warning
       FROM gu)"""


def _ground_cols(answer, context):
    g = X.grounding(answer, context)
    return [g.grounded.alias("grounded"), F.size(g.unmatched).cast("int").alias("n_unmatched"),
            F.array_join(g.unmatched, ", ").alias("unmatched"), g.warning.alias("warning")]


def READINESS_SQL(score: str, lang: str = "en") -> str:  # noqa: N802
    if lang == "de":
        return (f"firm_name || ' hat eine CSRD-Bereitschaft von ' || printf('%.0f', {score}) || '% mit ' "
                f"|| CAST(gaps_count AS VARCHAR) || ' offenen Berichtslücken. ' || CASE WHEN ({score}) < 60 "
                f"THEN {_sq(X.ADVICE_LOW_DE)} ELSE {_sq(X.ADVICE_OK_DE)} END")
    return (f"firm_name || ' has a CSRD readiness score of ' || printf('%.0f', {score}) || '% with ' "
            f"|| CAST(gaps_count AS VARCHAR) || ' open reporting gap(s). ' || CASE WHEN ({score}) < 60 "
            f"THEN {_sq(X.ADVICE_LOW_EN)} ELSE {_sq(X.ADVICE_OK_EN)} END")


@query("readiness_sentences", ("T3", "F6"), f"""
SELECT firm_id, {READINESS_SQL('readiness_score')} AS sentence_en, {READINESS_SQL('readiness_score', 'de')} AS sentence_de
FROM firms
""")
def readiness_sentences(spark, d):
    f = Ctx(spark, d).firms
    return f.select("firm_id",
                    X.readiness_sentence(F.col("firm_name"), F.col("readiness_score"), F.col("gaps_count")).alias("sentence_en"),
                    X.readiness_sentence(F.col("firm_name"), F.col("readiness_score"), F.col("gaps_count"), "de")
                     .alias("sentence_de"))


@query("grounding_check", ("T1", "T2", "F2", "F7", "F11", "J10"), f"""
WITH s AS (
  SELECT firm_id, {READINESS_SQL('CASE WHEN firm_id % 7 = 0 THEN readiness_score + 1000 ELSE readiness_score END')} AS answer,
         '{{"firm_id": ' || CAST(firm_id AS VARCHAR) || ', "firm_name": ' || to_json(firm_name) || ', "gaps_count": '
         || CAST(gaps_count AS VARCHAR) || ', "readiness_score": ' || {PYSTR('readiness_score')} || '}}' AS context
  FROM firms),
{GROUND_SQL('s', 'firm_id')}
SELECT * FROM gr
""")
def grounding_check(spark, d):
    f = Ctx(spark, d).firms
    score = F.when(F.col("firm_id") % 7 == 0, F.col("readiness_score") + 1000).otherwise(F.col("readiness_score"))
    answer = X.readiness_sentence(F.col("firm_name"), score, F.col("gaps_count"))
    context = json_sorted({"firm_id": "firm_id", "firm_name": "firm_name", "gaps_count": "gaps_count",
                           "readiness_score": "readiness_score"}, ints={"firm_id", "gaps_count"},
                          floats={"readiness_score"})
    return f.select("firm_id", *_ground_cols(answer, context))


@query("anomaly_sentences", ("T4", "F6"), f"""
WITH {q_quality.RECON_SQL}
SELECT entity, period, "column",
  'A change of ' || printf('%.1f', round(rc, 3) * 100.0) || '% was detected in ' || "column" || {_sq(X.ANOMALY_EN.split('{col}')[1])} AS sentence_en,
  'Eine Veränderung von ' || printf('%.1f', round(rc, 3) * 100.0) || '% wurde bei ' || "column" || {_sq(X.ANOMALY_DE.split('{col}')[1])} AS sentence_de
FROM flagged
""")
def anomaly_sentences(spark, d):
    from terrapanel.operators import reconcile as R
    a = R.anomalies(q_quality._compared(Ctx(spark, d, shared=("panel",))), q_quality.PANEL)
    return a.select("entity", "period", "column",
                    X.anomaly_sentence(F.col("relative_change"), F.col("column")).alias("sentence_en"),
                    X.anomaly_sentence(F.col("relative_change"), F.col("column"), "de").alias("sentence_de"))


LABELS_SQL = "labels(key, lang, text) AS (VALUES " + ", ".join(
    f"({_sq(k)}, {_sq(lg)}, {_sq(t)})" for k, lg, t in label_rows()) + ")"
METRIC_LABEL_SQL = "CASE metric " + " ".join(f"WHEN {_sq(k)} THEN {_sq(v)}" for k, v in METRIC_LABEL.items()) + " ELSE metric END"
METRIC_TITLE_SQL = "CASE metric " + " ".join(f"WHEN {_sq(k)} THEN {_sq(v)}" for k, v in METRIC_TITLE.items()) + " ELSE metric END"


def _label_sql(key_expr: str, lang: str) -> str:
    return (f"COALESCE((SELECT text FROM labels WHERE key = {key_expr} AND lang = {lang}), "
            f"(SELECT text FROM labels WHERE key = {key_expr} AND lang = 'en'), {key_expr})")


@query("label_lookup", ("J9",), f"""
WITH {LABELS_SQL},
m AS (SELECT DISTINCT metric FROM (SELECT unnest(['level_mt', 'share_a_pct', 'share_b_pct']) AS metric FROM panel)),
x AS (SELECT metric, lang, {METRIC_LABEL_SQL} AS key FROM m, (VALUES ('en'), ('de'), ('fr')) l(lang))
SELECT metric, lang, {_label_sql('x.key', 'x.lang')} AS label FROM x
""")
def label_lookup(spark, d):
    long = T.long_panel(Ctx(spark, d).panel, "entity", "period", MEASURES)
    m = long.select("metric").distinct()
    m = m.withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("fr"))))
    m = m.withColumn("key", metric_key_expr("metric", METRIC_LABEL))
    return lookup(m, "key", "lang").select("metric", "lang", "label")


LATEST_PCT_SQL = """lp AS (
  SELECT entity, metric, period, value,
         (value - lag(value) OVER (PARTITION BY entity, metric ORDER BY period))
           / NULLIF(lag(value) OVER (PARTITION BY entity, metric ORDER BY period), 0) * 100.0 AS pct,
         row_number() OVER (PARTITION BY entity, metric ORDER BY period DESC) AS rn
  FROM long)"""


@query("insight_bundles", ("T5", "J9", "W2"), f"""
WITH {LONG_SQL},
{LABELS_SQL},
{LATEST_PCT_SQL},
b AS (SELECT entity, metric, pct, {METRIC_LABEL_SQL} AS key FROM lp WHERE rn = 1 AND pct IS NOT NULL)
SELECT entity, metric, 'en' AS lang,
       {_label_sql('b.key', "'en'")} || ' ' || CASE WHEN pct > 0 THEN 'increased' ELSE 'decreased' END || ' by '
         || printf('%.1f', abs(pct)) || '%.' AS what_changed,
       {", ".join(f"{_sq(v)} AS {k}" for k, v in X.BUNDLE_EN.items())}
FROM b
UNION ALL
SELECT entity, metric, 'de',
       {_label_sql('b.key', "'de'")} || ' ist um ' || printf('%.1f', abs(pct)) || '% '
         || CASE WHEN pct > 0 THEN 'gestiegen' ELSE 'gesunken' END || '.',
       {", ".join(_sq(v) for v in X.BUNDLE_DE.values())}
FROM b
""")
def insight_bundles(spark, d):
    long = T.long_panel(Ctx(spark, d, shared=("panel",)).panel, "entity", "period", MEASURES)
    w = Window.partitionBy("entity", "metric").orderBy("period")
    prev = F.lag("value").over(w)
    lp = (long.withColumn("pct", F.try_divide(F.col("value") - prev, prev) * F.lit(100.0))
              .withColumn("rn", F.row_number().over(w.orderBy(F.col("period").desc()))))
    b = lp.where("rn = 1 AND pct IS NOT NULL").withColumn("key", metric_key_expr("metric", METRIC_LABEL))
    out = []
    for lang in ("en", "de"):
        x = lookup(b.withColumn("lang", F.lit(lang)), "key", "lang", "name")
        bundle = X.insight_bundle(F.col("name"), F.col("pct"), lang)
        out.append(x.select("entity", "metric", "lang", bundle.alias("b")).select("entity", "metric", "lang", "b.*"))
    return out[0].unionByName(out[1])


@query("risk_sentences", ("T7", "P16"), f"""
WITH s AS (SELECT entity, site, composite_score,
                  CASE WHEN composite_score IS NULL THEN NULL WHEN composite_score <= 4 THEN 'Low'
                       WHEN composite_score <= 7 THEN 'Medium' ELSE 'High' END AS lvl FROM sites)
SELECT entity, site, lvl AS risk_level,
  site || ' shows ' || lower(lvl) || ' composite climate risk. ' || CASE lvl WHEN 'High' THEN {_sq(X.RISK_EN['High'])}
    WHEN 'Medium' THEN {_sq(X.RISK_EN['Medium'])} ELSE {_sq(X.RISK_EN['Low'])} END AS sentence_en,
  site || ' zeigt ein ' || CASE lvl WHEN 'High' THEN 'hohes' WHEN 'Medium' THEN 'mittleres' ELSE 'niedriges' END
    || ' Klimarisiko. ' || CASE lvl WHEN 'High' THEN {_sq(X.RISK_DE['High'])} WHEN 'Medium' THEN {_sq(X.RISK_DE['Medium'])}
    ELSE {_sq(X.RISK_DE['Low'])} END AS sentence_de
FROM s
""")
def risk_sentences(spark, d):
    s = Ctx(spark, d).sites.withColumn("risk_level", risk_band("composite_score"))
    return s.select("entity", "site", "risk_level",
                    X.risk_sentence(F.col("site"), F.col("risk_level")).alias("sentence_en"),
                    X.risk_sentence(F.col("site"), F.col("risk_level"), "de").alias("sentence_de"))


@query("forecast_sentences", ("T7", "M9", "J9"), f"""
WITH {_ci_sql('5')},
{LABELS_SQL},
la AS (SELECT entity, metric, arg_max(value, period) AS last_actual FROM long GROUP BY entity, metric),
lf AS (SELECT entity, metric, arg_max(forecast, period) AS last_forecast, max(period) AS target_period
       FROM fc GROUP BY entity, metric),
j AS (SELECT lf.entity, lf.metric, target_period,
             round((last_forecast - last_actual) / NULLIF(last_actual, 0) * 100.0, 1) + 0.0 AS pct
      FROM lf JOIN la ON la.entity = lf.entity AND la.metric = lf.metric),
k AS (SELECT *, {METRIC_TITLE_SQL} AS key FROM j),
r AS (SELECT *, CASE WHEN pct = floor(pct) THEN CAST(CAST(pct AS BIGINT) AS VARCHAR) ELSE CAST(pct AS VARCHAR) END AS pct_txt FROM k)
SELECT entity, metric,
  'Under the ''Baseline'' scenario, ' || lower({_label_sql('r.key', "'en'")}) || ' is projected to change by '
    || pct_txt || '% by ' || CAST(target_period AS VARCHAR) || '.' AS sentence_en,
  'Im Szenario ''Baseline'' wird für ' || lower({_label_sql('r.key', "'de'")}) || ' bis ' || CAST(target_period AS VARCHAR)
    || ' eine Veränderung von ' || pct_txt || '% erwartet.' AS sentence_de
FROM r
""")
def forecast_sentences(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    long = T.long_panel(c.panel, "entity", "period", MEASURES)
    dr = T.direction(long, T.forecast_ci(long, "entity", "period", 5), "entity", "period")
    dr = dr.withColumn("key", metric_key_expr("metric", METRIC_TITLE))
    en = lookup(dr.withColumn("l_en", F.lit("en")), "key", "l_en", "title_en")
    both = lookup(en.withColumn("l_de", F.lit("de")), "key", "l_de", "title_de")
    sc = F.lit("Baseline")
    return both.select(
        "entity", "metric",
        X.forecast_sentence(sc, F.col("title_en"), F.col("change_pct"), F.col("target_period")).alias("sentence_en"),
        X.forecast_sentence(sc, F.col("title_de"), F.col("change_pct"), F.col("target_period"), "de").alias("sentence_de"))


@query("what_changed", ("T7", "W3"), """
WITH r AS (SELECT entity, period, level_mt - lag(level_mt) OVER (PARTITION BY entity ORDER BY period) AS delta,
                  row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS rn FROM panel)
SELECT entity, period,
  'CO2 emissions ' || CASE WHEN delta < 0 THEN 'decreased' ELSE 'increased' END || ' by ' || printf('%.1f', abs(delta))
    || ' Mt in the most recent available year.' AS sentence_en,
  'CO2-Emissionen sind im letzten verfügbaren Jahr um ' || printf('%.1f', abs(delta)) || ' Mt '
    || CASE WHEN delta < 0 THEN 'gesunken' ELSE 'gestiegen' END || '.' AS sentence_de
FROM r WHERE rn = 1 AND delta IS NOT NULL
""")
def what_changed(spark, d):
    p = Ctx(spark, d).panel
    w = Window.partitionBy("entity").orderBy("period")
    r = (p.withColumn("delta", F.col("level_mt") - F.lag("level_mt").over(w))
          .withColumn("rn", F.row_number().over(w.orderBy(F.col("period").desc())))
          .where("rn = 1 AND delta IS NOT NULL"))
    return r.select("entity", "period", X.what_changed_sentence(F.col("delta")).alias("sentence_en"),
                    X.what_changed_sentence(F.col("delta"), "de").alias("sentence_de"))


@query("kpi_headlines", ("T6", "T1", "W5"), f"""
WITH lt AS (SELECT p.* FROM panel p JOIN (SELECT entity, max(period) AS mp FROM panel GROUP BY entity) m
            ON m.entity = p.entity AND m.mp = p.period),
s AS (SELECT entity, 'Current position: ' || {PYSTR('level_mt')} || ' Mt CO2, ' || {PYSTR('share_a_pct')}
                     || '% renewable share.' AS answer,
             '{{"co2_emissions_mt": ' || {PYSTR('level_mt')} || ', "renewable_share_pct": ' || {PYSTR('share_a_pct')} || '}}' AS context
      FROM lt),
{GROUND_SQL('s', 'entity')}
SELECT s.entity, s.answer AS headline, grounded, n_unmatched, unmatched, warning FROM s JOIN gr ON gr.entity = s.entity
""")
def kpi_headlines(spark, d):
    lt = latest_rows(Ctx(spark, d, shared=("panel",)).panel, "period", "entity", mode="per_entity")
    answer = X.kpi_headline(F.col("level_mt"), F.col("share_a_pct"))
    context = json_sorted({"co2_emissions_mt": "level_mt", "renewable_share_pct": "share_a_pct"},
                          floats={"co2_emissions_mt", "renewable_share_pct"})
    return lt.select("entity", answer.alias("headline"), *_ground_cols(answer, context))


@query("report_notes", ("T6", "F5", "T1"), f"""
WITH s AS (SELECT doc_id, CAST(length(text) AS INT) AS n_chars, CAST(length(text) AS INT) AS excerpt_chars,
                  'Report excerpt received (' || CAST(length(text) AS VARCHAR) || ' characters).' AS answer,
                  '{{"report_excerpt": ' || to_json(text) || '}}' AS context
           FROM documents),
{GROUND_SQL('s', 'doc_id')}
SELECT s.doc_id, n_chars, excerpt_chars, answer AS note, grounded FROM s JOIN gr ON gr.doc_id = s.doc_id
""")
def report_notes(spark, d):
    docs = Ctx(spark, d).t.documents.select("doc_id", "text")
    answer = X.report_note(F.col("text"))
    context = json_sorted({"report_excerpt": X.report_excerpt(F.col("text"))})
    g = X.grounding(answer, context)
    return docs.select("doc_id", F.char_length("text").cast("int").alias("n_chars"),
                       F.char_length(X.report_excerpt(F.col("text"))).cast("int").alias("excerpt_chars"),
                       answer.alias("note"), g.grounded.alias("grounded"))


@query("pii_scan", ("D15b", "F3"), f"""
SELECT doc_id, source, CAST(len(regexp_extract_all(text, {_sq(EMAIL_RE)})) AS INT) AS n_email,
       CAST(len(regexp_extract_all(text, {_sq(IBAN_RE)})) AS INT) AS n_iban
FROM documents
""")
def pii_scan(spark, d):
    docs = Ctx(spark, d).t.documents
    return docs.select("doc_id", "source", email_count("text").cast("int").alias("n_email"),
                       F.regexp_count("text", F.lit(IBAN_RE)).cast("int").alias("n_iban"))


@query("pii_summary", ("D15b", "F3", "A2"), f"""
SELECT source, count(*) AS docs,
       CAST(SUM(CASE WHEN regexp_matches(text, {_sq(EMAIL_RE)}) THEN 1 ELSE 0 END) AS BIGINT) AS docs_with_email,
       CAST(SUM(CASE WHEN regexp_matches(text, {_sq(IBAN_RE)}) THEN 1 ELSE 0 END) AS BIGINT) AS docs_with_iban
FROM documents GROUP BY source
""")
def pii_summary(spark, d):
    docs = Ctx(spark, d).t.documents
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(has_email("text").cast("long")).alias("docs_with_email"),
        F.sum(F.col("text").rlike(IBAN_RE).cast("long")).alias("docs_with_iban"))


@query("person_name_share", ("D15c", "F1"), f"""
WITH x AS (SELECT 'firms' AS dataset, firm_name AS name FROM firms UNION ALL SELECT 'sites', site FROM sites)
SELECT dataset, count(*) AS "rows",
       CAST(SUM(CASE WHEN COALESCE(regexp_matches(name, {_sq(PERSON_NAME_RE)}), false) THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
       round(SUM(CASE WHEN COALESCE(regexp_matches(name, {_sq(PERSON_NAME_RE)}), false) THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS rate,
       SUM(CASE WHEN COALESCE(regexp_matches(name, {_sq(PERSON_NAME_RE)}), false) THEN 1 ELSE 0 END) / greatest(count(*), 1) < 0.05 AS passed
FROM x GROUP BY dataset
""")
def person_name_share(spark, d):
    c = Ctx(spark, d)
    x = c.firms.select(F.lit("firms").alias("dataset"), F.col("firm_name").alias("name")).unionByName(
        c.sites.select(F.lit("sites").alias("dataset"), F.col("site").alias("name")))
    g = x.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"),
                                 F.sum(looks_like_person("name").cast("long")).alias("suspicious"))
    rate = F.col("suspicious") / F.greatest(F.col("rows"), F.lit(1))
    return g.select("dataset", "rows", "suspicious", F.round(rate, 6).alias("rate"), (rate < 0.05).alias("passed"))


@query("encoding_check", ("D12", "F4"), f"""
SELECT 'documents' AS tbl, count(*) AS "rows", CAST(SUM(CASE WHEN contains(text, {_sq(REPLACEMENT_CHAR)}) THEN 1 ELSE 0 END) AS BIGINT) AS replacement_rows FROM documents
UNION ALL SELECT 'pages', count(*), CAST(SUM(CASE WHEN contains(html, {_sq(REPLACEMENT_CHAR)}) THEN 1 ELSE 0 END) AS BIGINT) FROM pages
UNION ALL SELECT 'conversations', count(*), CAST(SUM(CASE WHEN contains(text, {_sq(REPLACEMENT_CHAR)}) THEN 1 ELSE 0 END) AS BIGINT) FROM conversations
""")
def encoding_check(spark, d):
    t = Ctx(spark, d).t
    parts = []
    for name, col in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        parts.append(t.table(name).agg(
            F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("rows"),
            F.sum(F.col(col).contains(REPLACEMENT_CHAR).cast("long")).alias("replacement_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("invalid_utf8", ("D12", "F4"))
def invalid_utf8(spark, d):
    """Rows whose bytes are not valid UTF-8 (DuckDB rejects such files on read,
    so this has no SQL twin; the check runs on the raw bytes in Spark)."""
    t = Ctx(spark, d).t
    parts = [t.table(n).agg(F.lit(n).alias("tbl"),
                            F.sum((~F.is_valid_utf8(F.col(c).cast("binary"))).cast("long")).alias("invalid_rows"))
             for n, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])



@query("risk_recommendations", ("T6", "T1", "T2"), f"""
WITH s AS (SELECT entity, site, {_sq(X.RECOMMEND_EN.split('{score}')[0])} || {PYSTR('composite_score')} || {_sq(X.RECOMMEND_EN.split('{score}')[1])} AS answer,
                  {_sq(X.RECOMMEND_DE.split('{score}')[0])} || {PYSTR('composite_score')} || {_sq(X.RECOMMEND_DE.split('{score}')[1])} AS recommendation_de,
                  '{{"composite_climate_risk_score": ' || {PYSTR('composite_score')} || ', "heat_stress_score": ' || {PYSTR('round(heat_score, 2)')}
                    || ', "physical_risk_score": ' || {PYSTR('round(physical_score, 2)')} || '}}' AS context FROM sites),
{GROUND_SQL('s', 'entity, site')}
SELECT s.entity, s.site, s.answer AS recommendation, recommendation_de, grounded, n_unmatched, unmatched, warning
FROM s JOIN gr ON gr.entity = s.entity AND gr.site = s.site
""")
def risk_recommendations(spark, d):
    """What to do about each site's risk, with the check of its numbers against the profile (the 10 of "/10" is one of them)."""
    s = Ctx(spark, d).sites.select("entity", "site", "composite_score", F.round("heat_score", 2).alias("heat"), F.round("physical_score", 2).alias("physical"))
    context = json_sorted({"composite_climate_risk_score": "composite_score", "heat_stress_score": "heat", "physical_risk_score": "physical"},
                          floats={"composite_climate_risk_score", "heat_stress_score", "physical_risk_score"})
    answer = X.risk_recommendation(F.col("composite_score"))
    return s.select("entity", "site", answer.alias("recommendation"), X.risk_recommendation(F.col("composite_score"), "de").alias("recommendation_de"),
                    *_ground_cols(answer, context))
