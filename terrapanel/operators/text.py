"""Text outputs as table jobs (T1-T7): one row in, one row out, over a whole table.

Every sentence is a column expression (``concat`` of fixed text and formatted
numbers), so a table of a billion rows is a narrow stage; the grounding check is
higher-order array functions over the numbers of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrapanel.functions.text import (
    GROUNDING_LISTED, fixed, numbers, py_str, unmatched,
)

# ---------------------------------------------------------------------------
# The offline texts the reference emits (EN, DE).
# ---------------------------------------------------------------------------
READINESS_EN = "{name} has a CSRD readiness score of {score}% with {gaps} open reporting gap(s). {advice}"
READINESS_DE = "{name} hat eine CSRD-Bereitschaft von {score}% mit {gaps} offenen Berichtslücken. {advice}"
ADVICE_LOW_EN = "Prioritize closing Scope 3 and governance gaps before the next reporting wave."
ADVICE_OK_EN = "Readiness is solid; focus on assurance-quality evidence for the audit trail."
ADVICE_LOW_DE = "Priorisieren Sie das Schließen von Scope-3- und Governance-Lücken vor der nächsten Berichtswelle."
ADVICE_OK_DE = "Die Bereitschaft ist solide; konzentrieren Sie sich auf prüfungsfeste Nachweise für den Audit-Trail."
ANOMALY_EN = ("A change of {change}% was detected in {col}, larger than the expected tolerance. "
              "This could reflect a genuine policy/market shift, a reporting boundary change, or a "
              "data quality issue — it has been withheld from the dashboard pending review.")
ANOMALY_DE = ("Eine Veränderung von {change}% wurde bei {col} festgestellt, größer als die "
              "erwartete Toleranz. Dies kann eine echte Politik-/Marktverschiebung, eine geänderte "
              "Berichtsgrenze oder ein Datenqualitätsproblem widerspiegeln — die Daten wurden bis zur "
              "Prüfung vom Dashboard zurückgehalten.")
BUNDLE_EN = {
    "why_it_matters": "This metric directly feeds CSRD disclosure obligations and climate risk scoring.",
    "risk_explanation": "Large shifts can signal regulatory or market-driven change worth investigating.",
    "business_impact": "May affect cost of capital, insurance premiums, or investor perception.",
    "recommended_action": "Validate the trend with the relevant business unit and reflect it in the next CSRD report.",
    "csrd_implication": "Should be documented in the transition plan and target pathways.",
}
BUNDLE_DE = {
    "why_it_matters": "Diese Kennzahl beeinflusst direkt die CSRD-Offenlegungspflichten und die Klimarisikobewertung.",
    "risk_explanation": "Große Verschiebungen können auf regulatorische oder marktbedingte Veränderungen hindeuten.",
    "business_impact": "Kann Kapitalkosten, Versicherungsprämien oder Investorenwahrnehmung beeinflussen.",
    "recommended_action": "Trend mit Fachabteilung validieren und in den nächsten CSRD-Bericht aufnehmen.",
    "csrd_implication": "Sollte im Übergangsplan und in den Zielpfaden dokumentiert werden.",
}
DIRECTION = {"en": ("increased", "decreased"), "de": ("gestiegen", "gesunken")}
RISK_EN = {"High": "Prioritize adaptation investment and CSRD physical-risk disclosure.",
           "Medium": "Monitor trend; document mitigation plans for CSRD.",
           "Low": "Currently low priority; maintain monitoring cadence."}
RISK_DE = {"High": "Anpassungsinvestitionen und CSRD-Offenlegung physischer Risiken priorisieren.",
           "Medium": "Trend beobachten; Minderungspläne für CSRD dokumentieren.",
           "Low": "Derzeit niedrige Priorität; Überwachung fortsetzen."}
RISK_ADJ_DE = {"High": "hohes", "Medium": "mittleres", "Low": "niedriges"}
FORECAST_EN = "Under the '{scenario}' scenario, {title} is projected to change by {pct}% by {year}."
FORECAST_DE = "Im Szenario '{scenario}' wird für {title} bis {year} eine Veränderung von {pct}% erwartet."
WHAT_CHANGED_EN = "CO2 emissions {direction} by {delta} Mt in the most recent available year."
WHAT_CHANGED_DE = "CO2-Emissionen sind im letzten verfügbaren Jahr um {delta} Mt {direction}."
KPI_HEADLINE_EN = "Current position: {co2} Mt CO2, {renew}% renewable share."
KPI_HEADLINE_DE = "Aktuelle Position: {co2} Mt CO2, {renew}% Anteil Erneuerbare."
RECOMMEND_EN = ("[Offline mode] Composite risk score is {score}/10. General guidance: prioritize "
                "physical-risk adaptation if physical_risk_score is high, and document transition-risk "
                "exposure in the CSRD transition plan if transition_risk_score is high.")
RECOMMEND_DE = ("[Offline-Modus] Der zusammengesetzte Risiko-Score beträgt {score}/10. Allgemeine "
                "Empfehlung: Priorisieren Sie Anpassungsmaßnahmen bei hohem physical_risk_score und "
                "dokumentieren Sie die Übergangsrisiken im CSRD-Transitionsplan bei hohem transition_risk_score.")
REPORT_NOTE_EN = "Report excerpt received ({n} characters)."
REPORT_NOTE_DE = "Berichtsauszug empfangen ({n} Zeichen)."
WARNING = ("{k} numeric value(s) in this answer could not be verified against the source data ({nums}). "
           "Treat with caution.")


def template(text: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a fixed text with column values (one ``concat``)."""
    out, rest = [], text
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            out.append(F.lit(pre))
        out.append(parts[name].cast("string"))
    if rest:
        out.append(F.lit(rest))
    return F.concat(*out)


def r_num(x: Column) -> Column:
    """R's ``sprintf("%s", x)`` of a rounded number: ``3`` for 3.0, ``-5.2`` otherwise."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def readiness_sentence(name: Column, score: Column, gaps: Column, lang: str = "en") -> Column:
    """Readiness score (0 dp), open gaps, advice below 60."""
    low = score < F.lit(60.0)
    if lang == "de":
        adv = F.when(low, ADVICE_LOW_DE).otherwise(ADVICE_OK_DE)
        return template(READINESS_DE, name=name, score=fixed(score, 0), gaps=gaps, advice=adv)
    adv = F.when(low, ADVICE_LOW_EN).otherwise(ADVICE_OK_EN)
    return template(READINESS_EN, name=name, score=fixed(score, 0), gaps=gaps, advice=adv)


def anomaly_sentence(relative_change: Column, column: Column, lang: str = "en") -> Column:
    """T4: change in % (1 dp) of one (row, column) anomaly."""
    change = fixed(relative_change * F.lit(100.0), 1)
    return template(ANOMALY_DE if lang == "de" else ANOMALY_EN, change=change, col=column)


def insight_bundle(metric: Column, delta_pct: Column, lang: str = "en") -> Column:
    """T5: six-part insight; "increased" only for a strictly positive change."""
    up, down = DIRECTION[lang]
    direction = F.when(delta_pct > 0, up).otherwise(down)
    pct = fixed(F.abs(delta_pct), 1)
    if lang == "de":
        what = F.concat(metric, F.lit(" ist um "), pct, F.lit("% "), direction, F.lit("."))
        fixed_parts = BUNDLE_DE
    else:
        what = F.concat(metric, F.lit(" "), direction, F.lit(" by "), pct, F.lit("%."))
        fixed_parts = BUNDLE_EN
    return F.struct(what.alias("what_changed"), *[F.lit(v).alias(k) for k, v in fixed_parts.items()])


def risk_sentence(site: Column, level: Column, lang: str = "en") -> Column:
    """Region risk sentence by band."""
    if lang == "de":
        adj = F.when(level == "High", RISK_ADJ_DE["High"]).when(level == "Medium", RISK_ADJ_DE["Medium"]) \
               .otherwise(RISK_ADJ_DE["Low"])
        adv = F.when(level == "High", RISK_DE["High"]).when(level == "Medium", RISK_DE["Medium"]) \
               .otherwise(RISK_DE["Low"])
        return F.concat(site, F.lit(" zeigt ein "), adj, F.lit(" Klimarisiko. "), adv)
    adv = F.when(level == "High", RISK_EN["High"]).when(level == "Medium", RISK_EN["Medium"]).otherwise(RISK_EN["Low"])
    return F.concat(site, F.lit(" shows "), F.lower(level), F.lit(" composite climate risk. "), adv)


def forecast_sentence(scenario: Column, title: Column, change_pct: Column, year: Column, lang: str = "en") -> Column:
    """Projected change (already rounded to 1 dp) by the last forecast year."""
    t = FORECAST_DE if lang == "de" else FORECAST_EN
    return template(t, scenario=scenario, title=F.lower(title), pct=r_num(change_pct), year=year)


def what_changed_sentence(delta: Column, lang: str = "en") -> Column:
    """Last-period change; "increased" when the change is 0 or more."""
    up, down = DIRECTION[lang]
    direction = F.when(delta < 0, down).otherwise(up)
    t = WHAT_CHANGED_DE if lang == "de" else WHAT_CHANGED_EN
    return template(t, direction=direction, delta=fixed(F.abs(delta), 1))


def kpi_headline(co2: Column, renew: Column, lang: str = "en") -> Column:
    """KPI headline; values print as Python ``str`` of the numbers."""
    t = KPI_HEADLINE_DE if lang == "de" else KPI_HEADLINE_EN
    return template(t, co2=py_str(co2), renew=py_str(renew))


def risk_recommendation(composite: Column, lang: str = "en") -> Column:
    """Recommendation from a risk profile; a profile without a composite score counts as 0."""
    t = RECOMMEND_DE if lang == "de" else RECOMMEND_EN
    return template(t, score=F.coalesce(py_str(composite), F.lit("0")))


def report_note(text: Column, lang: str = "en") -> Column:
    """Report-received note with the length of the *whole* text."""
    t = REPORT_NOTE_DE if lang == "de" else REPORT_NOTE_EN
    return template(t, n=F.char_length(text))


def report_excerpt(text: Column, chars: int | None = None) -> Column:
    """the excerpt handed to the summariser: the whole text, or its first ``chars``
    characters where a caller's summariser has a limit."""
    return text if chars is None else F.substring(text, 1, chars)


def grounding(answer: Column, context: Column) -> Column:
    """struct(grounded, unmatched, warning) — every number in the answer
    must lie within 0.5 of a number in the context."""
    miss = unmatched(numbers(answer), numbers(context))
    miss_txt = F.transform(miss, lambda n: py_str(n))
    warn = F.when(F.size(miss) > 0, template(
        WARNING, k=F.size(miss), nums=F.array_join(F.slice(miss_txt, 1, GROUNDING_LISTED), ", ")))
    return F.struct((F.size(miss) == 0).alias("grounded"), miss_txt.alias("unmatched"), warn.alias("warning"))
