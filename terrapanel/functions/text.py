"""Text expressions (F1-F7, F11, J10, D15): all built-in Spark functions.

Number formatting: ``fixed(x, d)`` equals Python's ``f"{x:.{d}f}"`` and C's
``%.{d}f`` — ``format_number`` rounds half-even on the exact binary value — with
the thousands separators removed.  ``py_str(x)`` equals Python's ``str(float)``
for |x| < 1e7 (and integral values below 1e16).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Fixed values (patterns and limits that results must match):
# number pattern  -?\d+\.?\d*   (grounding check, tolerance 0.5, 5 numbers listed)
# email pattern   [A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}
# IBAN pattern    \b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b
# phone pattern   (?:\+?\d[\d\-\s()]{7,}\d)      (defined, not applied by the rules)
# replacement character U+FFFD; report excerpt 6000 characters.
# PII column-name signatures: email, e_mail, phone, telefon, ssn, social_security,
# date_of_birth, dob, birth_date, geburtsdatum, personal_id, passport, national_id,
# home_address, street_address, iban, credit_card, salary, first_name, last_name,
# given_name, surname.
# ---------------------------------------------------------------------------
NUMBER_RE = r"(-?\d+\.?\d*)"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN_RE = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
PHONE_RE = r"(?:\+?\d[\d\-\s()]{7,}\d)"
REPLACEMENT_CHAR = "�"
GROUNDING_TOLERANCE = 0.5
GROUNDING_LISTED = 5
PII_NAME_SIGNATURES = (
    "email", "e_mail", "phone", "telefon", "ssn", "social_security",
    "date_of_birth", "dob", "birth_date", "geburtsdatum", "personal_id",
    "passport", "national_id", "home_address", "street_address", "iban",
    "credit_card", "salary", "first_name", "last_name", "given_name", "surname",
)
# exact field names that must never appear in a published schema
PERSONAL_FIELDS = frozenset({
    "email", "phone", "ssn", "national_id", "date_of_birth", "full_name",
    "address", "ip_address", "passport", "tax_id",
})
# a word that Python's  w[:1].isupper() and w[1:].islower()  accepts
_PERSON_WORD = r"\p{Lu}[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*"
PERSON_NAME_RE = rf"^\s*{_PERSON_WORD}\s+{_PERSON_WORD}\s*$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def email_count(text: str | Column) -> Column:
    """Number of email-shaped matches.  Every match contains a literal ``@``, so
    texts without one skip the regex (a plain substring test): the pattern's
    leading character class otherwise restarts at every position of every word."""
    t = _c(text)
    return F.when(t.contains("@"), F.regexp_count(t, F.lit(EMAIL_RE))).otherwise(F.lit(0))


def has_email(text: str | Column) -> Column:
    t = _c(text)
    return t.contains("@") & t.rlike(EMAIL_RE)


def fixed(x: str | Column, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"`` (half-even on the exact binary value)."""
    return F.regexp_replace(F.format_number(_c(x), digits), ",", "")


def py_str(x: str | Column) -> Column:
    """Python ``str(float(x))``: integral values print with ``.0``, magnitudes from
    1e-4 to below 1e16 in plain decimals, others as ``1e-05`` or ``1.5e+16``."""
    x = _c(x).cast("double")
    text = x.cast("string")
    plain = F.regexp_replace(text.cast("decimal(38,21)").cast("string"), "0+$", "")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^([^E]*)E", 1), "[.]0$", "")
    power = F.regexp_extract(text, "E-?([0-9]+)$", 1)
    exponent = F.concat(F.when(text.contains("E-"), F.lit("e-")).otherwise(F.lit("e+")),
                        F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when(F.isnan(x), F.lit("nan"))
             .when(F.abs(x) == F.lit(float("inf")), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
             .when((x == F.floor(x)) & (F.abs(x) < F.lit(1e16)),
                   F.concat(F.when((x == 0) & text.startswith("-"), F.lit("-")).otherwise(F.lit("")),
                            x.cast("bigint").cast("string"), F.lit(".0")))
             .when((F.abs(x) >= F.lit(1e-4)) & (F.abs(x) < F.lit(1e16)), plain)
             .otherwise(F.concat(mantissa, exponent)))


def numbers(text: str | Column) -> Column:
    """every number token as double (``2020-2023`` gives 2020 and -2023)."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(NUMBER_RE), 1), lambda t: t.cast("double"))


def unmatched(answer_nums: Column, context_nums: Column, tol: float = GROUNDING_TOLERANCE) -> Column:
    """Answer numbers with no context number within ``tol``."""
    return F.filter(answer_nums, lambda n: ~F.exists(context_nums, lambda c: F.abs(n - c) <= F.lit(tol)))


def json_sorted(fields: Mapping[str, Column | str], ints: set[str] = frozenset(),
                floats: set[str] = frozenset()) -> Column:
    """``json.dumps(row, sort_keys=True, ensure_ascii=False)`` text (", " and ": "
    separators); ``ints`` print as integers, ``floats`` as Python floats, the rest as
    JSON strings.  Characters beyond ASCII stay as they are: their escapes would put
    digits into the text from which numbers are read."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        v = _c(fields[k])
        if k in ints:
            val = v.cast("bigint").cast("string")
        elif k in floats:
            val = py_str(v)
        else:
            one = F.to_json(F.array(v.cast("string")))
            val = F.substring(one, F.lit(2), F.length(one) - 2)
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{k}": '), F.coalesce(val, F.lit("null"))]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def looks_like_person(name: str | Column) -> Column:
    """Exactly two words, each capitalised (first upper, rest lower)."""
    return F.coalesce(_c(name).rlike(PERSON_NAME_RE), F.lit(False))


def pii_columns(columns: list[str]) -> list[tuple[str, str]]:
    """D15a (metadata only): (column, signature) pairs that hit a PII name signature."""
    return [(c, s) for c in columns for s in PII_NAME_SIGNATURES if s in c.lower()]


def personal_fields(columns: list[str]) -> set[str]:
    """D16 (metadata only): lower-cased column names that are personal-data fields."""
    return {c.lower() for c in columns} & PERSONAL_FIELDS
