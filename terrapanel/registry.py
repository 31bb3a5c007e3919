"""Dataset registry: keys, ordering, bounds, enums, tolerances per dataset.

Every operator that needs a business rule takes a ``Dataset`` instead of
hard-coded column lists, so the same code runs on the three reporting schemas
(country panel, regional scores, company disclosures) and on the driver views
``panel``, ``sites`` and ``firms`` that stand in for them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bound:
    lo: float | None = None
    hi: float | None = None


@dataclass(frozen=True)
class Dataset:
    name: str
    key: tuple[str, ...]
    entity: str                      # column holding the reporting entity (country)
    period: str | None = None        # time axis, when the dataset is a yearly panel
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    int_cols: tuple[str, ...] = ()
    bounds: dict[str, Bound] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    clamp: dict[str, Bound] = field(default_factory=dict)      # cleaning clamps
    code_cols: tuple[str, ...] = ()                              # upper + strip
    text_cols: tuple[str, ...] = ()                              # strip only
    dropna: tuple[str, ...] = ()
    check_cols: tuple[str, ...] = ()                             # reconciliation columns
    tolerance: float = 0.15
    row_bounds: tuple[int, int] = (1, 100_000)
    measures: tuple[str, ...] = ()
    max_key_null_rate: float = 0.05
    pass_rate: float = 0.95
    gate: tuple[str, ...] = ()                                   # columns of the null gate (default: the key)
    defaults: dict[str, str] = field(default_factory=dict)       # values of columns that a load lacks
    closed: bool = False                                         # columns beyond the contract are dropped

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.key + self.required + self.optional))


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's business rules.
# Tolerances: country panel 0.15, regional scores 0.25, company data 0.30;
# documented high-volatility tolerance 0.40.
# Gate: at least 95% of rows valid; silver gate: key-null rate at most 5%.
# Record-count bounds: panel 3..900, regional 3..500, companies 1..100000.
# Allowed countries DE, AT, CH; data_quality official, estimated, sample
# (plus user_input for user-submitted rows); risk levels Low, Medium, High.
# ---------------------------------------------------------------------------
TOL_PANEL = 0.15
TOL_SITES = 0.25
TOL_FIRMS = 0.30
TOL_HIGH_VOLATILITY = 0.40
VALID_COUNTRIES = ("DE", "AT", "CH")
QUALITY_TAGS = ("official", "estimated", "sample", "user_input")
RISK_LEVELS = ("Low", "Medium", "High")

PCT = Bound(0.0, 100.0)
SCORE = Bound(0.0, 10.0)
NONNEG = Bound(0.0, None)
YEAR = Bound(1990, 2100)

CO2_ENERGY = Dataset(
    name="co2_energy",
    key=("country_code", "year"),
    entity="country_code",
    period="year",
    required=("co2_emissions_mt", "renewable_share_pct"),
    optional=("co2_per_capita_t", "fossil_share_pct", "nuclear_share_pct",
              "electricity_generation_twh", "electricity_price_eur_mwh", "data_quality"),
    int_cols=("year",),
    bounds={"year": YEAR, "co2_emissions_mt": NONNEG, "renewable_share_pct": PCT,
            "co2_per_capita_t": NONNEG, "fossil_share_pct": PCT, "nuclear_share_pct": PCT,
            "electricity_generation_twh": NONNEG, "electricity_price_eur_mwh": NONNEG},
    enums={"country_code": VALID_COUNTRIES, "data_quality": QUALITY_TAGS[:3]},
    clamp={"renewable_share_pct": PCT, "fossil_share_pct": PCT, "nuclear_share_pct": PCT},
    code_cols=("country_code",),
    dropna=("country_code", "year", "co2_emissions_mt", "renewable_share_pct"),
    check_cols=("co2_emissions_mt", "renewable_share_pct"),
    tolerance=TOL_PANEL,
    row_bounds=(3, 900),
    measures=("co2_emissions_mt", "renewable_share_pct", "electricity_price_eur_mwh"),
    gate=("country_code", "year", "co2_emissions_mt"),
    defaults={"data_quality": "sample"},
    closed=True,
)

REGIONAL_RISK = Dataset(
    name="regional_climate_risk",
    key=("country_code", "region"),
    entity="country_code",
    required=("physical_risk_score", "transition_risk_score", "flood_risk_score",
              "heat_stress_score", "composite_climate_risk_score", "risk_level"),
    optional=("data_quality",),
    bounds={c: SCORE for c in ("physical_risk_score", "transition_risk_score", "flood_risk_score",
                               "heat_stress_score", "composite_climate_risk_score")},
    enums={"country_code": VALID_COUNTRIES, "risk_level": RISK_LEVELS, "data_quality": QUALITY_TAGS[:3]},
    clamp={c: SCORE for c in ("physical_risk_score", "transition_risk_score", "flood_risk_score",
                              "heat_stress_score", "composite_climate_risk_score")},
    code_cols=("country_code",),
    text_cols=("region",),
    dropna=("country_code", "region"),
    check_cols=("composite_climate_risk_score",),
    tolerance=TOL_SITES,
    row_bounds=(3, 500),
    gate=("country_code", "region", "composite_climate_risk_score"),
    defaults={"data_quality": "sample"},
    closed=True,
)

COMPANY_ESG = Dataset(
    name="company_esg",
    key=("company_id",),
    entity="country_code",
    required=("company_name", "country_code", "sector", "scope1_tco2e", "scope2_tco2e", "scope3_tco2e",
              "esg_readiness_score", "csrd_readiness_score", "reporting_gaps_count"),
    optional=("data_quality",),
    int_cols=("reporting_gaps_count",),
    bounds={"scope1_tco2e": NONNEG, "scope2_tco2e": NONNEG, "scope3_tco2e": NONNEG,
            "esg_readiness_score": PCT, "csrd_readiness_score": PCT, "reporting_gaps_count": NONNEG},
    enums={"country_code": VALID_COUNTRIES, "data_quality": QUALITY_TAGS[:3]},
    clamp={"scope1_tco2e": NONNEG, "scope2_tco2e": NONNEG, "scope3_tco2e": NONNEG,
           "esg_readiness_score": NONNEG, "csrd_readiness_score": NONNEG},
    code_cols=("country_code",),
    dropna=("company_id", "country_code"),
    check_cols=("scope1_tco2e", "scope2_tco2e", "scope3_tco2e"),
    tolerance=TOL_FIRMS,
    row_bounds=(1, 100_000),
    gate=("company_id", "country_code"),
    defaults={"data_quality": "sample"},
    closed=True,
)

# Driver views (see terrapanel.plans.views): same shapes on the test tables.
PANEL = Dataset(
    name="panel",
    key=("entity", "period"),
    entity="entity",
    period="period",
    required=("level_mt", "share_a_pct"),
    optional=("share_b_pct", "share_c_pct", "volume"),
    int_cols=("period",),
    bounds={"period": YEAR, "level_mt": NONNEG, "share_a_pct": PCT, "share_b_pct": PCT,
            "share_c_pct": PCT, "volume": NONNEG},
    clamp={"share_a_pct": PCT, "share_b_pct": PCT, "share_c_pct": PCT},
    code_cols=("entity",),
    dropna=("entity", "period", "level_mt", "share_a_pct"),
    check_cols=("level_mt", "share_a_pct"),
    tolerance=TOL_PANEL,
    row_bounds=(3, 900),
    measures=("level_mt", "share_a_pct", "share_b_pct"),
    gate=("entity", "period", "level_mt"),
)

SITES = Dataset(
    name="sites",
    key=("entity", "site"),
    entity="entity",
    required=("physical_score", "transition_score", "flood_score", "heat_score", "composite_score"),
    bounds={c: SCORE for c in ("physical_score", "transition_score", "flood_score", "heat_score",
                               "composite_score")},
    clamp={c: SCORE for c in ("physical_score", "transition_score", "flood_score", "heat_score",
                              "composite_score")},
    code_cols=("entity",),
    text_cols=("site",),
    dropna=("entity", "site"),
    check_cols=("composite_score",),
    tolerance=TOL_SITES,
    row_bounds=(3, 500),
)

FIRMS = Dataset(
    name="firms",
    key=("firm_id",),
    entity="entity",
    required=("firm_name", "entity", "sector", "scope1", "scope2", "scope3", "readiness_score",
              "gaps_count"),
    int_cols=("gaps_count",),
    bounds={"scope1": NONNEG, "scope2": NONNEG, "scope3": NONNEG, "readiness_score": PCT,
            "gaps_count": NONNEG},
    clamp={"scope1": NONNEG, "scope2": NONNEG, "scope3": NONNEG},
    code_cols=("entity",),
    dropna=("firm_id",),
    check_cols=("scope1", "scope2", "scope3"),
    tolerance=TOL_FIRMS,
    row_bounds=(1, 100_000),
)

DATASETS: dict[str, Dataset] = {d.name: d for d in
                                (CO2_ENERGY, REGIONAL_RISK, COMPANY_ESG, PANEL, SITES, FIRMS)}


def dataset(name: str) -> Dataset:
    return DATASETS[name]
