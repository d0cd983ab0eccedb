"""Declared contracts of the three input tables."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

NEEDS = _schema(
    ("country", _S), ("iso3", _S), ("year", _I),
    ("people_in_need_millions", _D), ("required_funding_musd", _D),
    ("funding_received_musd", _D), ("cbpf_allocation_musd", _D),
    ("severity", _I), ("primary_cluster", _S), ("region", _S),
    ("latitude", _D), ("longitude", _D), ("population_millions", _D),
)

PROJECTS = _schema(
    ("project_code", _S), ("country", _S), ("iso3", _S), ("cluster", _S),
    ("organization", _S), ("year", _I), ("budget_usd", _L),
    ("target_beneficiaries", _L), ("funding_received_usd", _L),
    ("beneficiaries_per_1000_usd", _D), ("funding_coverage_pct", _D),
)

ALLOCATIONS = _schema(
    ("country", _S), ("iso3", _S), ("cluster", _S), ("allocation_kusd", _D),
    ("year", _I), ("allocation_type", _S), ("allocation_musd", _D),
)

# Header of the published needs file, after normalisation, and
# the contract column each one carries.
NEEDS_FILE_NAMES = {
    "country": "country",
    "iso3": "iso3",
    "year": "year",
    "peopleinneed_m": "people_in_need_millions",
    "requiredfunding_m_usd": "required_funding_musd",
    "fundingreceived_m_usd": "funding_received_musd",
    "cbpfallocation_m_usd": "cbpf_allocation_musd",
    "severity": "severity",
    "primarycluster": "primary_cluster",
    "region": "region",
    "lat": "latitude",
    "lon": "longitude",
}

NEEDS_REQUIRED = (
    "country", "iso3", "year", "people_in_need_millions",
    "required_funding_musd", "funding_received_musd", "severity",
)
NEEDS_CRITICAL = (
    "country", "people_in_need_millions", "required_funding_musd", "funding_received_musd",
)
