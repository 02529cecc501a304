"""Fixed values that results depend on."""

# Codes of aggregate partners and reporters, per table family.
CUBE_AGGREGATES = ("WLD", "W00", "EUR", "ASE", "S19", "X99", "UNK", "99")
OVERVIEW_AGGREGATES = ("EUR", "WLD", "W00", "ASE")
MAP_AGGREGATES = ("EUR", "WLD", "W00", "ASE", "S19", "X99")
SERIES_AGGREGATES = ("EUR", "WLD", "W00", "ASE", "S19", "X99")
FORECAST_AGGREGATES = ("WLD", "W00", "EUR", "ASE", "S19", "UNK", "XZZ")

# Fixed value: partner names that never denote an economy.
NON_ECONOMY_NAME = r"(?i)World|Areas,?\s*nes|Special Categories|Bunkers|Free Zones"

# Fixed value: columns never written to a download.
UNSAFE_COLUMN = r"(?i)path|url|header|secret|token|key|raw_file|cache"

# Concentration bands (upper limit, label) and the missing label.
HHI_BANDS = (
    (0.15, "Diversified"),
    (0.25, "Moderate concentration"),
    (0.50, "High concentration"),
    (1.01, "Very high concentration"),
)
SHARE_BANDS = (
    (0.25, "Below 25%"),
    (0.50, "25%–50%"),
    (0.75, "50%–75%"),
    (1.01, "Above 75%"),
)
BAND_MISSING = "Unavailable"

# Macro indicator codes and the wide columns they become.
INDICATORS = {
    "NY.GDP.MKTP.CD": "gdp_current_usd",
    "SP.POP.TOTL": "population_total",
    "FP.CPI.TOTL": "cpi_index",
    "FP.CPI.TOTL.ZG": "inflation_annual_pct",
}
MACRO_FIELDS = (
    "gdp_current_usd", "population_total", "cpi_index",
    "inflation_annual_pct", "gdp_per_capita_usd",
)

SERIES_PARTS = ("reporter_iso3", "partner_iso3", "hs_code", "flow_code")
NODE_PARTS = ("iso3", "hs_code")

# Metric name -> (column, signed).
METRICS = {
    "imports": ("imports_value_usd", False),
    "exports": ("exports_value_usd", False),
    "total_trade": ("total_trade_value_usd", False),
    "trade_balance": ("trade_balance_usd", True),
    "total_trade_pct_gdp": ("total_trade_pct_gdp", False),
    "balance_pct_gdp": ("trade_balance_pct_gdp", True),
    "trade_per_capita": ("total_trade_per_capita_usd", False),
}

# Defaults of the dependency and network operators.
DEPENDENCY_NODE_CAP = 200
SHARE_TOLERANCE = 1e-6
NETWORK_TOP_EDGES = 100
OTHER_CODE = "OTHER"
OTHER_LABEL = "Other HS4 (outside top-N)"


def metric_column(metric: str) -> str:
    return METRICS.get(metric, (metric, False))[0]


def metric_signed(metric: str) -> bool:
    return METRICS.get(metric, (metric, False))[1]


def metric_allows_growth(metric: str) -> bool:
    return metric in METRICS and not METRICS[metric][1]
