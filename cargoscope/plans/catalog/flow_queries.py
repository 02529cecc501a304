"""Cleaning, filter and cube queries."""

from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.operators import clean, flows
from cargoscope.plans.catalog.base import CTE, query, rounded

MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def money(x="trade_value_usd"):
    return MONEY.format(x)


CTE["raw_cube"] = """
SELECT CAST(year AS VARCHAR) AS year, reporter_iso3, flow_code, hs_code AS cmd_code,
       CASE WHEN hs_code = '8525' THEN 'WLD' WHEN hs_code = '8524' THEN 'XX' ELSE partner_iso3 END AS partner_iso3,
       CASE WHEN hs_code = '8523' THEN 'Areas, nes' WHEN hs_code = '8522' THEN NULL ELSE partner_name END AS partner_name,
       CASE WHEN hs_code = '8521' THEN CAST('NaN' AS DOUBLE) WHEN hs_code = '8520' THEN -trade_value_usd
            ELSE trade_value_usd END AS trade_value_usd
FROM cube
"""


def raw_cube(s):
    """The cube before cleaning: aggregates, odd codes, NaN and negative values mixed in."""
    hs, value = F.col("hs_code"), F.col("trade_value_usd")
    return s.cube.select(
        F.col("year").cast("string").alias("year"), "reporter_iso3", "flow_code", hs.alias("cmd_code"),
        F.when(hs == "8525", "WLD").when(hs == "8524", "XX").otherwise(F.col("partner_iso3")).alias("partner_iso3"),
        F.when(hs == "8523", "Areas, nes").when(hs != "8522", F.col("partner_name")).alias("partner_name"),
        F.when(hs == "8521", float("nan")).when(hs == "8520", -value).otherwise(value).alias("trade_value_usd"),
    )


CTE["clean_cube"] = """
SELECT CAST(year AS INT) AS year, reporter_iso3, partner_iso3, partner_name, flow_code, cmd_code AS hs_code,
       CASE WHEN isnan(trade_value_usd) THEN NULL ELSE trade_value_usd END AS trade_value_usd
FROM raw_cube
WHERE length(partner_iso3) = 3 AND partner_iso3 NOT IN ('WLD','W00','EUR','ASE','S19','X99','UNK','99')
  AND NOT regexp_matches(COALESCE(partner_name, ''), 'world|areas,?\\s*nes|special categories|bunkers|free zones', 'i')
"""


@query("cube_prepare", """
SELECT year, reporter_iso3, reporter_iso3 AS reporter_name, partner_iso3, partner_name, flow_code, hs_code,
       trade_value_usd, CASE flow_code WHEN 'M' THEN 'Imports' ELSE 'Exports' END AS flow_name FROM clean_cube
""")
def _(s):
    return clean.prepare_cube(raw_cube(s)).select(
        "year", "reporter_iso3", "reporter_name", "partner_iso3", "partner_name", "flow_code", "hs_code",
        "trade_value_usd", "flow_name",
    )


@query("cube_from_lines", f"""
SELECT year, reporter_iso3, partner_iso3, flow_code, hs_code, trade_value_usd, n_lines FROM cube
""")
def _(s):
    return s.cube.select("year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd", "n_lines")


CRITERIA = dict(year_min=1996, year_max=2000, reporters=["NAA", "NBB", "NCC", "NDD"], partners=["__ALL__"], flows=["M"])
WHERE = "year BETWEEN 1996 AND 2000 AND reporter_iso3 IN ('NAA','NBB','NCC','NDD') AND flow_code = 'M'"


@query("cube_filter", f"""
SELECT year, reporter_iso3, partner_iso3, flow_code, hs_code, trade_value_usd FROM cube WHERE {WHERE}
""")
def _(s):
    return clean.filter_cube(s.cube, **CRITERIA).select(
        "year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd"
    )


@query("network_observations", "SELECT year, reporter_iso3, partner_iso3, flow_code, hs_code, trade_value_usd FROM cube WHERE hs_code <> '8501' AND year >= 1996")
def _(s):
    codes = [f"85{i:02d}" for i in range(2, 26)]
    return clean.filter_cube(s.cube, year_min=1996, hs_codes=codes).select(
        "year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd"
    )


@query("drop_aggregates", """
SELECT year, reporter_iso3, partner_iso3 FROM (SELECT year, reporter_iso3, cmd_code, flow_code,
  CASE WHEN cmd_code = '8525' THEN 'WLD' ELSE partner_iso3 END AS partner_iso3 FROM raw_cube)
WHERE regexp_full_match(partner_iso3, '[A-Z]{3}') AND partner_iso3 NOT IN ('EUR','WLD','W00','ASE')
""")
def _(s):
    return clean.drop_aggregates(raw_cube(s), "partner_iso3").select("year", "reporter_iso3", "partner_iso3")


AUDIT = f"""
SELECT reason, COUNT(*) AS n_rows, COALESCE({money()}, 0) AS value
FROM (SELECT *, CASE WHEN flow_code <> 'M' THEN 'exports'
     WHEN trade_value_usd IS NULL OR trade_value_usd <= 0 THEN 'non_positive_value'
     WHEN reporter_iso3 = partner_iso3 THEN 'self_partner'
     WHEN year BETWEEN 1996 AND 2000 AND trade_value_usd < 10000 THEN 'below_min_link_value' END AS reason FROM clean_cube)
WHERE reason IS NOT NULL GROUP BY 1
"""


@query("dependency_audit", AUDIT)
def _(s):
    cube = clean.prepare_cube(raw_cube(s))
    return clean.import_audit(cube, min_link_value=10000, year_min=1996, year_max=2000)


@query("dependency_eligible", """
SELECT year, reporter_iso3, partner_iso3, hs_code, trade_value_usd FROM clean_cube
WHERE flow_code = 'M' AND trade_value_usd >= 10000 AND reporter_iso3 <> partner_iso3 AND year BETWEEN 1996 AND 2000
""")
def _(s):
    cube = clean.prepare_cube(raw_cube(s))
    return clean.eligible_imports(cube, min_link_value=10000, year_min=1996, year_max=2000).select(
        "year", "reporter_iso3", "partner_iso3", "hs_code", "trade_value_usd"
    )


CTE["reporter_ref"] = """
SELECT CASE WHEN c_custkey % 50 = 0 THEN '0' ELSE CAST(c_custkey AS VARCHAR) END AS reporter_code, c_name AS reporter_name,
       CASE WHEN c_custkey % 11 = 0 THEN 'XX' WHEN c_custkey % 13 = 0 THEN 'EUR' WHEN c_custkey % 17 = 0 THEN NULL
            ELSE 'N' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + c_custkey % 24 AS INT)) END AS iso3,
       c_mktsegment = 'HOUSEHOLD' AS is_group,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'Trade region' END AS entity_type_raw,
       CASE WHEN c_acctbal > 5000 THEN make_date(CAST(1990 + c_custkey % 20 AS BIGINT), 1, 1) END AS entry_effective_date,
       CASE WHEN c_acctbal < 0 THEN make_date(CAST(1990 + c_custkey % 12 AS BIGINT), 12, 31) END AS expiry_date
FROM customer
"""


def reporter_ref(s):
    """A reporter reference as long as the customer table."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return s.raw("customer").select(
        F.when(k % 50 == 0, "0").otherwise(k.cast("string")).alias("reporter_code"),
        F.col("c_name").alias("reporter_name"),
        F.when(k % 11 == 0, "XX").when(k % 13 == 0, "EUR").when(k % 17 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("N"), F.char(65 + k % 26), F.char(65 + k % 24))).alias("iso3"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("is_group"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Trade region").alias("entity_type_raw"),
        F.when(bal > 5000, F.make_date((1990 + k % 20).cast("int"), F.lit(1), F.lit(1))).alias("entry_effective_date"),
        F.when(bal < 0, F.make_date((1990 + k % 12).cast("int"), F.lit(12), F.lit(31))).alias("expiry_date"),
    )


CTE["reporter_typed"] = """
SELECT *, CASE WHEN reporter_code = '0' OR COALESCE(iso3 IN ('W00','WLD'), false) THEN 'special' WHEN is_group THEN 'group'
   WHEN regexp_matches(lower(COALESCE(entity_type_raw, '')), 'aggregat|group|region|union') THEN 'aggregate'
   WHEN COALESCE(iso3 IN ('EUR','WLD','W00','ASE'), false) THEN 'special'
   WHEN COALESCE(regexp_full_match(iso3, '[A-Z]{3}'), false) AND reporter_code <> '' THEN 'country_or_economy'
   ELSE 'unknown' END AS reporter_entity_type FROM reporter_ref
"""
CTE["reporter_judged"] = """
SELECT *, CASE WHEN reporter_code IN ('', '0') THEN 'invalid_or_zero_reporter_code'
   WHEN NOT COALESCE(regexp_full_match(iso3, '[A-Z]{3}'), false) THEN 'missing_or_invalid_iso3'
   WHEN reporter_entity_type = 'group' THEN 'source_metadata_group'
   WHEN reporter_entity_type = 'aggregate' THEN 'source_metadata_aggregate'
   WHEN reporter_entity_type = 'special' THEN 'special_or_defensive_denylist'
   WHEN reporter_entity_type = 'unknown' THEN 'unknown_entity_type'
   WHEN NOT (COALESCE(entry_effective_date <= DATE '2001-12-31', true) AND COALESCE(expiry_date >= DATE '1995-01-01', true))
        THEN 'inactive_for_production_years' END AS exclusion_reason FROM reporter_typed
"""


@query("reporters_classified", "SELECT reporter_code, iso3, reporter_entity_type, exclusion_reason FROM reporter_judged")
def _(s):
    return clean.classify_reporters(reporter_ref(s), 1995, 2001).select(
        "reporter_code", "iso3", "reporter_entity_type", "exclusion_reason"
    )


@query("reporters_eligible", "SELECT reporter_code, iso3, reporter_name FROM reporter_judged WHERE exclusion_reason IS NULL")
def _(s):
    return clean.split_reporters(clean.classify_reporters(reporter_ref(s), 1995, 2001))[0].select(
        "reporter_code", "iso3", "reporter_name"
    )


@query("reporters_excluded", """
SELECT reporter_code, iso3 AS reporter_iso3, reporter_name, reporter_entity_type, exclusion_reason,
       is_group AS source_is_group, CAST(entry_effective_date AS DATE) AS effective_date, CAST(expiry_date AS DATE) AS expiry_date
FROM reporter_judged WHERE exclusion_reason IS NOT NULL
""")
def _(s):
    return clean.split_reporters(clean.classify_reporters(reporter_ref(s), 1995, 2001))[1]


# ---- raw trade rows, one per order line, against the dimensions -------------------

CTE["raw_trade"] = """
SELECT strftime(ship_date, '%Y%m') AS period, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(year AS VARCHAR) END AS ref_year,
       CAST(c_nationkey + 100 AS VARCHAR) AS reporter_code, CAST(s_nationkey + 100 AS VARCHAR) AS partner_code, flow_code, hs_code AS cmd_code,
       CAST(CASE WHEN quantity < 3 THEN -value ELSE value END AS DOUBLE) AS value, ship_date, l_orderkey, l_linenumber
FROM shipments
"""


def raw_trade(s):
    q = F.col("quantity")
    return s.shipments.select(
        E.period_token("ship_date").alias("period"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("year").cast("string")).alias("ref_year"),
        (F.col("c_nationkey") + 100).cast("string").alias("reporter_code"),
        (F.col("s_nationkey") + 100).cast("string").alias("partner_code"), "flow_code",
        F.col("hs_code").alias("cmd_code"),
        E.from_cents(F.when(q < 3, -F.col("cents")).otherwise(F.col("cents"))).cast("string").alias("primary_value"),
        F.date_format("ship_date", "yyyy-MM-dd").alias("ingested_at"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber")).alias("request_id"),
    )


def dims(s):
    # Nation 24 and brand 25 are left out, so that some codes stay unmatched.
    countries = s.economies.where("n_nationkey <> 24")
    flow_dim = s.cube.select("flow_code", "flow_name").distinct()
    items = s.cube.select(
        "hs_code", F.lit(4).alias("hs_level"), F.lit("HS").alias("hs_revision"), "commodity_description"
    ).where("hs_code <> '8525'").distinct()
    return countries, flow_dim, items


CTE["trade_conformed"] = """
SELECT COALESCE(CAST(ref_year AS INT), CAST(substr(period, 1, 4) AS INT)) AS year, reporter_code, partner_code, t.flow_code,
       cmd_code AS hs_code, r.iso3 AS reporter_iso3, p.iso3 AS partner_iso3, value AS trade_value_usd, ship_date,
       CASE t.flow_code WHEN 'M' THEN 'Imports' ELSE 'Exports' END AS flow_name,
       CASE WHEN cmd_code <> '8525' THEN 'Brand ' || substr(cmd_code, 3, 2) END AS commodity_description,
       lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber AS request_id
FROM raw_trade t
LEFT JOIN (SELECT * FROM economies WHERE n_nationkey <> 24) r ON r.comtrade_code = reporter_code
LEFT JOIN (SELECT * FROM economies WHERE n_nationkey <> 24) p ON p.comtrade_code = partner_code
"""


def conformed(s):
    return clean.conform_trade(raw_trade(s), *dims(s))


@query("trade_conform", """
SELECT year, reporter_code, partner_code, flow_code, hs_code, reporter_iso3, partner_iso3, trade_value_usd, flow_name,
       commodity_description, 'HS' AS hs_revision, 4 AS hs_level, strftime(ship_date, '%Y-%m-%d') AS ingested_at
FROM trade_conformed WHERE trade_value_usd >= 0
QUALIFY row_number() OVER (PARTITION BY year, reporter_code, partner_code, flow_code, hs_code
                           ORDER BY ship_date DESC, trade_value_usd DESC, request_id DESC) = 1
""")
def _(s):
    return conformed(s)["trade"].select(
        "year", "reporter_code", "partner_code", "flow_code", "hs_code", "reporter_iso3", "partner_iso3",
        "trade_value_usd", "flow_name", "commodity_description", "hs_revision", "hs_level", "ingested_at",
    )


@query("trade_conform_unmatched", """
SELECT 'reporter' AS role, reporter_code AS code FROM trade_conformed WHERE reporter_iso3 IS NULL GROUP BY 2
UNION ALL SELECT 'partner', partner_code FROM trade_conformed WHERE partner_iso3 IS NULL GROUP BY 2
""")
def _(s):
    parts = conformed(s)
    return (
        parts["unmatched_reporters"].select(F.lit("reporter").alias("role"), F.col("reporter_code").alias("code"))
        .unionByName(parts["unmatched_partners"].select(F.lit("partner").alias("role"), F.col("partner_code").alias("code")))
        .unionByName(parts["unmatched_hs"].select(F.lit("hs").alias("role"), F.col("hs_code").alias("code")))
    )


@query("trade_conform_dropped", "SELECT COUNT(*) AS dropped_invalid_value_rows FROM trade_conformed WHERE trade_value_usd < 0")
def _(s):
    return conformed(s)["dropped"]


def records(s):
    """Payload-shaped rows: half of the lines also appear as a chapter total against World."""
    names = s.economies.select(F.col("comtrade_code").alias("reporter_code"), F.col("iso3").alias("reporter_iso3"),
                               F.col("display_name").alias("reporter_name"))
    partner = s.economies.select(F.col("comtrade_code").alias("pc"), F.col("iso3").alias("pi"), F.col("display_name").alias("pn"))
    rows = raw_trade(s).join(names, "reporter_code").join(partner, F.col("partner_code") == F.col("pc"))
    world = F.substring("request_id", -1, 1) == "1"
    return rows.select(
        "period", "ref_year", "reporter_code", "reporter_iso3", "reporter_name", "flow_code",
        F.when(world, "0").otherwise(F.col("partner_code")).alias("partner_code"),
        F.when(world, "W00").otherwise(F.col("pi")).alias("partner_iso3"),
        F.when(world, "World").otherwise(F.col("pn")).alias("partner_name"),
        F.when(world, "85").otherwise(F.col("cmd_code")).alias("cmd_code"),
        F.when(world, "2").otherwise("4").alias("aggr_level"), "primary_value", "ingested_at", "request_id",
    )


CTE["records"] = """
SELECT COALESCE(CAST(ref_year AS INT), CAST(substr(period, 1, 4) AS INT)) AS year, reporter_code, r.iso3 AS reporter_iso3, flow_code,
       CASE WHEN l_linenumber = 1 THEN '0' ELSE partner_code END AS partner_code,
       CASE WHEN l_linenumber = 1 THEN 'W00' ELSE p.iso3 END AS partner_iso3,
       CASE WHEN l_linenumber = 1 THEN '85' ELSE cmd_code END AS hs_code, value AS trade_value_usd, ship_date,
       lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber AS request_id
FROM raw_trade JOIN economies r ON r.comtrade_code = reporter_code JOIN economies p ON p.comtrade_code = partner_code
"""


@query("payload_to_global", """
SELECT year, reporter_code, reporter_iso3, flow_code, hs_code, trade_value_usd FROM records WHERE hs_code = '85'
QUALIFY row_number() OVER (PARTITION BY year, reporter_code, flow_code ORDER BY ship_date DESC, trade_value_usd DESC, request_id DESC) = 1
""")
def _(s):
    return clean.payload_to_global(records(s)).select(
        "year", "reporter_code", "reporter_iso3", "flow_code", "hs_code", "trade_value_usd"
    )


@query("append_batch", """
SELECT year, reporter_iso3, partner_iso3, flow_code, hs_code, CASE WHEN year <= 1998 THEN trade_value_usd ELSE 2 * trade_value_usd END AS trade_value_usd FROM cube
""")
def _(s):
    keys = ["year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code"]
    rows = s.cube.select(*keys, "trade_value_usd")
    batch = rows.where("year >= 1997").withColumn("trade_value_usd", 2 * F.col("trade_value_usd"))
    return clean.append_batch(rows.where("year <= 1998"), batch, keys, F.col("trade_value_usd"))


@query("payload_to_cube", """
SELECT year, reporter_code, reporter_iso3, partner_code, partner_iso3, flow_code, hs_code, trade_value_usd,
       'uv_test' AS universe_checksum
FROM records WHERE hs_code <> '85' AND hs_code <= '8520' AND CAST(reporter_code AS INT) < 120 AND CAST(partner_code AS INT) < 122
  AND year BETWEEN 1995 AND 2001
QUALIFY row_number() OVER (PARTITION BY year, flow_code, reporter_code, partner_code, hs_code
                           ORDER BY ship_date DESC, trade_value_usd DESC, request_id DESC) = 1
""")
def _(s):
    key = F.col("n_nationkey")
    out = clean.payload_to_cube(
        records(s), s.economies.where(key < 20).select(F.col("comtrade_code").alias("reporter_code")),
        s.economies.where(key < 22).select(F.col("comtrade_code").alias("partner_code")),
        s.cube.select("hs_code").where("hs_code <= '8520'").distinct(), 1995, 2001, "uv_test",
    )
    return out.select("year", "reporter_code", "reporter_iso3", "partner_code", "partner_iso3", "flow_code",
                      "hs_code", "trade_value_usd", "universe_checksum")


# ---- queries on the cube ----------------------------------------------------------

@query("flow_kpis", f"""
SELECT {money()} AS filtered_trade_value,
       CAST(SUM(CASE WHEN flow_code = 'M' THEN CAST(trade_value_usd AS DECIMAL(18,2)) END) AS DOUBLE) AS imports_value,
       CAST(SUM(CASE WHEN flow_code = 'X' THEN CAST(trade_value_usd AS DECIMAL(18,2)) END) AS DOUBLE) AS exports_value,
       COUNT(*) AS n_observations, COUNT(DISTINCT reporter_iso3) AS n_reporters,
       COUNT(DISTINCT partner_iso3) AS n_partners, COUNT(DISTINCT hs_code) AS n_hs4 FROM cube
""")
def _(s):
    return flows.kpis(clean.filter_cube(s.cube))


@query("detailed_kpis", f"""
SELECT {money()} AS filtered_trade_value, COUNT(*) AS n_observations, COUNT(DISTINCT year) AS n_years,
       COUNT(DISTINCT partner_iso3) AS n_partners, COUNT(DISTINCT hs_code) AS n_hs4 FROM cube
""")
def _(s):
    return flows.detailed_kpis(s.cube)


@query("headline", f"""
SELECT COUNT(*) AS n_trade_rows, COUNT(DISTINCT reporter_iso3) AS n_reporters, COUNT(DISTINCT partner_iso3) AS n_partners,
       {money()} AS total_trade_value, MAX(ingested_at) AS latest_ingested_at FROM cube
""")
def _(s):
    return flows.headline(s.cube)


KEYS = {
    "reporter_partner": "reporter_iso3, partner_iso3, CAST(NULL AS VARCHAR) AS hs_code, flow_code",
    "reporter_commodity": "reporter_iso3, CAST(NULL AS VARCHAR) AS partner_iso3, hs_code, flow_code",
    "reporter_commodity_partner": "reporter_iso3, hs_code, partner_iso3, flow_code",
    "reporter_partner_commodity": "reporter_iso3, partner_iso3, hs_code, flow_code",
}


def paths_sql(grouping):
    return f"""
SELECT {KEYS[grouping]}, {money()} AS value, MIN(reporter_name) AS reporter_name, MIN(partner_name) AS partner_name,
       MIN(commodity_description) AS commodity_description
FROM cube GROUP BY {', '.join(flows.GROUPINGS[grouping])}
"""


def register_paths(grouping):
    @query(f"paths_{grouping}", paths_sql(grouping))
    def _(s):
        return flows.paths(s.cube, grouping)


for _grouping in KEYS:
    register_paths(_grouping)

CTE["rpc_paths"] = paths_sql("reporter_partner_commodity")
TOP_PATHS = """
SELECT * FROM rpc_paths WHERE value >= 1000
ORDER BY value DESC, reporter_iso3, partner_iso3, hs_code, flow_code LIMIT 25
"""


@query("top_paths", TOP_PATHS)
def _(s):
    return flows.top_paths(flows.paths(s.cube), 25, 1000).visible


@query("top_paths_coverage", f"""
SELECT t.total AS total_value, ROUND(t.total - v.v, 2) AS other_value, ROUND(100 * v.v / t.total, 6) AS coverage_pct,
       v.n AS n_visible, t.n AS n_total
FROM (SELECT {money('value')} AS total, COUNT(*) AS n FROM rpc_paths) t,
     (SELECT {money('value')} AS v, COUNT(*) AS n FROM ({TOP_PATHS})) v
""")
def _(s):
    out = flows.top_paths(flows.paths(s.cube), 25, 1000).summary
    return rounded(rounded(out, "other_value", digits=2), "coverage_pct")


DIAGRAM_EDGES = f"""
SELECT source_id, target_id, {money('value')} AS value, MIN(source_label) AS source_label, MIN(target_label) AS target_label
FROM (SELECT 'reporter_' || reporter_iso3 AS source_id, 'partner_' || partner_iso3 AS target_id, value,
             reporter_name || ' [reporter]' AS source_label, partner_name || ' [partner]' AS target_label FROM ({TOP_PATHS})
      UNION ALL
      SELECT 'partner_' || partner_iso3, 'commodity_' || hs_code, value, partner_name || ' [partner]',
             hs_code || ' — ' || commodity_description || ' [HS4]' FROM ({TOP_PATHS}))
GROUP BY 1, 2
"""
CTE["diagram_edges"] = DIAGRAM_EDGES
CTE["diagram_nodes"] = """
SELECT id, MIN(name) AS name, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS idx
FROM (SELECT source_id AS id, source_label AS name FROM diagram_edges UNION ALL SELECT target_id, target_label FROM diagram_edges)
GROUP BY id
"""


@query("flow_diagram_nodes", "SELECT id, name, idx, regexp_extract(id, '^[a-z]+') AS role FROM diagram_nodes")
def _(s):
    return flows.flow_diagram(flows.top_paths(flows.paths(s.cube), 25, 1000).visible)[1]


@query("flow_diagram_links", """
SELECT source_id, target_id, value, a.idx AS source, b.idx AS target FROM diagram_edges
JOIN diagram_nodes a ON a.id = source_id JOIN diagram_nodes b ON b.id = target_id
""")
def _(s):
    links, _nodes = flows.flow_diagram(flows.top_paths(flows.paths(s.cube), 25, 1000).visible)
    return links.select("source_id", "target_id", "value", "source", "target")


@query("flow_time_series", f"""
SELECT year, CASE flow_code WHEN 'M' THEN 'Imports' ELSE 'Exports' END AS series, {money()} AS value FROM cube GROUP BY 1, flow_code
""")
def _(s):
    return flows.time_series(s.cube).visible


def register_series(mode, key):
    @query(f"flow_series_{mode}", f"""
SELECT year, {key} AS series, {money()} AS value FROM cube
WHERE {key} IN (SELECT {key} FROM cube GROUP BY 1 ORDER BY {money()} DESC, 1 LIMIT 6) GROUP BY 1, 2
""")
    def _(s):
        return flows.time_series(s.cube, 6, mode).visible

    @query(f"flow_series_{mode}_rest", f"""
SELECT '{mode}' AS mode, ROUND({money()} - {money(f"CASE WHEN {key} IN (SELECT {key} FROM cube GROUP BY 1 ORDER BY {money()} DESC, 1 LIMIT 6) THEN trade_value_usd ELSE 0 END")}, 2) AS remainder_value
FROM cube
""")
    def _(s):
        return rounded(flows.time_series(s.cube, 6, mode).summary, "remainder_value", digits=2)


register_series("top_partners", "partner_iso3")
register_series("top_commodities", "hs_code")


COMPOSITION = f"""
SELECT CASE WHEN rk <= 12 THEN hs_code ELSE 'OTHER' END AS hs_code, {money('value')} AS value,
       MIN(CASE WHEN rk <= 12 THEN description ELSE 'Other HS4 (outside top-N)' END) AS commodity_description,
       ROUND(100 * {money('value')} / ANY_VALUE(total), 6) AS share_pct
FROM (SELECT *, row_number() OVER (ORDER BY value DESC, hs_code) AS rk,
             CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER () AS DOUBLE) AS total
      FROM (SELECT hs_code, {money()} AS value, MIN(commodity_description) AS description FROM cube GROUP BY 1)) GROUP BY 1
"""


@query("commodity_composition", COMPOSITION)
def _(s):
    return rounded(flows.composition(s.cube).visible.drop("label"), "share_pct")


@query("commodity_composition_coverage", f"""
SELECT {money('value')} AS total, COALESCE({money("CASE WHEN hs_code = 'OTHER' THEN value END")}, 0) AS other_value,
       ROUND(100 * ({money('value')} - COALESCE({money("CASE WHEN hs_code = 'OTHER' THEN value END")}, 0)) / {money('value')}, 6) AS coverage_pct
FROM ({COMPOSITION})
""")
def _(s):
    return rounded(flows.composition(s.cube).summary, "coverage_pct")


@query("commodity_treemap", f"""
SELECT hs_code, value, commodity_description, ROUND(100 * value / SUM(value) OVER (), 6) AS share_pct,
       hs_code || ' — ' || substr(commodity_description, 1, 40) AS label
FROM (SELECT CASE WHEN rk <= 15 THEN hs_code ELSE 'OTHER' END AS hs_code, {money('value')} AS value,
             MIN(CASE WHEN rk <= 15 THEN d ELSE 'Other HS4 (outside top-N)' END) AS commodity_description
      FROM (SELECT *, row_number() OVER (ORDER BY value DESC, hs_code) AS rk
            FROM (SELECT hs_code, {money()} AS value, MIN(commodity_description) AS d FROM cube WHERE {WHERE} GROUP BY 1)) GROUP BY 1)
""")
def _(s):
    return rounded(flows.treemap(s.cube, **CRITERIA).visible, "share_pct")


@query("trend_by_keys", f"""
SELECT year, flow_code, hs_code, {money()} AS value, COUNT(*) AS n_obs,
       CASE flow_code WHEN 'M' THEN 'Imports' ELSE 'Exports' END AS series FROM cube GROUP BY 1, 2, 3
""")
def _(s):
    return flows.trend(s.cube, ("year", "flow_code", "hs_code"))


CTE["hs_trend"] = f"SELECT year, hs_code AS series, {money()} AS value FROM cube GROUP BY 1, 2"


def hs_trend(s):
    return flows.trend(s.cube, ("year", "hs_code")).withColumnRenamed("hs_code", "series")


@query("top_series", f"""
SELECT year, series, value FROM hs_trend WHERE series IN (SELECT series FROM hs_trend GROUP BY 1 ORDER BY {money('value')} DESC, 1 LIMIT 6)
""")
def _(s):
    return flows.top_series(hs_trend(s)).visible.select("year", "series", "value")


@query("top_series_coverage", f"""
SELECT ROUND({money('value')} - {money('CASE WHEN top THEN value ELSE 0 END')}, 2) AS other_value,
       ROUND(100 * {money('CASE WHEN top THEN value ELSE 0 END')} / {money('value')}, 6) AS coverage_pct,
       COUNT(DISTINCT series) AS n_total, COUNT(DISTINCT CASE WHEN top THEN series END) AS n_visible
FROM (SELECT *, series IN (SELECT series FROM hs_trend GROUP BY 1 ORDER BY {money('value')} DESC, 1 LIMIT 6) AS top FROM hs_trend)
""")
def _(s):
    return rounded(rounded(flows.top_series(hs_trend(s)).summary, "other_value", digits=2), "coverage_pct")


CTE["matrix_cells"] = f"""
SELECT r.reporter_iso3, p.partner_iso3, c.value, c.value IS NOT NULL AS observed
FROM (SELECT DISTINCT reporter_iso3 FROM cube) r CROSS JOIN (SELECT DISTINCT partner_iso3 FROM cube) p
LEFT JOIN (SELECT reporter_iso3, partner_iso3, {money()} AS value FROM cube WHERE flow_code = 'M' GROUP BY 1, 2) c
USING (reporter_iso3, partner_iso3)
"""


@query("pair_matrix_imports", "SELECT * FROM matrix_cells")
def _(s):
    return flows.pair_matrix(s.cube, "imports")


@query("pair_matrix_counts", """
SELECT reporter_iso3, partner_iso3, CAST(COUNT(*) AS DOUBLE) AS value, true AS observed FROM cube GROUP BY 1, 2
""")
def _(s):
    return flows.pair_matrix(s.cube, "observation_count").where("observed")


@query("pair_matrix_order", f"""
SELECT reporter_iso3, {money('value')} AS tot, CAST(row_number() OVER (ORDER BY {money('value')} DESC, reporter_iso3) AS INT) AS position
FROM matrix_cells WHERE value IS NOT NULL GROUP BY 1
""")
def _(s):
    return flows.matrix_order(flows.pair_matrix(s.cube, "imports"), "reporter_iso3")


@query("safe_columns", """
SELECT reporter_iso3, SUM(n) AS n_rows FROM (SELECT reporter_iso3, COUNT(*) AS n FROM cube GROUP BY 1) GROUP BY 1
""".replace("SUM(n)", "CAST(SUM(n) AS BIGINT)"))
def _(s):
    tagged = s.cube.withColumns({"raw_file": F.lit("a"), "api_key": F.lit("b"), "source_url": F.lit("c")})
    kept = clean.safe_columns(tagged)
    if {"raw_file", "api_key", "source_url"} & set(kept.columns):
        raise AssertionError("unsafe column kept")
    return kept.groupBy("reporter_iso3").agg(F.count("*").alias("n_rows"))
