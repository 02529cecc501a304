"""JSON payloads -> typed rows.

Every parser takes a table of payload bodies (``request_id``, ``value``), one document
per row, so it runs on files, on a landing stream or on a column of another table alike.
Keys come in two spellings that differ only in case: records are read as string maps or,
where the keys are known beforehand, as structs whose fields are then named by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "array<map<string,string>>"
TRADE_DOCUMENT = "struct<count:bigint,statusCode:int,message:string,data:{0},dataset:{0},_corrupt:string>"

# Output column -> (payload keys by priority, type).
TRADE_FIELDS = {
    "period": (("period", "Period"), "string"),
    "ref_year": (("refYear", "RefYear"), "double"),
    "reporter_code": (("reporterCode", "ReporterCode"), "string"),
    "reporter_iso3": (("reporterISO", "ReporterISO"), "string"),
    "reporter_name": (("reporterDesc", "ReporterDesc"), "string"),
    "flow_code": (("flowCode", "FlowCode"), "string"),
    "flow_name": (("flowDesc", "FlowDesc"), "string"),
    "partner_code": (("partnerCode", "PartnerCode"), "string"),
    "partner_iso3": (("partnerISO", "PartnerISO"), "string"),
    "partner_name": (("partnerDesc", "PartnerDesc"), "string"),
    "partner2_code": (("partner2Code", "Partner2Code"), "string"),
    "partner2_iso3": (("partner2ISO", "Partner2ISO"), "string"),
    "partner2_name": (("partner2Desc", "Partner2Desc"), "string"),
    "classification_search_code": (("classificationSearchCode", "ClassificationSearchCode"), "string"),
    "classification_code": (("classificationCode", "ClassificationCode"), "string"),
    "cmd_code": (("cmdCode", "CmdCode"), "string"),
    "cmd_desc": (("cmdDesc", "CmdDesc"), "string"),
    "aggr_level": (("aggrLevel", "AggrLevel"), "double"),
    "is_leaf": (("isLeaf", "IsLeaf"), "string"),
    "primary_value": (("primaryValue", "PrimaryValue"), "double"),
    "net_wgt": (("netWgt", "NetWgt"), "double"),
    "qty": (("qty", "Qty"), "double"),
    "qty_unit": (("qtyUnitAbbr", "QtyUnitAbbr", "qtyUnitCode"), "string"),
    "customs_code": (("customsCode", "CustomsCode"), "string"),
    "mot_code": (("motCode", "MotCode"), "string"),
    "is_reported": (("isReported", "IsReported"), "string"),
    "is_aggregate": (("isAggregate", "IsAggregate"), "string"),
}
PILOT_FIELDS = {
    "period": (("period", "Period"), "string"),
    "reporter_code": (("reporterCode", "ReporterCode"), "string"),
    "reporter_desc": (("reporterDesc", "ReporterDesc"), "string"),
    "partner_code": (("partnerCode", "PartnerCode"), "string"),
    "partner_desc": (("partnerDesc", "PartnerDesc"), "string"),
    "flow_code": (("flowCode", "FlowCode"), "string"),
    "flow_desc": (("flowDesc", "FlowDesc"), "string"),
    "cmd_code": (("cmdCode", "CmdCode"), "string"),
    "cmd_desc": (("cmdDesc", "CmdDesc"), "string"),
    "customs_code": (("customsCode", "CustomsCode"), "string"),
    "mot_code": (("motCode", "MotCode"), "string"),
    "primary_value": (("primaryValue", "PrimaryValue"), "double"),
    "net_wgt": (("netWgt", "NetWgt"), "double"),
    "qty": (("qty", "Qty"), "double"),
    "qty_unit": (("qtyUnitAbbr", "QtyUnitAbbr", "qtyUnitCode"), "string"),
    "ref_year": (("refYear", "RefYear"), "double"),
    "ref_month": (("refMonth", "RefMonth"), "double"),
    "is_leaf": (("isLeaf", "IsLeaf"), "string"),
    "aggr_level": (("aggrLevel", "AggrLevel"), "double"),
}
MONTHLY_FIELDS = {
    "period": (("period", "Period"), "string"),
    "reporter_code": (("reporterCode", "rtCode"), "string"),
    "reporter_iso3": (("reporterISO", "rtISO"), "string"),
    "reporter_name": (("reporterDesc", "rtTitle"), "string"),
    "partner_code": (("partnerCode", "ptCode"), "string"),
    "partner_iso3": (("partnerISO", "ptISO"), "string"),
    "partner_name": (("partnerDesc", "ptTitle"), "string"),
    "flow_code": (("flowCode",), "string"),
    "flow_name": (("flowDesc",), "string"),
    "hs_revision": (("classificationCode",), "string"),
    "hs_code": (("cmdCode",), "string"),
    "commodity_description": (("cmdDesc",), "string"),
    "trade_value_usd": (("primaryValue", "TradeValue"), "double"),
    "source_updated_at": (("isLatestPeriod",), "string"),
}
AVAILABILITY_FIELDS = {
    "reporter_code": (("reporterCode",), "string"),
    "reporter_iso3": (("reporterISO",), "string"),
    "reporter_name": (("reporterDesc",), "string"),
    "period": (("period",), "string"),
    "classification": (("classificationCode",), "string"),
    "classification_search": (("classificationSearchCode",), "string"),
    "total_records": (("totalRecords",), "int"),
    "first_released": (("firstReleased",), "string"),
    "last_released": (("lastReleased",), "string"),
}
REPORTER_FIELDS = {
    "reporter_code": (("reporterCode", "id"), "string"),
    "reporter_name": (("reporterDesc", "text", "reporterNote"), "string"),
    "iso2": (("reporterCodeIsoAlpha2", "iso2"), "string"),
    "iso3": (("reporterCodeIsoAlpha3", "iso3"), "string"),
    "entry_effective_date": (("entryEffectiveDate", "entry_effective_date"), "date"),
    "expiry_date": (("expiryDate", "exitEffectiveDate", "expiry_date"), "date"),
    "is_group": (("isGroup", "is_group", "group"), "boolean"),
    "is_aggregate_flag": (("isAggregate", "is_aggregate", "aggregate", "isRegion", "is_region"), "boolean"),
    "entity_type_raw": (("entityType", "entity_type", "type", "reporterType"), "string"),
}


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("request_id"), "value")


def _of_map(record: Column, key: str) -> Column:
    return F.try_element_at(record, F.lit(key))


def _numbered(fields: dict) -> dict:
    """Field of a record struct per key of ``fields``."""
    return {k: f"k{i}" for i, k in enumerate(dict.fromkeys(k for keys, _kind in fields.values() for k in keys))}


def pick(fields: dict) -> list[Column]:
    """Every field of ``r``, cast; a value that does not parse is NULL."""
    out = []
    for name, (_keys, kind) in fields.items():
        raw = F.col(f"r.{name}")
        if kind == "date":
            typed = F.substring(raw, 1, 10).try_cast("date")
        elif kind == "boolean":
            typed = F.coalesce(raw.try_cast("boolean"), F.lit(False))
        else:
            typed = raw if kind == "string" else raw.try_cast("double" if kind == "int" else kind).cast(kind)
        out.append(typed.alias(name))
    return out


def trade_documents(bodies: DataFrame, fields: dict | None = None) -> DataFrame:
    """Payloads with their records and counts; malformed documents are flagged.

    With ``fields`` a record is a struct of those fields' keys, by number, and no other key is kept.
    """
    def parsed_as(record):
        return F.from_json("value", TRADE_DOCUMENT.format(record), {"columnNameOfCorruptRecord": "_corrupt"})

    kind, doc = RECORDS, parsed_as(RECORDS)
    if fields:
        names = _numbered(fields)
        kind = f"array<struct<{','.join(f'{n}:string' for n in names.values())}>>"
        doc = parsed_as(f"array<struct<{','.join(f'`{k}`:string' for k in names)}>>").cast(TRADE_DOCUMENT.format(kind))
    parsed = bodies.select("request_id", doc.alias("d"))
    return parsed.select(
        "request_id", (F.col("d").isNull() | F.col("d._corrupt").isNotNull()).alias("malformed"), F.col("d.statusCode").alias("status_code"),
        F.coalesce("d.data", "d.dataset", F.array().cast(kind)).alias("records"), F.col("d.count").alias("total"))


def payload_status(documents: DataFrame) -> DataFrame:
    """Per payload: usable or not, returned and announced records, truncated or not."""
    n = F.size("records").cast("bigint")
    return documents.select(
        "request_id", F.when(F.col("malformed"), "malformed").when(F.col("status_code") >= 400, "rejected").otherwise("ok").alias("status"),
        n.alias("returned_count"), F.coalesce("total", n).alias("total_count"), F.coalesce(F.col("total") > n, F.lit(False)).alias("is_truncated"))


def _exploded(rows: DataFrame, records, fields: dict, value_of=_of_map) -> DataFrame:
    """One row per record of an array, as the text of the first present key per field.

    Keys are looked up inside the array: lookups of many fields in one projection make a method
    that is too long to be compiled.  A filter below the generator would parse each document once
    per condition, and Spark infers one from a plain ``explode``; none is inferred from the outer form.
    """
    found = F.transform(records, lambda r: F.struct(*[F.coalesce(*[value_of(r, k) for k in keys]).alias(name) for name, (keys, _kind) in fields.items()]))
    return rows.select("request_id", F.posexplode_outer(found).alias("_at", "r")).where(F.col("_at").isNotNull()).drop("_at")


def _records(bodies: DataFrame, fields: dict) -> DataFrame:
    usable = ~F.col("malformed") & ~F.coalesce(F.col("status_code") >= 400, F.lit(False))
    names = _numbered(fields)
    return _exploded(trade_documents(bodies, fields), F.when(usable, F.col("records")), fields, lambda r, k: r.getField(names[k]))


def trade_records(bodies: DataFrame, fields: dict | None = None) -> DataFrame:
    """Records of usable payloads; ``fields`` holds the fields to return, every trade field by default."""
    return _records(bodies, fields or TRADE_FIELDS).select("request_id", *pick(fields or TRADE_FIELDS))


def monthly_records(bodies: DataFrame) -> DataFrame:
    rows = trade_records(bodies, MONTHLY_FIELDS)
    return rows.withColumn("year", F.substring("period", 1, 4).try_cast("int")).withColumn("month", F.substring("period", 5, 2).try_cast("int"))


def _listed(bodies: DataFrame, fields: dict, keys=("data", "results", "dataset")) -> DataFrame:
    """Records of the first present key, one level of nesting undone."""
    raw = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys])
    flat, nested = F.from_json(raw, RECORDS), F.flatten(F.from_json(raw, f"array<{RECORDS}>"))
    known = F.filter(flat, lambda r: r.isNotNull() & (F.size(r) > 0))
    return _exploded(bodies, F.when(F.size(known) > 0, known).otherwise(nested), fields)


def availability_records(bodies: DataFrame) -> DataFrame:
    rows = _listed(bodies, AVAILABILITY_FIELDS, ("data", "results")).select(*pick(AVAILABILITY_FIELDS)).where(F.col("reporter_code").isNotNull())
    return rows.withColumn("year", F.substring("period", 1, 4).try_cast("int")).withColumn("availability_status", F.lit("available")).drop("period")


def reporter_records(bodies: DataFrame) -> DataFrame:
    return _listed(bodies, REPORTER_FIELDS, ("results", "data", "dataset")).select(*pick(REPORTER_FIELDS))


INDICATOR_ROW = ("array<struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,countryiso3code:string,"
                 "date:string,value:string>>")


def indicator_pages(bodies: DataFrame) -> DataFrame:
    """Announced pages per payload; an error document is a one-element array with a message."""
    return bodies.select(
        "request_id", F.coalesce(F.get_json_object("value", "$[0].pages").try_cast("int"), F.lit(1)).alias("pages"),
        F.get_json_object("value", "$[0].message").isNotNull().alias("is_error"))


def indicator_records(bodies: DataFrame) -> DataFrame:
    rows = bodies.select("request_id", F.explode(F.from_json(F.get_json_object("value", "$[1]"), INDICATOR_ROW)).alias("r"))
    return rows.select(
        F.coalesce(F.nullif("r.countryiso3code", F.lit("")), "r.country.id").alias("iso3"), F.col("r.country.value").alias("country_name"),
        F.col("r.date").try_cast("int").alias("year"), F.col("r.indicator.id").alias("indicator_code"), F.col("r.indicator.value").alias("indicator_name"),
        F.col("r.value").try_cast("double").alias("value"), "request_id")


COUNTRY_ROW = ("array<struct<id:string,iso2Code:string,name:string,region:struct<value:string>,incomeLevel:struct<value:string>,capitalCity:string>>")


def country_records(bodies: DataFrame) -> DataFrame:
    rows = bodies.select(F.explode(F.from_json(F.get_json_object("value", "$[1]"), COUNTRY_ROW)).alias("r"))
    return rows.select(
        F.col("r.id").alias("world_bank_code"), F.col("r.iso2Code").alias("iso2"), F.col("r.name").alias("country_name"),
        F.col("r.region.value").alias("region"), F.col("r.incomeLevel.value").alias("income_level"), F.col("r.capitalCity").alias("capital_city"),
        F.coalesce(F.lower("r.region.value").contains("aggregat"), F.lit(False)).alias("is_aggregate"))
