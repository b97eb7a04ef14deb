"""Company tables derived from the star schema, which holds no company names, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = """concat('K', cast(p_partkey % 5000 as string), ' ', p_name, case p_partkey % 12
 when 0 then ', Inc.' when 1 then ' Holdings Ltd' when 2 then ' Technologies Corp.' when 3 then concat(' (owned by ', p_brand, ' Group)')
 when 4 then ' S. A.' when 5 then ' and affiliates' when 6 then '-OLD' when 8 then concat(' / ', p_type, ' Co')
 when 9 then concat(' and ', p_type, ' Ltd') when 10 then concat('''s ', p_type) else '' end)"""
BRIDGE_NAME = """concat('K', cast(p_partkey % 5000 as string), ' ', p_name, case p_partkey % 5 when 0 then ' INC' when 1 then ' HOLDINGS LTD' when 2 then ' TECH CORP' when 3 then ' S A' else ' GLOBAL WIDGETS' end)"""
SOURCE = "case p_partkey % 5 when 0 then 'DISCERN' when 1 then 'CCM_COMPUSTAT_EXTENSION' when 2 then 'COMPUSTAT_US' when 3 then 'SEC_HEADER' else 'COMPUSTAT_GLOBAL' end"
CIK = "case when p_partkey % 3 = 0 then null else concat(cast(p_partkey as string), '.0') end"
GVKEY = "case when p_partkey % 4 = 1 then '-1' else lpad(cast(p_partkey as string), 6, '0') end"


def companies(part: DataFrame) -> DataFrame:
    """p_partkey and a decorated raw name; every thirteenth begins in lower case."""
    return part.selectExpr("p_partkey", f"case when p_partkey % 13 = 0 then lower({RAW}) else {RAW} end as raw")


def bridge(part: DataFrame) -> DataFrame:
    """name_original, fyear, cik, gvkey, source: two consecutive years for each part."""
    rows = part.selectExpr("p_partkey", f"{BRIDGE_NAME} as name_original", f"{CIK} as cik", f"{GVKEY} as gvkey", f"{SOURCE} as source")
    first = (F.col("p_partkey") % 6 + 1995).cast("int")
    return rows.withColumn("fyear", F.explode(F.array(first, first + 1))).drop("p_partkey")


def mentions(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """raw, fyear, n: how many line items mention a part's company in a year; counted before names are joined."""
    years = orders.select("o_orderkey", F.year("o_orderdate").alias("fyear"))
    counted = lineitem.select("l_orderkey", "l_partkey").join(years, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey", "fyear").agg(F.count("*").alias("n"))
    return counted.join(companies(part), F.col("l_partkey") == F.col("p_partkey")).select("raw", "fyear", "n")


def duck(expression: str) -> str:
    """The same expression in DuckDB's types."""
    return expression.replace("as string", "as varchar")


COMPANIES_SQL = f"companies as (select p_partkey, case when p_partkey % 13 = 0 then lower({duck(RAW)}) else {duck(RAW)} end raw from part)"
BRIDGE_SQL = f"""bridge as (select {duck(BRIDGE_NAME)} name_original, (p_partkey % 6 + 1995 + y)::int fyear, {duck(CIK)} cik, {duck(GVKEY)} gvkey, {SOURCE} source
 from part, (values (0), (1)) v(y))"""
MENTIONS_SQL = """mentions as (select raw, fyear, n from (select l_partkey, year(o_orderdate)::int fyear, count(*) n from lineitem join orders on l_orderkey = o_orderkey group by all)
 join companies on l_partkey = p_partkey)"""
