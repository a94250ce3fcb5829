"""Survey tables seen in the driver's tables: persons in `orders`, their households in `customer`, pixels in `lineitem`.

Expressions are plain SQL that Spark and other engines read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PERSONS = [
    "case cast(year(o_orderdate) as bigint) % 4 when 0 then 1991 when 1 then 2000 when 2 then 2010 else 2022 end as censo",
    "cast(o_custkey as bigint) as controle",
    "cast(o_orderkey as bigint) as pessoa",
    "cast(c_nationkey as bigint) as ap",
    "cast(1 + c_custkey % 7 as double) as peso",
    "case when c_custkey % 5 < 3 then 'urbana' when c_custkey % 5 = 3 then 'rural' end as situacao",
    "cast(nullif(o_orderkey * 37 % 97, 96) as int) as idade",
    "cast(o_orderkey % 3 as string) as sexo_cod",
    "cast(o_orderkey % 7 as string) as raca_cod",
    "cast(o_orderkey % 19 as int) as anos_estudo",
    "c_mktsegment as segmento",
    "o_orderpriority as prioridade",
    "o_orderstatus as status",
    "case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 0.0 else o_totalprice / 100 end as renda",
    "cast(nullif(o_orderkey % 9, 8) as int) as tempo_moradia",
    "lpad(cast(o_orderkey % 100 as string), 2, '0') as divisao",
    "cast(o_orderkey % 5 as string) as migracao_cod",
    "lpad(cast(nullif(o_orderkey % 25, 24) as string), 2, '0') as uf_origem",
    "lpad(cast(c_nationkey as string), 2, '0') as uf_atual",
    "lpad(cast(nullif(o_orderkey % 50, 49) as string), 7, '0') as mun_origem",
    "lpad(cast(c_custkey % 50 as string), 7, '0') as mun_atual",
    "case when o_orderkey % 3 = 0 then '2' else '1' end as nunca_mudou",
    "cast(year(o_orderdate) as int) as ano",
]
DWELLINGS = [
    "cast(c_custkey as bigint) as controle",
    "cast(c_nationkey as bigint) as ap",
    "cast(1 + c_custkey % 7 as double) as peso",
    "c_mktsegment as tipo",
    "case when c_custkey % 7 = 0 then null else c_custkey % 2 = 0 end as agua",
    "c_custkey % 3 > 0 as esgoto",
    "c_custkey % 5 > 1 as lixo",
    "cast(c_custkey % 9 as double) / 2 as densidade",
]
PIXELS = [
    "cast(year(l_shipdate) as int) as year",
    # A strip of 40 columns whose length grows with the orders, so patches and neighbourhoods grow with the table.
    "cast(floor(l_orderkey / 400) as int) as row",
    "cast(floor(l_orderkey / 10) as int) % 40 as col",
    "cast(l_orderkey as bigint) as scene",
    "cast(l_linenumber as int) as qa",
    "l_quantity as red",
    "l_extendedprice / 1000 as nir",
    "l_discount * 100 as swir",
    "l_tax * 100 as green",
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(*PERSONS)


def dwellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(*DWELLINGS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*PIXELS)


COLS = 40


def rows_of(table: DataFrame) -> int:
    """Rows of a pixel table's grid."""
    return int(table.agg({"row": "max"}).first()[0] or 0) + 1


WITH = f"""with persons as (select {', '.join(PERSONS)} from orders join customer on o_custkey = c_custkey),
dwellings as (select {', '.join(DWELLINGS)} from customer),
pixels as (select {', '.join(PIXELS)} from lineitem)
"""
