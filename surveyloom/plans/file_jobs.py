"""Text files: the driver's tables written and read again in the formats of statistical offices."""

from ..sources import files as S
from ..sources.storage import new_path
from .registry import query

_LAYOUT = {"c_custkey": (0, 12), "c_nationkey": (12, 15), "c_mktsegment": (15, 30)}


def customer(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("s01_fixed_width", "select rpad(c_mktsegment, 15, ' ') c_mktsegment, rpad(c_custkey::varchar, 12, ' ') c_custkey from customer")
def s01(spark, d):
    path = new_path(spark)
    S.write_fixed_width(customer(spark, d), path, _LAYOUT)
    return S.read_fixed_width(spark, path, _LAYOUT, ["c_mktsegment", "c_custkey"])


@query("s03_text_table", "select c_custkey::varchar c_custkey, try_cast(nullif(trim(c_mktsegment), '') as bigint) c_mktsegment, c_nationkey from customer")
def s03(spark, d):
    path = new_path(spark)
    S.write_locale_table(customer(spark, d), path)
    return S.read_text_table(spark, path, ["c_custkey", "c_mktsegment", "c_nationkey"], {"c_mktsegment": "long", "c_nationkey": "int"})


@query("s04_decimal_comma", "select c_custkey::varchar c_custkey, round(c_acctbal, 6) c_acctbal from customer")
def s04(spark, d):
    path = new_path(spark)
    S.write_locale_table(customer(spark, d), path, "ISO-8859-1")
    return S.read_decimal_comma(spark, path, ["c_custkey", "c_acctbal"], ["c_acctbal"])


@query("s16_locale_table", "select c_custkey::varchar c_custkey, replace(c_acctbal::decimal(38,6)::varchar, '.', ',') c_acctbal from customer")
def s16(spark, d):
    path = new_path(spark)
    S.write_locale_table(customer(spark, d).select("c_custkey", "c_acctbal"), path)
    return S.read_text_table(spark, path, ["c_custkey", "c_acctbal"], {})
