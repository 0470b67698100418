"""The driver's tables in the roles of the engine's own inputs.

Each role is one SQL text that both engines accept, so a query and its twin
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LARGE = {"lineitem", "orders", "documents", "events", "conversations", "pages"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One table. A file with fewer splits than task slots (one row group, here)
    would be read by a single task, so its rows are spread; with many files the
    scan is left alone."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    if name not in LARGE:
        return df
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(slots) if splits < slots else df


def _dates(fmt_spark: bool) -> str:
    return "date_format(o_orderdate, 'yyyyMMdd')" if fmt_spark else "strftime(o_orderdate, '%Y%m%d')"


def _raw_lines_sql(spark_side: bool) -> str:
    bigint_text = "cast(cast(l_quantity as bigint) as string)" if spark_side else "cast(cast(l_quantity as bigint) as varchar)"
    s = "string" if spark_side else "varchar"
    return f"""
select case when l_partkey % 97 = 0 then concat(' test-', cast(l_partkey as {s}), ' ')
            else concat(' ', cast(l_partkey as {s}), ' ') end as OBITNO,
       {_dates(spark_side)} as OBRGDT,
       case when l_linenumber = 7 and l_suppkey % 5 = 0 then 'n/a'
            when l_returnflag = 'R' and l_discount > 0.05 then concat('-', {bigint_text})
            else {bigint_text} end as OBORQT,
       replace(cast(case when l_returnflag = 'R' and l_discount > 0.05 then -l_extendedprice
                         else l_extendedprice end as {s}), '.', ',') as NET_LINE,
       replace(cast(p_size / cast(10 as double) as {s}), '.', ',') as MMNEWE,
       concat(p_name, ' ', p_type, case when l_linenumber > 3 then ' No. 12-XX unique' else ' for the home' end) as DESCRIPT,
       concat(' ', cast(l_orderkey as {s}), ' ') as OBCUOR,
       concat(cast(o_custkey as {s}), '  ') as OACUNO,
       concat(' C', cast(c_nationkey as {s})) as OKCSCD,
       case when l_suppkey % 11 = 0 then '54210' when l_suppkey % 7 = 0 then null
            else cast(10000 + l_suppkey as {s}) end as MMITCL,
       cast(l_linenumber as {s}) as OBPONR, 'x' as MBBCOS, 'x' as MMITGR, 'x' as OKCUNM, 'x' as MBLEAT
from lineitem join orders on l_orderkey = o_orderkey
     join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
"""


RAW_LINES = _raw_lines_sql(False)
MAPPING = """
select concat(cast(p_partkey as varchar), ' ', p_name) as OBITNO,
       substr('ABCDE', cast(p_partkey % 5 as int) + 1, 1) as category
from part where p_partkey % 8 = 0
"""


def _sql(spark: SparkSession, d: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    for t in tables:
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(text)


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as padded, decimal-comma text, as an extract delivers them."""
    return _sql(spark, d, _raw_lines_sql(True), ("lineitem", "orders", "customer", "part"))


def mapping(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, MAPPING.replace("varchar", "string"), ("part",))
