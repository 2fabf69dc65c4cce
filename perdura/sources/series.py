"""Series from any table: long rows (series_id, t, v) or packed rows (series_id, n, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_to_series(df: DataFrame, key: Column | str, order: list[str], value: Column | str) -> DataFrame:
    """Long series: t counts from 0 in order of the order columns; null values are left out.

    One shuffle, by series; every later step by series reuses that partitioning.
    """
    key, value = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    rows = df.select(key.cast("string").alias("series_id"), value.cast("double").alias("v"), *order).filter("v is not null")
    t = F.row_number().over(Window.partitionBy("series_id").orderBy(*order)) - 1
    return rows.select("series_id", t.cast("long").alias("t"), "v")


def table_to_blocks(df: DataFrame, key: Column | str, order: list[str], value: Column | str, blocks: int) -> DataFrame:
    """Long series as table_to_series gives them, with block, for series too long for one task.

    A block is a range of the first order column, the same for all series, with bounds at its
    approximate quantiles (one pass, which yields blocks - 1 values). Rows are shuffled by
    series and block; t counts on from the series' earlier blocks, whose sizes are a small table.
    """
    key, value = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    rows = df.select(key.cast("string").alias("series_id"), value.cast("double").alias("v"), *order).filter("v is not null")
    at = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(rows.agg(F.percentile_approx(order[0], at)).first()[0] or [])) if at else []
    block = sum(((F.col(order[0]) >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    rows = rows.withColumn("block", block)
    t = F.row_number().over(Window.partitionBy("series_id", "block").orderBy(*order)) - 1
    numbered = rows.withColumn("t", t.cast("long"))
    return before_blocks(numbered, F.count(F.lit(1)).alias("rows")).select("series_id", "block", (F.col("t") + F.col("rows")).alias("t"), "v")


def before_blocks(rows: DataFrame, *sums: Column) -> DataFrame:
    """rows (series_id, block, ...) with each sum over the series' earlier blocks, 0 in the first."""
    each = rows.groupBy("series_id", "block").agg(*sums)
    names = [c for c in each.columns if c not in ("series_id", "block")]
    earlier = Window.partitionBy("series_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(each.select("series_id", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names]), ["series_id", "block"])


def pack(long: DataFrame) -> DataFrame:
    """series_id, n and values, in order of t."""
    rows = long.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("x"))
    return rows.select("series_id", F.size("x").cast("long").alias("n"), F.transform("x", lambda r: r["v"]).alias("values"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("series_id", F.posexplode("values").alias("t", "v")).withColumn("t", F.col("t").cast("long"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_to_series(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_to_series(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def revenue_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue by return flag; a day is one step."""
    daily = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return table_to_series(daily, "l_returnflag", ["l_shipdate"], "revenue")


def price_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.avg("o_totalprice").alias("price"))
    return table_to_series(daily, "o_orderpriority", ["o_orderdate"], "price")


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("series_id"), F.posexplode("embedding").alias("t", "v"))
    return rows.select("series_id", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))


def events_in_blocks(spark: SparkSession, sf_dir: str, blocks: int = 16) -> DataFrame:
    return table_to_blocks(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", blocks)


VIEWS = {"E5": events_by_type, "EU": events_by_user, "L3": revenue_by_flag, "O": price_by_priority, "V": embedding_rows, "E5B": events_in_blocks}
