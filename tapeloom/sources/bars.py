"""Bars from event tables, files and databases; resampling, benchmarks and as-of joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tapeloom.functions.grown import Growth

SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Bars from Parquet, CSV (header), JSON or ORC, with the bar schema."""
    reader = spark.read.options(**({"header": "true"} | options if kind == "csv" else options)).schema(SCHEMA)
    return reader.format(kind).load(path)


def read_table(spark: SparkSession, url: str, table: str, partition: tuple[str, str, str, int] | None = None, **options) -> DataFrame:
    """A database table over JDBC; ``partition``: (column, lower, upper, parts) to read it in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, parts = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


def fetch(bars: DataFrame, symbol: str, limit: int = 500, newest: bool = False) -> DataFrame:
    """The oldest (or newest) bars of one symbol in order; the filter reaches the scan."""
    own = bars.where(F.col("symbol") == symbol)
    return own.orderBy(F.col("ts").desc() if newest else F.col("ts").asc()).limit(limit).orderBy("ts")


def lookup(table: DataFrame, symbol: str) -> DataFrame:
    """The row of a keyed table (fundamentals, listings, master data)."""
    return table.where(F.col("symbol") == symbol).limit(1)


def aggregate(rows: DataFrame, symbol: Column, bucket: Column, value: Column, order: list[str], volume: Column | None = None) -> DataFrame:
    """Bars of ticks: first and last by ``order``, extremes, and summed (or counted) volume, combined before the shuffle."""
    at = F.struct(*order)
    return rows.groupBy(symbol.alias("symbol"), bucket.alias("ts")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        (F.count(F.lit(1)) if volume is None else F.sum(volume)).cast("double").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return aggregate(e, F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), ["ts", "event_id"])


def all_event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value")
    return aggregate(e, F.lit("ALL"), F.date_trunc(unit, "ts"), F.col("value"), ["ts", "event_id"])


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return aggregate(o, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"), ["o_orderdate", "o_orderkey"])


def ship_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    return aggregate(rows, F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), F.col("l_extendedprice"), ["l_shipdate", "l_orderkey", "l_linenumber"], F.col("l_quantity"))


def _sql(table: str, symbol: str, bucket: str, value: str, order: list[str], volume: str = "count(*)") -> str:
    at = "struct_pack(" + ", ".join(f"k{i} := {c}" for i, c in enumerate(order)) + ")"
    return f"SELECT {symbol} AS symbol, {bucket} AS ts, arg_min({value}, {at}) AS open, max({value}) AS high, min({value}) AS low, arg_max({value}, {at}) AS close, ({volume})::DOUBLE AS volume FROM {table} GROUP BY 1, 2"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery by its return flag, with the second its bars begin at, its price and its quantity."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity")
    at = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1440)) * 60
    return rows.select(F.col("l_returnflag").alias("symbol"), at.alias("at"), F.col("l_extendedprice").cast("double").alias("value"), F.col("l_quantity").cast("double").alias("volume"))


def delivery_ticks(spark: SparkSession, sf_dir: str, each: int = 16) -> DataFrame:
    """``each`` bars a minute apart for every delivery, by its return flag: three symbols with a third of all bars each."""
    return ticks(deliveries(spark, sf_dir), each)


def ticks(rows: DataFrame, each: int = 16) -> DataFrame:
    """The bars of rows such as ``deliveries`` gives."""
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    p = F.col("value") * (1 + F.col("i") / 1000)
    prices = (p.alias("open"), (p * 1.01).alias("high"), (p * 0.99).alias("low"), (p * (1 + F.sin("i") / 200)).alias("close"))
    return rows.select("symbol", F.timestamp_seconds(F.col("at") + F.col("i") * 60).alias("ts"), *prices, "volume")


def delivery_growth(each: int = 16) -> Growth:
    """The bars of ``ticks`` as tasks make them."""
    i = np.arange(each)

    def prices(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = value[:, None] * (1 + i / 1000)
        return p, p * (1 + np.sin(i) / 200)

    return Growth(each, 60, prices)


#: DuckDB SQL of the same bars
SQL = {
    "hour": _sql("events", "event_type", "date_trunc('hour', ts)", "value", ["ts", "event_id"]),
    "day": _sql("events", "event_type", "date_trunc('day', ts)", "value", ["ts", "event_id"]),
    "all_hour": _sql("events", "'ALL'", "date_trunc('hour', ts)", "value", ["ts", "event_id"]),
    "orders": _sql("orders", "o_orderpriority", "date_trunc('day', o_orderdate)", "o_totalprice", ["o_orderdate", "o_orderkey"]),
    "ship": _sql("lineitem", "l_returnflag", "date_trunc('day', l_shipdate)", "l_extendedprice", ["l_shipdate", "l_orderkey", "l_linenumber"], "sum(l_quantity)"),
}


def with_benchmark(bars: DataFrame, bench: DataFrame, how: str = "left") -> DataFrame:
    """``bars`` with the prices of a second series at the same time as bench_*; the engine picks the join by size."""
    named = bench.select("ts", *(F.col(c).alias(f"bench_{c}") for c in ("open", "high", "low", "close", "volume")))
    return bars.join(named, "ts", how).select(*bars.columns, *(c for c in named.columns if c != "ts"))


def benchmark_sql(bars: str, bench: str) -> str:
    names = ", ".join(f"b.{c} AS bench_{c}" for c in ("open", "high", "low", "close", "volume"))
    return f"SELECT a.*, {names} FROM ({bars}) a LEFT JOIN ({bench}) b ON a.ts = b.ts"


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe (an interval such as ``4 hours``); buckets without bars don't appear; missing volume is 0."""
    bucket = F.window("ts", timeframe)
    out = bars.groupBy("symbol", bucket.alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def asof(left: DataFrame, right: DataFrame, columns: list[str], by: str = "symbol", at: str = "ts", suffix: str = "", ready: str | None = None) -> DataFrame:
    """``left`` with the last ``columns`` of ``right`` known at each row's time (``ready``: when a right row is known).

    One shuffle by ``by``: the tables are put together and the last right value is carried on; at the same time right rows
    come first. Rows never multiply.
    """
    struct = F.struct(*(F.col(c) for c in columns))
    kinds = [f for f in left.schema if f.name not in (by, at)]
    a = left.select(by, F.col(at).alias("at_"), F.lit(1).alias("side_"), F.struct(*(F.col(f.name) for f in kinds)).alias("row_"), F.lit(None).cast(right.select(struct.alias("r")).schema["r"].dataType).alias("right_"))
    b = right.select(by, F.col(ready or at).alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), struct.alias("right_"))
    w = Window.partitionBy(by).orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("known_", F.last("right_", ignorenulls=True).over(w)).where("side_ = 1")
    return got.select(by, F.col("at_").alias(at), *(F.col(f"row_.{f.name}").alias(f.name) for f in kinds), *(F.col(f"known_.{c}").alias(f"{c}{suffix}") for c in columns))


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    report.write.mode("overwrite").json(path)
