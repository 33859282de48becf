"""The engine's input tables made from the harness tables, as DataFrames and as the same SQL.

Brands are tickers, line items are trades: a bar has the day's volume-weighted price as close. Money is summed
as decimals, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURRENCIES = ("EUR", "USD", "GBP", "CHF", "JPY")
FIRST_ESTR = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, monthly: bool = False) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    day = F.to_date("l_shipdate")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    met = items.where("l_quantity > 0").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    out = met.groupBy(F.col("p_brand").alias("ticker"), (F.trunc(day, "month") if monthly else day).alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        (F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double") / F.sum(F.col("l_quantity").cast("decimal(15,2)")).cast("double")).alias("close"),
        F.sum(F.col("l_quantity").cast("decimal(15,2)")).cast("double").alias("volume"),
    )
    return out


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, venue, currency, sector) from a brand's number: five venues with a currency each, four sectors."""
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct()
    n = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    x = n % 5 + 1
    return brand.select("ticker", F.when(x == 3, "XLON").otherwise(F.concat(F.lit("V"), x.cast("string"))).alias("venue"), F.get(F.array(*[F.lit(c) for c in CURRENCIES]), x - 1).alias("currency"), F.concat(F.lit("S"), (n % 4 + 1).cast("string")).alias("sector"))


def sessions(bars_: DataFrame, listings_: DataFrame) -> DataFrame:
    """A venue's sessions: days on which four fifths of its tickers traded."""
    size = listings_.groupBy("venue").agg(F.count("*").alias("n"))
    days = bars_.join(F.broadcast(listings_), "ticker").groupBy("venue", "date").agg(F.count("*").alias("k"))
    return days.join(F.broadcast(size), "venue").where("5 * k >= 4 * n").select("venue", "date")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    code = F.get(F.array(*[F.lit(c) for c in CURRENCIES[1:]]), (F.col("o_custkey") % 4).cast("int"))
    mean = F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / F.count("*") / 100000.0
    return o.groupBy(F.concat(F.lit("EUR"), code).alias("pair"), F.to_date("o_orderdate").alias("date")).agg(mean.alias("rate"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_custkey") % 2 == 0, "ESTR").otherwise("EONIA").alias("series"))
    return o.where((F.col("series") == "EONIA") | (F.col("date") >= FIRST_ESTR)).groupBy("series", "date").agg((F.count("*") % 7 / 2.0).alias("rate"))


def actions(bars_: DataFrame) -> DataFrame:
    """A 2:1 split at every 400th bar, a small dividend at every 130th."""
    w = Window.partitionBy("ticker").orderBy("date")
    n = bars_.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("close").over(w))
    splits = n.where("n % 400 = 0").select("ticker", "date", F.lit("split").alias("action"), F.lit(2.0).alias("value"))
    paid = n.where("n % 130 = 7").select("ticker", "date", F.lit("dividend").alias("action"), (F.col("before") * 0.0005).alias("value"))
    return splits.unionByName(paid)


#: The same as common table expressions.
BARS_SQL = """
bars AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
  arg_min(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': l_quantity}) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS close,
  CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2)"""
LISTINGS_SQL = """
listings AS (SELECT ticker, CASE WHEN n % 5 = 2 THEN 'XLON' ELSE 'V' || (n % 5 + 1) END AS venue, (['EUR', 'USD', 'GBP', 'CHF', 'JPY'])[n % 5 + 1] AS currency, 'S' || (n % 4 + 1) AS sector
  FROM (SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS n FROM part))"""
SESSIONS_SQL = """
sessions AS (SELECT venue, date FROM (SELECT venue, date, count(*) AS k FROM bars JOIN listings USING (ticker) GROUP BY 1, 2) JOIN (SELECT venue, count(*) AS n FROM listings GROUP BY 1) USING (venue) WHERE 5 * k >= 4 * n)"""
GRID_SQL = """
spans AS (SELECT ticker, venue, min(date) AS lo, max(date) AS hi FROM bars JOIN listings USING (ticker) GROUP BY 1, 2),
days AS (SELECT ticker, date FROM spans JOIN sessions USING (venue) WHERE date BETWEEN lo AND hi UNION SELECT ticker, date FROM bars),
grid AS (SELECT d.ticker, d.date, b.open, b.high, b.low, b.close, b.volume, b.ticker IS NOT NULL AS stored FROM days d LEFT JOIN bars b ON b.ticker = d.ticker AND b.date = d.date)"""
FX_SQL = """
fx AS (SELECT 'EUR' || (['USD', 'GBP', 'CHF', 'JPY'])[o_custkey % 4 + 1] AS pair, CAST(o_orderdate AS DATE) AS date,
  CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) / 100000.0 AS rate FROM orders GROUP BY 1, 2)"""
RATES_SQL = """
rates AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'ESTR' ELSE 'EONIA' END AS series, CAST(o_orderdate AS DATE) AS date, (count(*) % 7) / 2.0 AS rate
  FROM orders WHERE o_custkey % 2 <> 0 OR CAST(o_orderdate AS DATE) >= DATE '1995-01-01' GROUP BY 1, 2)"""
ACTIONS_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars),
actions AS (SELECT ticker, date, 'split' AS action, 2.0::DOUBLE AS value FROM numbered WHERE n % 400 = 0
  UNION ALL SELECT ticker, date, 'dividend', before * 0.0005 FROM numbered WHERE n % 130 = 7)"""
