"""Canonical bronze inputs derived from the driver's TPC-H-style tables.

Mapping (FIXTURES.md §3): a nation is a country (iso3 ``N07``), the order
year is the plan year, the customer's market segment is the sector, order
value is the requirement, settled value the funding, returned-and-final
line quantities the people in need, order priorities the donors, and
events the media articles.

Scale notes. ``lineitem`` and ``orders`` are the only tables that grow
without bound. Both are reduced by partial (map-side) aggregation before
every shuffle: lines collapse per order key, orders collapse per
(customer, year, status, priority) before the customer join, so a hot
order or customer key never lands as raw rows in one task. ``customer`` is
joined by shuffle (never broadcast: it grows with the data); ``nation`` and
``region`` are dimension tables of fixed size and are broadcast. The
resulting cube is bounded by the dimension cardinalities (nations x years x
segments x statuses x priorities), whatever the input size.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.constants import SEGMENT_TO_SECTOR
from lacuna.functions.lookups import lookup_frame

MONEY = "decimal(18,2)"
MONEY3 = "decimal(38,3)"

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_FRAMES: dict[tuple, DataFrame] = {}


def _reuse(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Reuse a DataFrame object (its analysed plan, not data) within one application."""
    full = (spark.sparkContext.applicationId,) + key
    df = _FRAMES.get(full)
    if df is None:
        df = _FRAMES[full] = build()
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return _reuse(spark, ("parquet", path), lambda: spark.read.parquet(path))


def iso3_of(nationkey: Column) -> Column:
    """Country code of a nation key, e.g. 7 -> ``N07``."""
    return F.upper(F.concat(F.lit("N"), F.lpad(nationkey.cast("string"), 2, "0")))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iso3, country, region, nationkey — a fixed-size dimension."""
    return _reuse(spark, ("nations", sf_dir), lambda: _nations(spark, sf_dir))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_nationkey").alias("nationkey"),
        iso3_of(F.col("n_nationkey")).alias("iso3"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
    )


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nationkey, year, segment, status, priority) -> order value, R/F quantity, order counts."""
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("rf_qty"))
    )
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast(MONEY).alias("price"),
    )
    per_customer = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy("o_custkey", "year", "status", "priority")
        .agg(
            F.sum("price").alias("price"),
            F.sum("rf_qty").alias("rf_qty"),
            F.count(F.lit(1)).alias("n_orders"),
            F.count("rf_qty").alias("n_rf_orders"),
        )
    )
    customers = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment")
    )
    return (
        per_customer.join(customers, per_customer.o_custkey == customers.c_custkey)
        .groupBy("nationkey", "year", "segment", "status", "priority")
        .agg(
            F.sum("price").alias("price"),
            F.sum("rf_qty").alias("rf_qty"),
            F.sum("n_orders").alias("n_orders"),
            F.sum("n_rf_orders").alias("n_rf_orders"),
        )
    )


def _with_country(cube: DataFrame, nat: DataFrame) -> DataFrame:
    return cube.join(F.broadcast(nat.select("nationkey", "iso3", "country")), "nationkey")


def _sector_of_segment(spark: SparkSession) -> DataFrame:
    return lookup_frame(spark, SEGMENT_TO_SECTOR, "segment", "cluster")


def funding_raw(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """Funding source rows: iso3, country, year, cluster, requirements_usd, funding_usd.

    One row per (nation, year, segment, status, priority); the silver step
    aggregates them to (iso3, year, sector).
    """
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    nat = nations(spark, sf_dir)
    # exact to the tenth of a cent: every branch typed decimal(38,3) so the
    # CASE does not widen to a type with fewer fraction digits
    funded = (
        F.when(F.col("status") == "F", F.col("price").cast(MONEY3))
        .when(F.col("status") == "P", (F.col("price") * F.lit(0.5).cast("decimal(2,1)")).cast(MONEY3))
        .otherwise(F.lit(0).cast(MONEY3))
    )
    return (
        _with_country(cube, nat)
        .join(F.broadcast(_sector_of_segment(spark)), "segment", "left")
        .select(
            "iso3",
            "country",
            "year",
            "cluster",
            F.col("price").alias("requirements_usd"),
            funded.alias("funding_usd"),
        )
    )


def customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: customer count and count with balance < 4000."""
    return _reuse(spark, ("custcounts", sf_dir), lambda: _customer_counts(spark, sf_dir))


def _customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read_table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("nationkey"))
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            F.count_if(F.col("c_acctbal") < 4000).alias("n_low_balance"),
        )
    )


def needs_raw(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """Needs source rows: iso3, country, year, cluster, in_need, targeted, affected, population.

    Only cells with returned-and-final lines report a need; the targeted
    people are the part of that need on settled (status F) orders.
    """
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    nat = nations(spark, sf_dir)
    cells = (
        cube.where(F.col("rf_qty").isNotNull())
        .groupBy("nationkey", "year", "segment")
        .agg(
            F.sum("rf_qty").alias("rf_qty"),
            F.sum(F.when(F.col("status") == "F", F.col("rf_qty"))).alias("rf_settled"),
        )
    )
    counts = customer_counts(spark, sf_dir)
    return (
        _with_country(cells, nat)
        .join(F.broadcast(_sector_of_segment(spark)), "segment", "left")
        .join(counts, "nationkey", "left")
        .select(
            "iso3",
            "country",
            "year",
            "cluster",
            (F.col("rf_qty") * 100).cast("bigint").alias("in_need"),
            (F.col("rf_settled") * 100).cast("bigint").alias("targeted"),
            F.lit(None).cast("bigint").alias("affected"),
            (F.col("n_customers") * 100000).cast("bigint").alias("population"),
        )
    )


def severity_raw(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """Severity source rows per (iso3, year): 10 x share of low-balance customers.

    Nations with key % 5 == 4 publish no value (null), to exercise the default.
    """
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    nat = nations(spark, sf_dir)
    years = cube.select("nationkey", "year").distinct()
    sev = F.when(
        F.col("nationkey") % 5 != 4,
        F.lit(10.0) * F.col("n_low_balance") / F.col("n_customers"),
    )
    return (
        years.join(customer_counts(spark, sf_dir), "nationkey")
        .join(F.broadcast(nat.select("nationkey", "iso3", "country")), "nationkey")
        .select("country", "iso3", sev.alias("inform_severity"), F.lit(None).cast("double").alias("inform_risk"), "year")
    )


def cbpf_raw(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """Pooled-fund contributions: country(iso3), fiscal_year, donor_name, paid, pledged."""
    cube = cube if cube is not None else order_cube(spark, sf_dir)
    nat = nations(spark, sf_dir)
    return (
        _with_country(cube, nat)
        .groupBy("iso3", "year", "priority")
        .agg(
            F.sum(F.when(F.col("status") == "F", F.col("price")).otherwise(F.lit(0).cast(MONEY))).alias("paid"),
            F.sum("price").alias("pledged"),
        )
        .select(
            F.col("iso3").alias("country"),
            F.col("year").alias("fiscal_year"),
            F.col("priority").alias("donor_name"),
            F.col("paid").cast("double").alias("paid_amt_u_s_d"),
            F.col("pledged").cast("double").alias("pledge_amt_u_s_d"),
        )
    )


def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iso3 -> region for the test nations."""
    return nations(spark, sf_dir).select("iso3", "region")


def media_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article counts per iso3: events whose user_id % 25 equals the nation key."""
    nat = nations(spark, sf_dir)
    counts = (
        read_table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 25).cast("int").alias("nationkey"))
        .agg(F.count(F.lit(1)).alias("article_count"))
    )
    return counts.join(F.broadcast(nat.select("nationkey", "iso3", "country")), "nationkey").select(
        "iso3", "country", "article_count"
    )
