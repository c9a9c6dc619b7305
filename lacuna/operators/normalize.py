"""Silver-layer operators: code resolution, sector labels and de-duplicated aggregates.

P11 country -> ISO3, P12 pooled-fund name -> ISO3, P13 multi-country split,
P14 sector normaliser, P15 region lookup, A1 funding flows, A2 needs by
sector, A4 keep-first de-dup, U1-U3 unions, severity index.

Scale: resolution works on *distinct* names (a vocabulary, far smaller than
the rows) and joins the answer back; the fixed dictionaries are tiny and
broadcast. Aggregates are plain ``groupBy`` with map-side partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.functions import lookups
from lacuna.functions.cleaning import capped_coverage, clamp, per_capita


# ------------------------------------------------------------------ P14 sectors
def normalize_sector(df: DataFrame, src: str, out: str = "sector") -> DataFrame:
    """Trim+lower lookup; unknown -> trimmed original; null/empty -> 'Total'."""
    spark = df.sparkSession
    m = F.broadcast(lookups.sector_map(spark))
    key = F.lower(F.trim(F.col(src)))
    joined = df.withColumn("_sector_key", key).join(m, F.col("_sector_key") == m.sector_key, "left")
    label = (
        F.when(F.col(src).isNull() | (F.trim(F.col(src)) == ""), F.lit(C.TOTAL_SECTOR))
        .otherwise(F.coalesce(F.col("sector_label"), F.trim(F.col(src))))
    )
    return joined.withColumn(out, label).drop("_sector_key", "sector_key", "sector_label")


# ------------------------------------------------------------------ P11 country -> iso3
GRAM = 3


def _pieces(c: str) -> Column:
    """One row per distinct piece of up to GRAM characters of a text (the empty piece included)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    grams = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.transform(starts, lambda i: F.substr(F.col(c), i, n))))
    return F.explode(F.array_distinct(grams))


def resolve_names(names: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Map distinct names (column ``name_in``) to ISO3 through tiers 2-4.

    Tier 2 exact name, tier 3 case-insensitive trimmed, tier 4 substring
    either way; tiers 3/4 take the first dictionary entry in dictionary order.
    ``dictionary`` has (name, iso3, ordinal) and may have any size: all joins are
    equi-joins without a hint, tier 4 over an index of the short pieces of the longer text.
    """
    spark = names.sparkSession
    d = dictionary if dictionary is not None else lookups.country_dictionary(spark)
    exact = d.groupBy(F.col("name").alias("_k2")).agg(F.min_by("iso3", "ordinal").alias("_t2"))
    lower = d.groupBy(F.lower(F.col("name")).alias("_k3")).agg(F.min_by("iso3", "ordinal").alias("_t3"))
    base = names.select("name_in").distinct().withColumn("_low", F.lower(F.trim(F.col("name_in"))))
    step = (
        base.join(exact, base.name_in == F.col("_k2"), "left")
        .join(lower, F.col("_low") == F.col("_k3"), "left")
        .select("name_in", "_low", F.coalesce("_t2", "_t3").alias("_t23"))
    )
    unresolved = step.where(F.col("_t23").isNull()).select("name_in", "_low")
    dl = d.select(F.lower(F.col("name")).alias("_dname"), F.col("iso3").alias("_t4iso"), F.col("ordinal").alias("_t4ord"))
    # a text that holds another holds its first GRAM characters: join on those, then check exactly
    inside = unresolved.withColumn("_gram", F.left("_low", F.lit(GRAM))).join(dl.withColumn("_gram", _pieces("_dname")), "_gram").where(
        F.contains("_dname", "_low")
    )
    around = unresolved.withColumn("_gram", _pieces("_low")).join(dl.withColumn("_gram", F.left("_dname", F.lit(GRAM))), "_gram").where(
        F.contains("_low", "_dname")
    )
    tier4 = (
        inside.unionByName(around)
        .groupBy("name_in")
        .agg(F.min_by("_t4iso", "_t4ord").alias("_t4"))
    )
    return step.join(tier4, "name_in", "left").select(
        "name_in", F.coalesce("_t23", "_t4").alias("iso3_resolved")
    )


def resolve_iso3(df: DataFrame, name_col: str = "country", iso3_col: str | None = "iso3", out: str = "iso3",
                 dictionary: DataFrame | None = None) -> DataFrame:
    """P11 on a whole table: tier 1 = given 3-letter code (upper-cased), else tiers 2-4 by name."""
    names = df.select(F.col(name_col).cast("string").alias("name_in")).where(F.col("name_in").isNotNull())
    if iso3_col:
        given = F.col(iso3_col).cast("string")
        names = df.where(~(F.length(given) == 3) | given.isNull()).select(
            F.col(name_col).cast("string").alias("name_in")
        ).where(F.col("name_in").isNotNull())
    resolved = resolve_names(names, dictionary)
    joined = df.join(resolved, df[name_col].cast("string") == resolved.name_in, "left")
    code = F.col("iso3_resolved")
    if iso3_col:
        given = F.col(iso3_col).cast("string")
        code = F.when(F.length(given) == 3, F.upper(given)).otherwise(code)
    cols = [c for c in df.columns if c != out]
    return joined.select(*cols, code.alias(out))


# ------------------------------------------------------------------ P12 pooled fund
def pooled_fund_iso3(df: DataFrame, fund_col: str = "pooled_fund_name") -> DataFrame:
    """Remove ' HF' / ' CHF', exact lookup, else 'UNK'. Adds country_name and country."""
    spark = df.sparkSession
    name = F.replace(F.replace(F.col(fund_col).cast("string"), F.lit(" HF"), F.lit("")), F.lit(" CHF"), F.lit(""))
    m = F.broadcast(lookups.pooled_fund_map(spark))
    out = df.withColumn("country_name", name).join(m, F.col("country_name") == m.fund_country, "left")
    return out.withColumn("country", F.coalesce(F.col("iso3"), F.lit(C.UNKNOWN_ISO3))).drop("fund_country", "iso3")


# ------------------------------------------------------------------ P12b map names
def map_name_iso3(df: DataFrame, name_col: str = "name", out: str = "iso3") -> DataFrame:
    """World-map shape name -> ISO3, case-insensitive, else 'UNK' (broadcast of a fixed 177-row table)."""
    m = F.broadcast(lookups.map_name_map(df.sparkSession))
    joined = df.join(m, F.lower(F.col(name_col)) == m.map_key, "left")
    return joined.withColumn(out, F.coalesce(F.col("map_iso3"), F.lit(C.UNKNOWN_ISO3))).drop("map_key", "map_iso3")


# ------------------------------------------------------------------ P13 split
def split_countries(df: DataFrame, col: str = "country") -> DataFrame:
    """One row per '|'-separated, trimmed, distinct country name."""
    return (
        df.select(F.explode(F.split(F.col(col).cast("string"), r"\|")).alias(col))
        .select(F.trim(F.col(col)).alias(col))
        .distinct()
    )


# ------------------------------------------------------------------ P15 region
def with_region(df: DataFrame, regions: DataFrame | None = None, iso3_col: str = "iso3", out: str = "region") -> DataFrame:
    """Left join a region lookup (default the fixed map); missing -> 'Other'.

    When ``df`` already has ``out`` its non-null values win. A given lookup is
    de-duplicated by ISO3 and joined without a hint; only the fixed map is broadcast.
    """
    spark = df.sparkSession
    fixed = lookups.region_map(spark).withColumnRenamed("region", "_region_fixed")
    res = df.join(F.broadcast(fixed), df[iso3_col] == fixed.iso3, "left").drop(fixed.iso3)
    candidates: list[Column] = []
    if out in df.columns:
        candidates.append(F.col(out))
    if regions is not None:
        r = regions.select(F.col("iso3").alias("_r_iso3"), F.col("region").alias("_region_given")).dropDuplicates(["_r_iso3"])
        res = res.join(r, res[iso3_col] == F.col("_r_iso3"), "left").drop("_r_iso3")
        candidates.append(F.col("_region_given"))
    candidates += [F.col("_region_fixed"), F.lit(C.DEFAULT_REGION)]
    res = res.withColumn("_region_out", F.coalesce(*candidates))
    drop = [c for c in ("_region_fixed", "_region_given", out) if c in res.columns]
    return res.drop(*drop).withColumnRenamed("_region_out", out)


# ------------------------------------------------------------------ A4 keep-first
def keep_first(df: DataFrame, keys: list[str], by: str, descending: bool = False) -> DataFrame:
    """One row per key: the row with the smallest (or largest) ``by``, ties broken by the other columns.

    A plain aggregate of ``min``/``max`` over a struct, so partial aggregation
    shrinks a hot key before the shuffle (no window over the whole group).
    """
    rest = [c for c in df.columns if c not in keys and c != by]
    packed = F.struct(F.col(by).alias(by), *[F.col(c).alias(c) for c in rest])
    pick = F.max(packed) if descending else F.min(packed)
    return df.groupBy(*keys).agg(pick.alias("_first")).select(*keys, "_first.*")


# ------------------------------------------------------------------ A1 funding flows
def funding_flows(global_raw: DataFrame | None, cluster_raw: DataFrame | None) -> DataFrame:
    """Silver funding: (iso3, year, sector) -> sums, first country, capped coverage.

    Global rows are sector 'Total'; cluster rows get the normalised cluster
    label; cluster rows without a cluster are dropped (they would double the
    global total).
    """
    frames = []
    if global_raw is not None:
        frames.append(global_raw.withColumn("sector", F.lit(C.TOTAL_SECTOR)))
    if cluster_raw is not None:
        c = cluster_raw.where(F.col("cluster").isNotNull() & (F.trim(F.col("cluster")) != ""))
        frames.append(normalize_sector(c, "cluster"))
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    combined = resolve_iso3(combined, "country", "iso3")
    money = "decimal(38,3)"
    return (
        combined.where(F.col("iso3").isNotNull() & F.col("year").isNotNull())
        .groupBy("iso3", F.col("year").cast("int").alias("year"), "sector")
        .agg(
            F.min("country").alias("country"),
            F.sum(F.coalesce(F.col("requirements_usd").cast(money), F.lit(0).cast(money))).alias("_req"),
            F.sum(F.coalesce(F.col("funding_usd").cast(money), F.lit(0).cast(money))).alias("_fund"),
        )
        .select(
            "iso3", "country", "year", "sector",
            F.col("_req").cast("double").alias("requirements_usd"),
            F.col("_fund").cast("double").alias("funding_usd"),
        )
        .withColumn("coverage_ratio", capped_coverage("funding_usd", "requirements_usd"))
    )


# ------------------------------------------------------------------ A2 needs
def needs_by_sector(needs_raw: DataFrame) -> DataFrame:
    """Silver needs: (iso3, year, sector) -> people sums, max population, per-capita.

    Grouped by iso3 (not iso3 x country), so two spellings of one country do
    not fan out the later join.
    """
    n = normalize_sector(needs_raw, "cluster")
    n = resolve_iso3(n, "country", "iso3")
    return (
        n.where(F.col("iso3").isNotNull() & F.col("year").isNotNull())
        .groupBy("iso3", F.col("year").cast("int").alias("year"), "sector")
        .agg(
            F.min("country").alias("country"),
            F.sum("in_need").cast("bigint").alias("people_in_need"),
            F.sum("targeted").cast("bigint").alias("people_targeted"),
            F.sum("affected").cast("bigint").alias("affected"),
            F.max("population").cast("bigint").alias("population"),
        )
        .withColumn("pin_per_capita", per_capita(F.coalesce("people_in_need", F.lit(0)), F.coalesce("population", F.lit(0))))
    )


# ------------------------------------------------------------------ severity
def severity_index(severity_raw: DataFrame) -> DataFrame:
    """Silver severity: clamp 0..10, drop null codes/values, one row per (iso3, year)."""
    s = severity_raw.withColumn("inform_severity", clamp(F.col("inform_severity").cast("double"), 0.0, 10.0))
    s = s.withColumn("iso3", F.upper(F.trim(F.col("iso3"))))
    s = s.where(F.col("iso3").isNotNull() & F.col("inform_severity").isNotNull() & F.col("year").isNotNull())
    s = s.withColumn("year", F.col("year").cast("int"))
    return keep_first(s.select("iso3", "year", "inform_severity"), ["iso3", "year"], "inform_severity", descending=True)


# ------------------------------------------------------------------ U3 universe
def crisis_universe(sources: list[DataFrame], regions: DataFrame | None = None) -> DataFrame:
    """Distinct countries over several sources -> iso3, country, region (first name per iso3)."""
    parts = []
    for s in sources:
        iso = F.col("iso3") if "iso3" in s.columns else F.lit(None).cast("string")
        parts.append(
            s.where(F.col("country").isNotNull())
            .select(F.explode(F.split(F.col("country").cast("string"), r"\|")).alias("country"), iso.alias("iso3"))
            .select(F.trim("country").alias("country"), "iso3")
        )
    names = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    resolved = resolve_iso3(names, "country", "iso3").where(F.col("iso3").isNotNull())
    first = resolved.groupBy("iso3").agg(F.min("country").alias("country"))
    return with_region(first, regions).select("iso3", "country", "region")
