"""More registered queries: operators over tables that grow, sources and sinks, and inputs that take every branch.

Same contract as ``registry``. Inputs derive from the driver tables by
deterministic rules (keys modulo small numbers), so that each branch an
operator exists for has rows; the oracle SQL applies the same rules.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna import oracle as O
from lacuna.functions import cleaning as CL
from lacuna.functions import constants as C
from lacuna.functions.lookups import lookup_frame
from lacuna.operators import normalize as N
from lacuna.operators import paging
from lacuna.operators import quality as Q
from lacuna.operators import search as S
from lacuna.operators.order_stats import group_quantiles
from lacuna.operators.ordinal import global_cumsum, global_rank, global_row_number
from lacuna.plans import api as A
from lacuna.plans import eda as EDA
from lacuna.plans import medallion as P
from lacuna.plans import registry as R
from lacuna.plans.memo import finalize
from lacuna.session import materialize, scratch_table_path
from lacuna.sources import csv as CSV
from lacuna.sources import json_ingest as J
from lacuna.sources import tables as TB
from lacuna.sources import testdata as TD
from lacuna.sources import workbook as WB
from lacuna.streaming import ingest, sliding
from lacuna.streaming import quality as SQ

DOUBLES = R.DOUBLES | {
    "o_totalprice", "running_total", "raw_coverage", "acctbal", "mean_coverage", "mean_confidence", "min_score", "max_score",
    "max_multiplier", "percent_rank", "quantile", "fraction", "funded", "gap", "need_weight", "gap_severity", "structural_multiplier", "urgency_weight", "visibility_penalty", "sector_reqs", "in_need", "population", "targeted", "inform_risk",
}


def register(name: str, columns: list[str], sql: str, gold: str | None = None):
    """Like ``registry.register``; ``gold`` replaces the CTE chain (for other model parameters)."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir).select(*columns))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        R.QUERIES[name] = (run, O.rounded((gold or O.GOLD) + sql, columns, DOUBLES))
        return run

    return deco


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_table_path(spark, f"{name}-{uuid.uuid4().hex}")


def _values(pairs) -> str:
    return ", ".join("('{}', '{}', {})".format(k.replace("'", "''"), v, i) for i, (k, v) in enumerate(pairs))


# --- W8 over a table that grows ---------------------------------------------------
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("w8_order_ordinal", ORDERS + ["ordinal"], f"""
SELECT {', '.join(ORDERS)}, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders""")
def _w8o(spark, sf):
    """Ordinal of every order by price, all columns kept."""
    return global_row_number(TD.read_table(spark, sf, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@register("w8_order_cumsum", ORDERS + ["cents", "running_cents", "ordinal"], f"""
SELECT {', '.join(ORDERS)}, cents, CAST(SUM(cents) OVER w AS BIGINT) AS running_cents, ROW_NUMBER() OVER w AS ordinal
FROM (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders) t WINDOW w AS (ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def _w8c(spark, sf):
    """Running total of every order by price, all columns kept."""
    orders = TD.read_table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return global_cumsum(orders, [F.col("o_totalprice"), F.col("o_orderkey")], {"running_cents": "cents"})


# --- J11 over a table that grows ----------------------------------------------------
@register("j11_related_customers", ["crisis_id", "related_id", "position"], """,
cust AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS seg, c_nationkey % 3 AS kind,
                CAST((c_acctbal + 1000) / 11000 AS DECIMAL(38,12)) AS cov, (c_custkey * 7919 % 1000) / CAST(1000.0 AS DOUBLE) AS score FROM customer)
SELECT crisis_id, related_id, CAST(position AS INTEGER) AS position FROM (
  SELECT a.id AS crisis_id, b.id AS related_id, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY b.score DESC, b.id) AS position
  FROM cust a JOIN cust b ON a.seg = b.seg AND a.kind = b.kind AND a.id <> b.id AND ABS(a.cov - b.cov) < 0.15) t WHERE position <= 5""")
def _j11c(spark, sf):
    """Similar customers (same segment and nation kind, near balance), top 5 by a score; 15 hot groups over a growing table."""
    from lacuna.operators.related import related_crises

    index = TD.read_table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("crisis_id"), F.col("c_mktsegment").alias("region"), (F.col("c_nationkey") % 3).cast("string").alias("crisis_type"),
        ((F.col("c_acctbal") + 1000) / 11000).alias("coverage_ratio"), ((F.col("c_custkey") * 7919 % 1000) / 1000.0).alias("mismatch_score"), F.lit(True).alias("is_in_scope"),
    )
    return related_crises(index)


# --- names that resolve -------------------------------------------------------------
@register("p12_pooled_fund_known", ["pooled_fund_name", "country_name", "country"], f""",
funds(name, iso3, ordinal) AS (VALUES {_values(list(C.POOLED_FUND_ISO3.items()) if isinstance(C.POOLED_FUND_ISO3, dict) else C.POOLED_FUND_ISO3)})
SELECT f.name || CASE WHEN nationkey % 3 = 0 THEN ' HF' WHEN nationkey % 3 = 1 THEN ' CHF' ELSE ' Fund' END AS pooled_fund_name,
       f.name || CASE WHEN nationkey % 3 = 2 THEN ' Fund' ELSE '' END AS country_name,
       CASE WHEN nationkey % 3 = 2 THEN 'UNK' ELSE f.iso3 END AS country
FROM nat JOIN funds f ON f.ordinal = nationkey % (SELECT COUNT(*) FROM funds)""")
def _p12k(spark, sf):
    """Pooled-fund names of the fixed list (by nation key), some with an unknown suffix."""
    items = list(C.POOLED_FUND_ISO3.items()) if isinstance(C.POOLED_FUND_ISO3, dict) else C.POOLED_FUND_ISO3
    known = lookup_frame(spark, items, "name", "fund_iso3", ordinal="ordinal")
    nat = TD.nations(spark, sf).withColumn("ordinal", F.col("nationkey") % len(items))
    suffix = F.when(F.col("nationkey") % 3 == 0, F.lit(" HF")).when(F.col("nationkey") % 3 == 1, F.lit(" CHF")).otherwise(F.lit(" Fund"))
    return N.pooled_fund_iso3(nat.join(F.broadcast(known), "ordinal").select(F.concat("name", suffix).alias("pooled_fund_name")))


@register("p12b_map_name_known", ["name", "iso3"], f""",
known(name, iso3, ordinal) AS (VALUES {_values(C.MAP_NAME_TO_ISO3)})
SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN upper(k.name) WHEN 1 THEN k.name ELSE k.name || '?' END AS name,
       CASE c_custkey % 3 WHEN 2 THEN 'UNK' ELSE (SELECT iso3 FROM known x WHERE lower(x.name) = lower(k.name) LIMIT 1) END AS iso3
FROM customer JOIN known k ON k.ordinal = c_custkey % {len(C.MAP_NAME_TO_ISO3)}""")
def _p12bk(spark, sf):
    """Map names of the fixed list (by customer key) in several spellings, a third of them unknown."""
    known = lookup_frame(spark, C.MAP_NAME_TO_ISO3, "k", "known_iso3", ordinal="ordinal")
    cust = TD.read_table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % len(C.MAP_NAME_TO_ISO3)).cast("int").alias("ordinal"))
    spelled = F.when(F.col("c_custkey") % 3 == 0, F.upper("k")).when(F.col("c_custkey") % 3 == 1, F.col("k")).otherwise(F.concat("k", F.lit("?")))
    names = cust.join(F.broadcast(known), "ordinal").select(spelled.alias("name")).distinct()
    return N.map_name_iso3(names, "name", "iso3")


# --- branches of the index ------------------------------------------------------------
@register("j15_needs_without_dropped_plan", ["iso3", "year", "sector"], """
SELECT iso3, year, sector FROM needs ANTI JOIN (SELECT * FROM funding WHERE (year + CAST(substr(iso3, 2) AS INTEGER)) % 3 <> 0) f USING (iso3, year, sector)""")
def _j15(spark, sf):
    """Needs cells without a plan, after a third of the plan cells is taken away (left anti join)."""
    s = P.silver(P.bronze_from_testdata(spark, sf))
    kept = s.funding.where((F.col("year") + F.substring("iso3", 2, 2).cast("int")) % 3 != 0)
    return s.needs.join(kept, ["iso3", "year", "sector"], "left_anti")


TIGHT_REQ, TIGHT_PIN = 5_000_000.0, 40_000.0
_TIGHT = O.GOLD.replace("requirements_usd >= 100000 OR people_in_need >= 1000", f"requirements_usd >= {TIGHT_REQ} OR people_in_need >= {TIGHT_PIN}")


@register("w1_rank_tight_scope", ["crisis_id", "is_in_scope", "mismatch_score_lower_bound", "global_rank"],
          "SELECT crisis_id, is_in_scope, mismatch_score_lower_bound, global_rank FROM gold", gold=_TIGHT)
def _w1t(spark, sf):
    """P22 + W1: a scope rule that leaves rows out; those have rank 0."""
    return P.gold_index(spark, sf, min_requirements=TIGHT_REQ, min_people=TIGHT_PIN)


_BROKEN = """,
broken AS (
  SELECT CASE WHEN h % 11 = 0 THEN NULL WHEN h % 11 = 1 THEN iso3 || 'X' ELSE iso3 END AS iso3,
         CASE WHEN h % 13 = 0 THEN NULL WHEN h % 13 = 1 THEN year - 50 ELSE year END AS year, crisis_id,
         CASE WHEN h % 7 = 0 THEN -funding_usd - 1 ELSE funding_usd END AS funding_usd,
         CASE WHEN h % 17 = 0 THEN -1 ELSE people_in_need END AS people_in_need,
         CASE WHEN h % 19 = 0 THEN 0.0 ELSE requirements_usd END AS requirements_usd,
         CASE WHEN h % 23 = 0 THEN 11.0 ELSE inform_severity END AS inform_severity,
         CASE WHEN h % 29 = 0 THEN 1.5 ELSE coverage_ratio END AS coverage_ratio,
         CASE WHEN h % 5 = 0 THEN -0.5 ELSE confidence_score END AS confidence_score,
         CASE WHEN h % 3 = 0 THEN 'OTHER' ELSE crisis_type END AS crisis_type,
         CASE WHEN h % 2 = 0 THEN 'NONE' ELSE confidence_level END AS confidence_level
  FROM (SELECT *, global_rank AS h FROM gold) g)"""


def _broken(spark, sf):
    """The gold index with broken cells, by rank, so that every quality rule fails somewhere."""
    g = R.gold(spark, sf)
    h = F.col("global_rank")

    def when(n, rest, value, c):
        return F.when(h % n == rest, value).otherwise(F.col(c)).alias(c)

    return g.select(
        "crisis_id", F.when(h % 11 == 0, F.lit(None)).when(h % 11 == 1, F.concat("iso3", F.lit("X"))).otherwise(F.col("iso3")).alias("iso3"),
        F.when(h % 13 == 0, F.lit(None)).when(h % 13 == 1, F.col("year") - 50).otherwise(F.col("year")).alias("year"),
        when(7, 0, -F.col("funding_usd") - 1, "funding_usd"), when(17, 0, F.lit(-1), "people_in_need"), when(19, 0, F.lit(0.0), "requirements_usd"),
        when(23, 0, F.lit(11.0), "inform_severity"), when(29, 0, F.lit(1.5), "coverage_ratio"), when(5, 0, F.lit(-0.5), "confidence_score"),
        when(3, 0, F.lit("OTHER"), "crisis_type"), when(2, 0, F.lit("NONE"), "confidence_level"),
    )


@register("q1_quarantine_broken", ["crisis_id", "failed_rules"], _BROKEN + """
SELECT crisis_id, array_to_string(list_filter([
    CASE WHEN iso3 IS NULL THEN 'iso3_missing' END,
    CASE WHEN year IS NULL OR year < 2000 OR year > 2030 THEN 'year_out_of_range' END,
    CASE WHEN funding_usd < 0 THEN 'funding_negative' END], lambda x: x IS NOT NULL), ',') AS failed_rules
FROM broken WHERE iso3 IS NULL OR year IS NULL OR year < 2000 OR year > 2030 OR funding_usd < 0""")
def _q1b(spark, sf):
    """Q1: quarantine of rows that break each drop rule."""
    _, bad = Q.split_quarantine(_broken(spark, sf), Q.drop_rules())
    return bad.withColumn("failed_rules", F.array_join("failed_rules", ","))


@register("q3_rule_counts_broken", ["rule", "failures"], _BROKEN + R.RULE_SQL.replace("FROM gold", "FROM broken"))
def _q3b(spark, sf):
    """Q1-Q3: failure counts; every rule has failures."""
    return Q.rule_counts(_broken(spark, sf), {**Q.drop_rules(), **Q.warn_rules(), **Q.range_rules()})


@register("q2_observed_counts", ["rule", "failures"], _BROKEN + """
SELECT 'people_negative' AS rule, COUNT(*) FILTER (WHERE people_in_need < 0) AS failures FROM broken
UNION ALL SELECT 'requirements_not_positive', COUNT(*) FILTER (WHERE requirements_usd <= 0) FROM broken""")
def _q2(spark, sf):
    """Q2: warn rules counted by an observation while the rows are written."""
    seen, obs = Q.rule_metrics(_broken(spark, sf), Q.warn_rules(), f"warn-{uuid.uuid4().hex}")
    materialize(seen, "observed")
    return spark.createDataFrame([(k, int(v)) for k, v in obs.get.items()], "rule string, failures long")


EDA2 = R.EDA_SQL.replace("CAST(population AS DOUBLE) AS Population", "CAST(population AS DOUBLE) / 2000 AS Population")


@register("f19_concentrated_need", R.EDA_COLS + ["priority_score_v2", "is_forgotten", "population_missing"], EDA2 + """
SELECT *, CAST(ROUND(CAST(priority_score * (CASE WHEN Severity_Index > 0.5 THEN 2.0 ELSE 1.0 END)
                * (CASE WHEN Cluster IN ('Water Sanitation Hygiene', 'Health', 'Shelter/NFI', 'WASH', 'HEA', 'SHL') THEN 1.5 ELSE 1.0 END) AS DECIMAL(38,12)), 4) AS DOUBLE) AS priority_score_v2,
       Planning_Gap > 0.8 AND Importance_Score < 3 AS is_forgotten, Population IS NULL OR Population = 0 AS population_missing FROM m""")
def _f19c(spark, sf):
    """with a population 2000 times smaller, so that the severity bonus acts."""
    n = N.normalize_sector(P.bronze_from_testdata(spark, sf).needs_raw, "cluster")
    return EDA.decision_metrics_v2(EDA.decision_metrics(n.withColumn("population", F.col("population").cast("double") / 2000)))


SUMMARY = ["n_countries", "n_sectors", "first_year", "last_year", "mean_coverage", "mean_confidence", "n_scored", "min_score", "max_score",
           "n_structural", "n_acute", "max_multiplier"]


@register("a14_index_summary", SUMMARY, """
SELECT COUNT(DISTINCT iso3) AS n_countries, COUNT(DISTINCT sector) AS n_sectors, MIN(year) AS first_year, MAX(year) AS last_year,
       AVG(coverage_ratio) AS mean_coverage, AVG(confidence_score) AS mean_confidence, COUNT(*) FILTER (WHERE mismatch_score > 0) AS n_scored,
       MIN(mismatch_score) FILTER (WHERE mismatch_score > 0) AS min_score, MAX(mismatch_score) FILTER (WHERE mismatch_score > 0) AS max_score,
       (SELECT COUNT(DISTINCT iso3 || sector) FROM gold WHERE crisis_type = 'STRUCTURAL') AS n_structural,
       (SELECT COUNT(DISTINCT iso3 || sector) FROM gold WHERE crisis_type = 'ACUTE') AS n_acute, MAX(structural_multiplier) AS max_multiplier
FROM gold""")
def _a14s(spark, sf):
    """The build summaries (countries, sectors, years, means, score range, profile counts)."""
    return Q.index_summary(R.gold(spark, sf))


# --- S4: fences, errors and broken replies ------------------------------------------------
_REPLY = """
replies AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"error": "no data", "k": 1}'
                                  WHEN event_id % 5 = 0 THEN substr(props, 1, length(props) - 1)
                                  WHEN event_id % 3 = 0 THEN '```json' || chr(10) || props || chr(10) || '```' ELSE props END AS reply FROM events)"""


def _replies(spark, sf):
    props = F.col("props")
    reply = (
        F.when(F.col("event_id") % 7 == 0, F.lit('{"error": "no data", "k": 1}'))
        .when(F.col("event_id") % 5 == 0, F.expr("substr(props, 1, length(props) - 1)"))
        .when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(props)
    )
    ev = TD.read_table(spark, sf, "events").select("event_id", reply.alias("reply"))
    return J.parse_records(ev, "reply", T.StructType([T.StructField("k", T.IntegerType()), T.StructField("error", T.StringType())]))


@register("s4_fenced_replies", ["event_id", "k"], f""",{_REPLY}
SELECT event_id, CAST(json_extract_string(t, '$.k') AS INTEGER) AS k FROM (
  SELECT event_id, regexp_replace(reply, '^\\s*```(json)?\\s*|\\s*```\\s*$', '', 'g') AS t FROM replies) x
WHERE CASE WHEN json_valid(t) THEN json_extract_string(t, '$.error') IS NULL ELSE FALSE END""")
def _s4g(spark, sf):
    """Fenced and bare replies that parse and carry no error."""
    return _replies(spark, sf)[0]


@register("s4_quarantined_replies", ["event_id", "reply"], f""",{_REPLY}
SELECT event_id, reply FROM replies WHERE event_id % 7 = 0 OR event_id % 5 = 0""")
def _s4b(spark, sf):
    """Replies with an error field and replies that do not parse."""
    return _replies(spark, sf)[1]


# --- CSV and table sources and sinks ------------------------------------------------------
@register("s11_csv_round_trip", ["c_custkey", "c_name", "acctbal", "c_mktsegment"], """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
       c_name || CASE c_custkey % 4 WHEN 0 THEN ', "the ' || c_mktsegment || '"' WHEN 1 THEN chr(10) || 'of "' || c_mktsegment || '", too' ELSE '' END AS c_name,
       c_acctbal AS acctbal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def _s11(spark, sf):
    """S11 + S1 + P5: customers exported as CSV (quotes, commas, line breaks, nulls) and read back by the S1 scan."""
    part = F.col("c_custkey") % 4
    name = F.concat("c_name", F.when(part == 0, F.concat(F.lit(', "the '), F.col("c_mktsegment"), F.lit('"')))
                    .when(part == 1, F.concat(F.lit('\nof "'), F.col("c_mktsegment"), F.lit('", too'))).otherwise(F.lit("")))
    cust = TD.read_table(spark, sf, "customer").select(
        "c_custkey", name.alias("c_name"), F.col("c_acctbal").cast("decimal(18,2)").alias("acctbal"),
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    path = _folder(spark, "customers-csv")
    TB.export_csv(cust, path)
    return CSV.numeric(CSV.read_csv_strings(spark, path), ["acctbal"])


@register("s1_csv_rows", ["a", "b"], """
SELECT CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderpriority END AS b
FROM orders WHERE o_orderkey % 4 NOT IN (2, 3) AND o_orderkey % 9 <> 0""")
def _s1(spark, sf):
    """S1 + S2 + P1: rows with a missing cell stay, rows with a surplus cell (full or empty) and tag rows go."""
    key = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("#tag,#tag")).when(F.col("o_orderkey") % 4 == 1, key)
        .when(F.col("o_orderkey") % 4 == 2, F.concat_ws(",", key, "o_orderpriority", F.lit("more")))
        .when(F.col("o_orderkey") % 4 == 3, F.concat(key, F.lit(","), F.col("o_orderpriority"), F.lit(","))).otherwise(F.concat_ws(",", key, "o_orderpriority"))
    )
    orders = TD.read_table(spark, sf, "orders").select(line.alias("value"))
    path = _folder(spark, "orders-csv")
    orders.write.text(path + "/rows")
    spark.range(1).select(F.lit("a,b").alias("value")).write.text(path + "/header")
    return CSV.read_csv_rows(spark.read.text(path + "/rows"), ["a", "b"], skip_second_header=True)


def _yearly(spark, sf) -> dict[int, str]:
    """One CSV folder of needs per order year, with other headers in even years and a column only in odd ones."""
    per = (
        P.order_cube_of(spark, sf).where(F.col("year").isNotNull()).groupBy("nationkey", "year")
        .agg(F.sum("rf_qty").cast("long").alias("q"), F.sum("n_orders").cast("long").alias("n"))
        .join(F.broadcast(TD.nations(spark, sf).select("nationkey", "iso3")), "nationkey")
    )
    years = [r["year"] for r in per.select("year").distinct().orderBy("year").collect()]  # as many as years in the data
    out = {}
    for y in years:
        rows = per.where(F.col("year") == y)
        if y % 2 == 0:
            cols = rows.select(F.col("iso3").alias("Country ISO3"), F.format_number("q", 0).alias("In Need"))
        else:
            cols = rows.select(F.col("iso3").alias("Country ISO3"), F.col("q").cast("string").alias("In Need"), F.col("n").cast("string").alias("Targeted"))
        out[y] = _folder(spark, f"needs-{y}")
        cols.coalesce(1).write.option("header", True).csv(out[y])
    return out


@register("u1_yearly_needs_files", ["iso3", "year", "in_need", "targeted"], """
SELECT nat.iso3, f.year, CAST(SUM(f.rf_qty) AS DOUBLE) AS in_need, CASE WHEN f.year % 2 <> 0 THEN CAST(COUNT(*) AS DOUBLE) END AS targeted
FROM facts f JOIN nat USING (nationkey) WHERE f.year IS NOT NULL GROUP BY nat.iso3, f.year""")
def _u1(spark, sf):
    """S1 + P2 + P5 + P6 + U1: yearly files with differing columns, united by name; missing columns are null."""
    names = {"iso3": ["country iso3"], "in_need": ["in need"], "targeted": ["targeted"]}
    return CSV.read_needs_files(spark, _yearly(spark, sf), names)


@register("s3_severity_sheet", ["iso3", "country", "year", "inform_severity", "inform_risk"], """
SELECT nat.iso3, nat.country, CASE WHEN nationkey % 7 = 0 THEN NULL ELSE 2020 + nationkey % 5 END AS year, custs.n_low / 10.0 AS inform_severity,
       CASE WHEN nationkey % 4 = 0 THEN NULL ELSE CAST(custs.n_customers AS DOUBLE) END AS inform_risk
FROM nat JOIN custs USING (nationkey)""")
def _s3(spark, sf):
    """S3 + P2 + P5: the severity sheet as CSV with spaced and punctuated headers and text numbers."""
    cust = TD.read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 4000).alias("low")
    )
    sheet = TD.nations(spark, sf).join(cust, "nationkey").select(
        F.col("iso3").alias("ISO3"), F.col("country").alias("COUNTRY"),
        F.when(F.col("nationkey") % 7 == 0, F.lit("n/a")).otherwise((F.col("nationkey") % 5 + 2020).cast("string")).alias("Year"),
        (F.col("low") / 10.0).cast("decimal(18,1)").cast("string").alias("INFORM Severity Index"),
        F.when(F.col("nationkey") % 4 == 0, F.lit("x")).otherwise(F.format_number("n", 0)).alias("INFORM Risk"),
    )
    path = _folder(spark, "severity-csv")
    sheet.coalesce(1).write.option("header", True).csv(path)
    return CSV.severity_sheet(spark, path)


@register("s3_workbook_scan", ["source_file", "c_custkey", "c_name", "acctbal", "c_mktsegment"], """
SELECT 'customers-' || CAST(c_custkey // 500 AS VARCHAR) || '.xlsx' AS source_file, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' & <co>' AS c_name,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS acctbal, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def _s3b(spark, sf):
    """S3 + P5 + P6: customers written as workbooks of 500 keys each (title row, shared strings, numbers, blanks) and read back."""
    cust = TD.read_table(spark, sf, "customer").select(
        F.concat(F.lit("customers-"), F.floor(F.col("c_custkey") / 500).cast("string")).alias("book"), "c_custkey", F.concat("c_name", F.lit(" & <co>")).alias("c_name"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("double")).alias("acctbal"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    books = materialize(WB.to_workbooks(cust, "book", "Customers", [["Customers of the bank", None]]), "workbooks")
    return CSV.numeric(WB.sheet_table(WB.read_cells(books), "Customers", header_row=1), ["acctbal"])


@register("s14_population_baseline", ["iso3", "year", "population"], """
SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS iso3, CAST(2000 + c_custkey % 3 AS INTEGER) AS year,
       CAST(SUM(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 1000 + c_custkey END) AS BIGINT) AS population FROM customer GROUP BY 1, 2""")
def _s14(spark, sf):
    """Population rows (one per customer, with thousands commas and junk) summed per country and year."""
    rows = TD.read_table(spark, sf, "customer").select(
        F.concat(F.lit(" n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("iso3"), (F.col("c_custkey") % 3 + 2000).cast("string").alias("year"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit("unknown")).otherwise(F.format_number(F.col("c_custkey") + 1000, 0)).alias("population"),
    )
    return CSV.population_baseline(rows)


@register("p3_snake_case_rename", ["o_order_key", "customer", "price_text", "raw_coverage"], """
SELECT o_orderkey AS o_order_key, o_custkey AS customer, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ROUND(o_totalprice) END AS price_text,
       COALESCE(ROUND(o_totalprice) / NULLIF(o_custkey % 4, 0), 0.0) AS raw_coverage FROM orders""")
def _p3(spark, sf):
    """P3 + P4 + P5 + P10: camel-case columns renamed and dropped, text numbers parsed, raw ratio without a cap."""
    src = TD.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("oOrderKey"), F.col("o_custkey").alias("oCustKey"), F.col("o_orderpriority").alias("orderPriority"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.format_number(F.round("o_totalprice"), 0)).alias("priceText"), F.col("o_totalprice").alias("p"),
    )
    out = CSV.drop_and_rename(CSV.snake_case_columns(src), ["order_priority", "not_there"], {"o_cust_key": "customer", "not_there": "x"})
    return CSV.numeric(out, ["price_text"]).withColumn("raw_coverage", CL.raw_coverage(F.round("p"), F.col("customer") % 4))


@register("p26_total_category", ["c_custkey", "category"], """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Total' ELSE 'TOTAL' END AS category FROM customer WHERE c_custkey % 4 IN (0, 2)""")
def _p26(spark, sf):
    """Only the rows of the total category, in any case."""
    category = F.when(F.col("c_custkey") % 4 == 0, F.lit("Total")).when(F.col("c_custkey") % 4 == 2, F.lit("TOTAL")).otherwise(F.col("c_mktsegment"))
    return EDA.total_category_only(TD.read_table(spark, sf, "customer").select("c_custkey", category.alias("category")))


@register("s8_table_writes", ["c_custkey", "c_mktsegment", "copies"], """
SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS copies FROM customer""")
def _s8(spark, sf):
    """S6 + S7 + S8 + S10 + S12: layers made, overwrite then append, an empty write that keeps the table, a missing table as empty."""
    prefix = f"q{uuid.uuid4().hex[:12]}_"
    TB.init_schemas(spark, prefix)
    name = f"{prefix}bronze.customers"
    cust = TD.read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    missing = TB.table_or_empty(spark, name, cust.schema)
    TB.write_table(cust.limit(1), name)
    TB.write_table(cust, name)
    TB.write_table(cust.where(F.col("c_custkey") % 2 == 0), name, mode="append")
    TB.write_table(cust.limit(0), name)
    read = TB.table_or_empty(spark, name, cust.schema).unionByName(missing)
    if TB.scalar(read.agg(F.count(F.lit(1)))) is None:
        raise ValueError("a count always has a cell")
    return read.groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@register("g1_incremental_load", ["user_id", "n_events", "first_day", "last_day"], """
SELECT user_id, COUNT(DISTINCT event_id) AS n_events, CAST(MIN(ts) AS DATE) AS first_day, CAST(MAX(ts) AS DATE) AS last_day FROM events GROUP BY user_id""")
def _g1(spark, sf):
    """G1 + S13: events landed in three deliveries, the earliest ones last and a third of them twice, loaded incrementally, counted per user."""
    ev = TD.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    landing, sink, checkpoint = (_folder(spark, n) for n in ("landing", "loaded", "load-state"))
    late = F.day("ts") <= 10
    for rows in (ev.where(~late), ev.where(late & (F.col("event_id") % 2 == 0)), ev.where(late | (F.col("event_id") % 3 == 0))):
        rows.write.mode("append").parquet(landing)
        ingest.start_incremental_load(spark, landing, ev.schema, ["event_id"], "ts", sink, checkpoint, key_fixes_time=True).awaitTermination()
    rows = ingest.loaded(spark, sink, ev.schema)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))


@register("s9_in_place_update", ["crisis_id", "year", "funding_usd", "state"], """
SELECT crisis_id, year, funding_usd, 'kept' AS state FROM gold WHERE year % 2 = 0
UNION ALL SELECT crisis_id, year, funding_usd * 2, 'updated' FROM gold WHERE year % 2 <> 0 AND sector <> (SELECT MIN(sector) FROM gold)
UNION ALL SELECT crisis_id || '_new', year, 1.0, 'added' FROM gold WHERE year % 2 <> 0 AND sector = (SELECT MAX(sector) FROM gold)""")
def _s9b(spark, sf):
    """One table read, changed and overwritten in place: in odd years funding doubles, one sector's rows go and rows are added."""
    g = P.gold_index(spark, sf).select("crisis_id", "year", "sector", "funding_usd")
    name = f"index_{uuid.uuid4().hex[:12]}"
    g.select("crisis_id", "funding_usd", F.lit("kept").alias("state"), "year").repartition("year").write.partitionBy("year").option("path", _folder(spark, name)).saveAsTable(name)
    least, most = g.agg(F.min("sector"), F.max("sector")).first()
    odd = g.where(F.col("year") % 2 != 0)
    ups = odd.where(F.col("sector") != least).select("crisis_id", (F.col("funding_usd") * 2).alias("funding_usd"), F.lit("updated").alias("state"), "year")
    new = odd.where(F.col("sector") == most).select(F.concat("crisis_id", F.lit("_new")).alias("crisis_id"), F.lit(1.0).alias("funding_usd"), F.lit("added").alias("state"), "year")
    TB.overwrite_partitions(ups.unionByName(new), name, ["crisis_id", "year"], deletes=odd.where(F.col("sector") == least).select("crisis_id", "year"))
    out = materialize(spark.table(name), "updated-index")
    spark.sql(f"DROP TABLE {name}")
    return out


@register("g2_sliding_attention", ["iso3", "window_start", "window_end", "article_count"], """
, per_day AS (SELECT nat.iso3, CAST(ts AS DATE) AS day FROM events JOIN nat ON CAST(events.user_id % 25 AS INTEGER) = nat.nationkey)
SELECT iso3, day - CAST(k AS INTEGER) AS window_start, day - CAST(k AS INTEGER) + 30 AS window_end, COUNT(*) AS article_count
FROM per_day, range(30) AS r(k) GROUP BY 1, 2, 3""")
def _g2b(spark, sf):
    """G2 (stream): 30-day attention windows with a daily slide, kept as state per country, over deliveries with the latest days first."""
    ev = TD.read_table(spark, sf, "events")
    landing, sink, checkpoint = (_folder(spark, n) for n in ("articles", "windows", "window-state"))
    nations = F.broadcast(TD.nations(spark, sf).select("nationkey", "iso3"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, sliding.ROCKS)
    try:
        for late in (False, True):
            ev.where((F.day("ts") <= 12) == late).write.mode("append").parquet(landing)
            articles = spark.readStream.schema(ev.schema).parquet(landing).join(nations, (F.col("user_id") % 25).cast("int") == F.col("nationkey"))
            sliding.start_sliding_counts(articles, F.col("iso3"), "ts", sink, checkpoint).awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    found = sliding.latest_windows(spark.read.parquet(sink))
    return found.select(F.col("key").alias("iso3"), "window_start", "window_end", F.col("n").alias("article_count"))


@register("w9_order_percent_rank", ["o_orderkey", "percent_rank"], """
SELECT o_orderkey, PERCENT_RANK() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE FLOOR(o_totalprice) END) AS percent_rank FROM orders""")
def _w9b(spark, sf):
    """W9 over a table that grows: percent rank of order values of which a third are equal."""
    price = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(F.floor("o_totalprice"))
    orders = TD.read_table(spark, sf, "orders").select("o_orderkey", price.alias("price"))
    n = orders.agg(F.count(F.lit(1))).scalar()
    return global_rank(orders, ["price"], ["o_orderkey"]).select("o_orderkey", ((F.col("rank") - 1) / (n - 1)).alias("percent_rank"))


@register("q2_stream_metrics", ["rule", "failures", "n_rows"], """
SELECT rule, CAST(SUM(CASE WHEN broken THEN 1 ELSE 0 END) AS BIGINT) AS failures, COUNT(*) AS n_rows FROM (
  SELECT 'value_above_20' AS rule, value > 20 AS broken FROM events
  UNION ALL SELECT 'is_error', event_type = 'error' FROM events
  UNION ALL SELECT 'user_in_first_ten', user_id < 10 FROM events) t GROUP BY rule""")
def _q2b(spark, sf):
    """Q2 (stream): events in two deliveries; the rule counts of every micro-batch, added up."""
    ev = TD.read_table(spark, sf, "events")
    landing, sink, metrics, checkpoint = (_folder(spark, n) for n in ("observed-in", "observed", "metrics", "observed-state"))
    rules = {"value_above_20": F.col("value") > 20, "is_error": F.col("event_type") == "error", "user_in_first_ten": F.col("user_id") < 10}
    for part in (0, 1):
        ev.where(F.col("event_id") % 2 == part).write.mode("append").parquet(landing)
        SQ.start_observed(spark.readStream.schema(ev.schema).parquet(landing), rules, sink, metrics, checkpoint).awaitTermination()
    return spark.read.parquet(metrics).groupBy("rule").agg(F.sum("failures").alias("failures"), F.sum("n_rows").alias("n_rows"))


@register("p23_indexed_search", ["text", "c_custkey", "c_name", "c_mktsegment"], """
SELECT text, c_custkey, c_name, c_mktsegment FROM customer, (VALUES ('CHINE'), ('00001'), ('r#0000000'), ('no such'), ('bu')) AS t(text)
WHERE contains(lower(c_name), lower(text)) OR contains(lower(c_mktsegment), lower(text))""")
def _p23b(spark, sf):
    """Customers by name or segment over an inverted index of three-character pieces (a short text by scan)."""
    cust = TD.read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = _folder(spark, "pieces")
    S.build_index(cust, "c_custkey", ["c_name", "c_mktsegment"], path)
    found = [S.search(cust, "c_custkey", ["c_name", "c_mktsegment"], t, path).withColumn("text", F.lit(t)) for t in ("CHINE", "00001", "r#0000000", "no such", "bu")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


PAGE, SEEK = 50, (150_000.0, 0)  # rows a page, and a key that lies among the orders


@register("t1_order_pages", ["page", "ordinal", "o_orderkey", "o_totalprice"], f"""
SELECT CAST((ordinal - 1) // {PAGE} AS BIGINT) AS page, ordinal, o_orderkey, o_totalprice
FROM (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders) t""")
def _t1a(spark, sf):
    """The pages of all orders by value, from the written chunks put together."""
    path = _folder(spark, "order-pages")
    paging.write_pages(TD.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], path, chunk_rows=10_000)
    rows = paging.Pages(spark, path).rows
    return rows.select(F.expr(f"(_ordinal - 1) div {PAGE}").alias("page"), F.col("_ordinal").alias("ordinal"), "o_orderkey", "o_totalprice")


@register("t1_seek_pages", ["page", "ordinal", "o_orderkey", "o_totalprice"], f"""
, sorted AS (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders),
seek AS (SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > {SEEK[0]} OR (o_totalprice = {SEEK[0]} AND o_orderkey <= {SEEK[1]}))
SELECT CASE WHEN ordinal <= {PAGE} THEN 'first' WHEN ordinal <= n + {PAGE} THEN 'behind the key' ELSE 'next' END AS page, ordinal, o_orderkey, o_totalprice
FROM sorted, seek WHERE ordinal <= {PAGE} OR (ordinal > n AND ordinal <= n + 2 * {PAGE})""")
def _t1b(spark, sf):
    """The first page of all orders by value, the page behind a key and the one behind its last row."""
    path = _folder(spark, "order-pages")
    paging.write_pages(TD.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], path, chunk_rows=10_000)
    pages = paging.Pages(spark, path)
    second = pages.after(SEEK, PAGE)
    last = second.orderBy(F.col("_ordinal").desc()).first()
    third = pages.after((last.o_totalprice, last.o_orderkey), PAGE)
    found = pages.at(0, PAGE).withColumn("page", F.lit("first")).unionByName(second.withColumn("page", F.lit("behind the key"))).unionByName(third.withColumn("page", F.lit("next")))
    return found.withColumnRenamed("_ordinal", "ordinal")


@register("a5_order_quantiles", ["o_orderpriority", "fraction", "n", "quantile"], """
SELECT o_orderpriority, f AS fraction, COUNT(*) AS n,
       CASE f WHEN 0.1 THEN QUANTILE_CONT(v, 0.1) WHEN 0.5 THEN QUANTILE_CONT(v, 0.5) ELSE QUANTILE_CONT(v, 0.9) END AS quantile
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 100000.0 ELSE CAST(o_totalprice AS DOUBLE) END AS v FROM orders) o,
     (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS t(f) GROUP BY o_orderpriority, f""")
def _a5b(spark, sf):
    """A5 over a table that grows: exact deciles and medians of order values per priority; a third of the values are equal."""
    price = F.when(F.col("o_orderkey") % 3 == 0, 100000.0).otherwise(F.col("o_totalprice").cast("double"))
    return group_quantiles(TD.read_table(spark, sf, "orders").select("o_orderpriority", price.alias("v")), ["o_orderpriority"], "v", (0.1, 0.5, 0.9))


@register("p20_build_time", ["kind", "n_rows", "n_set", "n_times"], """
SELECT 'timestamp' AS kind, COUNT(*) AS n_rows, COUNT(*) AS n_set, CAST(1 AS BIGINT) AS n_times FROM gold""")
def _p20(spark, sf):
    """P20: the index with its build time: a timestamp, set in every row, one for the whole build."""
    built = P.score(P.base_index(spark, sf), updated_at=True)
    return built.agg(F.max(F.typeof("updated_at")).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count("updated_at").alias("n_set"), F.count_distinct("updated_at").alias("n_times"))


@register("f17_card_details", ["crisis_id", "card_type", "attribution", "funded", "gap", "need_weight", "gap_severity", "structural_multiplier",
                               "urgency_weight", "visibility_penalty", "n_sectors", "sector_reqs"], """
, cards AS (SELECT UNNEST([{'t': 'FUNDING_GAP', 's': 'UN OCHA FTS'}, {'t': 'MISMATCH_RANK', 's': 'UN OCHA / INFORM'},
                           {'t': 'DONOR_RISK', 's': 'UN OCHA CBPF'}, {'t': 'SECTOR_BREAKDOWN', 's': 'UN OCHA FTS'}]) AS c),
worst AS (SELECT iso3, year, CAST(COUNT(*) AS INTEGER) AS n, SUM(requirements_usd) AS r
          FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY iso3, year ORDER BY coverage_ratio, sector) AS rn FROM gold) x WHERE rn <= 8 GROUP BY iso3, year)
SELECT crisis_id, c.t AS card_type, 'Data: ' || c.s || ' / Lacuna' AS attribution,
       CASE WHEN c.t = 'FUNDING_GAP' THEN COALESCE(funding_usd, 0.0) END AS funded,
       CASE WHEN c.t = 'FUNDING_GAP' THEN GREATEST(0.0, requirements_usd - funding_usd) END AS gap,
       CASE WHEN c.t = 'MISMATCH_RANK' THEN COALESCE(need_weight, 0.0) END AS need_weight,
       CASE WHEN c.t = 'MISMATCH_RANK' THEN COALESCE(gap_severity, 0.0) END AS gap_severity,
       CASE WHEN c.t = 'MISMATCH_RANK' THEN COALESCE(structural_multiplier, 1.0) END AS structural_multiplier,
       CASE WHEN c.t = 'MISMATCH_RANK' THEN COALESCE(urgency_weight, 1.0) END AS urgency_weight,
       CASE WHEN c.t = 'MISMATCH_RANK' THEN COALESCE(visibility_penalty, 1.0) END AS visibility_penalty,
       CASE WHEN c.t = 'SECTOR_BREAKDOWN' THEN w.n END AS n_sectors, CASE WHEN c.t = 'SECTOR_BREAKDOWN' THEN w.r END AS sector_reqs
FROM gold JOIN worst w USING (iso3, year), cards""")
def _f17b(spark, sf):
    """chart data, score factors and listed sectors of the insight cards."""
    cards = A.insight_cards(R.gold(spark, sf), R.donors(spark, sf))
    has = F.col("sectors").isNotNull()
    return cards.select(
        "crisis_id", "card_type", "attribution", F.col("chart_data")[0]["value"].alias("funded"), F.col("chart_data")[1]["value"].alias("gap"), "factors.*",
        F.when(has, F.size("sectors")).alias("n_sectors"),
        F.when(has, F.aggregate("sectors", F.lit(0.0), lambda a, x: a + x["reqs"])).alias("sector_reqs"))


@register("s9_layer_tables", ["layer_table", "n_rows"], """
SELECT 'bronze.severity_raw' AS layer_table, COUNT(*) AS n_rows FROM (SELECT DISTINCT iso3, year FROM funding) s
UNION ALL SELECT 'silver.funding', COUNT(*) FROM funding
UNION ALL SELECT 'silver.needs', COUNT(*) FROM needs
UNION ALL SELECT 'gold.crisis_index', COUNT(*) FROM gold
UNION ALL SELECT 'gold.donor_concentration', COUNT(*) FROM donors""")
def _s9(spark, sf):
    """The layers written as tables by the staged run, counted back from the catalog."""
    prefix = f"q{uuid.uuid4().hex[:12]}_"
    for stage in ("bronze", "silver", "gold"):
        P.run(spark, sf, stage, prefix)
    names = ["bronze.severity_raw", "silver.funding", "silver.needs", "gold.crisis_index", "gold.donor_concentration"]
    counts = [spark.table(prefix + n).agg(F.lit(n).alias("layer_table"), F.count(F.lit(1)).alias("n_rows")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


QUERIES = R.QUERIES
