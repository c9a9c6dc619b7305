"""Independent SQL (DuckDB dialect) for every registered query.

Written from the model's definitions, not generated from the Spark plans.
Views ``region nation customer ... conversations`` are the driver tables.
``GOLD`` is a chain of CTEs ending in ``gold`` (the scored, ranked index),
``donors`` and a few helpers; each query appends its own final SELECT.
Double columns are rounded to 6 places on both sides (``ROUNDED``).
"""

from __future__ import annotations

from lacuna.functions import constants as C

SEGMENTS = ", ".join(f"('{k}', '{v}')" for k, v in C.SEGMENT_TO_SECTOR.items())
REGIONS = ", ".join(f"('{k}', '{v}')" for k, v in C.REGION_MAP.items())

GOLD = f"""
WITH
rf AS (
  SELECT l_orderkey, SUM(l_quantity) AS rf_qty
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
  GROUP BY l_orderkey
),
facts AS (
  SELECT c.c_nationkey AS nationkey,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         c.c_mktsegment AS segment, o.o_orderstatus AS status, o.o_orderpriority AS priority,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS price, rf.rf_qty
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN rf ON rf.l_orderkey = o.o_orderkey
),
nat AS (
  SELECT n_nationkey AS nationkey, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3,
         n_name AS country, r_name AS region
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
),
seg(segment, sector) AS (VALUES {SEGMENTS}),
fixed_region(iso3, region) AS (VALUES {REGIONS}),
custs AS (
  SELECT c_nationkey AS nationkey, COUNT(*) AS n_customers,
         COUNT(*) FILTER (WHERE c_acctbal < 4000) AS n_low
  FROM customer GROUP BY c_nationkey
),
funding AS (
  SELECT nat.iso3, MIN(nat.country) AS country, f.year, seg.sector,
         CAST(SUM(f.price) AS DOUBLE) AS requirements_usd,
         CAST(SUM(CASE f.status WHEN 'F' THEN CAST(f.price AS DECIMAL(38,3))
                                  WHEN 'P' THEN CAST(f.price * 0.5 AS DECIMAL(38,3))
                                  ELSE CAST(0 AS DECIMAL(38,3)) END) AS DOUBLE) AS funding_usd
  FROM facts f JOIN nat USING (nationkey) JOIN seg USING (segment)
  GROUP BY nat.iso3, f.year, seg.sector
),
needs AS (
  SELECT nat.iso3, MIN(nat.country) AS country, f.year, seg.sector,
         CAST(SUM(f.rf_qty) * 100 AS BIGINT) AS people_in_need,
         CAST(SUM(CASE WHEN f.status = 'F' THEN f.rf_qty END) * 100 AS BIGINT) AS people_targeted,
         CAST(MAX(custs.n_customers) * 100000 AS BIGINT) AS population
  FROM facts f JOIN nat USING (nationkey) JOIN seg USING (segment) JOIN custs USING (nationkey)
  WHERE f.rf_qty IS NOT NULL
  GROUP BY nat.iso3, f.year, seg.sector
),
severity AS (
  SELECT DISTINCT nat.iso3, f.year,
         LEAST(GREATEST(CAST(10.0 AS DOUBLE) * custs.n_low / custs.n_customers, 0.0), 10.0) AS inform_severity
  FROM facts f JOIN nat USING (nationkey) JOIN custs USING (nationkey)
  WHERE f.nationkey % 5 <> 4
),
articles AS (
  SELECT nat.iso3, COUNT(*) AS n_articles
  FROM events JOIN nat ON CAST(events.user_id % 25 AS INTEGER) = nat.nationkey
  GROUP BY nat.iso3
),
base AS (
  SELECT fu.iso3, fu.country,
         COALESCE(nat.region, fixed_region.region, 'Other') AS region,
         fu.year, fu.sector, fu.requirements_usd, fu.funding_usd,
         COALESCE(nd.people_in_need, 0) AS people_in_need,
         COALESCE(nd.people_targeted, 0) AS people_targeted,
         COALESCE(nd.population, 0) AS population,
         COALESCE(sv.inform_severity, 5.0) AS inform_severity,
         CASE WHEN fu.requirements_usd > 0 THEN LEAST(fu.funding_usd / fu.requirements_usd, 1.0) ELSE 0.0 END AS coverage_ratio,
         CASE WHEN COALESCE(nd.population, 0) > 0 THEN CAST(nd.people_in_need AS DOUBLE) / nd.population ELSE 0.0 END AS pin_per_capita,
         fu.iso3 || '_' || CAST(fu.year AS VARCHAR) || '_' || fu.sector AS crisis_id,
         COALESCE(LEAST(CAST(ar.n_articles AS DOUBLE) / 1000.0, 1.0), 0.5) AS media_visibility
  FROM funding fu
  LEFT JOIN needs nd USING (iso3, year, sector)
  LEFT JOIN severity sv USING (iso3, year)
  LEFT JOIN nat ON nat.iso3 = fu.iso3
  LEFT JOIN fixed_region ON fixed_region.iso3 = fu.iso3
  LEFT JOIN articles ar ON ar.iso3 = fu.iso3
),
conf AS (
  SELECT b.*,
         CASE WHEN age = 0 THEN 1.0 ELSE GREATEST(EXP(CAST(-0.4 AS DOUBLE) * age), 0.1) END AS freshness_score
  FROM (SELECT *, GREATEST((SELECT MAX(year) FROM funding) - year, 0) AS age FROM base) b
),
conf2 AS (
  SELECT c.*,
         CAST(CASE WHEN requirements_usd = 0 AND people_in_need = 0 THEN LEAST(raw_c, 0.4) ELSE raw_c END AS DOUBLE) AS completeness_score
  FROM (SELECT *,
          ((CASE WHEN requirements_usd > 0 THEN 1.5 ELSE 0 END)
         + (CASE WHEN people_in_need > 0 THEN 1.5 ELSE 0 END)
         + (CASE WHEN funding_usd > 0 THEN 1.0 ELSE 0 END)
         + (CASE WHEN inform_severity > 0 AND inform_severity <> 5.0 THEN 0.5 ELSE 0 END)
         + (CASE WHEN population > 0 THEN 0.5 ELSE 0 END)) / CAST(5.0 AS DOUBLE) AS raw_c
        FROM conf) c
),
conf3 AS (
  SELECT *, ROUND(freshness_score * 0.5 + CAST(completeness_score AS DOUBLE) * 0.5, 3) AS confidence_score
  FROM conf2
),
ser AS (
  SELECT iso3, sector, year, coverage_ratio,
         GREATEST(requirements_usd - funding_usd, 0.0) AS gap,
         ROW_NUMBER() OVER (PARTITION BY iso3, sector ORDER BY year DESC) AS rn,
         MAX(CASE WHEN coverage_ratio >= 0.5 THEN year END) OVER (PARTITION BY iso3, sector) AS last_ok
  FROM base
),
prof0 AS (
  SELECT iso3, sector, COUNT(*) AS n_years,
         COUNT(*) FILTER (WHERE last_ok IS NULL OR year > last_ok) AS consecutive_years_underfunded,
         MAX(coverage_ratio) FILTER (WHERE rn = 1) AS c1,
         MAX(coverage_ratio) FILTER (WHERE rn = 2) AS c2,
         MAX(coverage_ratio) FILTER (WHERE rn = 3) AS c3,
         MAX(gap) FILTER (WHERE rn = 1) AS g1,
         MAX(gap) FILTER (WHERE rn = 2) AS g2,
         MAX(gap) FILTER (WHERE rn = 3) AS g3
  FROM ser GROUP BY iso3, sector
),
prof1 AS (
  SELECT *,
         CASE WHEN n_years >= 3 THEN c3 ELSE c2 END AS early,
         CASE WHEN n_years >= 3 THEN (c2 + c1) / 2 ELSE c1 END AS late,
         CASE WHEN n_years >= 3 THEN g3 ELSE g2 END AS gap_early,
         CASE WHEN n_years >= 3 THEN (g2 + g1) / 2 ELSE g1 END AS gap_late
  FROM prof0
),
prof AS (
  SELECT iso3, sector, n_years, consecutive_years_underfunded,
         CASE WHEN n_years < 2 THEN 0.0 ELSE
           (CASE WHEN late < early - 0.05 THEN 0.10 WHEN late < 0.40 THEN 0.05 ELSE 0.0 END)
         + (CASE WHEN gap_early > 0 AND gap_late / gap_early > 1.10 THEN 0.15 ELSE 0.0 END) END AS trend_penalty
  FROM prof1
),
struct AS (
  SELECT c.*, CAST(p.consecutive_years_underfunded AS INTEGER) AS consecutive_years_underfunded, CAST(p.trend_penalty AS DOUBLE) AS trend_penalty,
         1.0 + p.consecutive_years_underfunded * CAST(0.15 AS DOUBLE) + CAST(p.trend_penalty AS DOUBLE) AS structural_multiplier,
         CASE WHEN p.consecutive_years_underfunded >= 3 THEN 'STRUCTURAL'
              WHEN p.consecutive_years_underfunded >= 1 THEN 'ACUTE'
              WHEN p.n_years > 1 THEN 'RECOVERING' ELSE 'ACUTE' END AS crisis_type
  FROM conf3 c JOIN prof p USING (iso3, sector)
),
cpp AS (
  SELECT *, CASE WHEN people_in_need > 0 THEN requirements_usd / people_in_need ELSE 0.0 END AS cost_per_pin
  FROM struct
),
med AS (
  SELECT sector, MEDIAN(cost_per_pin) AS med FROM cpp WHERE cost_per_pin > 0 GROUP BY sector
),
scored0 AS (
  SELECT x.*,
         CASE WHEN x.cost_per_pin = 0 OR med.med IS NULL OR med.med = 0 THEN 1.0
              WHEN x.cost_per_pin / med.med > 3.0 THEN 1.0 - LEAST((x.cost_per_pin / med.med - 3.0) * 0.05, 0.40)
              ELSE 1.0 END AS efficiency_discount,
         GREATEST(LOG10(GREATEST(CAST(x.people_in_need AS DOUBLE), 0.0) + 1), 0.1)
           * (x.inform_severity / 10.0) * (1.0 + LEAST(x.pin_per_capita, 1.0) * 0.5) AS need_weight,
         POW(1.0 - LEAST(GREATEST(x.coverage_ratio, 0.0), 1.0), 1.3) AS gap_severity,
         1.0 + (1.0 - LEAST(GREATEST(x.media_visibility, 0.0), 1.0)) * 0.2 AS visibility_penalty,
         CAST(CASE WHEN lower(x.sector) LIKE '%wash%' OR lower(x.sector) LIKE '%water sanitation hygiene%'
                OR lower(x.sector) LIKE '%health%' OR lower(x.sector) LIKE '%shelter%'
                OR lower(x.sector) LIKE '%nfi%' THEN 1.5
              WHEN lower(x.sector) LIKE '%food security%' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS urgency_weight
  FROM cpp x LEFT JOIN med USING (sector)
),
scored1 AS (
  SELECT *, gap_severity * structural_multiplier * visibility_penalty * urgency_weight AS mismatch_score
  FROM scored0
),
scored AS (
  SELECT *,
         mismatch_score * (1.0 - (1.0 - confidence_score) * 0.3) AS mismatch_score_lower_bound,
         mismatch_score * (1.0 + (1.0 - confidence_score) * 0.3) AS mismatch_score_upper_bound,
         (requirements_usd >= 100000 OR people_in_need >= 1000) AS is_in_scope,
         CASE WHEN confidence_score >= 0.8 THEN 'HIGH' WHEN confidence_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
         ((requirements_usd >= 100000 OR people_in_need >= 1000) AND (requirements_usd > 0 OR people_in_need > 0)) AS rankable
  FROM scored1
),
gold AS (
  SELECT * EXCLUDE (rankable, age, raw_c),
         CAST(CASE WHEN rankable THEN ROW_NUMBER() OVER (PARTITION BY rankable ORDER BY mismatch_score_lower_bound DESC, crisis_id) ELSE 0 END AS BIGINT) AS global_rank
  FROM scored
),
cbpf AS (
  SELECT nat.iso3, f.year, f.priority AS donor_name,
         SUM(CASE WHEN f.status = 'F' THEN f.price ELSE 0 END) AS paid,
         SUM(f.price) AS pledged
  FROM facts f JOIN nat USING (nationkey)
  GROUP BY nat.iso3, f.year, f.priority
),
shares AS (
  SELECT iso3, year, donor_name, CAST(paid AS DOUBLE) AS paid_d,
         CAST(paid AS DOUBLE) / CAST(SUM(paid) OVER (PARTITION BY iso3, year) AS DOUBLE) AS share,
         SUM(paid) OVER (PARTITION BY iso3, year) AS total_fund
  FROM cbpf
),
dm AS (
  SELECT iso3, year, SUM(share * share) AS hhi_index, CAST(COUNT(*) AS INTEGER) AS donor_count,
         MAX(share) AS top_donor_share,
         FIRST(donor_name ORDER BY share DESC, donor_name) AS top_donor_name
  FROM shares WHERE total_fund > 0 GROUP BY iso3, year
),
donors AS (
  SELECT g.crisis_id, g.iso3, g.year, g.sector,
         COALESCE(dm.hhi_index, 0.0) AS hhi_index,
         COALESCE(dm.top_donor_name, 'Unknown') AS top_donor_name,
         COALESCE(dm.top_donor_share, 0.0) AS top_donor_share,
         COALESCE(dm.donor_count, 0) AS donor_count,
         CASE WHEN dm.iso3 IS NULL THEN 'UNKNOWN'
              WHEN dm.hhi_index > 0.25 AND dm.top_donor_share > 0.5 THEN 'HIGH'
              WHEN dm.hhi_index > 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS dependency_risk
  FROM base g LEFT JOIN dm USING (iso3, year)
)
"""


def rounded(select_sql: str, columns: list[str], doubles: set[str], digits: int = 6) -> str:
    """Wrap a query so double columns are rounded like the Spark side."""
    cols = ", ".join(f"ROUND({c}, {digits}) AS {c}" if c in doubles else c for c in columns)
    return f"SELECT {cols} FROM ({select_sql}) q"
