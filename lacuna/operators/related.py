"""Similar crises — same region and type, |coverage difference| < 0.15, top-k by score.

Exact, without emitting all pairs of a (region, type) group and without a row
loop. Coverage is an integer number of 1e-12 units, cut into cells of an
eighth of the band. All crises of a cell have the cells less than the band
away in common; the best of these are found once per cell, from the best of
each cell. Of the cells at the edge of the band, only crises that beat the last
one of a cell's full list can matter to that cell. Where they are few, every
crisis of the cell looks through them; where they are more than ``MOST_EDGE``
(scores that rise with the coverage, say), they form a binary tree over the
units: a point belongs to one node per level, every node keeps its best, and
the open interval of a crisis splits into at most two nodes per level. So a
crisis meets a bounded number of candidates, however many crises share its
region, type and coverage, and no task holds more rows than a few per crisis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as C
from lacuna.session import materialize

UNITS = 10**12
CELLS, MOST_EDGE = 8, 64
_CELL = ["_r", "_t", "_cell"]


def _best(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``_o`` for each of the keys."""
    order = Window.partitionBy(*keys).orderBy("_o")
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def _sorted_list(name: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("_o", "_c"))).alias(name)


def _tree_candidates(queries: DataFrame, edge: DataFrame, width: int, keep: int) -> DataFrame:
    """(crisis_id, _o) of the best ``edge`` points in each tree node of the units c - width < x < c + width, per cell."""
    level = F.explode(F.sequence(F.lit(0), F.lit(max(1, (2 * width).bit_length())))).alias("_level")
    nodes = _best(edge.select("*", level).withColumn("_node", F.expr("shiftright(_c, _level)")), [*_CELL, "_level", "_node"], keep).drop("_c")
    # per level the first and the last node that no higher node covers
    spans = (
        queries.select("crisis_id", *_CELL, (F.col("_c") - width + 1).alias("_lo"), (F.col("_c") + width).alias("_hi"), level)
        .withColumn("_a", F.expr("-shiftright(-_lo, _level)")).withColumn("_b", F.expr("shiftright(_hi, _level)"))
        .where(F.col("_a") < F.col("_b"))
    )
    odd = spans.withColumn("_node", F.explode(F.array_compact(F.array(
        F.when(F.col("_a").bitwiseAND(F.lit(1)) == 1, F.col("_a")), F.when(F.col("_b").bitwiseAND(F.lit(1)) == 1, F.col("_b") - 1)
    )))).select("crisis_id", *_CELL, "_level", "_node")
    return odd.join(nodes, [*_CELL, "_level", "_node"]).where(F.col("crisis_id") != F.col("_o.id")).select("crisis_id", "_o")


def related_crises(gold: DataFrame, k: int = 5, band: float = C.RELATED_COVERAGE_BAND) -> DataFrame:
    """(crisis_id, related_id, position) for every in-scope crisis. Null region or type is a group of its own."""
    width = round(band * UNITS)
    step = max(1, width // CELLS)
    reach, keep = width // step, 2 * (k + 1)  # a crisis is in its own list, more than once if its id repeats
    score = F.col("mismatch_score")
    pts = gold.where(F.col("is_in_scope") & F.col("coverage_ratio").isNotNull() & F.col("crisis_id").isNotNull()).select(
        "crisis_id", F.coalesce("region", F.lit("")).alias("_r"), F.coalesce("crisis_type", F.lit("")).alias("_t"),
        F.round(F.col("coverage_ratio").cast("decimal(38,12)") * UNITS, 0).cast("long").alias("_c"),
        # ascending: the score descending with null last and NaN first, then the id
        F.struct(score.isNull().alias("none"), (~F.isnan(score)).alias("number"), (-score).alias("less"), F.col("crisis_id").alias("id")).alias("_o"),
    ).where(F.col("_c").isNotNull()).withColumn("_cell", F.expr(f"(_c - pmod(_c, {step}L)) div {step}L"))
    # dealt evenly: a table of few files would give a task many rows to sort
    pts = materialize(pts.repartition("crisis_id"), "related-points")

    best = materialize(_best(pts, _CELL, keep).drop("crisis_id"), "related-best")
    around = F.explode(F.sequence(F.col("_cell") - (reach - 1), F.col("_cell") + (reach - 1))).alias("_near")
    shared = best.select("_r", "_t", around, "_o", "_c").withColumnRenamed("_near", "_cell").join(best.select(*_CELL).distinct(), _CELL)
    shared = materialize(_best(shared, _CELL, keep).groupBy(*_CELL).agg(_sorted_list("shared")), "related-shared")

    last = F.when(F.size("shared") == keep, F.element_at("shared", -1)["_o"])
    edges = F.explode(F.array(*[F.col("_cell") + d for d in (-reach - 1, -reach, reach, reach + 1)])).alias("_edge")
    wanted = shared.select("_r", "_t", edges, F.struct(F.col("_cell").alias("cell"), last.alias("last")).alias("w")).groupBy("_r", "_t", F.col("_edge").alias("_cell")).agg(F.collect_list("w").alias("wanted"))  # four at most
    able = F.explode(F.filter("wanted", lambda w: w["last"].isNull() | (F.col("_o") < w["last"]))).alias("w")
    edge = materialize(pts.join(wanted, _CELL).select("_r", "_t", "_o", "_c", able).select("_r", "_t", F.col("w.cell").alias("_cell"), "_o", "_c"), "related-edge")
    counts = materialize(edge.groupBy(*_CELL).count(), "related-edge-counts")
    few = edge.join(counts.where(F.col("count") <= MOST_EDGE).select(*_CELL), _CELL).groupBy(*_CELL).agg(_sorted_list("edge"))
    lists = materialize(shared.join(few, _CELL, "left").select(*_CELL, F.concat("shared", F.coalesce("edge", F.array().cast(few.schema["edge"].dataType))).alias("near")), "related-lists")

    near = F.filter("near", lambda x: (F.abs(x["_c"] - F.col("_c")) < width) & (x["_o"]["id"] != F.col("crisis_id")))
    found = pts.join(lists, _CELL).select("crisis_id", F.explode(F.slice(F.array_sort(F.transform(near, lambda x: x["_o"])), 1, k)).alias("_o"))
    many = counts.where(F.col("count") > MOST_EDGE).select(*_CELL)
    if not many.isEmpty():
        found = found.unionByName(_tree_candidates(pts.join(many, _CELL, "left_semi"), edge.join(many, _CELL, "left_semi"), width, keep))
    order = Window.partitionBy("crisis_id").orderBy("_o")
    return (
        found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
        .select("crisis_id", F.col("_o.id").alias("related_id"), "position")
    )
