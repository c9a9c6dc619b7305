import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import vector_codes as vc
from lacuna.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) -> {(vec_id, code, error, label_error)} as a sorted list, and the codebooks' digest."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = -(-dim // parts)
    cut = [[tuple((v + [0] * width * parts)[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, own in groups.items():
                books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, e, by_label[lab]) for i, code, e, lab in out), key=str), digest


def check(got, rows, **how):
    want, digest = brute(rows, **how)
    got = got.collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op12_vector_codes"][0](spark, SMALL)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    check(got, rows)


def test_odd_rows_ties_and_one_hot_label(spark):
    """Null, short, infinite and repeated vectors, equal ids, integers on a coarse grid (many equal distances), clashing columns."""
    rnd = random.Random(4)
    grid = lambda n: [rnd.randrange(-3, 4) / 256 for _ in range(n)]
    rows = [(i, grid(32), rnd.choice([0, 0, 0, 1, None])) for i in range(900)] + [(5000 + i, grid(32), 100 + i) for i in range(40)]
    rows += [(i, [0.0] * 32, 0) for i in range(300)] + [(7, grid(32), 9), (7, grid(32), None), (None, grid(32), 3), (None, grid(32), None)]
    rows += [(-1, None, 1), (-2, [], 1), (-3, [None] * 32, 1), (-4, [float("nan")] + [0.0] * 31, 1), (-5, [float("inf")] * 32, 2), (-6, [0.5] * 31 + [None], 2), (3, [0.25] * 7, 5)]
    rnd.shuffle(rows)
    src = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit("clash"), "code": F.lit("clash"), "slot": F.lit(1), "n": F.lit(1)}).repartition(5)
    check(vc.encode(src), rows)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_dimension_entries_and_rounds(spark, rounds):
    """A dimension that the parts do not divide, fewer rows than entries, clustered and far values, any number of rounds."""
    rnd = random.Random(rounds)
    rows = [(i, [rnd.gauss(rnd.choice([-2, 0, 700.5]), 0.3) for _ in range(10)], i % 3) for i in range(400)]
    check(vc.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3), parts=4, entries=12, rounds=rounds), rows, parts=4, entries=12, rounds=rounds)
    few = rows[:5]
    check(vc.encode(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int"), rounds=rounds), few, rounds=rounds)


def test_empty_table(spark):
    assert vc.encode(spark.createDataFrame([], SCHEMA)).count() == 0
    got = vc.encode(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("scale", [3, 100, 1 << 27])
def test_bounds_equal_all_distances(scale):
    """Through many moves, packed and cut on the way, the lists give what all distances give; bounds stay below the distances."""
    rnd = np.random.default_rng(scale)
    x, c = rnd.integers(-scale, scale + 1, (2000, 3)), rnd.integers(-scale, scale + 1, (40, 3))
    lists, b = vc.Bounds.of_all(vc.squared(x, c), 8), 8
    skipped = 0
    for turn in range(6):
        step = rnd.integers(-(scale // 20) - 1, scale // 20 + 2, c.shape)
        new = c + step * (rnd.random((len(c), 1)) < 0.5)
        move = np.nextafter(np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)), np.inf)
        c = new
        best, depth = lists.moved(x, c, move)
        sq = vc.squared(x, c)
        assert (best == sq.min(axis=1)).all() and (lists.ids[:, 0] == sq.argmin(axis=1)).all()
        assert all(len(set(row)) == b for row in lists.ids.tolist())
        assert (lists.low[:, :b] ** 2 <= np.take_along_axis(sq, lists.ids, axis=1) * (1 + 1e-9)).all()
        others = np.ones(sq.shape, bool)
        np.put_along_axis(others, lists.ids, False, axis=1)
        assert (np.where(others, sq, np.iinfo(np.int64).max).min(axis=1) * (1 + 1e-9) >= lists.low[:, b] ** 2).all()
        skipped += int((depth <= b).sum())
        if turn == 2:
            b = 5
        lists = vc.Bounds.unpack(lists.cut(b).pack(40), b, 40)
    assert scale == 3 or skipped > 0


def test_exact_squares_of_far_values():
    x = np.array([[1 << 28, -(1 << 28), 5]])
    assert vc.squared(x, -x).tolist() == [[4 * ((1 << 56) * 2 + 25)]]
