"""Hard negatives against a plain version; scores against products."""

import numpy as np

from quiltframe.llm import hard_negatives as H
from pyspark.sql import functions as F


def brute(rows, positives=5, negatives=3):
    def whole(v):
        return [int(np.floor(256.0 * float(np.float32(x)))) for x in v]
    good = [(i, lab, whole(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, a_label, av in good:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, lab) for i, lab, v in good if i != a]
        near = sorted(x for x in scored if x[2] == a_label)[:positives]
        for p, pid, _ in near:
            far = sorted(x for x in scored if x[2] != a_label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            out += [(a, pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(far)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows],
                                 "vec_id long, label int, embedding array<float>, score string")


def fixture_rows():
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(0.3, 0.4, 13)).tolist()) for i in range(-100, 260)]
    same = rows[5][2]
    rows += [(i, i % 3, same) for i in range(300, 340)]  # ties
    return rows + [(400, None, same), (450, 1, None), (500, 1, [None, 1.0]), (550, 1, [float("nan"), 1.0]),
                   (600, 1, [float("inf")]), (None, 1, same), (650, 2, [0.5, 0.25]), (700, 1, []), (750, 1, [9e5] * 13)]


def test_negatives_equal_the_plain_version(spark, monkeypatch):
    rows = fixture_rows()
    got = H.mine(table(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    monkeypatch.setattr(H, "ROUND_BYTES", 2000)  # many rounds
    assert sorted(tuple(r) for r in H.mine(table(spark, rows)).collect()) == brute(rows)


def test_repeated_rows_count_each_and_extra_labels_work(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.75, 0.0])]
    got = sorted(tuple(r) for r in H.mine(table(spark, rows)).collect())
    assert got == [(0, 1, 1, 2, 65536, 49152)] * 2
    moved = H.mine(table(spark, rows), F.col("label") * 0)
    assert moved.count() == 0  # one label: no negatives


def test_empty_table(spark):
    assert H.mine(table(spark, [])).count() == 0


def test_lookups_equal_products():
    rng = np.random.default_rng(1)
    for scale, dims in ((200, 64), (3, 5), (10 ** 7, 17), (2 ** 62, 9)):
        rows = rng.integers(-scale, scale, (50, dims))
        anchors = rng.integers(-scale, scale, (7, dims))
        with np.errstate(over="ignore"):
            want = (rows[:, None, :] * anchors[None, :, :]).sum(axis=2)
        assert (H.scores(H.bit_planes(rows), H.subset_sums(anchors)) == want).all()


def test_bounds_are_exact():
    p = np.arange(-500, 500)
    low, high = H._bounds(p)
    for x, a, b in zip(p.tolist(), low.tolist(), high.tolist()):
        allowed = [n for n in range(-600, 600) if 50 * x <= 100 * n <= 95 * x]
        assert allowed == list(range(a, b + 1))
