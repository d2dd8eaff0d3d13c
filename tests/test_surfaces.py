"""Distance transform, surface metrics with tolerances by label, and evaluation of probabilities."""

import time

import numpy as np
import pytest

from lumaquery.operators import metrics, surfaces

RNG = np.random.default_rng(9)


def plain_squares(points):
    at = np.argwhere(points)
    every = np.argwhere(np.ones(points.shape, bool))
    d = ((every[:, None, :] - at[None, :, :]) ** 2).sum(2).min(1) if len(at) else np.full(len(every), np.inf)
    return d.reshape(points.shape)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (7, 13), (20, 20)])
def test_squared_distances_are_exact(shape):
    for share in (0.02, 0.2, 0.9):
        for _ in range(20):
            points = RNG.random(shape) < share
            assert np.array_equal(surfaces.squared_distances(points), plain_squares(points))
    assert np.isinf(surfaces.squared_distances(np.zeros(shape, bool))).all()
    one = np.zeros(shape, bool)
    one[-1, 0] = True
    assert np.array_equal(surfaces.squared_distances(one), plain_squares(one))


def test_time_is_linear_in_cells():
    def taken(n):
        points = RNG.random((n, n)) < 0.3
        began = time.process_time()
        surfaces.squared_distances(points)
        return time.process_time() - began

    taken(64)
    assert min(taken(800) for _ in range(3)) < 12 * min(taken(400) for _ in range(3))  # 4 for linear work, 16 for pairs of borders


def cells_of(spark, label, prediction, valid=None, name="i"):
    label, prediction = np.array(label), np.array(prediction)
    valid = np.ones(label.shape, bool) if valid is None else np.array(valid)
    rows = [(name, r, c, int(label[r, c]), int(prediction[r, c]), bool(valid[r, c])) for r, c in np.ndindex(label.shape)]
    return spark.createDataFrame(rows, "image_name string, row int, col int, label int, prediction int, valid boolean")


def halves(cut):
    return (np.arange(10)[None, :] >= cut).astype(int).repeat(10, axis=0)


def test_tolerances_by_label(spark):
    cells = cells_of(spark, halves(6), halves(5))
    score = lambda t: {r.label: r.nsd for r in surfaces.surface_scores(cells, tolerance=t).collect()}
    # fixed values: label 0 has borders of 28 and 26 cells, of which 10 and 8 differ
    none, one = score([0, 0]), score({0: 1, 1: 0})
    assert none[0] == pytest.approx(1 - 18 / 54) and one[0] == 1 and none[0] < one[0] and none[1] == one[1]
    images = [metrics.evaluate_images(cells, "image_name", 2, tolerance=t).first() for t in ([0, 0], [1, 0])]
    assert images[0].surface_dice_mean < images[1].surface_dice_mean and images[1].surface_dice[0] == 1
    with pytest.raises(Exception, match="list index"):
        surfaces.surface_scores(cells, tolerance=[1.0]).collect()


def test_missing_label_and_distance(spark):
    label, prediction = halves(6) * 2, halves(5)
    prediction[:, 8:] = 4
    got = {r.label: r.nsd for r in surfaces.surface_scores(cells_of(spark, label, prediction), tolerance=[1, 1, 1, 1, 1]).collect()}
    assert got == {0: 1.0, 2: 0.0}
    small = {r.label: r.asd for r in surfaces.surface_scores(cells_of(spark, [[0, 0, 1, 1]] * 2, [[0, 1, 1, 1]] * 2)).collect()}
    masked = cells_of(spark, [[0, 0, 1, 1], [0, 0, 1, 1], [10, 0, 2, 3]], [[0, 1, 1, 1], [0, 1, 1, 1], [11, 1, 2, 2]], [[True] * 4, [True] * 4, [False] * 4])
    assert small[0] == pytest.approx(2 / 6) and {r.label: r.asd for r in surfaces.surface_scores(masked).collect()} == small


def test_tolerances_from_annotators(spark):
    cells = cells_of(spark, halves(6), halves(4))
    d = surfaces.border_distances(cells)
    plain = [np.sqrt(((np.argwhere(surfaces.border(a == 1))[:, None] - np.argwhere(surfaces.border(b == 1))[None]) ** 2).sum(2).min(1)) for a, b in ((halves(6), halves(4)), (halves(4), halves(6)))]
    assert surfaces.tolerances(d)[1] == pytest.approx(np.concatenate(plain).mean())
    assert surfaces.tolerances(d, "q=0.95")[1] == pytest.approx(np.quantile(np.concatenate(plain), 0.95))


def test_evaluation_of_probabilities(spark):
    rows = [("i", 0, k, k % 2, True, [0.7, 0.3] if k < 3 else [0.1, 0.9]) for k in range(6)] + [("i", 0, 6, 0, False, [0.5, 0.5]), ("j", 0, 0, 1, True, [float("nan"), float("inf")])]
    cells = spark.createDataFrame(rows, "image string, row int, col int, label int, valid boolean, p array<double>")
    out = {r.image: r for r in metrics.evaluate_images(cells, "image", 2, probabilities="p", thresholds=[0.0, 0.8]).collect()}
    assert out["i"].accuracy == pytest.approx(4 / 6) and out["i"].confusion == [[2, 1], [1, 2]]
    assert out["i"].error == pytest.approx((3 * abs(0.7 - 2 / 3) + 3 * abs(0.9 - 2 / 3)) / 6)
    low, high = out["i"].dice_confidences[0.0], out["i"].dice_confidences[0.8]
    assert [(x.label, x.dice) for x in low] == [(0, pytest.approx(4 / 6)), (1, pytest.approx(4 / 6))]
    assert [(x.label, x.area) for x in high] == [(0, 0.25), (1, pytest.approx(2 / 3))] and high[1].dice == pytest.approx(4 / 5)
    assert out["j"].accuracy == 1  # repaired: infinity is the largest
    for bad in ([0.7, 0.7], [2.0, -3.0], [1.0], [0.5, 0.25, 0.25]):
        with pytest.raises(Exception, match="no probabilities"):
            metrics.predicted(spark.createDataFrame([(bad,)], "p array<double>"), "p", 2).collect()
