"""The fit of a reduction against a plain version."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.operators import graph, reduction, views


def made(n=50, d=6):
    rng = np.random.default_rng(8)
    return np.concatenate([c + rng.normal(size=(n // 2, d)) * 0.3 for c in rng.normal(size=(2, d))])


def plain_affinities(x, k):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    far = np.round(1 - unit @ unit.T, 9) + 0.0
    np.fill_diagonal(far, np.inf)
    a = np.zeros_like(far)
    for i, row in enumerate(far):
        near = np.argsort(row, kind="stable")[:k]
        spread = max(row[near].std(), 1e-6)
        a[i, near] = np.exp(-row[near] / (2 * spread**2))
    a = (a + a.T) / 2
    return a / a.sum()


def plain_loss(y, p, least=1e-6):
    far = ((y[:, None] - y[None]) ** 2).sum(-1)
    kernel = 1 / (1 + far + least)
    np.fill_diagonal(kernel, 0)
    q = np.clip(kernel / kernel.sum() + least, least, 1 - least)
    p = p + least
    return -(p * np.log(q) + (1 - p) * np.log(1 - q + least)).sum()


def frame_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")


def test_affinities_equal_plain(spark):
    x = made()
    got = np.zeros((len(x), len(x)))
    for r in reduction.affinities(graph.nearest_of_all(frame_of(spark, x), "i", "v", 7)).collect():
        got[r["i"], r["j"]] = r["p"]
    assert got == pytest.approx(plain_affinities(x, 7), abs=1e-12)


def test_axes_equal_a_decomposition(spark):
    x = made()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    mean, axes = reduction.principal_axes(frame_of(spark, x).repartition(3), 3)
    assert mean == pytest.approx(unit.mean(0))
    want = np.linalg.svd(unit - unit.mean(0))[2][:3].T
    assert np.abs((axes * want).sum(0)) == pytest.approx(np.ones(3))


def test_sums_give_the_gradient():
    rng = np.random.default_rng(9)
    y, p = rng.normal(size=(12, 3)), rng.random((12, 12)) * 0.01
    p = (p + p.T) / 2
    np.fill_diagonal(p, 0)
    total = reduction._kernel(y, y, True, 1e-6).sum()
    pull, push, share, loss = reduction.pair_sums(y, y, p, True, total)
    assert loss == pytest.approx(plain_loss(y, p))
    gradient = -4 * (pull / total - share / total**2 * push)
    for i, k in ((0, 0), (3, 2), (11, 1)):
        step = np.zeros_like(y)
        step[i, k] = 1e-5
        assert gradient[i, k] == pytest.approx((plain_loss(y + step, p) - plain_loss(y - step, p)) / 2e-5, rel=1e-4, abs=1e-7)


def test_rounds_equal_plain_and_the_loss_falls(spark):
    x, rounds, rate = made(), 4, 0.5
    frame = frame_of(spark, x)
    fit = reduction.fitted(frame, graph.nearest_of_all(frame, "i", "v", 7), "i", "v", rounds=rounds, rate=rate, block=16)
    assert len(fit.losses) == rounds and all(b < a for a, b in zip(fit.losses, fit.losses[1:], strict=False))
    mean, axes = reduction.principal_axes(frame, 3)
    y, p, losses = (x / np.linalg.norm(x, axis=1)[:, None] - mean) @ axes, plain_affinities(x, 7), []
    for _ in range(rounds):
        total = reduction._kernel(y, y, True, 1e-6).sum()
        pull, push, share, loss = reduction.pair_sums(y, y, p, True, total)
        losses.append(loss)
        y = y + 4 * rate * (pull / total - share / total**2 * push)
        y = y - y.mean(0)
    assert fit.losses == pytest.approx(losses)
    got = np.array([r["reduced"] for r in fit.model.orderBy("id").collect()])
    assert got == pytest.approx(y, abs=1e-9)
    # the model reduces rows it was fitted on to near where they are
    low = views.reduced_by_model(frame.withColumnRenamed("i", "id"), fit.model, "id", "v", k=1)
    assert np.array([r["reduced"] for r in low.orderBy("id").collect()]) == pytest.approx(y, abs=1e-9)


def test_few_vectors_and_early_stop(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0])], "i long, v array<double>")
    near = graph.nearest_of_all(one, "i", "v", 3)
    assert [(r["id"], r["reduced"]) for r in reduction.fitted(one, near, "i", "v").model.collect()] == [(1, [0.0, 0.0, 0.0])]
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "i long, v array<double>")
    fit = reduction.fitted(same, graph.nearest_of_all(same, "i", "v", 3), "i", "v", patience=2)
    assert len(fit.losses) == 3  # nothing can get better
    assert fit.model.filter(F.size("reduced") == 3).count() == 4


def test_sums_of_two_blocks_are_made_at_once():
    """Those of both blocks equal the plain sums over all pairs from either side, in tiles that end anywhere."""
    rng, least, total = np.random.default_rng(4), reduction.LEAST, 500.0
    y, z = rng.normal(size=(37, 3)), rng.normal(size=(29, 3))
    p = np.where(rng.random((37, 29)) < 0.1, rng.random((37, 29)) * 1e-2, 0.0)
    i, j = np.nonzero(p)
    mine, theirs, share, loss = reduction.both_sums(y, z, i[::-1], j[::-1], p[i, j][::-1], False, total, step=8)
    kernel = 1 / (1 + ((y[:, None] - z[None]) ** 2).sum(2) + least)
    q = kernel / total + least
    slope = -(p + least) / q + (1 - p - least) / (1 - q + least)
    apart = y[:, None] - z[None]
    for k, force in enumerate((slope * kernel**2, kernel**2)):
        assert np.allclose(mine[:, 3 * k : 3 * k + 3], (force[..., None] * apart).sum(1), rtol=1e-9, atol=1e-12)
        assert np.allclose(theirs[:, 3 * k : 3 * k + 3], -(force[..., None] * apart).sum(0), rtol=1e-9, atol=1e-12)
    assert np.isclose(share, (slope * kernel).sum())
    assert np.isclose(loss, -((p + least) * np.log(q) + (1 - p - least) * np.log(1 - q + least)).sum())


@pytest.mark.parametrize("d", [3, 2])
def test_sums_through_the_grid_leave_out_no_pair(spark, monkeypatch, d):
    """All pairs' sums by the grid, in parts too, equal those by pairs."""
    y = np.random.default_rng(5).normal(size=(1500, d)) * 0.2
    monkeypatch.setattr(reduction, "ALONE", 1000)
    grid, plain = reduction._Points(spark), reduction._Points(spark)
    total = grid.look(y)
    monkeypatch.setattr(reduction, "FEW_POINTS", 1 << 20)
    assert grid.grid is not None and plain.look(y) == pytest.approx(total, rel=1e-12) and plain.grid is None
    assert total == pytest.approx(reduction._kernel(y, y, True, reduction.LEAST).sum(), rel=1e-12)
    (mine, share, loss), (want, want_share, want_loss) = grid.sums(total), plain.sums(total)
    assert np.abs(mine - want).max() < 1e-10 * np.abs(want).max()
    far = -(len(y) ** 2) * reduction.LEAST * np.log(reduction.LEAST)
    assert share == pytest.approx(want_share, rel=1e-10) and loss == pytest.approx(want_loss, abs=2e-9)  # by pairs, each adds some 1e-16
    none = np.zeros(0, int)
    mine, _, share, loss = reduction.both_sums(y, y, none, none, np.zeros(0), True, total)
    assert want == pytest.approx(mine, abs=1e-9) and (want_share, want_loss + far) == pytest.approx((share, loss), rel=1e-9)


def test_either_way_gives_the_same_rounds(spark, monkeypatch):
    frame = frame_of(spark, made(90))
    near = graph.nearest_of_all(frame, "i", "v", 7)
    low = lambda fit: np.array([r["reduced"] for r in fit.model.orderBy("id").collect()])
    blocks = monkeypatch.context
    with blocks() as m:
        m.setattr(reduction, "MOST_POINTS", 0)
        want = reduction.fitted(frame, near, "i", "v", rounds=3, rate=0.5, block=16)
    for few in (1024, 10):
        monkeypatch.setattr(reduction, "FEW_POINTS", few)
        fit = reduction.fitted(frame, near, "i", "v", rounds=3, rate=0.5)
        assert low(fit) == pytest.approx(low(want), abs=1e-9) and fit.losses == pytest.approx(want.losses, rel=1e-10)


def test_small_gains_of_many_points_are_seen(spark):
    """Points far less moved than the loss has digits: it falls all the same, so that patience doesn't end the rounds."""
    rng = np.random.default_rng(3)
    frame = frame_of(spark, rng.normal(size=(6000, 8)))
    near = spark.createDataFrame([(i, (i + k) % 6000, 0.1 * k) for i in range(6000) for k in (1, 2, 3)], "id long, other long, distance double")
    fit = reduction.fitted(frame, near, "i", "v", rounds=12, rate=1e-3, patience=1)
    assert len(fit.losses) == 12


def test_the_query_goes_on_for_all_rounds(spark, monkeypatch):
    """No parameter shortens the fit."""
    from kelpie.plans import knowledge_queries

    given = {}
    monkeypatch.setattr(knowledge_queries, "table", lambda *_: None)
    monkeypatch.setattr(knowledge_queries, "kept_vectors", lambda *_: type("Index", (), {"nearest_of_all": lambda self, k: k})())
    monkeypatch.setattr(reduction, "fitted", lambda *a, **k: given.update(k) or a)
    assert knowledge_queries._fit(spark, "")[1] == 45
    assert not {"rounds", "rate", "patience"} & given.keys() and reduction.ROUNDS == 150
