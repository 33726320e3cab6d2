"""The feature build's parts on small tables of their own."""

import datetime as dt

import numpy as np

from chronopanel.operators import build, stats

DAY = dt.date(2001, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def panel(spark, tickers, n=80, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(d, t, float(c), float(v)) for t in tickers for d, c, v in zip(days(n), 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), rng.integers(1, 9, n), strict=True)]
    return spark.createDataFrame(rows, "date date, ticker string, close double, volume double")


def test_other_tickers_leave_no_trace(spark):
    three, two = panel(spark, ["a", "b", "c"]), panel(spark, ["a", "b"])
    got, want = (build.assembled(x, ["a", "b"]).toPandas().sort_values("date").set_index("date") for x in (three, two))
    assert list(got.columns) == list(want.columns) and len(got) == 80
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, equal_nan=True)


def test_empty_columns_go(spark):
    wide = spark.createDataFrame([(DAY, 1.0, None, None), (DAY, None, None, 2.0)], "date date, x double, y double, z double")
    assert build.drop_empty(wide).columns == ["date", "x", "z"]
    assert build.drop_empty(wide.limit(0)).columns == ["date"]


def test_fit_sees_its_window_only_and_digest_shows_changes(spark):
    x = np.arange(40.0)
    rows = lambda late: spark.createDataFrame([(d, "f", float(v if i < 30 else late)) for i, (d, v) in enumerate(zip(days(40), x, strict=True))], "date date, name string, value double")
    end = str(DAY + dt.timedelta(29))
    a, b = build.fit_statistics(rows(5), str(DAY), end), build.fit_statistics(rows(1e6), str(DAY), end)
    r = a.first()
    edges = np.quantile(x[:30], [0.01, 0.99])
    inside = np.clip(x[:30], *edges)
    np.testing.assert_allclose([r["low"], r["high"], r["centre"], r["scale"]], [*edges, inside.mean(), inside.std()])
    assert (r["n"], r["fit_start"], r["fit_end"]) == (30, DAY, DAY + dt.timedelta(29))
    assert build.tampered(a, b).count() == 0
    assert build.tampered(build.fit_statistics(rows(5), str(DAY), str(DAY + dt.timedelta(28))), b).count() == 1
    z = build.transformed(rows(1e6), a).toPandas().sort_values("date")["value"].to_numpy()
    np.testing.assert_allclose(z[-1], (edges[1] - inside.mean()) / inside.std())


def test_permutation_is_one_and_depends_on_the_seed_alone(spark):
    rows = spark.range(50).selectExpr("id", "id % 2 as g")
    at = lambda r, seed: {(x["g"], x["id"]): x["place"] for x in build.permuted(r, ["g"], seed, ["id"]).collect()}
    one = at(rows, 3)
    assert sorted(v for (g, _), v in one.items() if g == 0) == list(range(25))
    assert one == at(rows.repartition(7), 3) and one != at(rows, 4)


def test_inner_folds_stay_within_the_fit_window(spark):
    folds = spark.createDataFrame([(0, DAY, DAY + dt.timedelta(400), DAY + dt.timedelta(430), DAY + dt.timedelta(500)), (1, DAY, DAY + dt.timedelta(10), DAY + dt.timedelta(40), DAY + dt.timedelta(50))], "fold int, fit_start date, fit_end date, apply_start date, apply_end date")
    (r,) = stats.inner_folds(folds).collect()  # the second is too short to be cut
    assert (r["apply_start"] - DAY).days == 320 and (r["apply_start"] - r["fit_end"]).days == 35 and (r["apply_end"] - DAY).days == 400


def test_alphas_by_fold(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (0, 2.0, 0.0, 1.0), (0, 3.0, 0.0, 2.0), (1, 1.0, 0.0, 2.0), (1, 2.0, 0.0, 0.5)], "fold int, alpha double, y double, pred double")
    assert {(r["fold"], r["alpha"]) for r in stats.select_alphas(rows).collect()} == {(0, 2.0), (1, 2.0)}


def test_no_vectors_have_no_axes(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert stats.pca_latents(none, "embedding", "vec_id", 2).count() == 0
