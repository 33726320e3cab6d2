"""Replicates, benchmark portfolios and snapshots on small tables of their own."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import benchmarks, replicates
from chronopanel.sources import snapshot

DAY = dt.date(2001, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def uniform(seed, tag, *counters):
    return int(hashlib.md5(":".join([str(seed), tag, *map(str, counters)]).encode()).hexdigest()[:8], 16) / 2**32


def paths_of(n, count, block, seed):
    """Every replicate position by position."""
    for rep in range(count):
        begin = first = 0
        for pos in range(n):
            if pos == 0 or uniform(seed, "block", rep, pos) < 1 / block:
                begin, first = int(uniform(seed, "start", rep, pos) * n), pos
            yield rep, pos, (begin + pos - first) % n


@pytest.mark.parametrize(("n", "block"), [(1, 5), (17, 1), (40, 6), (40, 1000)])
def test_replicates(spark, n, block):
    dates = spark.createDataFrame([(d,) for d in days(n)], "date date").repartition(3)
    got = sorted((r["rep"], r["pos"], (r["date"] - DAY).days) for r in replicates.replicates(dates, 5, block, 3).collect())
    assert got == list(paths_of(n, 5, block, 3))
    assert replicates.replicates(dates.where("false"), 5, block, 3).count() == 0


@pytest.fixture(scope="module")
def paths(spark):
    rng = np.random.default_rng(2)
    data = {s: rng.normal(m, 0.02, 50) for s, m in (("a", 0.004), ("b", 0.0), ("c", -0.004))}
    return data, spark.createDataFrame([(s, d, float(v)) for s, x in data.items() for d, v in zip(days(50), x, strict=True)], "strategy string, date date, net double")


def metrics(x):
    curve = np.cumprod(1 + x)
    down = (curve / np.maximum(np.maximum.accumulate(curve), 1) - 1).min()
    return {"ann_return": curve[-1] ** (252 / len(x)) - 1, "sharpe": x.mean() / x.std(ddof=1) * 252**0.5, "max_dd": down, "cvar": x[x <= np.quantile(x, 0.05)].mean()}


def test_intervals_and_pairs(paths):
    data, df = paths
    values = replicates.path_statistics(df, 30, 6, 3).cache()
    draws = np.array([i for _, _, i in paths_of(50, 30, 6, 3)]).reshape(30, 50)
    each = {s: [metrics(x[d]) for d in draws] for s, x in data.items()}
    for r in replicates.intervals(values, ["strategy"]).collect():
        drawn = [m[r["name"]] for m in each[r["strategy"]]]
        want = (metrics(data[r["strategy"]])[r["name"]], *np.quantile(drawn, [0.025, 0.975]))
        assert (r["point"], r["low"], r["high"]) == pytest.approx(want, rel=1e-9) and r["n"] == 30
    got = replicates.paired(values, "strategy", "b").collect()
    assert len(got) == 8
    for r in got:
        drawn = [m[r["name"]] - b[r["name"]] for m, b in zip(each[r["strategy"]], each["b"], strict=True)]
        low, high = np.quantile(drawn, [0.025, 0.975])
        assert (r["low"], r["high"]) == pytest.approx((low, high), rel=1e-9)
        assert r["verdict"] == ("favourable" if low > 0 else "adverse" if high < 0 else "inconclusive")


def test_gate_over_names(spark):
    rows = [("x", str(i), v) for i, v in enumerate(["favourable"] * 3 + ["inconclusive"])] + [("y", str(i), v) for i, v in enumerate(["favourable"] * 3 + ["adverse"])]
    got = {r["k"]: tuple(r)[1:] for r in replicates.all_favourable(spark.createDataFrame(rows, "k string, name string, verdict string"), "k").collect()}
    assert got == {"x": (3, 0, True), "y": (3, 1, False)}


def test_any_statistic_over_shared_dates(spark):
    rng = np.random.default_rng(1)
    y, p, q = rng.normal(0, 1, (3, 40))
    df = spark.createDataFrame([("k", d, float(a), float(b), float(c)) for d, a, b, c in zip(days(40), y, p, q, strict=True)], "k string, date date, y double, pred double, base double")
    named = {**replicates.r2_statistic(), **replicates.loss_difference(["pred", "base"])}
    got = {(r["rep"], r["name"]): r["value"] for r in replicates.statistics(df, ["k"], named, 4, 5, 9).collect()}
    draws = {-1: np.arange(40), **{rep: np.array([i for r, _, i in paths_of(40, 4, 5, 9) if r == rep]) for rep in range(4)}}
    for rep, d in draws.items():
        e, b = (y[d] - p[d]) ** 2, (y[d] - q[d]) ** 2
        assert (got[rep, "r2"], got[rep, "pred_less_base"]) == pytest.approx((1 - e.sum() / b.sum(), (e - b).mean()))


def test_seed_replicates(spark):
    values = {"v": [1.0, 2.0, 4.0], "w": [5.0]}
    df = spark.createDataFrame([(n, i, x) for n, xs in values.items() for i, x in enumerate(xs)], "name string, run int, value double")
    for r in replicates.seed_replicates(df, ["name"], 6, 4).collect():
        xs = values[r["name"]]
        drawn = xs if r["rep"] < 0 else [xs[int(uniform(4, "seed", r["rep"], j) * len(xs))] for j in range(len(xs))]
        assert r["value"] == pytest.approx(np.mean(drawn))


def capped(vols, cap):
    """Repeated redistribution."""
    inv = {k: 1 / v for k, v in vols.items() if v}
    out, open_ = dict.fromkeys(vols, 0.0), set(inv)
    while open_:
        left = 1 - cap * (len(inv) - len(open_))
        share = {k: left * inv[k] / sum(inv[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap + 1e-15}
        out.update(dict.fromkeys(over, cap) if over else share)
        if not over:
            break
        open_ -= over
    return out


def test_capped_inverse_vol(spark):
    rng = np.random.default_rng(8)
    cases = [{"a": 0.1, "b": 0.1}, {"a": 0.001, "b": 1.0, "c": 1.0, "d": 2.0}, {"a": None, "b": 0.2, "c": 0.3, "d": 0.3}, {"a": 0.0, "b": None}, *[dict(zip("abcdef", rng.lognormal(0, 1.5, 6).tolist(), strict=True)) for _ in range(20)]]
    df = spark.createDataFrame([(i, k, v) for i, c in enumerate(cases) for k, v in c.items()], "decision int, line string, vol double")
    got = {(r["decision"], r["line"]): r["weight"] for r in benchmarks.capped_inverse_vol(df, 0.35).collect()}
    for i, c in enumerate(cases):
        for k, v in capped(c, 0.35).items():
            assert got[i, k] == pytest.approx(v), (i, k)


def test_other_benchmarks(spark):
    prices = spark.createDataFrame([(d, k, c) for d, a, b in zip(days(3), (1.0, 2.0, 3.0), (4.0, 4.0, 2.0), strict=True) for k, c in (("a", a), ("b", b))], "date date, line string, close double")
    decided = prices.select(F.col("date").alias("decision"), "line")
    held = {(r["decision"].day, r["line"]): r["weight"] for r in benchmarks.buy_and_hold(prices, decided).collect()}
    assert [held[i, "a"] for i in (1, 2, 3)] == pytest.approx([0.5, 2 / 3, 3 / 3.5])
    assert {(r["line"], r["weight"]) for r in benchmarks.fixed_mix(decided, {"a": 0.6}).collect()} == {("a", 0.6), ("b", 0.0)}
    vols = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.2), (2, "a", 0.01), (3, "a", None)], "decision int, line string, vol double")
    assert sorted((r["decision"], r["line"], r["weight"]) for r in benchmarks.vol_target_leg(vols, "a", 0.1).collect()) == [(1, "a", 0.5), (1, "b", 0.0), (2, "a", 1.0), (3, "a", 0.0)]
    solved = spark.createDataFrame([(g, d, k, w) for g, w in ((1.0, 0.5), (5.0, 0.34), (9.0, 0.36)) for d in (1, 2) for k in "ab"], "gamma double, decision int, line string, weight double")
    r = benchmarks.nearest_exposure(solved).first()
    assert (r["gamma"], r["exposure"]) == (5.0, pytest.approx(0.68))


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([(d, t, float(i), None if i == 3 else i) for i, d in enumerate(days(10)) for t in ("a", "b")], "date date, ticker string, close double, volume long")


def test_snapshot_is_written_once_and_checked(spark, panel, tmp_path):
    root = str(tmp_path)
    made = {r["column"]: r for r in snapshot.create(panel, root, "2001-02-01", "p").collect()}
    assert (made["volume"]["rows"], made["volume"]["nulls"], made["close"]["first_date"], made["close"]["last_date"]) == (20, 2, DAY, days(10)[-1])
    again = snapshot.load(spark, root, "2001-02-01", "p")
    assert again.count() == 20 and again.exceptAll(panel).count() == 0
    for flags in ({}, {"force": True}, {"may_overwrite": True}):
        with pytest.raises(snapshot.SnapshotError, match="written once"):
            snapshot.create(panel, root, "2001-02-01", "p", **flags)
    snapshot.create(panel.where("ticker = 'a'"), root, "2001-02-01", "p", force=True, may_overwrite=True)
    assert snapshot.load(spark, root, "2001-02-01", "p").count() == 10


def test_tampered_and_unfinished_snapshots_are_refused(spark, panel, tmp_path):
    root = str(tmp_path)
    snapshot.create(panel, root, "d", "p")
    path = snapshot.table_path(root, "d", "p")
    panel.withColumn("close", F.when(F.col("close") == 7, 7.5).otherwise(F.col("close"))).write.mode("overwrite").parquet(path)
    with pytest.raises(snapshot.SnapshotError, match=r"\['close'\]"):
        snapshot.load(spark, root, "d", "p")
    assert snapshot.load(spark, root, "d", "p", verify=False).count() == 20
    panel.unionByName(panel.where("ticker = 'a'")).write.mode("overwrite").parquet(path)  # repeated rows show too
    with pytest.raises(snapshot.SnapshotError, match="volume"):
        snapshot.load(spark, root, "d", "p")
    panel.write.parquet(snapshot.table_path(root, "d", "q"))  # no manifest
    with pytest.raises(snapshot.SnapshotError, match="no finished"):
        snapshot.load(spark, root, "d", "q")


def test_digest_does_not_depend_on_order(panel):
    assert sorted(snapshot.summary(panel.orderBy("close")).collect()) == sorted(snapshot.summary(panel.repartition(5)).collect())


def test_locked_range(spark, panel, tmp_path):
    root, log, locked = str(tmp_path), str(tmp_path / "log"), (str(days(10)[4]), str(days(10)[6]))
    snapshot.create(panel, root, "d", "p")
    table = snapshot.load(spark, root, "d", "p")
    seen = snapshot.readable(table, locked)
    assert seen.count() == 14 and "PushedFilters: [Or(LessThan(date" in seen._jdf.queryExecution().toString().replace("IsNotNull(date),", "")
    for flags in ({}, {"final": True, "allowed": True}, {"final": True, "reason": "r"}, {"allowed": True, "reason": "r"}, {"final": True, "allowed": True, "reason": " "}):
        with pytest.raises(snapshot.LockedRangeError):
            snapshot.opened(table, locked, log, **flags)
    for reason in ("first", "second"):
        assert snapshot.opened(table, locked, log, final=True, allowed=True, reason=reason).count() == 6
    assert [(r["reason"], r["first"]) for r in snapshot.accesses(spark, log).collect()] == [("first", locked[0]), ("second", locked[0])]
    assert snapshot.pick(table, ["b"]).count() == 10
    with pytest.raises(snapshot.SnapshotError, match="zz"):
        snapshot.pick(table, ["a", "zz"])
