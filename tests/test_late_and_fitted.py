"""Late rows and carried moments, artifacts fitted once, pruning within groups, and the whole build, on tables of their own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_build import DAY, days, panel

from chronopanel.operators import build, features, fitted
from chronopanel.plans import stream_queries
from chronopanel.sources import artifacts
from chronopanel.streaming import streams

EVENT = "event_type string, event_id long, ts timestamp_ntz, value double"


def at(day, hour=12):
    return dt.datetime(2001, 1, 1) + dt.timedelta(days=day, hours=hour)


def windows(out):
    return sorted((r["event_type"], r["w"]["start"], r["n"], r["total"]) for r in out.collect())


def test_late_rows_are_dropped_by_the_watermark_of_earlier_runs(spark, tmp_path):
    parts = [
        [("a", 0, at(0), 1.0), ("a", 1, at(3), 1.0)],  # the watermark comes to day 2, noon
        [("a", 2, at(1), 10.0), ("a", 3, at(2), 10.0), ("b", 4, at(6), 1.0)],  # day 1 is closed, day 2 is open
        [("b", 5, at(0), 100.0), ("a", 6, at(9), 1.0), ("a", 7, at(3, 13), None)],  # all but the second are late
    ]
    frames = [spark.createDataFrame(p, EVENT) for p in parts]
    got = windows(streams.run_in_parts(frames, streams.closed_windows, "append", str(tmp_path)))
    assert got == windows(streams.closed_windows_batch(frames))
    assert [(k, d.day, n, total) for k, d, n, total in got] == [("a", 1, 1, 1.0), ("a", 3, 1, 10.0), ("a", 4, 1, 1.0), ("b", 7, 1, 1.0)]


def test_parts_by_arrival_hold_each_event_once(spark):
    rows = spark.createDataFrame([("a", i, at(i), 1.0) for i in range(20)], EVENT)
    parts = streams.by_arrival(rows, F.when(F.col("event_id") == 0, F.expr("INTERVAL 9 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS")), 8)
    assert [sorted(r["event_id"] for r in p.collect()) for p in parts] == [list(range(1, 8)), [0, *range(8, 16)], list(range(16, 20))]
    assert [p.count() for p in streams.by_arrival(rows.limit(0), F.expr("INTERVAL 0 DAYS"), 8)] == [0]


def test_moments_merge_to_those_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = 1e6 + rng.gamma(2.0, 3.0, 300)  # far from zero, where sums of powers would lose all places
    rows = [("a" if i % 3 else None, i, at(0), float(v)) for i, v in enumerate(x)] + [("c", 900, at(0), None), ("d", 901, at(0), 5.0), ("d", 902, at(1), 5.0)]
    frames = [spark.createDataFrame(rows[k::3], EVENT) for k in range(3)]
    got = {r["event_type"]: r for r in streams.moments(streams.run_in_parts(frames, streams.carried_moments, "update", str(tmp_path))).collect()}
    assert set(got) == {"a", None, "d"}
    for kind, mine in (("a", x[np.arange(300) % 3 > 0]), (None, x[::3])):
        d = mine - mine.mean()
        want = [mine.mean(), mine.std(ddof=1), (d**3).mean() / mine.std() ** 3, (d**4).mean() / mine.std() ** 4 - 3]
        assert got[kind]["n"] == len(mine)
        np.testing.assert_allclose([got[kind][c] for c in ("mean", "sd", "skew", "kurt")], want, rtol=1e-6)
    assert (got["d"]["sd"], got["d"]["skew"], got["d"]["kurt"]) == (0.0, None, None)


def test_the_query_has_truly_late_rows(spark):
    sf = "/root/testdata/sf0.001"
    parts = stream_queries._parts(spark, sf)
    kept = sum(r["n"] for r in streams.closed_windows_batch(parts).collect())
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    assert kept < 0.97 * sum(r["n"] for r in streams.closed_windows_batch([whole]).collect())


def long(spark, names, n=40, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(d, c, float(v)) for c in names for d, v in zip(days(n), rng.normal(0, 1, n), strict=True)], "date date, name string, value double")


def test_an_artifact_is_fitted_once(spark, tmp_path):
    root, end = str(tmp_path), str(DAY + dt.timedelta(29))
    rows = long(spark, ["x", "y"])
    with pytest.raises(artifacts.ArtifactError, match="no finished"):
        artifacts.fitted(spark, root, "train", "scaler", str(DAY), end)
    first = artifacts.fit_once(rows, str(DAY), end, root, "train", "scaler").collect()
    with pytest.raises(artifacts.ArtifactError, match="fitted already"):
        artifacts.fit_once(long(spark, ["x", "y"], seed=2), str(DAY), end, root, "train", "scaler")
    kept = artifacts.fitted(spark, root, "train", "scaler", str(DAY), end)
    assert sorted(kept.collect()) == sorted(first)
    before = artifacts.log(spark, root, "train", "scaler").first()
    assert (before["n_names"], before["fit_end"]) == (2, DAY + dt.timedelta(29))
    other = artifacts.fit_once(long(spark, ["x", "y"], seed=2), str(DAY), end, root, "train", "scaler", refit=True)
    assert sorted(other.collect()) != sorted(first) and artifacts.log(spark, root, "train", "scaler").first()["digest"] != before["digest"]
    artifacts.fit_once(rows, str(DAY), end, root, "fold-1", "scaler")  # another scope is another artifact


def test_an_artifact_stays_in_its_window_and_with_its_columns(spark, tmp_path):
    root, end = str(tmp_path), str(DAY + dt.timedelta(29))
    rows = long(spark, ["x", "y"])
    one = artifacts.fit_once(rows, str(DAY), end, root, "train", "scaler")
    with pytest.raises(artifacts.ArtifactError, match="beyond"):
        artifacts.fitted(spark, root, "train", "scaler", str(DAY), str(DAY + dt.timedelta(28)))
    assert artifacts.transform(rows, one).count() == 80
    for names, message in ((["x"], "y .absent"), (["x", "y", "z"], "z .not fitted")):
        with pytest.raises(artifacts.ArtifactError, match=message):
            artifacts.transform(long(spark, names), one)


def test_a_changed_artifact_is_not_read(spark, tmp_path):
    root, end = str(tmp_path), str(DAY + dt.timedelta(29))
    artifacts.fit_once(long(spark, ["x"]), str(DAY), end, root, "train", "scaler").count()
    build.fit_statistics(long(spark, ["x"], seed=5), str(DAY), end).write.mode("overwrite").parquet(f"{root}/train/scaler")
    with pytest.raises(artifacts.ArtifactError, match="has changed"):
        artifacts.fitted(spark, root, "train", "scaler", str(DAY), end)


def test_later_rows_leave_no_trace_in_an_artifact(spark, tmp_path):
    end = str(DAY + dt.timedelta(29))
    rows = long(spark, ["x"])
    spoiled = rows.withColumn("value", F.when(F.col("date") > end, 1e9).otherwise(F.col("value")))
    one, two = (artifacts.fit_once(r, str(DAY), end, str(tmp_path), scope, "scaler").collect() for r, scope in ((rows, "a"), (spoiled, "b")))
    assert one == two


def test_pruning_within_groups_against_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (60, 2))
    mix = {"a1": base[:, 0], "a2": base[:, 0] + 0.1 * base[:, 1], "a3": base[:, 1], "a4": base[:, 1] - 0.05 * base[:, 0], "b1": base[:, 0], "b2": np.ones(60), "b3": -base[:, 0], "c1": base[:, 0]}
    mix["a2"] = np.where(np.arange(60) % 9 == 0, np.nan, mix["a2"])
    names = list(mix)
    rows = [(d, *[None if np.isnan(mix[c][i]) else float(mix[c][i]) for c in names]) for i, d in enumerate(days(60))]
    wide = spark.createDataFrame(rows, "date date, " + ", ".join(f"{c} double" for c in names))
    groups = {"a": ["a2", "a1", "a4", "a3"], "b": ["b1", "b2", "b3"], "c": ["c1"]}
    end = DAY + dt.timedelta(39)
    got = {(r["grp"], r["name"]): (r["dropped_for"], r["abs_corr"]) for r in fitted.prune_groups(wide, groups, F.col("date") <= F.lit(end), 0.9).collect()}
    for g, members in groups.items():
        kept = []
        for c in members:
            clash = None
            for k in kept:
                ok = ~np.isnan(mix[k][:40]) & ~np.isnan(mix[c][:40])
                x, y = mix[k][:40][ok], mix[c][:40][ok]
                if x.std() > 0 and y.std() > 0 and abs(np.corrcoef(x, y)[0, 1]) > 0.9:
                    clash = (k, abs(np.corrcoef(x, y)[0, 1]))
                    break
            assert got[g, c][0] == (clash and clash[0])
            if clash:
                np.testing.assert_allclose(got[g, c][1], clash[1])
            else:
                kept.append(c)
    assert [k for k, v in got.items() if v[0]] == [("a", "a1"), ("a", "a3"), ("b", "b3")]  # c1 equals a1 and b1, in a group of its own
    assert all(r["dropped_for"] is None for r in fitted.prune_groups(wide.limit(0), groups, F.lit(True), 0.9).collect())
    with pytest.raises(ValueError, match="threshold"):
        fitted.prune_groups(wide, groups, F.lit(True), 0.0)


def test_warm_start_and_trim(spark):
    rows = [(d, float("nan") if i == 1 else None if i < 1 else float(i), float("inf") if i == 2 else None if i == 5 else 1.0) for i, d in enumerate(days(7))]
    wide = spark.createDataFrame(rows, "date date, x double, y double")
    assert build.warm_start(wide, ["x", "y"]).first()["date"] == DAY + dt.timedelta(3)
    assert sorted(r["date"] for r in build.trimmed(wide, ["x", "y"]).collect()) == days(7)[3:]  # day 5 has a gap and stays
    assert build.trimmed(wide.where("x is null"), ["x", "y"]).count() == 0 and build.trimmed(wide.limit(0), ["x"]).count() == 0


def test_the_whole_build_fills_and_drops(spark):
    whole = panel(spark, ["a", "b"], 330)
    holes = whole.where(~((F.col("ticker") == "b") & F.col("date").isin(days(330)[100:102])))
    macro = whole.select("date").distinct().withColumns({"level": F.lit(1.0), "nothing": F.lit(None).cast("double")})
    out = build.complete(holes, ["a", "b"], whole.select("date").distinct(), macro).toPandas().sort_values("date")
    assert "nothing" not in out and "level" in out
    assert list(out["date"]) == days(330)[251:]  # the longest window is 252 sessions
    assert out.drop(columns="date").notna().all().all()


def test_a_series_that_stands_still_has_no_correlation(spark):
    moving, still = panel(spark, ["a"], 12), panel(spark, ["b"], 12).withColumn("close", F.lit(7.0))
    rows = features.pairwise_correlation(moving.unionByName(still), 5).collect()
    assert len(rows) == 12 and all(r["avg_corr"] is None for r in rows)


def test_isolation_names_what_does_not_belong(spark):
    wide = spark.createDataFrame([(DAY, 1.0, None, 2.0, 3.0)], "date date, a_ret double, b_ret double, fwd_vol_5 double, avg_corr double")
    assert sorted((r["name"], r["n"], r["fault"]) for r in build.isolation_faults(wide, ["a"], ["a", "b"]).collect()) == [("b_ret", 0, "other ticker"), ("fwd_vol_5", 1, "future")]
    assert build.isolation_faults(wide.select("date", "a_ret"), ["a"], ["a", "b"]).count() == 0
