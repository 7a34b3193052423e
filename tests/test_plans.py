import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import prototypes as pr
from vectorloom.plans import reports, rounds, storage
from vectorloom.sources import fixture


def workload(spark, clients=3):
    t = fixture.template(spark, 5, 16, 20, 10)
    s = fixture.clients(t, clients)
    return s.withColumn("split", F.lit("train")).unionByName(s.withColumn("split", F.lit("test"))), t


def test_fixture_has_the_known_mistakes(spark):
    _, t = workload(spark)
    anchors = pr.class_means(t, ["y"], "h")
    for r in anchors.collect():
        assert np.allclose(r.w, np.eye(16)[r.y])
    seen = pr.predict(t, anchors, [], "h", metric="dot").collect()
    assert all((r.pred != r.y) == r.expect_wrong for r in seen) and sum(r.pred != r.y for r in seen) == 10


def test_three_methods_run_and_report(spark):
    samples, _ = workload(spark)
    s = rounds.Settings(rounds=2, batch=8, common_rank=3, global_rank=2, personal_rank=4, participation=0.6, snapshot_rounds=(2,))
    for name, method in rounds.METHODS.items():
        run = method(samples, s)
        h = run.history.collect()
        assert {r["round"] for r in h} == {1, 2} and all(0 <= r.value <= 1 for r in h if r.metric.endswith("accuracy")), name
        assert {r.metric for r in h} >= {"payload_bytes", "macro_accuracy" if name in ("averaging", "feedback") else "fused_accuracy"}
        assert {t[:2] for t in run.timings} == {(r, stage) for r in (1, 2) for stage in ("clients", "server")}
        assert run.snapshots[2].count() > 0


def test_bases_are_refreshed_and_centres_pull(spark):
    samples, _ = workload(spark, 3)
    s = rounds.Settings(rounds=2, batch=8, common_rank=3, global_rank=2, personal_rank=6, refresh_every=2, centre_every=1, beta=0.2)
    h = rounds.subspace(samples, s).history.collect()
    drift = [r.value for r in h if r.metric == "basis_drift_degrees"]
    assert len(drift) == 1 and 0 <= drift[0] <= 90 and {r["round"] for r in h} == {1, 2}


def test_plans_do_not_grow_with_the_rounds(spark):
    samples, _ = workload(spark, 2)
    size = lambda n: len(rounds.averaging(samples, rounds.Settings(rounds=n)).history._jdf.queryExecution().analyzed().toString())
    assert abs(size(1) - size(3)) < 200
    df = samples.select("sample", F.lit(0).alias("y"), F.col("h").alias("x"))
    scans = lambda n: pr.kmeans(df, ["y"], "sample", 2, n)._jdf.queryExecution().analyzed().toString().count("Relation")
    assert scans(1) == scans(4) == 1


def test_unknown_choices_are_errors(spark):
    samples, _ = workload(spark, 2)
    with pytest.raises(ValueError):
        rounds.bootstrap(samples, rounds.Settings(change_start="half"))
    with pytest.raises(ValueError):
        rounds.merge(samples, samples, rounds.Settings(server="half"))


def test_bootstrap_rebuilds_memories_in_full_rank(spark):
    samples, _ = workload(spark, 2)
    noisy = samples.withColumn("h", F.transform("h", lambda v, i: v + F.sin(F.col("sample") * 3.0 + i + F.col("client")) / 5))
    s = rounds.Settings(common_rank=3, global_rank=2, personal_rank=8)
    boot = rounds.bootstrap(noisy, s)
    memory = {(r.client, r.y): np.array(r.w) for r in pr.class_means(noisy.where("split = 'train'"), ["client", "y"], "h", "clamp").collect()}
    personal = {}
    for r in boot.personal.orderBy("r").collect():
        personal.setdefault(r.client, []).append(r.b)
    for r in boot.state.collect():
        m = memory[r.client, r.y]
        own = boot.common @ (boot.common.T @ m)
        rest = m - own - boot.extra @ np.array(r.g)
        basis = np.array(personal[r.client]).T
        assert np.allclose(basis.T @ rest, r.p)


def test_storage(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, storage.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], a.schema), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.k for r in storage.remaining(a, a.where("k = 1"), ["k"]).collect()] == [2]
    assert storage.signature({"b": 1, "a": 2}) == storage.signature({"a": 2, "b": 1}) != storage.signature({"a": 2})
    assert storage.compatible({"a": 1}, {"a": 1, "cap": 7}, {"cap": 7}) and not storage.compatible({"a": 1}, {"a": 2}, {})
    storage.save_snapshot(a.withColumn("round", F.lit(1)).unionByName(a.withColumn("round", F.lit(5))), str(tmp_path / "s"), "d", "m", 1, "sig")
    back = storage.load_snapshot(spark, str(tmp_path / "s"), dataset="d", round=5)
    assert back.count() == 2 and "round=5" in back.select("v").inputFiles()[0]


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("b", 1, 0.1)], "method string, round int, value double")
    assert reports.markdown(reports.pivot_rounds(df, [1, 2]).orderBy("method")).splitlines()[2] == "| a | 0.5 | 0.7 |"
    assert reports.violations(df, df, ["method", "round"], "value").count() == 0
    assert reports.violations(df, df.where("round = 1"), ["method", "round"], "value").count() == 1
    h = {r.bin: r.share for r in reports.histogram(df, "value").collect()}
    assert len(h) == 10 and np.isclose(h[5], 1 / 3) and h[0] == 0
