import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import vectors as v
from vectorloom.operators import prototypes as pr
from vectorloom.operators import training as tr

D = "array<double>"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def protos(df, value="w"):
    return {r["y"]: list(r[value]) for r in df.collect()}


def test_means_sums_and_empty_classes(spark):
    df = rows(spark, [(0, 0, [1.0, 0.0]), (1, 0, [2.0, 0.0]), (2, 1, [0.0, 1.0])], f"sample int, y int, x {D}")
    assert protos(pr.class_means(df, ["y"])) == {0: [1.5, 0.0], 1: [0.0, 1.0]}
    assert protos(pr.class_sums(df, ["y"])) == {0: [3.0, 0.0], 1: [0.0, 1.0]}
    assert protos(pr.class_means(df, ["y"], mode="safe")) == {0: [1.0, 0.0], 1: [0.0, 1.0]}
    counts = pr.class_counts(df.withColumn("client", F.lit(5)), spark.createDataFrame([(5,)], "client int"), spark.range(3).select(F.col("id").cast("int").alias("y")))
    assert {r.y: r.n for r in counts.collect()} == {0: 2, 1: 1, 2: 0}


def test_push_and_pull_and_step(spark):
    memory = rows(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], f"y int, w {D}")
    df = rows(spark, [(0, 0, [0.0, 1.0])], f"sample int, y int, x {D}")
    assert protos(pr.stale_step(df, memory, [], 0.5)) == {0: [1.0, 0.5], 1: [0.0, 0.5], 2: [0.0, 0.0]}


def memory(w):
    return {"w": w, "delta": w * 0.0}


def test_stale_and_sequential_updates_differ():
    w, x, y = np.eye(2), np.array([[-1, 1], [0.2, 0.8]]), np.array([0, 0])
    rule = tr.Memory(1.0, renormalise=None)
    one = tr.run_batches(rule, memory(w), {"h": x}, y, 1)
    assert one.held["w"].tolist() == [[0, 1], [1, 0]] and one.errors.tolist() == [1, 0] and np.allclose(one.held["delta"], one.held["w"] - w)
    stale = tr.run_batches(rule, memory(w), {"h": x}, y, 2)
    assert np.allclose(stale.held["w"], [[0.2, 1.8], [0.8, -0.8]]) and stale.errors.tolist() == [2, 0]


def test_rows_of_a_batch_may_come_in_pieces():
    draw = np.random.default_rng(1)
    w, x, y = draw.normal(size=(4, 6)), draw.normal(size=(20, 6)), draw.integers(0, 4, 20)
    whole, pieces = (tr.Memory(0.3) for _ in range(2))
    whole.start(memory(w))
    pieces.start(memory(w))
    whole.take({"h": x}, y)
    for a in range(0, 20, 7):
        pieces.take({"h": x[a : a + 7]}, y[a : a + 7])
    whole.step()
    pieces.step()
    assert np.allclose(whole.finish()["w"], pieces.finish()["w"])


def test_masks_and_bases_of_updates_are_checked_and_hold():
    draw = np.random.default_rng(3)
    w, x, y = draw.normal(size=(3, 4)), draw.normal(size=(30, 4)), draw.integers(0, 3, 30)
    mask = np.array([1, 0, 1, 0])
    got = tr.run_batches(tr.Memory(0.5, renormalise=None, mask=mask), memory(w), {"h": x}, y, 5).held["w"]
    assert np.array_equal(got[:, [1, 3]], w[:, [1, 3]]) and not np.allclose(got, w)
    basis = np.eye(4)[:1]
    got = tr.run_batches(tr.Memory(0.5, renormalise=None, basis=basis), memory(w), {"h": x}, y, 5).held["w"]
    assert np.allclose(got[:, 1:], w[:, 1:])
    for wrong in ({"mask": np.ones(3)}, {"basis": np.ones((2, 3))}, {"basis": np.ones(4)}):
        with pytest.raises(ValueError):
            tr.run_batches(tr.Memory(0.5, **wrong), memory(w), {"h": x}, y, 5)


def test_clients_train_in_the_order_of_their_digests(spark):
    """Rows of one client over several Arrow batches, unknown classes, a client without rows and one without state."""
    draw = np.random.default_rng(5)
    data = [(int(draw.integers(3)), i, int(draw.integers(4)), draw.normal(size=5).tolist()) for i in range(200)]
    state = [(c, y, draw.normal(size=5).tolist(), [0.0] * 5) for c in (0, 1, 9) for y in (0, 1, 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        samples, held = rows(spark, data, f"client int, sample bigint, y int, h {D}"), rows(spark, state, f"client int, y int, w {D}, delta {D}")
        out = tr.local(samples, held, "client", tr.Memory(0.4), batch=8, epochs=2, seed=3, round_=1)
        got = {(r.client, r.y): (r.w, r.errors) for r in out.collect()}
        assert out.count() == len(state) and {r.client for r in out.select("client").collect()} == {0, 1, 9}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import hashlib

    for c in (0, 1):
        w = np.array([s[2] for s in state if s[0] == c])
        one = tr.Memory(0.4)
        one.start(memory(w))
        labels = np.array([0, 1, 3])
        for epoch in range(2):
            turn = lambda i: hashlib.md5(f"3|1|{epoch}|{i}".encode()).hexdigest()  # noqa: B023, E731
            own = sorted((d for d in data if d[0] == c and d[2] in labels), key=lambda d: turn(d[1]))
            x, y = np.array([d[3] for d in own]), np.searchsorted(labels, [d[2] for d in own])
            for a in range(0, len(y), 8):
                one.take({"h": x[a : a + 8]}, y[a : a + 8])
                one.step()
        want = one.finish()["w"]
        for k, label in enumerate(labels.tolist()):
            assert np.allclose(got[c, label][0], want[k]) and got[c, label][1] == one.errors[k]
    assert all(np.allclose(got[9, y][0], next(s[2] for s in state if s[:2] == (9, y))) and got[9, y][1] == 0 for y in (0, 1, 3))


def test_dot_and_cosine_predict_apart_and_zero_rows_never_win(spark):
    protos_ = rows(spark, [(0, [2.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], f"y int, w {D}")
    df = rows(spark, [(0, 0, [0.5, 0.8]), (1, 0, [-1.0, -1.0])], f"sample int, y int, x {D}")
    pred = lambda m: {r.sample: r.pred for r in pr.predict(df, protos_, [], metric=m).collect()}
    assert pred("cos")[0] == 1 and pred("dot")[0] == 0
    assert pred("cos")[1] != 2 and pred("dot")[1] != 2
    with pytest.raises(ValueError):
        v.similarity("a", "b", "l1")


def test_averages_over_clients(spark):
    state = rows(spark, [(1, 0, [1.0, 0.0], 3), (1, 1, [0.0, 1.0], 3), (2, 0, [0.0, 1.0], 1), (2, 1, [1.0, 0.0], 1)], f"client int, y int, w {D}, n int")
    got = protos(pr.consensus(state, "y", "w", "n", "safe"))
    assert np.allclose(got[0], np.array([3, 1]) / np.sqrt(10)) and np.allclose(got[1], np.array([1, 3]) / np.sqrt(10))
    empty = protos(pr.consensus(state.withColumn("n", F.lit(0)), "y", "w"))
    assert empty == {0: [0.0, 0.0], 1: [0.0, 0.0]}


def test_changed_rows_alone_are_normalised():
    w = np.array([[1.0, 0], [0, 1], [-3, -4]])
    out = tr.run_batches(tr.Memory(0.5, unit_rows=True, renormalise="changed"), memory(w), {"h": np.array([[0.0, 2], [0, 2]])}, np.array([0, 0]), 2).finish()["w"]
    assert out[1].tolist() == [0, 0] and out[2].tolist() == [-3, -4] and np.isclose(np.linalg.norm(out[0]), 1)


def test_follow_ratio_and_merge(spark):
    df = rows(spark, [(10, 0), (10, 10), (0, 0)], "n int, wrong int")
    assert np.allclose([r.g for r in df.select(pr.follow_ratio(F.col("n"), F.col("wrong")).alias("g")).collect()], [0.1, 0.9, 0])
    merged = rows(spark, [([1.0], [2.0])], f"a {D}, b {D}").select(pr.gated_merge("a", "b", 0.2, F.lit(0.5)).alias("m")).first().m
    assert np.isclose(merged[0], 1.1)


def test_coefficients_accumulate_over_a_stale_batch():
    state = {"c": np.array([[1.0, 0], [0, 0], [0, 0]]), "g": np.zeros((3, 1)), "d": np.zeros((3, 2)), "p": np.zeros((3, 1))}
    z = {"zc": np.array([[1.0, 0], [1, 1]]), "zg": np.zeros((2, 1)), "zp": np.ones((2, 1))}
    one = tr.run_batches(tr.Coefficients(1.0, 0.5), state, z, np.array([1, 1]), 0)
    assert np.allclose(one.held["c"], [[-1, -1], [2, 1], [0, 0]]) and np.allclose(one.held["d"], 0.5 * (one.held["c"] - state["c"]))  # two rates
    assert np.allclose(one.held["p"][:, 0], [-1, 1, 0]) and one.errors.tolist() == [0, 2, 0]


def test_mixed_coordinates_keep_unit_rows():
    draw = np.random.default_rng(2)
    state = {"s": tr.unit(draw.normal(size=(3, 4))), "p": tr.unit(draw.normal(size=(3, 2))), "alpha": np.full((3, 1), 0.25)}
    z, y = {"zs": draw.normal(size=(40, 4)), "zp": draw.normal(size=(40, 2))}, draw.integers(0, 3, 40)
    one = tr.run_batches(tr.Mixed(0.1, 0.2), state, z, y, 10)
    assert one.errors.sum() > 0 and np.allclose(np.linalg.norm(one.held["s"], axis=1), 1, atol=1e-6) and np.allclose(np.linalg.norm(one.held["p"], axis=1), 1, atol=1e-6)


def test_updates_sum_to_nothing(spark):
    draw = np.random.default_rng(0)
    data = [(i, int(draw.integers(3)), int(draw.integers(3)), draw.normal(size=4).tolist()) for i in range(60)]
    df = rows(spark, data, f"sample int, y int, pred int, x {D}")
    assert np.allclose(np.sum([r.u for r in pr.push_pull(df, []).collect()], axis=0), 0)


def test_kmeans_keeps_empty_centres_and_pull_keeps_norms(spark):
    df = rows(spark, [(i, 0, [float(i // 2), 1.0]) for i in range(6)], f"sample int, y int, x {D}")
    centres = pr.kmeans(df, ["y"], "sample", 3, 5)
    assert sorted(r.c[0] for r in centres.collect()) == [0.0, 1.0, 2.0]
    assert pr.squared_error(df, centres, ["y"]).first().sse == 0
    clash = pr.pull(df.withColumns({"c": F.lit("mine"), "distance": F.lit(7)}), centres, ["y"], 0.5)
    assert {(r.c, r.distance) for r in clash.collect()} == {("mine", 7)}
    pulled = pr.pull(df, centres, ["y"], 0.5).select("sample", v.norm("x").alias("n")).collect()
    assert np.allclose([r.n for r in sorted(pulled)], [np.hypot(i // 2, 1) for i in range(6)])
