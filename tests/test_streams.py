"""Rows beside their state, slices of keys of any size, and rounds that go on where they stopped."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions.vectors import normalise
from vectorloom.operators import encoders, prep, slices, streams
from vectorloom.operators import prototypes as pr
from vectorloom.operators import training as tr
from vectorloom.plans import rounds, storage
from vectorloom.sources import fixture


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def samples(spark):
    s = fixture.clients(fixture.template(spark, 5, 16, 20, 10), 3)
    return s.withColumn("split", F.lit("train")).unionByName(s.withColumn("split", F.lit("test")))


def test_stored_samples_are_not_shuffled_again(spark, samples):
    train = samples.where("split = 'train'")
    state = storage.settle(pr.class_means(train, ["client", "y"], "h").withColumn("delta", F.transform("w", lambda v: v * 0.0)), "state")
    held = streams.store(train, "held-samples", ["client"])
    learner = tr.Memory(0.4)
    stored = tr.local(held.rows, state, "client", learner, 8, 2, 3, buckets=held.buckets)
    text = plan(stored)
    assert text.count("Exchange") == 2 and text.count("Bucketed: true") == 2  # one pass per epoch; only the state moves
    assert "explode" not in text
    cells = lambda df: sorted((r.client, r.y, r.errors, *np.round(r.w, 9)) for r in df.collect())
    assert cells(stored) == cells(tr.local(train, state, "client", learner, 8, 2, 3))
    some = held.rows.join(train.select("client").distinct().where("client < 2"), "client", "left_semi")
    text = plan(tr.local(some, state, "client", learner, 8, buckets=held.buckets))
    assert text.count("Bucketed: true") == 1 and not re.search(r"Exchange[^\n]*\n[^\n]*(Project|FileScan)[^\n]*\bh#\d+[^\n]*Bucketed", text)
    assert len(re.findall(r"Exchange hashpartitioning\(client#\d+, \d+\), REPARTITION_BY_NUM", text)) == 1
    wide_keys = tr.local(held.rows, state.withColumn("client", F.col("client").cast("bigint")), "client", learner, 8, 2, 3, buckets=held.buckets)
    assert plan(wide_keys).count("Exchange") == 2  # keys of another type are turned, the rows stay
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    try:
        assert cells(tr.local(held.rows, state, "client", learner, 8, 2, 3, buckets=held.buckets)) == cells(stored)
    finally:
        spark.conf.unset("spark.sql.unionOutputPartitioning")
    seen = pr.predict(held.rows, state, ["client"], "h", buckets=held.buckets)
    assert plan(seen).count("Exchange") == 1 and not re.search(r"Join", plan(seen))
    got, want = (sorted((r.client, r.sample, r.pred) for r in d.collect()) for d in (seen, pr.predict(train, state, ["client"], "h")))
    assert got == want
    held.drop()
    assert not spark.catalog.tableExists(held.name)


def test_predictions_take_any_column_names(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0], "p"), ("a", 2, [0.0, 2.0], "q"), ("a", 3, None, "r"), ("b", 4, [1.0, 1.0], "s"), (None, 5, [1.0, 0.0], "t")], "client string, sample int, x array<double>, _protos string").withColumn("pred", F.lit("old")).withColumn("_kind", F.lit(7))
    protos = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("a", 2, [0.0, 0.0]), (None, 3, [1.0, 0.0])], "client string, y int, w array<double>")
    got = {r.sample: (r.pred, r._protos) for r in pr.predict(df, protos, ["client"]).collect()}
    assert got == {1: (0, "p"), 2: (1, "q"), 3: (None, "r"), 5: (3, "t")}  # rows of keys without prototypes go
    flat = {r.sample: r.pred for r in pr.predict(df, protos.where("client = 'a'").drop("client"), []).collect()}
    assert flat == {1: 0, 2: 1, 3: None, 4: 0, 5: 0}
    assert pr.predict(df, protos.where("false"), []).count() == 0


def test_encoding_of_computed_arrays(spark):
    x = spark.range(50).select("id", F.array(*[F.sin(F.col("id") * (i + 1.0)) for i in range(6)]).alias("x"))
    w = np.random.default_rng(0).normal(size=(6, 32))
    got = encoders.encode_cosine(x.withColumn("x", normalise("x")), w).withColumn("n", F.transform("h", lambda v: v * 2)).collect()
    for r in got:
        z = np.cos(np.array(r.x) @ w)
        assert np.allclose(r.h, z / (np.linalg.norm(z) + 1e-8))
    assert encoders.multiply(x.withColumn("x", F.when(F.col("id") > 1, F.col("x"))), w).where("z IS NULL").count() == 2


def series(spark, n=400):
    """One user has half of all rows; times repeat."""
    draw = np.random.default_rng(1)
    rows = [(("hot" if i % 2 else f"u{i % 7}") if i % 50 else None, float(t), float(i % 11) if i % 5 else None, int(i % 3), i) for i, t in enumerate(draw.integers(0, 150, n))]
    return rows, spark.createDataFrame(rows, "k string, t double, v double, y int, id int").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[4])):
        out.setdefault(r[0], []).append(r)
    return out


def test_places_windows_and_carried_values(spark, monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 16)
    rows, df = series(spark)
    got = {(r.k, r.id): r.at for r in slices.ordinals(df, ["k"], ["t", "id"], "at").collect()}
    assert got == {(k, r[4]): i for k, own in by_key(rows).items() for i, r in enumerate(own)}
    near = {r.id: (r.last, r.first) for r in slices.carried(df, ["k"], ["t", "id"], "v", "last", "first", 16).collect()}
    for own in by_key(rows).values():
        for i, r in enumerate(own):
            before, after = [x[2] for x in own[: i + 1] if x[2] is not None], [x[2] for x in own[i:] if x[2] is not None]
            assert near[r[4]] == (before[-1] if before else None, after[0] if after else None)
    got = {(r.k, r.start): (r.x, r.label, r.labels) for r in prep.windows(df, "k", ["t", "id"], 7, 3, "v", "y").collect()}
    want = {}
    for k, own in by_key([(r[0], r[1], r[2], r[3], r[4]) for r in rows]).items():
        for i in range(0, len(own) - 6, 3):
            ys = [r[3] for r in own[i : i + 7]]
            want[k, i] = ([r[2] for r in own[i : i + 7]], min(set(ys), key=lambda y: (-ys.count(y), y)), len(set(ys)))
    assert got == want
    lag = {r.id: r.before for r in slices.lagged(df, ["k"], ["t", "id"], F.col("t"), "before", "at", 16).collect()}
    assert all(lag[r[4]] == (own[i - 1][1] if i else None) for own in by_key(rows).values() for i, r in enumerate(own))


def test_a_hot_key_is_shared_by_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("k"), (F.col("id") * 7919 % 40_009).alias("t"))
    placed = slices.blocks(slices.ordinals(df, ["k"], ["t"], "at"), "at", 256, ahead=9)
    sizes = [r.n for r in placed.repartition(8, "k", "block").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * np.median(sizes)
    dealt = df.repartitionByRange(8, "k", "t").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in dealt) <= 2 * np.median([r.n for r in dealt])


def test_quantiles_by_rank(spark):
    rows, df = series(spark)
    got = {r.k: r.q for r in slices.quantiles(df, ["k"], "v", [0.25, 0.5, 0.9]).collect()}
    for k, own in by_key(rows).items():
        values = [r[2] for r in own if r[2] is not None]
        assert np.allclose(got[k], np.quantile(values, [0.25, 0.5, 0.9])) if values else k not in got
    whole = slices.quantiles(df, [], "v", [0.0, 1.0]).first().q
    assert whole == [0.0, 10.0]
    assert slices.quantiles(df.where("false"), ["k"], "v", [0.5]).count() == 0


def test_moments(spark):
    nan = float("nan")
    rows = [("a", [1.0, nan, None]), ("a", [3.0, 4.0, None]), ("b", [1e9, 5.0]), ("b", [1e9 + 2, 7.0]), ("a", None), (None, [2.0])]
    df = spark.createDataFrame(rows, "k string, x array<double>").repartition(3)
    got = {r.k: r for r in slices.moments(df, ["k"], "x", skip_nan=True).collect()}
    assert (got["a"].n, got["a"].mean, got["a"].variance) == ([2, 1, 0], [2.0, 4.0, None], [1.0, 0.0, None])
    assert got["b"].mean == [1e9 + 1, 6.0] and got["b"].variance == [1.0, 1.0] and got[None].mean == [2.0]
    assert np.isnan({r.k: r for r in slices.moments(df, ["k"], "x").collect()}["a"].mean[1])
    assert len({r.k for r in prep.impute_mean(df, ["k"]).collect()}) == 3 and prep.impute_mean(df, ["k"]).count() == len(rows)
    kept = prep.standardise(df.withColumn("_stats", F.lit(1)), ["k"], F.col("k") == "b")
    assert sorted(str(r.x) for r in kept.collect() if r.k != "b") == sorted(str(list(x) if x else x) for k, x in rows if k != "b")
    assert plan(slices.moments(df, ["k"], "x")).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("method", ["averaging", "feedback", "subspace", "mixed"])
def test_a_stopped_run_goes_on_after_its_last_whole_round(spark, samples, tmp_path, monkeypatch, method):
    s = rounds.Settings(rounds=2, batch=8, common_rank=3, global_rank=2, personal_rank=4)
    told = lambda run: sorted((r["round"], r.metric, round(r.value, 9)) for r in run.history.collect())
    whole = told(rounds.METHODS[method](samples, s))
    s.journal = str(tmp_path / "journal")
    plain = rounds._Book.uploads

    def failing(self, local, round_, *parts):
        if round_ == 2:
            raise RuntimeError("stopped")
        plain(self, local, round_, *parts)

    monkeypatch.setattr(rounds._Book, "uploads", failing)
    with pytest.raises(RuntimeError, match="stopped"):
        rounds.METHODS[method](samples, s)
    monkeypatch.setattr(rounds._Book, "uploads", plain)
    run = rounds.METHODS[method](samples, s)
    assert told(run) == whole and {t[0] for t in run.timings} == {2}
    times = {r.stage: r for r in rounds.timing_report(spark, run, 3).collect()}
    assert times.keys() == {"clients", "server"} and all(t.rounds == 1 and t.median > 0 and np.isclose(t.ms_per_client, t.median * 1000 / 3) for t in times.values())
    assert told(rounds.METHODS[method](samples, s)) == whole  # nothing is left to do


def test_methods_are_compared_and_reported_one_by_one(spark, samples, tmp_path, monkeypatch):
    s = rounds.Settings(rounds=1, batch=8)
    saved = []
    rows = rounds.compare(samples, s, ["averaging", "feedback"], str(tmp_path / "runs"), lambda df: saved.append(df.select("method").distinct().count()))
    assert saved == [1, 2] and {r.method for r in rows.collect()} == {"averaging", "feedback"}
    monkeypatch.setitem(rounds.METHODS, "averaging", None)  # is not run again
    assert rounds.compare(samples, s, ["averaging", "feedback"], str(tmp_path / "runs")).count() == rows.count()
