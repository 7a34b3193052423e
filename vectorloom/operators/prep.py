"""Preparation of samples: filters, labels, splits, caps, partitions, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions import rng
from vectorloom.functions.tables import settle
from vectorloom.functions.vectors import normalise
from vectorloom.operators import slices

#: Cells of moments that go to every task.
SENT = 1 << 21


def drop_null_class(df: DataFrame, label: str = "y", offset: int = 0) -> DataFrame:
    """Rows of class 0 go; the others move down by one, then up by ``offset``."""
    return df.where(F.col(label) != 0).withColumn(label, F.col(label) - 1 + offset)


def valid_clients(df: DataFrame, least: int, client: str = "client", label: str = "y") -> DataFrame:
    """Rows of clients with ``least`` samples or more and two classes or more."""
    good = df.groupBy(client).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).where((F.col("n") >= least) & (F.col("k") >= 2))
    return df.join(good.select(client), client, "left_semi")


def compact_labels(df: DataFrame, label: str = "y", out: str = "y_dense") -> DataFrame:
    """Dense ids of the distinct labels in order; few labels, so they are ranked in one task and sent."""
    ids = df.select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(ids, label)


def first_seen_labels(df: DataFrame, order: str, label: str = "y", out: str = "y_seen") -> DataFrame:
    """Ids of the labels in the order of their first rows."""
    ids = df.groupBy(label).agg(F.min(order).alias("_at")).select(label, (F.row_number().over(Window.orderBy("_at", label)) - 1).alias(out))
    return df.join(ids, label)


def l2_normalise(df: DataFrame, x: str = "x", mode: str = "unit") -> DataFrame:
    return df.withColumn(x, normalise(x, mode))


def _with_moments(df: DataFrame, stats: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """Rows with the moments of their key, an array of structs, in one column of its own name; null without any.

    The moments are written once.  SENT cells or fewer go to every task; more are
    joined by shuffle, without sorting the rows.
    """
    (held,) = slices.fresh(df, "moments")
    names = [f"{held}_{i}" for i in range(len(keys))]
    packed = settle(stats.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.arrays_zip(*stats.columns[len(keys) :]).alias(held)), "moments")
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    cells = packed.agg(F.sum(F.size(held) + F.lit(1))).first()[0] or 0
    return df.join(F.broadcast(packed) if cells <= SENT else packed.hint("shuffle_hash"), same, "left").drop(*names), held


def standardise(df: DataFrame, keys: list[str], is_train: Column, x: str = "x", floor: float = 0.3) -> DataFrame:
    """Centres and scales by the train rows of each key, with a floor under the deviation.

    Tasks add up moments, so one row per key and task is shuffled for them (per
    dimension too where they are many).  Rows of a key without train rows stay as they
    are; a null x stays null.
    """
    stats = slices.moments(df.where(is_train), keys, x)
    divisor = F.transform("variance", lambda s: F.greatest(F.sqrt(s), F.lit(floor)))
    joined, held = _with_moments(df, stats.select(*keys, "mean", divisor.alias("divisor")), keys)
    scaled = F.zip_with(x, held, lambda v, t: (v - t["mean"]) / t["divisor"])
    return joined.withColumn(x, F.when(F.col(held).isNull(), F.col(x).cast("array<double>")).otherwise(scaled)).select(*df.columns)


def impute_mean(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """NaN and null cells become the mean of their column in the key, or 0 if it has none; a null x stays null."""
    real = lambda v: F.when(~F.isnan(v), v)
    joined, held = _with_moments(df, slices.moments(df, keys, x, skip_nan=True).select(*keys, "mean"), keys)
    filled = F.zip_with(x, F.slice(held, 1, F.greatest(F.size(x), F.lit(0))), lambda v, t: F.coalesce(real(v), t["mean"], F.lit(0.0)))
    return joined.withColumn(x, filled).select(*df.columns)


def split_train_test(df: DataFrame, groups: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Adds split: a random ``share`` of every group is test, half to even, one to n - 1 rows."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(rng.digest(seed, F.col(key)), key))
    n = F.count("*").over(Window.partitionBy(*groups))
    take = F.greatest(F.least(F.bround(n * F.lit(share)), n - 1), F.lit(1))
    return df.withColumn("split", F.when((n > 1) & (rank <= take), "test").otherwise("train"))


def chronological_split(df: DataFrame, groups: list[str], order: list[str], train: float, val: float = 0.0) -> DataFrame:
    """Adds split by position in order: cuts half to even, at least one train row, the last row test."""
    w = Window.partitionBy(*groups)
    rank, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    first = F.greatest(F.bround(n * F.lit(train)), F.lit(1))
    second = F.greatest(F.bround(n * F.lit(train + val)), first)
    place = F.when((n >= 2) & (rank == n), "test").when(rank <= first, "train").when(rank <= second, "val").otherwise("test")
    return df.withColumn("split", place)


def stratified_cap(df: DataFrame, client: str, label: str, key: str, most: int | str, seed: int) -> DataFrame:
    """At most ``most`` rows of a client, shared over classes in proportion.

    ``most`` is a number, or the name of a column with each client's own number.

    Every class starts with the floor of its share, at least one and at most all;
    only more classes than rows leave some class without one.
    Where that is too many, the largest quotas give back one each in turn; where
    it is too few, classes with the most rows left take one each in turn.  The
    turns follow from ranks of the (class, step) pairs, one row per unit to move,
    so no loop runs on the driver.
    """
    limit = (F.max(most) if isinstance(most, str) else F.lit(most)).alias("most")
    counts = df.groupBy(F.col(client).alias("client"), F.col(label).alias("label")).agg(F.count("*").alias("n"), limit)
    most_ = F.col("most")
    w = Window.partitionBy("client")
    quota = counts.withColumn("total", F.sum("n").over(w)).withColumn("q", F.when(F.col("total") <= most_, F.col("n")).otherwise(F.least(F.greatest(F.floor(F.col("n") * most_ / F.col("total")), F.lit(1)), F.col("n"))))
    gap = quota.withColumn("gap", F.least(most_, F.col("total")) - F.sum("q").over(w))
    units = F.when(F.col("gap") < 0, F.col("q")).when(F.col("gap") > 0, F.col("n") - F.col("q")).otherwise(0)
    steps = gap.withColumn("u", F.explode(F.sequence(F.lit(0), F.greatest(F.least(units, F.abs("gap")), F.lit(0)))))
    level = F.when(F.col("gap") < 0, F.col("q") - F.col("u") + 1).otherwise(F.col("n") - F.col("q") - F.col("u") + 1)
    turn = F.row_number().over(w.orderBy(F.desc(F.when(F.col("u") > 0, level).otherwise(-1)), "label"))
    moved = steps.withColumn("turn", turn).groupBy("client", "label", "q", "gap").agg(F.count_if((F.col("u") > 0) & (F.col("turn") <= F.abs("gap"))).alias("m"))
    place, allowed = fresh_ = slices.fresh(df, "place", "allowed")
    final = moved.select(F.col("client").alias(client), F.col("label").alias(label), (F.col("q") + F.signum("gap") * F.col("m")).alias(allowed))
    rank = F.row_number().over(Window.partitionBy(client, label).orderBy(rng.digest(seed, F.col(key)), key))
    return df.withColumn(place, rank).join(final, [client, label]).where(F.col(place) <= F.col(allowed)).drop(*fresh_)


def allocate_budget(sizes: DataFrame, size: str, budget: int, key: str) -> DataFrame:
    """Adds quota: the budget shared in proportion, floors first, then largest remainders.

    sizes has one row per client; those rows meet in one task.
    """
    every = Window.partitionBy()
    raw = F.col(size) * budget / F.sum(size).over(every)
    parts = sizes.withColumn("_raw", raw).withColumn("_floor", F.least(F.greatest(F.floor("_raw"), F.lit(1)), F.col(size)))
    left = F.least(F.lit(budget), F.sum(size).over(every)) - F.sum("_floor").over(every)
    turn = F.row_number().over(Window.orderBy(F.desc(F.when(F.col("_floor") < F.col(size), F.col("_raw") - F.floor("_raw")).otherwise(-1)), key))
    return parts.withColumn("quota", (F.col("_floor") + (turn <= left).cast("int")).cast("bigint")).drop("_raw", "_floor")


def cap_total(df: DataFrame, client: str, label: str, key: str, threshold: int, total: int, seed: int) -> DataFrame:
    """Nothing for tables up to ``threshold`` rows; larger ones are cut to ``total`` rows.

    The budget is shared over clients by size and inside a client over classes.
    """
    sizes = df.groupBy(client).agg(F.count("*").alias("_size"))
    if (sizes.agg(F.sum("_size")).first()[0] or 0) <= threshold:
        return df
    quotas = allocate_budget(sizes, "_size", total, client).select(client, F.col("quota").alias("_most"))
    return stratified_cap(df.join(quotas, client), client, label, key, "_most", seed).drop("_most")


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n random rows, the same in every run; the rows keep their order by key."""
    return df.orderBy(rng.digest(seed, F.col(key)), key).limit(n)


def participants(clients: DataFrame, rounds: int, share: float, seed: int, client: str = "client") -> DataFrame:
    """Clients that take part in each round: the ceiling of ``share``, one at least."""
    per = clients.select(client).distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    w = Window.partitionBy("round")
    rank = F.row_number().over(w.orderBy(rng.digest(seed, F.col("round"), F.col(client)), client))
    return per.withColumn("_r", rank).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1))).select("round", client)


def dirichlet_clients(df: DataFrame, key: str, label: str, clients: int, halves: int, seed: int, keep: list[str] | None = None) -> DataFrame:
    """Adds client: every class is cut over clients in proportions Dir(halves / 2).

    ``keep`` names columns (a split, say) inside which the cuts are made, with the
    same proportions in each.
    """
    labels = df.select(label).distinct()
    g = labels.withColumn("client", F.explode(F.sequence(F.lit(0), F.lit(clients - 1)))).withColumn("g", rng.half_gamma(seed, halves, F.col(label), F.col("client")))
    w = Window.partitionBy(label).orderBy("client")
    share = F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("g").over(Window.partitionBy(label))
    cuts = g.withColumn("c", share).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("client", "c"))).alias("cuts"))
    inside = Window.partitionBy(label, *(keep or []))
    ranked = df.withColumns({"_at": F.row_number().over(inside.orderBy(rng.digest(seed, F.col(key)), key)) - 1, "_n": F.count("*").over(inside)})
    first = F.filter("cuts", lambda c: F.when(c["client"] == clients - 1, F.col("_n")).otherwise(F.floor(F.round(c["c"], 9) * F.col("_n"))) > F.col("_at"))
    return ranked.join(cuts, label).withColumn("client", F.get(first, 0)["client"]).drop("cuts", "_at", "_n")


def windows(df: DataFrame, key: str, order: list[str], width: int, stride: int, x: str, label: str, strict: bool = False) -> DataFrame:
    """Runs of ``width`` rows every ``stride`` rows of each key: key, start, x (flattened), label, labels.

    The tail that fills no window goes.  The label is the most frequent one, the
    smallest on a tie; with ``strict`` windows of several labels go.  A key's rows are
    cut into blocks, each with the rows that its last windows need of the next.
    """
    given = df.select(key, F.struct(x, label).alias("row"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)])
    placed = slices.ordinals(given, [key], [f"order{i}" for i in range(len(order))], "start")
    cut = slices.blocks(placed, "start", max(slices.BLOCK, width), ahead=width - 1)
    ahead = Window.partitionBy(key, "block").orderBy("start").rowsBetween(0, width - 1)
    full = cut.withColumn("run", F.collect_list("row").over(ahead)).where(F.col("own") & (F.col("start") % stride == 0) & (F.size("run") == width))
    labels = F.transform("run", lambda r: r[label])
    kinds = F.array_distinct(labels)
    votes = F.transform(kinds, lambda k: F.struct(F.size(F.filter(labels, lambda y: y == k)).alias("n"), (-k).alias("k")))
    values = F.transform("run", lambda r: r[x])
    flat = F.flatten(values) if dict(df.dtypes)[x].startswith("array") else values
    out = full.select(key, F.col("start").cast("int").alias("start"), flat.alias("x"), (-F.array_max(votes)["k"]).alias("label"), F.size(kinds).alias("labels"))
    return out.where("labels = 1") if strict else out


def downsample(df: DataFrame, key: str, order: list[str], seconds: Column, target: float) -> DataFrame:
    """Every k-th row of a key, k being the target step over the median positive step: the rows and their step.

    Steps are taken inside blocks of rows, medians by the rank of the steps.
    """
    dt, place, half, named = slices.fresh(df, "dt", "place", "half", "named")
    steps = settle(slices.lagged(df, [key], order, seconds, dt, place).withColumn(dt, seconds - F.col(dt)), "steps")
    typical = slices.quantiles(steps.where(F.col(dt) > 0), [key], dt, [0.5]).select(F.col(key).alias(named), F.col("q")[0].alias(half))
    k = F.greatest(F.coalesce(F.bround(target / F.col(half)), F.lit(1.0)), F.lit(1.0)).cast("bigint")
    return steps.join(typical, F.col(key).eqNullSafe(F.col(named)), "left").withColumn("step", k).where(F.col(place) % F.col("step") == 0).drop(dt, half, named, place)


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def minibatches(df: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """Adds batch: runs of ``size`` rows of each key in the given order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))


def interpolate(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds to left rows the right value interpolated at their time, held flat beyond the ends.

    Both sides are merged by time; the nearest right rows before and after a left
    row come from windows over blocks of the merged rows and, beyond a block, from
    the blocks' own ends.  Right rows of equal time count once, the first by value.
    """
    r = right.groupBy(F.col(key).alias("key"), F.col(at).alias("at")).agg(F.min(value).alias("v")).where(F.col("v").isNotNull())
    points = r.select("key", "at", F.lit(0).alias("side"), F.struct(F.col("at").alias("t"), "v").alias("point"))
    rows = left.select(F.col(key).alias("key"), F.col(at).alias("at"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))
    both = points.unionByName(rows, allowMissingColumns=True)
    near = slices.carried(both, ["key"], ["at", "side"], "point", "before", "after").where("side = 1")
    t = F.col("at")
    share = (t - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    lerp = F.col("before.v") + share * (F.col("after.v") - F.col("before.v"))
    out = F.when(F.col("before").isNull(), F.col("after.v")).when(F.col("after").isNull() | (F.col("after.t") == F.col("before.t")), F.col("before.v")).otherwise(lerp)
    return near.select(*[F.col(f"row.{c}").alias(c) for c in left.columns], out.alias("interpolated"))
