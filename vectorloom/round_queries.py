"""Queries over whole rounds of learning, and their SQL.

The SQL unrolls a run: one batch per epoch, every client in every round, bases
that both engines know in closed form.  It is written apart from the operators.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import rng
from vectorloom.functions import vectors as v
from vectorloom.operators import bases, training
from vectorloom.operators import prototypes as pr
from vectorloom.plans import rounds, storage
from vectorloom.queries import DIMS, H, M, R, SEED, S, cells, encoded, query, r6, vectors

RATE, OWN_RATE = 0.035, 0.02
#: Rows 1-4 of a Walsh matrix span the common part, 5 and 6 the global one, 7 and 8 the clients' own.
COMMON, EXTRA, OWN = range(1, 5), range(5, 7), range(7, 9)
_SETTINGS = rounds.Settings(rounds=2, batch=0, rate=RATE, personal_rate=OWN_RATE, common_rank=6, global_rank=2, personal_rank=4, snapshot_rounds=(2,))


def round_samples(spark, sf) -> DataFrame:
    return storage.settle(encoded(spark, sf).select("client", "sample", "split", F.col("y").cast("int").alias("y"), "h"), "round-samples")


def walsh(rows: range) -> np.ndarray:
    """Orthonormal columns in closed form."""
    return np.array([[(-1.0) ** bin(r & d).count("1") / np.sqrt(DIMS) for r in rows] for d in range(DIMS)])


def fixed_bases(spark, samples: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    own = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(walsh(OWN).T)], "r int, b array<double>")
    return walsh(COMMON), walsh(EXTRA), samples.select("client").distinct().crossJoin(F.broadcast(own))  # a few rows


def fixed_bootstrap(spark, sf, **settings) -> tuple[DataFrame, rounds.Settings, rounds.Bootstrap]:
    samples, s = round_samples(spark, sf), rounds.Settings(**{**_SETTINGS.__dict__, **settings})
    return samples, s, rounds.bootstrap(samples, s, given=fixed_bases(spark, samples))


def told(history: DataFrame) -> DataFrame:
    return history.select("round", "metric", r6("value").alias("value"))


def _with(*steps: str) -> str:
    """CTEs that are computed once each."""
    return "WITH " + ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)


def _unit(value: str, keys: str, eps: str = "+ 1e-8") -> str:
    return f"{value} / (sqrt(sum(({value}) * ({value})) OVER (PARTITION BY {keys})) {eps})"


_COS = "round(sum(x.v * m.w) / (greatest(sqrt(sum(x.v * x.v)), 1e-8) * greatest(sqrt(sum(m.w * m.w)), 1e-8)), 9)"
_SPLITS = ("tr AS (SELECT client, sample, y, d, v FROM h WHERE split = 'train')", "te AS (SELECT client, sample, y, d, v FROM h WHERE split = 'test')")
_ENCODED = f"h AS (WITH {H} SELECT * FROM h)"


def _predicted(name: str, rows: str, memory: str, on: str) -> list[str]:
    """Predictions of rows on memories (client, y, d, w)."""
    return [
        f"{name}s AS (SELECT x.client, x.sample, x.y, m.y AS k, {_COS} AS s FROM {rows} x JOIN {memory} m ON m.d = x.d AND {on} GROUP BY 1, 2, 3, 4)",
        f"{name} AS (SELECT client, sample, y, k AS pred FROM {name}s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, k) = 1)",
    ]


def _moves(name: str, seen: str, rows: str = "tr") -> str:
    """Signed sums of the rows that were predicted wrong, by client and class."""
    return (
        f"{name} AS (SELECT client, y, d, sum(v) AS u FROM (SELECT p.client, p.y, d, v FROM {seen} p JOIN {rows} USING (sample) WHERE p.pred <> p.y"
        f" UNION ALL SELECT p.client, p.pred, d, -v FROM {seen} p JOIN {rows} USING (sample) WHERE p.pred <> p.y) GROUP BY 1, 2, 3)"
    )


def _macro(r: int, name: str, seen: str) -> str:
    return f"SELECT {r} AS round, '{name}' AS metric, avg(a) AS value FROM (SELECT client, avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0 END) AS a FROM {seen} GROUP BY 1)"


def _uploads(r: int, table: str, **parts: str) -> list[str]:
    """Bytes that a client sends, and the mean norm of its rows; parts: metric suffix -> value (rows with null d are not sent)."""
    out = [f"SELECT {r}, 'payload_bytes', avg(b) FROM (SELECT client, 8.0 * count(*) * {len(parts)} AS b FROM {table} GROUP BY 1)"] if len(parts) == 1 else []
    return out + [f"SELECT {r}, 'upload_norm_{k}', avg(n) FROM (SELECT client, avg(n) AS n FROM (SELECT client, y, sqrt(sum({e} * {e})) AS n FROM {table} GROUP BY 1, 2) GROUP BY 1)" for k, e in parts.items()]


def _report(selects: list[str]) -> str:
    return f" SELECT CAST(round AS INT) AS round, metric, {R.format('value')} AS value FROM (" + " UNION ALL ".join(selects) + ")"


def _averaging_sql(n: int) -> str:
    steps = [_ENCODED, *_SPLITS, "i0 AS (SELECT client, y, d, sum(v) AS s FROM tr GROUP BY 1, 2, 3)", f"m0 AS (SELECT y, d, {_unit('s', 'y')} AS w FROM i0 WHERE client = (SELECT min(client) FROM i0))"]
    out = []
    for r in range(1, n + 1):
        was, now = f"m{r - 1}", f"m{r}"
        steps += _predicted(f"p{r}", "tr", was, f"x.y IN (SELECT y FROM {was})")
        steps += [
            _moves(f"u{r}", f"p{r}"),
            f"l{r} AS (SELECT client, y, d, {_unit('w', 'client, y')} AS w FROM (SELECT c.client, m.y, m.d, m.w + {RATE}::DOUBLE * coalesce(u.u, 0) AS w FROM (SELECT DISTINCT client FROM tr) c CROSS JOIN {was} m LEFT JOIN u{r} u ON u.client = c.client AND u.y = m.y AND u.d = m.d))",
            f"{now} AS (SELECT y, d, {_unit('s', 'y')} AS w FROM (SELECT y, d, sum(w) AS s FROM l{r} GROUP BY 1, 2))",
        ]
        steps += _predicted(f"e{r}", "te", now, "true")
        out += [_macro(r, "macro_accuracy", f"e{r}"), f"SELECT {r}, 'micro_accuracy', count(*) FILTER (WHERE pred = y) / count(*)::DOUBLE FROM e{r}", *_uploads(r, f"l{r}", w="w")]
    return _with(*steps) + _report(out)


def _feedback_sql(n: int) -> str:
    steps = [
        _ENCODED, *_SPLITS,
        "i0 AS (SELECT client, y, d, sum(v) AS s FROM tr GROUP BY 1, 2, 3)",
        f"j0 AS (SELECT client, y, d, {_unit('s', 'client, y')} AS w FROM i0)",
        f"k0 AS (SELECT y, d, {_unit('s', 'y')} AS w FROM (SELECT y, d, sum(w) AS s FROM j0 GROUP BY 1, 2))",
        "cn AS (SELECT client, y, count(DISTINCT sample) AS n FROM tr GROUP BY 1, 2)",
        "m0 AS (SELECT c.client, k.y, k.d, k.w, CAST(0 AS BIGINT) AS errors FROM (SELECT DISTINCT client FROM h) c CROSS JOIN k0 k)",
        "g0 AS (SELECT y, d, 0.0::DOUBLE AS g FROM k0)",
    ]
    out = []
    for r in range(1, n + 1):
        was = f"m{r - 1}"
        steps += [
            f"a{r} AS (SELECT client, y, d, w, g, {_unit('t', 'client, y')} AS moved, sum(abs(g)) OVER (PARTITION BY client, y) = 0 AS still FROM (SELECT m.client, m.y, m.d, m.w, g.g, m.w + m.errors / greatest(coalesce(cn.n, 0), 1)::DOUBLE * {RATE}::DOUBLE * g.g AS t FROM {was} m JOIN g{r - 1} g USING (y, d) LEFT JOIN cn ON cn.client = m.client AND cn.y = m.y))",
            f"b{r} AS (SELECT client, y, d, CASE WHEN still THEN w ELSE moved END AS w FROM a{r})",
        ]
        steps += _predicted(f"p{r}", "tr", f"b{r}", "m.client = x.client")
        steps += [
            _moves(f"u{r}", f"p{r}"),
            f"x{r} AS (SELECT client, y, count(*) AS errors FROM p{r} WHERE pred <> y GROUP BY 1, 2)",
            f"d{r} AS (SELECT b.client, b.y, b.d, b.w, {RATE}::DOUBLE * coalesce(u.u, 0) AS delta, coalesce(x.errors, 0) AS errors, b.client IN (SELECT client FROM x{r}) AS erred FROM b{r} b LEFT JOIN u{r} u ON u.client = b.client AND u.y = b.y AND u.d = b.d LEFT JOIN x{r} x ON x.client = b.client AND x.y = b.y)",
            f"m{r} AS (SELECT client, y, d, CASE WHEN erred THEN {_unit('(w + delta)', 'client, y')} ELSE w END AS w, errors, delta FROM d{r})",
            f"g{r} AS (SELECT y, d, sum(delta) AS g FROM m{r} GROUP BY 1, 2)",
        ]
        steps += _predicted(f"e{r}", "te", f"m{r}", "m.client = x.client")
        out += [_macro(r, "macro_accuracy", f"e{r}"), *_uploads(r, f"m{r}", delta="delta")]
    return _with(*steps) + _report(out)


#: Memories, coefficients and projected samples in the fixed bases; r numbers the Walsh rows.
_PART = "CASE WHEN r <= 4 THEN 'c' WHEN r <= 6 THEN 'g' ELSE 'p' END"


def _bootstrap_steps(start: str) -> list[str]:
    of_start = "k.t - c.c" if start == "difference" else "0.0::DOUBLE"
    return [
        _ENCODED, *_SPLITS,
        f"wb AS (SELECT CAST(r.range AS INT) AS r, CAST(d.range AS INT) AS d, CASE WHEN bit_count(CAST(r.range AS INT) & CAST(d.range AS INT)) % 2 = 0 THEN 1 ELSE -1 END / sqrt({DIMS}::DOUBLE) AS b FROM range(1, 9) r, range({DIMS}) d)",
        "cn AS (SELECT client, y, count(DISTINCT sample) AS n FROM tr GROUP BY 1, 2)",
        "me AS (SELECT client, y, d, a / greatest(sqrt(sum(a * a) OVER (PARTITION BY client, y)), 1e-8) AS w FROM (SELECT client, y, d, avg(v) AS a FROM tr GROUP BY 1, 2, 3))",
        "kt AS (SELECT client, y, r, sum(w * b) AS t FROM me JOIN wb USING (d) WHERE r <= 6 GROUP BY 1, 2, 3)",
        "kc AS (SELECT y, r, sum(n * t) / sum(n) AS c FROM kt JOIN cn USING (client, y) GROUP BY 1, 2)",
        "rs AS (SELECT me.client, me.y, me.d, me.w - sum(CASE WHEN k.r <= 4 THEN k.t ELSE c.c END * b.b) AS w FROM me JOIN kt k ON k.client = me.client AND k.y = me.y JOIN kc c ON c.y = me.y AND c.r = k.r JOIN wb b ON b.r = k.r AND b.d = me.d GROUP BY me.client, me.y, me.d, me.w)",
        "kp AS (SELECT client, y, r, sum(w * b) AS p FROM rs JOIN wb USING (d) WHERE r > 6 GROUP BY 1, 2, 3)",
        f"s0 AS (SELECT k.client, k.y, k.r, c.c AS v, CASE WHEN k.r <= 4 THEN {of_start} ELSE 0 END AS dv FROM kt k JOIN kc c ON c.y = k.y AND c.r = k.r UNION ALL SELECT client, y, r, p, 0 FROM kp)",
        "z AS (SELECT client, sample, y, split, r AS d, sum(v * b) AS v FROM h JOIN wb USING (d) GROUP BY 1, 2, 3, 4, 5)",
        "ztr AS (SELECT client, sample, y, d, v FROM z WHERE split = 'train')",
        "zte AS (SELECT client, sample, y, d, v FROM z WHERE split = 'test')",
    ]


def _branch(name: str, rows: str, state: str, branch: str) -> list[str]:
    """Predictions of a branch by inner products of coefficients."""
    weight, where = {"fused": ("m.v + m.dv", "true"), "shared": ("m.v", "m.r <= 6"), "personal": ("CASE WHEN m.r <= 4 THEN m.dv ELSE m.v END", "(m.r <= 4 OR m.r > 6)")}[branch]
    return [
        f"{name}s AS (SELECT x.client, x.sample, x.y, m.y AS k, round(sum(x.v * ({weight})), 9) AS s FROM {rows} x JOIN {state} m ON m.client = x.client AND m.r = x.d AND {where} GROUP BY 1, 2, 3, 4)",
        f"{name} AS (SELECT client, sample, y, k AS pred FROM {name}s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, k) = 1)",
    ]


def _subspace_steps(n: int, start: str, server: str = "gated") -> tuple[list[str], list[str], list[str]]:
    steps, out, accuracies = _bootstrap_steps(start), [], []
    for r in range(1, n + 1):
        was = f"s{r - 1}"
        steps += _branch(f"p{r}", "ztr", was, "fused")
        steps += [
            _moves(f"u{r}", f"p{r}", "ztr"),
            f"t{r} AS (SELECT s.client, s.y, s.r, s.v + CASE WHEN s.r <= 6 THEN {RATE}::DOUBLE ELSE {OWN_RATE}::DOUBLE END * coalesce(u.u, 0) AS v, s.dv + CASE WHEN s.r <= 4 THEN {OWN_RATE}::DOUBLE * coalesce(u.u, 0) ELSE 0 END AS dv FROM {was} s LEFT JOIN u{r} u ON u.client = s.client AND u.y = s.y AND u.d = s.r)",
        ]
        steps += _branch(f"q{r}", "ztr", f"t{r}", "fused")
        steps += [
            f"x{r} AS (SELECT cn.client, cn.y, cn.n, coalesce(w.wrong, 0) AS wrong, 1 - greatest(least(1 - coalesce(w.wrong, 0) / greatest(cn.n, 1)::DOUBLE, 0.9::DOUBLE), 0.1::DOUBLE) AS gate FROM cn LEFT JOIN (SELECT client, y, count(*) AS wrong FROM q{r} WHERE pred <> y GROUP BY 1, 2) w USING (client, y))",
            f"c{r} AS (SELECT y, r, sum(n * v) / sum(n) AS cc FROM t{r} JOIN cn USING (client, y) WHERE r <= 6 GROUP BY 1, 2)",
            f"{'o' if server == 'gated_unit' else 's'}{r} AS (SELECT t.client, t.y, t.r, CASE WHEN t.r <= 6 THEN {'c.cc' if server == 'replace' else f't.v + {RATE}::DOUBLE * x.gate * (c.cc - t.v)'} ELSE t.v END AS v, t.dv FROM t{r} t JOIN x{r} x ON x.client = t.client AND x.y = t.y LEFT JOIN c{r} c ON c.y = t.y AND c.r = t.r)",
        ]
        if server == "gated_unit":
            steps += [f"s{r} AS (SELECT client, y, r, CASE WHEN r <= 6 THEN {_unit('v', f'client, y, {_PART}')} ELSE v END AS v, dv FROM o{r})"]
        for b in ("fused", "shared", "personal"):
            steps += _branch(f"e{r}{b}", "zte", f"s{r}", b)
            accuracies.append(_macro(r, f"{b}_accuracy", f"e{r}{b}"))
        out += [
            f"SELECT {r}, 'payload_bytes', avg(b) FROM (SELECT client, 8.0 * count(*) AS b FROM t{r} WHERE r <= 6 GROUP BY 1)",
            *_uploads(r, f"(SELECT * FROM t{r} WHERE r <= 4)", c="v", _="v")[:1],
            *_uploads(r, f"(SELECT * FROM t{r} WHERE r BETWEEN 5 AND 6)", g="v", _="v")[:1],
            f"SELECT {r}, 'mean_gate', avg(gate) FROM x{r}",
            f"SELECT {r}, 'mean_sync_move', avg(n) FROM (SELECT t.client, t.y, {RATE}::DOUBLE * any_value(x.gate) * sqrt(sum((c.cc - t.v) * (c.cc - t.v))) AS n FROM t{r} t JOIN x{r} x ON x.client = t.client AND x.y = t.y JOIN c{r} c ON c.y = t.y AND c.r = t.r WHERE t.r <= 4 GROUP BY 1, 2)",
        ]
    return steps, out, accuracies


def _subspace_sql(n: int, start: str, only_last: bool = False, server: str = "gated") -> str:
    steps, out, accuracies = _subspace_steps(n, start, server)
    if server != "gated":
        return _with(*steps) + _report(accuracies)
    return _with(*steps) + (_report(accuracies[-3:]) if only_last else _report(accuracies + out))


@query(_averaging_sql(2))
def averaging_rounds(spark, sf):
    return told(rounds.averaging(round_samples(spark, sf), _SETTINGS).history)


@query(_feedback_sql(2))
def feedback_rounds(spark, sf):
    return told(rounds.feedback(round_samples(spark, sf), _SETTINGS).history)


@query(_subspace_sql(2, "zero"))
def subspace_rounds_fixed(spark, sf):
    samples, s, boot = fixed_bootstrap(spark, sf)
    return told(rounds.subspace(samples, s, boot).history)


@query(_subspace_sql(2, "difference"))
def subspace_rounds_difference(spark, sf):
    samples, s, boot = fixed_bootstrap(spark, sf, change_start="difference")
    return told(rounds.subspace(samples, s, boot).history)


def _accuracies(spark, sf, **settings) -> DataFrame:
    samples, s, boot = fixed_bootstrap(spark, sf, **settings)
    return told(rounds.subspace(samples, s, boot).history.where("metric LIKE '%accuracy'"))


@query(_subspace_sql(2, "difference", server="replace"))
def subspace_rounds_replace(spark, sf):
    return _accuracies(spark, sf, change_start="difference", server="replace")


@query(_subspace_sql(2, "difference", server="gated_unit"))
def subspace_rounds_unit(spark, sf):
    return _accuracies(spark, sf, change_start="difference", server="gated_unit")


@query(_subspace_sql(2, "zero", only_last=True))
def replay_snapshots(spark, sf):
    samples, s, boot = fixed_bootstrap(spark, sf)
    return told(rounds.replay(rounds.subspace(samples, s, boot).snapshots, boot.cache))


_STATE = "SELECT client, y, CAST(r - 1 AS INT) AS d, round(v, 6) + 0.0 AS v, round(dv, 6) + 0.0 AS change FROM s0"


@query(_with(*_bootstrap_steps("difference")) + " " + _STATE)
def bootstrap_difference(spark, sf):
    _, _, boot = fixed_bootstrap(spark, sf, change_start="difference")
    change = F.concat("d", F.array_repeat(F.lit(0.0), len(EXTRA) + len(OWN)))
    both = boot.state.select("client", "y", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(7)).alias("d"), F.concat("c", "g", "p").alias("v"), change.alias("change"))).alias("x"))
    return both.select("client", "y", F.col("x.d").alias("d"), r6("x.v").alias("v"), r6("x.change").alias("change"))


@query(_with(*_bootstrap_steps("zero")) + " " + _STATE.replace(", round(dv, 6) + 0.0 AS change", ""))
def bootstrap_fixed(spark, sf):
    _, _, boot = fixed_bootstrap(spark, sf)
    return cells(boot.state.select("client", "y", F.concat("c", "g", "p").alias("w")), ["client", "y"], "w")


_ONCE = [*_bootstrap_steps("difference"), *_branch("bf", "zte", "s0", "fused"), *_branch("bs", "zte", "s0", "shared"), *_branch("bp", "zte", "s0", "personal")]


@query(_with(*_ONCE) + " SELECT branch, round(avg(a), 6) + 0.0 AS accuracy, count(*) AS clients FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS branch, client, avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0 END) AS a FROM {t} GROUP BY 2" for n, t in (("fused", "bf"), ("shared", "bs"), ("personal", "bp"))) + ") GROUP BY 1")
def branch_scores(spark, sf):
    _, _, boot = fixed_bootstrap(spark, sf, change_start="difference")
    out = None
    for name, rows in rounds.branch_predictions(boot.cache.where("split = 'test'"), boot.state).items():
        part = pr.macro_accuracy(rows).select(F.lit(name).alias("branch"), r6("accuracy").alias("accuracy"), "clients")
        out = part if out is None else out.unionByName(part)
    return out


@query(_with(*_ONCE) + " SELECT sample, CAST(pred AS INT) AS pred FROM bf")
def whole_memory_scores(spark, sf):
    samples, _, boot = fixed_bootstrap(spark, sf, change_start="difference")
    return rounds.whole_predictions(samples.where("split = 'test'"), boot, boot.state).select("sample", F.col("pred").cast("int").alias("pred"))


@query(_with(*_bootstrap_steps("zero")) + " SELECT sample, CAST(d AS INT) AS r, round(v, 6) + 0.0 AS v FROM z")
def query_cache_fixed(spark, sf):
    samples = round_samples(spark, sf)
    z = rounds.query_cache(samples, *fixed_bases(spark, samples))
    return z.select("sample", F.posexplode(F.concat("zc", "zg", "zp")).alias("r", "v")).select("sample", (F.col("r") + 1).alias("r"), r6("v").alias("v"))


_LATE = [s for s in _bootstrap_steps("zero") if not s.startswith(("z AS", "ztr AS", "zte AS"))]


@query(_with(*_LATE) + f" SELECT CAST(t.client + 100 AS INT) AS client, t.y, CAST(c.r - 1 AS INT) AS d, {R.format('c.c')} AS v FROM (SELECT DISTINCT client, y FROM te) t JOIN kc c USING (y)")
def late_clients(spark, sf):
    samples, s, boot = fixed_bootstrap(spark, sf)
    late = samples.where("split = 'test'").withColumns({"client": (F.col("client") + 100).cast("int"), "split": F.lit("train")})
    state, _ = rounds.late_join(boot, boot.state, late, s)
    return cells(state.select("client", "y", F.concat("c", "g").alias("w")), ["client", "y"], "w")


def _memory(name: str, state: str, value: str) -> str:
    """Whole memories of unit rows from coefficients ``value`` by Walsh row r."""
    return f"{name} AS (SELECT client, y, d, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY client, y)), 1e-8) AS w FROM (SELECT s.client, s.y, wb.d, sum(({value}) * wb.b) AS w FROM {state} s JOIN wb USING (r) GROUP BY 1, 2, 3))"


@query(_with(*_bootstrap_steps("difference"), _memory("m1", "s0", "s.v * CASE WHEN s.r <= 6 AND s.client % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END + s.dv"), _memory("m2", "s0", "s.v + s.dv")) + f" SELECT a.client, a.y, CAST(a.d AS INT) AS d, {R.format('a.w')} AS first, {R.format('b.w')} AS second FROM m1 a JOIN m2 b USING (client, y, d)")
def materialise_pending(spark, sf):
    _, _, boot = fixed_bootstrap(spark, sf, change_start="difference")
    half = lambda c: F.transform(c, lambda v: v * 0.5).alias(c)
    held = rounds.Clients(boot.state, boot.state.where("client % 2 = 0").select("client", "y", half("c"), half("g")))
    out = None
    for name in ("first", "second"):
        read, held = rounds.materialise(held, boot, consume=True)
        part = read.select("client", "y", F.posexplode("w").alias("d", name)).select("client", "y", "d", r6(name).alias(name))
        out = part if out is None else out.join(part, ["client", "y", "d"])
    return out


_FULL = [*_bootstrap_steps("difference"), _memory("m0", "s0", "s.v + s.dv"), *_predicted("p1", "tr", "m0", "m.client = x.client"), _moves("u1", "p1"),
    "q1 AS (SELECT client, y, r, sum(u * b) AS q FROM u1 JOIN wb USING (d) GROUP BY 1, 2, 3)",
    f"t1 AS (SELECT s.client, s.y, s.r, s.v + CASE WHEN s.r <= 6 THEN {RATE}::DOUBLE ELSE {OWN_RATE}::DOUBLE END * coalesce(q.q, 0) AS v, s.dv + CASE WHEN s.r <= 4 THEN {OWN_RATE}::DOUBLE * coalesce(q.q, 0) ELSE 0 END AS dv FROM s0 s LEFT JOIN q1 q ON q.client = s.client AND q.y = s.y AND q.r = s.r)",
    _memory("n1", "t1", "s.v + s.dv"), *_predicted("e1", "tr", "n1", "m.client = x.client"), "w1 AS (SELECT client, y, count(*) AS wrong FROM e1 WHERE pred <> y GROUP BY 1, 2)"]


@query(_with(*_FULL) + f" SELECT t.client, t.y, CAST(t.r - 1 AS INT) AS d, {R.format('t.v')} AS v, {R.format('t.dv')} AS change, coalesce(w.wrong, 0) AS wrong FROM t1 t LEFT JOIN w1 w USING (client, y)")
def full_space_step(spark, sf):
    samples, s, boot = fixed_bootstrap(spark, sf, change_start="difference")
    upload, state = rounds.full_space_step(samples.where("split = 'train'"), boot.state, boot, s)
    both = upload.join(state.select("client", "y", "d", "p"), ["client", "y"])
    change = F.concat("d", F.array_repeat(F.lit(0.0), len(EXTRA) + len(OWN)))
    each = both.select("client", "y", "wrong", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(7)).alias("d"), F.concat("c", "g", "p").alias("v"), change.alias("change"))).alias("x"))
    return each.select("client", "y", F.col("x.d").alias("d"), r6("x.v").alias("v"), r6("x.change").alias("change"), "wrong")


@query(_with(*_ONCE) + " SELECT f.sample, CAST(f.pred AS INT) AS fused, CAST(s.pred AS INT) AS shared, CAST(p.pred AS INT) AS personal FROM bf f JOIN bs s USING (sample) JOIN bp p USING (sample)")
def raw_vector_branches(spark, sf):
    samples, _, boot = fixed_bootstrap(spark, sf, change_start="difference")
    seen = rounds.raw_branches(samples.where("split = 'test'"), boot.state, boot)
    return seen.select("sample", *[F.col(b).cast("int").alias(b) for b in rounds.BRANCHES])


@query()
def subspace_rounds(spark, sf):
    return rounds.subspace(round_samples(spark, sf), rounds.Settings(**{**_SETTINGS.__dict__, "batch": 16})).history


def _mixed_scores(name: str, rows: str, state: str) -> str:
    """Cosines of every sample and class of its client in both bases: s and p."""
    cos = "round(sum(x.v * m.v) FILTER (WHERE {0}) / (greatest(sqrt(sum(x.v * x.v) FILTER (WHERE {0})), 1e-8) * greatest(sqrt(sum(m.v * m.v) FILTER (WHERE {0})), 1e-8)), 9)"
    return f"{name} AS (SELECT x.client, x.sample, x.y, m.y AS k, {cos.format('m.r <= 6')} AS s, {cos.format('m.r > 6')} AS p FROM {rows} x JOIN {state} m ON m.client = x.client AND m.r = x.d GROUP BY 1, 2, 3, 4)"


def _best(name: str, scores: str, value: str, alphas: str = "") -> str:
    return f"{name} AS (SELECT x.client, x.sample, x.y, x.k AS pred FROM {scores} x {alphas} QUALIFY row_number() OVER (PARTITION BY x.sample ORDER BY round({value}, 9) DESC, x.k) = 1)"


def _mixed_sql(n: int) -> str:
    """Rounds with unit coordinates in Walsh bases and a mixing weight per client, the server's means replacing."""
    part = "r <= 6"
    steps = [
        *_bootstrap_steps("zero"),
        f"a0 AS (SELECT client, y, r, {_unit('t', f'client, y, {part}')} AS v FROM (SELECT client, y, r, sum(w * b) AS t FROM me JOIN wb USING (d) GROUP BY 1, 2, 3))",
        "al0 AS (SELECT DISTINCT client, 0.5::DOUBLE AS a FROM tr)",
        f"zu AS (SELECT client, sample, y, d, {_unit('v', 'sample, d <= 6')} AS v FROM ztr)",
    ]
    out = []
    for i in range(1, n + 1):
        fused = lambda al: ("a.a * x.s + (1 - a.a) * x.p", f"JOIN {al} a USING (client)")
        steps += [
            _mixed_scores(f"c{i}", "zu", f"a{i - 1}"), _best(f"p{i}", f"c{i}", *fused(f"al{i - 1}")), _moves(f"u{i}", f"p{i}", "zu"),
            f"w{i} AS (SELECT a.client, a.y, a.r, a.v AS old, a.v + CASE WHEN a.r <= 6 THEN {RATE}::DOUBLE ELSE {OWN_RATE}::DOUBLE END * coalesce(u.u, 0) AS v, a.client IN (SELECT client FROM p{i} WHERE pred <> y) AS erred FROM a{i - 1} a LEFT JOIN u{i} u ON u.client = a.client AND u.y = a.y AND u.d = a.r)",
            f"t{i} AS (SELECT client, y, r, CASE WHEN erred THEN {_unit('v', f'client, y, {part}')} ELSE old END AS v FROM w{i})",
            _mixed_scores(f"g{i}", "ztr", f"t{i}"),
            f"h{i} AS (SELECT x.client, x.y, x.k, b.i, b.a FROM g{i} x CROSS JOIN (SELECT range AS i, range * 0.25::DOUBLE AS a FROM range(5)) b QUALIFY row_number() OVER (PARTITION BY x.sample, b.i ORDER BY round(b.a * x.s + (1 - b.a) * x.p, 9) DESC, x.k) = 1)",
            f"al{i} AS (SELECT client, a FROM (SELECT client, i, a, avg(CASE WHEN k = y THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM h{i} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY client ORDER BY round(acc, 9) DESC, i) = 1)",
            f"m{i} AS (SELECT y, r, {_unit('c', 'y')} AS v FROM (SELECT y, r, sum(n * v) / sum(n) AS c FROM t{i} JOIN cn USING (client, y) WHERE r <= 6 GROUP BY 1, 2))",
            f"a{i} AS (SELECT t.client, t.y, t.r, CASE WHEN t.r <= 6 THEN m.v ELSE t.v END AS v FROM t{i} t LEFT JOIN m{i} m USING (y, r))",
            _mixed_scores(f"e{i}", "zte", f"a{i}"), _best(f"ef{i}", f"e{i}", *fused(f"al{i}")), _best(f"es{i}", f"e{i}", "x.s"), _best(f"ep{i}", f"e{i}", "x.p"),
        ]
        out += [_macro(i, f"{b}_accuracy", f"e{b[0]}{i}") for b in ("fused", "shared", "personal")] + [f"SELECT {i}, 'mean_alpha', avg(a) FROM al{i}"]
    return _with(*steps) + _report(out)


@query(_mixed_sql(2))
def mixed_rounds_fixed(spark, sf):
    samples = round_samples(spark, sf)
    common, extra, personal = fixed_bases(spark, samples)
    s = rounds.Settings(**{**_SETTINGS.__dict__, "server": "replace"})
    history = rounds.mixed(samples, s, (np.hstack([common, extra]), personal)).history
    return told(history.where("metric LIKE '%accuracy' OR metric = 'mean_alpha'"))


@query()
def mixed_rounds(spark, sf):
    return rounds.mixed(round_samples(spark, sf), rounds.Settings(**{**_SETTINGS.__dict__, "batch": 16, "server": "replace"})).history


@query()
def subspace_bootstrap(spark, sf):
    boot = rounds.bootstrap(round_samples(spark, sf), _SETTINGS)
    return cells(boot.state.select("client", "y", F.concat("c", "g", "p").alias("w")), ["client", "y"], "w")


# --- local steps ---

_DOT = "list_dot_product({}, {})"
_SEQUENTIAL = (
    f"WITH RECURSIVE {M}, k AS (SELECT client, y, row_number() OVER (PARTITION BY client ORDER BY y) AS pos, list(v ORDER BY d) AS w FROM m GROUP BY 1, 2),"
    " st AS (SELECT client, list(w ORDER BY pos) AS w, list(CAST(0 AS BIGINT) ORDER BY pos) AS e FROM k GROUP BY 1),"
    f" o AS (SELECT s.client, row_number() OVER (PARTITION BY s.client ORDER BY {rng.sql_digest(SEED, '0', '0', 's.sample')}, s.sample) AS i, k.pos, s.x FROM s JOIN k USING (client, y)),"
    " t(client, i, w, e, x, pos, p) AS (SELECT client, CAST(0 AS BIGINT), w, e, CAST(NULL AS DOUBLE[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM st UNION ALL"
    " SELECT q.client, q.i, list_transform(range(1, len(q.w) + 1), lambda j: CASE WHEN q.p <> q.pos AND j = q.pos THEN list_transform(range(1, 65), lambda a: q.w[j][a] + 0.5::DOUBLE * q.x[a]) WHEN q.p <> q.pos AND j = q.p THEN list_transform(range(1, 65), lambda a: q.w[j][a] - 0.5::DOUBLE * q.x[a]) ELSE q.w[j] END),"
    " list_transform(range(1, len(q.e) + 1), lambda j: q.e[j] + CASE WHEN q.p <> q.pos AND j = q.pos THEN 1 ELSE 0 END), q.x, q.pos, q.p FROM"
    " (SELECT t.client, o.i, t.w, t.e, o.x, o.pos, list_position(list_transform(t.w, lambda c: round(list_dot_product(o.x, c) / (greatest(sqrt(list_dot_product(o.x, o.x)), 1e-8) * greatest(sqrt(list_dot_product(c, c)), 1e-8)), 9)), list_max(list_transform(t.w, lambda c: round(list_dot_product(o.x, c) / (greatest(sqrt(list_dot_product(o.x, o.x)), 1e-8) * greatest(sqrt(list_dot_product(c, c)), 1e-8)), 9)))) AS p FROM t JOIN o ON o.client = t.client AND o.i = t.i + 1) q),"
    " f AS (SELECT client, w, e FROM t QUALIFY row_number() OVER (PARTITION BY client ORDER BY i DESC) = 1)"
)


def _sequential(spark, sf) -> DataFrame:
    """One pass of row-by-row updates: a batch of one."""
    s = vectors(spark, sf)
    state = pr.class_means(s, ["client", "y"]).withColumn("delta", F.transform("w", lambda a: a * 0.0))
    return training.local(s.withColumnRenamed("x", "h"), state, "client", training.Memory(0.5, renormalise=None), batch=1, seed=SEED)


@query(_SEQUENTIAL + f", c AS (SELECT k.client, k.y, f.w[k.pos] AS w FROM f JOIN k USING (client)) SELECT client, y, CAST(unnest(range(64)) AS INT) AS d, {R.format('unnest(w)')} AS v FROM c")
def samplewise_update(spark, sf):
    return cells(_sequential(spark, sf), ["client", "y"], "w")


@query(_SEQUENTIAL + ", n AS (SELECT client, y, count(*) AS n FROM s GROUP BY 1, 2) SELECT k.client, k.y, f.e[k.pos] AS errors, n.n, round(sqrt(list_sum(list_transform(range(1, 65), lambda a: (f.w[k.pos][a] - k.w[a]) ** 2))), 6) + 0.0 AS change FROM f JOIN k USING (client) JOIN n USING (client, y)")
def samplewise_change(spark, sf):
    n = vectors(spark, sf).groupBy("client", "y").agg(F.count("*").alias("n"))
    return _sequential(spark, sf).join(n, ["client", "y"]).select("client", "y", "errors", "n", r6(v.norm("delta")).alias("change"))


_MASKED = (
    "c AS (SELECT client, y, d, avg(v) AS w FROM l GROUP BY 1, 2, 3),"
    " j AS (SELECT x.client, x.sample, x.y, m.y AS k, " + _COS + " AS s FROM l x JOIN c m ON m.client = x.client AND m.d = x.d GROUP BY 1, 2, 3, 4),"
    " b AS (SELECT client, sample, y, k AS pred FROM j QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, k) = 1), " + _moves("u", "b", "l")
)


@query(f"WITH {S}, l AS (SELECT sample, client, y, CAST(unnest(range(64)) AS INT) AS d, unnest(x) AS v FROM s), {_MASKED}, n AS (SELECT c.client, c.y, c.d, c.w + CASE WHEN c.d % 2 = 0 THEN 0.5::DOUBLE * coalesce(u.u, 0) ELSE 0 END AS w FROM c LEFT JOIN u USING (client, y, d)) SELECT client, y, d, round(CASE WHEN d % 2 = 0 THEN w / (sqrt(sum(w * w) FILTER (WHERE d % 2 = 0) OVER (PARTITION BY client, y)) + 1e-8) ELSE w END, 6) + 0.0 AS v FROM n")
def masked_update(spark, sf):
    s = vectors(spark, sf)
    state = pr.class_means(s, ["client", "y"]).withColumn("delta", F.transform("w", lambda a: a * 0.0))
    mask = (np.arange(64) % 2 == 0).astype(float)
    return cells(training.local(s.withColumnRenamed("x", "h"), state, "client", training.Memory(0.5, mask=mask)), ["client", "y"], "w")


_BASIS64 = "wb AS (SELECT CAST(r.range AS INT) AS r, CAST(d.range AS INT) AS d, CASE WHEN bit_count(CAST(r.range AS INT) & CAST(d.range AS INT)) % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END AS b FROM range(6) r, range(64) d)"


@query(f"WITH {S}, l AS (SELECT sample, client, y, CAST(unnest(range(64)) AS INT) AS d, unnest(x) AS v FROM s), {_BASIS64}, {_MASKED}, q AS (SELECT client, y, r, sum(u * b) AS q FROM u JOIN wb USING (d) GROUP BY 1, 2, 3), o AS (SELECT client, y, wb.d, sum(q * b) AS u FROM q JOIN wb USING (r) GROUP BY 1, 2, 3), n AS (SELECT c.client, c.y, c.d, c.w + 0.5::DOUBLE * coalesce(o.u, 0) AS w FROM c LEFT JOIN o USING (client, y, d)) SELECT client, y, d, round({_unit('w', 'client, y')}, 6) + 0.0 AS v FROM n")
def projected_update(spark, sf):
    s = vectors(spark, sf)
    state = pr.class_means(s, ["client", "y"]).withColumn("delta", F.transform("w", lambda a: a * 0.0))
    basis = np.array([[(-1.0) ** bin(r & d).count("1") / 8.0 for d in range(64)] for r in range(6)])
    return cells(training.local(s.withColumnRenamed("x", "h"), state, "client", training.Memory(0.5, basis=basis)), ["client", "y"], "w")


@query(f"WITH {S}, l AS (SELECT sample, client, y, CAST(unnest(range(64)) AS INT) AS d, unnest(x) AS v FROM s), {_MASKED} SELECT client, k.y, u.d, round(coalesce(u.u, 0), 6) + 0.0 AS v FROM u JOIN (SELECT DISTINCT y FROM s) k USING (y)")
def push_pull_onehot(spark, sf):
    s = vectors(spark, sf)
    rows = pr.predict(s, pr.class_means(s, ["client", "y"]), ["client"])
    u = pr.push_pull_matmul(rows, ["client"], 10)
    plain = pr.push_pull(rows, ["client"]).select("client", "y")  # classes that no wrong row touches are zero in the product
    return cells(u.join(plain, ["client", "y"], "left_semi"), ["client", "y"], "u")
