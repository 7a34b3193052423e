"""Queries of the analytics engine over the given tables, and their SQL.

Clients are made from the tables: vectors by vec_id modulo 8, line items by
supplier, events by user.  Each query applies the library's operators; its SQL is
written apart from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.functions import rng
from vectorloom.functions import vectors as v
from vectorloom.operators import bases, encoders, prep, slices
from vectorloom.operators import prototypes as pr
from vectorloom.plans import reports, storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIMS, SEED = 32, 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from vectorloom import round_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as samples: sample, client, y, x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 8).cast("int").alias("client"), F.col("label").alias("y"), v.doubles("embedding").alias("x"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples: key, client, y (0 A, 1 N, 2 R), x of four features."""
    x = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.col("l_suppkey").alias("client"), y.alias("y"), x.alias("x"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as series: user, event, seconds, type, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("event"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"), F.col("event_type").alias("kind"), "value")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_train_test(vectors(spark, sf_dir), ["client", "y"], "sample", 0.3, SEED)


def weights(spark: SparkSession, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return encoders.weights(encoders.projection(spark, 64, dims, seed))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def cells(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Arrays as rounded rows (keys, d, v)."""
    return v.long_form(df, keys, x).select(*keys, F.col("d"), r6("v").alias("v"))


# SQL fragments: samples, their cells, class means.
S = "s AS (SELECT vec_id AS sample, CAST(vec_id % 8 AS INT) AS client, label AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
L = S + ", l AS (SELECT sample, client, y, CAST(unnest(range(64)) AS INT) AS d, unnest(x) AS v FROM s)"
I = "i AS (SELECT l_orderkey * 10 + l_linenumber AS sample, l_suppkey AS client, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, [l_quantity, l_extendedprice, l_discount, l_tax] AS x FROM lineitem)"  # noqa: E741
IL = I + ", il AS (SELECT sample, client, y, CAST(unnest(range(4)) AS INT) AS d, unnest(x) AS v FROM i)"
E = "e AS (SELECT user_id AS \"user\", event_id AS event, epoch_us(ts) / 1e6::DOUBLE AS sec, event_type AS kind, value FROM events)"
SPLIT = (
    S
    + f", r AS (SELECT *, row_number() OVER (PARTITION BY client, y ORDER BY {rng.sql_digest(SEED, 'sample')}, sample) AS rk, count(*) OVER (PARTITION BY client, y) AS n FROM s)"
    + ", t AS (SELECT sample, client, y, x, CASE WHEN n > 1 AND rk <= greatest(least(round_even(n * 0.3::DOUBLE, 0), n - 1), 1) THEN 'test' ELSE 'train' END AS split FROM r)"
)
W = f"p AS (SELECT f.f, d.d, {rng.sql_normal(SEED, 'f.f', 'd.d')} AS w FROM range(64) f(f), range({DIMS}) d(d))"
#: Encoded samples h(sample, client, y, split, d, v).
H = (
    SPLIT
    + ", tl AS (SELECT sample, client, y, split, unnest(range(64)) AS f, unnest(x) AS v FROM t), "
    + W
    + ", z AS (SELECT sample, client, y, split, p.d, cos(sum(tl.v * p.w)) AS c FROM tl JOIN p USING (f) GROUP BY ALL)"
    + ", h AS (SELECT sample, client, y, split, CAST(d AS INT) AS d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM z)"
)
R = "round({}, 6) + 0.0"


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoders.encode_cosine(split(spark, sf_dir), weights(spark))


# --- sources, filters, row transforms ---


@query(f"WITH {S} SELECT sample, client, y, CAST(len(x) AS INT) AS dims, round(sqrt(list_sum(list_transform(x, lambda a: a * a))), 6) + 0.0 AS norm FROM s")
def samples_scan(spark, sf):
    return vectors(spark, sf).select("sample", "client", "y", F.size("x").alias("dims"), r6(v.norm("x")).alias("norm"))


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, coalesce(try_cast(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT), -1) AS number FROM pages")
def pages_name_parse(spark, sf):
    url = F.col("url")
    number = F.regexp_extract(url, r"([0-9]+)[^0-9]*$", 1)
    return table(spark, sf, "pages").select("page_id", F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.coalesce(number.try_cast("bigint"), F.lit(-1)).alias("number"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, round(value, 6) + 0.0 AS value FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) IS NOT NULL")
def try_cast_filter(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", k.alias("k"), r6("value").alias("value")).where("k IS NOT NULL")


@query(r"SELECT doc_id, trim(w[1], ',. ') AS head, trim(w[len(w)], ',. ') AS label, CAST(len(w) AS INT) AS fields FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents) WHERE len(w) >= 2")
def csv_parse_trim(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("w"))
    cut = lambda c: F.btrim(c, F.lit(",. "))
    return w.where(F.size("w") >= 2).select("doc_id", cut(F.col("w")[0]).alias("head"), cut(F.element_at("w", -1)).alias("label"), F.size("w").alias("fields"))


@query(f"WITH {I} SELECT client, y - 1 + 12 AS y, count(*) AS n, round(sum(x[1]), 4) + 0.0 AS quantity FROM i WHERE y <> 0 GROUP BY 1, 2")
def null_class_filter(spark, sf):
    return prep.drop_null_class(items(spark, sf), offset=12).groupBy("client", "y").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("x")[0]), 4) + 0.0).alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, round(list_sum([l_quantity, l_discount] || [l_tax]), 6) + 0.0 AS total FROM lineitem")
def column_prune_concat(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.array("l_quantity", "l_discount"), F.array("l_tax")).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", r6(F.aggregate("x", F.lit(0.0), lambda a, b: a + b)).alias("total"))


@query(f"WITH {I}, n AS (SELECT sample, CAST(unnest(range(4)) AS INT) AS d, unnest(x) AS v, sqrt(list_sum(list_transform(x, lambda a: a * a))) AS n FROM i) SELECT sample, d, round(v / CASE WHEN n < 1e-12 THEN 1 ELSE n END, 6) + 0.0 AS v FROM n")
def l2_normalize(spark, sf):
    return cells(prep.l2_normalise(items(spark, sf)), ["sample"], "x")


@query(f"WITH {IL}, m AS (SELECT *, sample % 10 < 7 AS tr FROM il), q AS (SELECT client, d, avg(v) AS m, greatest(stddev_pop(v), 0.3) AS s FROM m WHERE tr GROUP BY 1, 2) SELECT sample, d, round((v - q.m) / q.s, 5) + 0.0 AS v FROM m JOIN q USING (client, d)")
def standardize_floor(spark, sf):
    done = prep.standardise(items(spark, sf), ["client"], F.col("sample") % 10 < 7)
    return v.long_form(done, ["sample"], "x").select("sample", "d", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {IL}, m AS (SELECT client, sample, d, CASE WHEN (sample + d) % 5 = 0 THEN NULL ELSE v END AS v FROM il), a AS (SELECT client, d, coalesce(avg(v), 0) AS m FROM m GROUP BY 1, 2) SELECT sample, d, round(coalesce(v, a.m), 5) + 0.0 AS v FROM m JOIN a USING (client, d)")
def nan_impute(spark, sf):
    holes = items(spark, sf).withColumn("x", F.array(*[F.when((F.col("sample") + i) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("x")[i]) for i in range(4)]))
    return v.long_form(prep.impute_mean(holes, ["client"]), ["sample"], "x").select("sample", "d", (F.round("v", 5) + 0.0).alias("v"))


@query(f"WITH {L} SELECT sample, CAST(count(*) FILTER (WHERE v < 0) AS BIGINT) AS negative, CAST(sum(CASE WHEN v < 0 THEN -1 ELSE 1 END) AS DOUBLE) AS total FROM l GROUP BY 1")
def hardsign(spark, sf):
    signs = v.hardsign("x")
    return vectors(spark, sf).select("sample", F.size(F.filter(signs, lambda s: s < 0)).cast("bigint").alias("negative"), F.aggregate(signs, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query(f"WITH {L} SELECT sample, d, round(CASE WHEN d % 4 = 1 THEN v / (sqrt(sum(CASE WHEN d % 4 = 1 THEN v * v END) OVER (PARTITION BY sample)) + 1e-8) ELSE v END, 6) + 0.0 AS v FROM l")
def masked_normalize(spark, sf):
    return cells(vectors(spark, sf).withColumn("x", v.normalise_masked("x", list(range(1, 64, 4)))), ["sample"], "x")


@query(f"WITH {L}, n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY sample)) AS n FROM l) SELECT sample, d, round(v / (n + 1e-8), 6) + 0.0 AS plus, round(v / greatest(n, 1e-8), 6) + 0.0 AS clamp, round(v / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0 AS safe FROM n")
def normalize_modes(spark, sf):
    rows = vectors(spark, sf).select("sample", F.posexplode(F.arrays_zip(*[v.normalise("x", m).alias(m) for m in ("plus", "clamp", "safe")])).alias("d", "t"))
    return rows.select("sample", "d", *[r6(f"t.{m}").alias(m) for m in ("plus", "clamp", "safe")])


@query("WITH k AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS y FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderkey, y FROM orders JOIN k USING (o_orderpriority)")
def label_compact(spark, sf):
    return prep.compact_labels(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "y").select("o_orderkey", "y")


@query("WITH k AS (SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS INT) AS y FROM events GROUP BY 1) SELECT event_id, y FROM events JOIN k USING (event_type)")
def label_first_seen(spark, sf):
    return prep.first_seen_labels(table(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_type", "y").select("event_id", "y")


@query(f"WITH {I}, g AS (SELECT client FROM i WHERE y < 2 GROUP BY 1 HAVING count(*) >= 300 AND count(DISTINCT y) >= 2) SELECT client, count(*) AS n FROM i WHERE y < 2 AND client IN (SELECT client FROM g) GROUP BY 1")
def client_having(spark, sf):
    return prep.valid_clients(items(spark, sf).where("y < 2"), 300).groupBy("client").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT sample, list_sum(list_transform(x[1:8] || x[57:64], lambda a: CASE WHEN a > 0 THEN 1 ELSE 0 END))::BIGINT AS up FROM s WHERE y IN (1, 3, 4)")
def class_mask_take(spark, sf):
    part = F.concat(F.slice("x", 1, 8), F.slice("x", 57, 8))
    return vectors(spark, sf).where("y IN (1, 3, 4)").select("sample", F.size(F.filter(part, lambda a: a > 0)).cast("bigint").alias("up"))


# --- joins and sets ---


@query("SELECT c_custkey AS \"user\", count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def user_inner(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy(F.col("c_custkey").alias("user")).agg(F.count("*").alias("orders"))


@query("SELECT a.user_id AS \"user\", a.k AS hour, a.n AS clicks, b.n AS views FROM (SELECT user_id, hour(ts) AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2) a JOIN (SELECT user_id, hour(ts) AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2) b USING (user_id, k)")
def composite_join(spark, sf):
    e = table(spark, sf, "events").withColumn("hour", F.hour(F.col("ts").cast("timestamp")).cast("bigint"))
    per = lambda t, n: e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("user"), "hour").agg(F.count("*").alias(n))
    return per("click", "clicks").join(per("view", "views"), ["user", "hour"])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_docs, l.doc_id IS NOT NULL AS in_labels FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l USING (doc_id)")
def user_outer(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.lit(True).alias("a"))
    l = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("b"))  # noqa: E741
    return d.join(l, "doc_id", "full_outer").select("doc_id", F.coalesce("a", F.lit(False)).alias("in_docs"), F.coalesce("b", F.lit(False)).alias("in_labels"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def user_semi(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, o_orderkey FROM orders), b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_partkey FROM part) SELECT r, o_orderkey, p_partkey FROM a JOIN b USING (r)")
def ordinal_join(spark, sf):
    from vectorloom.operators.relational import zip_rows

    return zip_rows(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "part").select("p_partkey"), "o_orderkey", "p_partkey", "r")





@query(
    f"WITH {E}, k AS (SELECT * FROM e WHERE kind = 'click'), w AS (SELECT \"user\", sec, min(value) AS value FROM e WHERE kind = 'view' GROUP BY 1, 2),"
    ' b AS (SELECT k.event, k.sec, w.sec AS t, w.value AS v FROM k ASOF LEFT JOIN w ON k."user" = w."user" AND k.sec >= w.sec),'
    ' f AS (SELECT k.event, w.sec AS t, w.value AS v FROM k ASOF LEFT JOIN w ON k."user" = w."user" AND k.sec <= w.sec)'
    " SELECT event, round(CASE WHEN b.v IS NULL THEN f.v WHEN f.v IS NULL OR b.t = f.t THEN b.v ELSE b.v + (b.sec - b.t) / (f.t - b.t) * (f.v - b.v) END, 5) + 0.0 AS value FROM b JOIN f USING (event)"
)
def asof_interp(spark, sf):
    e = events(spark, sf)
    out = prep.interpolate(e.where("kind = 'click'").select("user", "event", "sec"), e.where("kind = 'view'").select("user", "sec", "value"), "user", "sec", "value")
    return out.select("event", (F.round("interpolated", 5) + 0.0).alias("value"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return storage.remaining(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT c_custkey, coalesce(n, 0) AS n, round(coalesce(total, c_acctbal), 2) + 0.0 AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def state_left_join(spark, sf):
    pending = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return table(spark, sf, "customer").join(pending, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), (F.round(F.coalesce("total", "c_acctbal"), 2) + 0.0).alias("state"))


@query("SELECT doc_id, coalesce(toxic, quality, -1) AS value, CASE WHEN toxic IS NOT NULL THEN 'toxic' WHEN quality IS NOT NULL THEN 'quality' ELSE 'none' END AS found FROM documents LEFT JOIN (SELECT doc_id, nullif(toxic, 0) AS toxic, quality FROM labels) USING (doc_id)")
def metric_coalesce(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("m", F.create_map(F.lit("toxic"), F.nullif("toxic", F.lit(0)), F.lit("quality"), F.col("quality")))
    value, found = reports.first_metric("m", ["toxic", "quality"])
    return rows.select("doc_id", F.coalesce(value, F.lit(-1)).alias("value"), F.coalesce(found, F.lit("none")).alias("found"))


@query(f"WITH {L}, m AS (SELECT client, y, d, avg(v) AS v FROM l GROUP BY ALL), n AS (SELECT client, y, sqrt(sum(v * v)) AS n FROM m GROUP BY ALL) SELECT a.client AS i, b.client AS j, y, round(sum(a.v * b.v) / (greatest(any_value(p.n), 1e-8) * greatest(any_value(q.n), 1e-8)), 6) + 0.0 AS overlap FROM m a JOIN m b USING (y, d) JOIN n p ON p.client = a.client AND p.y = y JOIN n q ON q.client = b.client AND q.y = y WHERE a.client < b.client GROUP BY 1, 2, 3")
def client_pair_overlap(spark, sf):
    m = pr.class_means(vectors(spark, sf), ["client", "y"])
    a, b = m.select(F.col("client").alias("i"), "y", F.col("w").alias("a")), m.select(F.col("client").alias("j"), "y", F.col("w").alias("b"))
    return a.join(b, "y").where("i < j").select("i", "j", "y", r6(v.cosine("a", "b")).alias("overlap"))


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def union_all(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).unionAll(table(spark, sf, "customer").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k")).intersect(table(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf, "customer").select("c_nationkey")).distinct()


@query("SELECT count(*) = 0 AS covered, count(*) AS missing FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang <> 'de')")
def superset_test(spark, sf):
    gone = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").where("lang != 'de'"), "doc_id", "left_anti").distinct()
    return gone.agg((F.count("*") == 0).alias("covered"), F.count("*").alias("missing"))


@query("WITH n AS (SELECT doc_id FROM documents WHERE lang = 'fr') SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (FROM n) UNION ALL SELECT doc_id, 1 - quality, toxic FROM labels WHERE doc_id IN (FROM n) UNION ALL SELECT doc_id, 9, 9 FROM n WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert(spark, sf):
    old = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").where("lang = 'fr'").select("doc_id")
    new = docs.join(old, "doc_id", "left").select("doc_id", F.coalesce(1 - F.col("quality"), F.lit(9)).alias("quality"), F.coalesce("toxic", F.lit(9)).alias("toxic"))
    return storage.upsert(old, new, ["doc_id"])


# --- aggregates ---

M = L + ", m AS (SELECT client, y, d, avg(v) AS v, sum(v) AS sv, count(*) AS n FROM l GROUP BY ALL)"


@query(f"WITH {M} SELECT client, y, d, {R.format('v')} AS v FROM m")
def class_mean(spark, sf):
    return cells(pr.class_means(vectors(spark, sf), ["client", "y"]), ["client", "y"], "w")


@query(f"WITH {M} SELECT client, y, d, {R.format('sv')} AS v FROM m")
def class_sum(spark, sf):
    return cells(pr.class_sums(vectors(spark, sf), ["client", "y"]), ["client", "y"], "w")


@query(f"WITH {M} SELECT client, y, d, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY client, y)), 1e-8), 6) + 0.0 AS v FROM m")
def class_mean_normalized(spark, sf):
    return cells(pr.class_means(vectors(spark, sf), ["client", "y"], mode="clamp"), ["client", "y"], "w")


@query(f"WITH {S} SELECT c.client, k.y, count(s.sample) AS n FROM (SELECT DISTINCT client FROM s) c CROSS JOIN (SELECT DISTINCT y FROM s) k LEFT JOIN s ON s.client = c.client AND s.y = k.y AND s.x[1] > 0.2 GROUP BY 1, 2")
def class_hist(spark, sf):
    s = vectors(spark, sf)
    return pr.class_counts(s.where("x[0] > 0.2"), s.select("client").distinct(), s.select("y").distinct())


_WRONG = "u AS (SELECT client, y, d, v FROM l WHERE sample % 3 <> 0), q AS (SELECT client, CAST((y + sample) % 10 AS INT) AS pred, y, d, v FROM l), w AS (SELECT client, y AS k, d, v FROM q WHERE pred <> y UNION ALL SELECT client, pred, d, -v FROM q WHERE pred <> y)"


@query(f"WITH {L}, {_WRONG} SELECT client, k AS y, d, {R.format('sum(v)')} AS v FROM w GROUP BY 1, 2, 3")
def push_pull(spark, sf):
    rows = vectors(spark, sf).withColumn("pred", ((F.col("y") + F.col("sample")) % 10).cast("int"))
    return cells(pr.push_pull(rows, ["client"]), ["client", "y"], "u")


@query(f"WITH {M} SELECT y, d, {R.format('sum(n * v) / sum(n)')} AS v FROM m GROUP BY 1, 2")
def weighted_consensus(spark, sf):
    s = vectors(spark, sf)
    state = pr.class_means(s, ["client", "y"]).join(s.groupBy("client", "y").agg(F.count("*").alias("n")), ["client", "y"])
    return cells(pr.consensus(state, "y", "w"), ["y"], "w")


@query(f"WITH {M}, a AS (SELECT y, d, sum(n * v) / sum(n) AS v FROM m GROUP BY 1, 2) SELECT y, d, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY y)), 1e-8), 6) + 0.0 AS v FROM a")
def weighted_consensus_normalized(spark, sf):
    s = vectors(spark, sf)
    state = pr.class_means(s, ["client", "y"]).join(s.groupBy("client", "y").agg(F.count("*").alias("n")), ["client", "y"])
    return cells(pr.consensus(state, "y", "w", mode="clamp"), ["y"], "w")


@query(f"WITH {M}, c AS (SELECT client, count(*) AS t FROM s GROUP BY 1), a AS (SELECT y, d, sum(t * v) / sum(t) AS v FROM m JOIN c USING (client) GROUP BY 1, 2) SELECT y, d, round(v / CASE WHEN sum(v * v) OVER (PARTITION BY y) = 0 THEN 1 ELSE sqrt(sum(v * v) OVER (PARTITION BY y)) END, 6) + 0.0 AS v FROM a")
def sample_weighted_model(spark, sf):
    s = vectors(spark, sf)
    models = pr.class_means(s, ["client", "y"]).join(s.groupBy("client").agg(F.count("*").alias("t")), "client")
    return cells(pr.consensus(models, "y", "w", "t", "safe"), ["y"], "w")


@query(f"WITH {M}, b AS (SELECT client, y, d, sv / (sqrt(sum(sv * sv) OVER (PARTITION BY client, y)) + 1e-8) AS v FROM m), a AS (SELECT y, d, sum(v) AS v FROM b GROUP BY 1, 2) SELECT y, d, round(v / (sqrt(sum(v * v) OVER (PARTITION BY y)) + 1e-8), 6) + 0.0 AS v FROM a")
def memory_sum(spark, sf):
    return cells(pr.memory_sum(pr.class_sums(vectors(spark, sf), ["client", "y"], mode="plus")), ["y"], "w")


@query(f"WITH {L}, {_WRONG}, x AS (SELECT client, k, d, sum(v) * 0.035::DOUBLE AS v FROM w GROUP BY 1, 2, 3) SELECT k AS y, d, {R.format('sum(v)')} AS v FROM x GROUP BY 1, 2")
def delta_sum(spark, sf):
    rows = vectors(spark, sf).withColumn("pred", ((F.col("y") + F.col("sample")) % 10).cast("int"))
    moved = pr.push_pull(rows, ["client"]).withColumn("w", v.scale("u", F.lit(0.035)))
    return cells(pr.memory_sum(moved, mode=None), ["y"], "w")


@query(f"WITH {E} SELECT kind, round(quantile_cont(value, 0.25), 6) + 0.0 AS q1, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.75), 6) + 0.0 AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr FROM e GROUP BY 1")
def quartile_summary(spark, sf):
    return reports.quartiles(events(spark, sf), ["kind"], "value").select("kind", *[r6(c).alias(c) for c in ("q1", "median", "q3", "iqr")])


@query(f"WITH {I} SELECT client, round(avg(x[1]), 6) + 0.0 AS mean, round(stddev_pop(x[1]), 6) + 0.0 AS std FROM i GROUP BY 1")
def mean_std(spark, sf):
    return reports.mean_std(items(spark, sf).withColumn("value", F.col("x")[0]), ["client"], "value").select("client", r6("mean").alias("mean"), r6("std").alias("std"))


@query("WITH g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE AS e FROM lineitem GROUP BY 1), b AS (SELECT CAST(least(floor(greatest(least(e, 1), 0) * 10), 9) AS INT) AS bin, count(*) AS n FROM g GROUP BY 1) SELECT r.bin, round(coalesce(n, 0) / (SELECT sum(n) FROM b), 6) + 0.0 AS share, round(r.bin / 10.0::DOUBLE, 1) AS edge FROM (SELECT CAST(range AS INT) AS bin FROM range(10)) r LEFT JOIN b USING (bin)")
def gate_histogram(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("e"))
    return reports.histogram(g, "e").select("bin", r6("share").alias("share"), F.round("edge", 1).alias("edge"))


@query("WITH g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE AS e FROM lineitem GROUP BY 1) SELECT round(avg(CASE WHEN e >= 0.25::DOUBLE - 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS share, round(avg(e), 6) + 0.0 AS mean, round(stddev_pop(e), 6) + 0.0 AS std FROM g")
def gate_floor_fraction(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("e"))
    return g.agg(r6(reports.floor_share("e", 0.25)).alias("share"), r6(F.avg("e")).alias("mean"), r6(F.stddev_pop("e")).alias("std"))


@query(f"WITH {L} SELECT a.d AS i, b.d AS j, {R.format('sum(a.v * b.v)')} AS g FROM l a JOIN l b USING (sample) GROUP BY 1, 2")
def gram_matrix(spark, sf):
    return bases.gram(vectors(spark, sf), "x").select("i", F.posexplode("g").alias("j", "g")).select("i", "j", r6("g").alias("g"))


@query(f"WITH {E}, d AS (SELECT \"user\", sec - lag(sec) OVER (PARTITION BY \"user\" ORDER BY sec, event) AS dt FROM e) SELECT \"user\", round(quantile_cont(dt, 0.5), 3) + 0.0 AS median FROM d WHERE dt > 0 GROUP BY 1")
def median_dt(spark, sf):
    steps = slices.lagged(events(spark, sf).select("user", "event", "sec"), ["user"], ["sec", "event"], F.col("sec"), "before", "place").withColumn("dt", F.col("sec") - F.col("before"))
    return slices.quantiles(steps.where("dt > 0"), ["user"], "dt", [0.5]).select("user", (F.round(F.col("q")[0], 3) + 0.0).alias("median"))


@query(f"WITH {L} SELECT d, {R.format('avg(v)')} AS mean, {R.format('stddev_pop(v)')} AS std, {R.format('avg(v) FILTER (WHERE v > 0)')} AS up FROM l GROUP BY 1")
def column_stats(spark, sf):
    return v.long_form(vectors(spark, sf), ["sample"], "x").groupBy("d").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.avg(F.when(F.col("v") > 0, F.col("v")))).alias("up"))


@query(f"WITH {S} SELECT client, CAST(sum(len(x)) * 4 AS BIGINT) AS bytes FROM (SELECT DISTINCT client, y, x FROM s) GROUP BY 1")
def payload_bytes(spark, sf):
    return vectors(spark, sf).select("client", "y", "x").distinct().groupBy("client").agg(reports.payload_bytes("x").alias("bytes"))


@query("SELECT event_id, round(value / count(*) OVER (PARTITION BY event_type), 9) + 0.0 AS ms FROM events")
def amortized_ms(spark, sf):
    return reports.amortise(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", ["event_type"], "ms").select("event_id", (F.round("ms", 9) + 0.0).alias("ms"))


@query(f"WITH {S}, g AS (SELECT client, avg(CASE WHEN (y + sample) % 10 = y THEN 1.0::DOUBLE ELSE 0 END) AS a FROM s GROUP BY 1) SELECT client, a <= 1.1::DOUBLE / 10 AS collapsed, round(a, 6) + 0.0 AS accuracy FROM g")
def collapse_flag(spark, sf):
    rows = vectors(spark, sf).withColumn("ok", ((F.col("y") + F.col("sample")) % 10 == F.col("y")).cast("double")).groupBy("client").agg(F.avg("ok").alias("a"))
    return rows.select("client", reports.collapsed(F.col("a"), 10, 1.1).alias("collapsed"), r6("a").alias("accuracy"))


_METRICS = "m AS (SELECT l_linestatus AS method, l_linenumber AS round, l_suppkey % 3 AS seed, avg(l_discount) AS value, l_returnflag AS dataset FROM lineitem GROUP BY ALL)"


@query(f"WITH {_METRICS} SELECT method, " + ", ".join(f"round(avg(value) FILTER (WHERE round = {r}), 6) + 0.0 AS round_{r}" for r in range(1, 5)) + " FROM m GROUP BY 1")
def round_summary_pivot(spark, sf):
    return reports.pivot_rounds(_metric_rows(spark, sf), [1, 2, 3, 4]).select("method", *[r6(f"round_{r}").alias(f"round_{r}") for r in range(1, 5)])


def _metric_rows(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("round"), (F.col("l_suppkey") % 3).alias("seed"), F.col("l_returnflag").alias("dataset"))
    return rows.agg(F.avg("l_discount").alias("value"))


@query(f"WITH {_METRICS} SELECT method, round, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, count(*) AS n FROM m GROUP BY 1, 2")
def method_round_summary(spark, sf):
    return reports.mean_std(_metric_rows(spark, sf), ["method", "round"], "value").select("method", "round", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(f"WITH {_METRICS}, f AS (SELECT method, dataset, avg(value) AS a FROM m WHERE round = 7 GROUP BY 1, 2) SELECT method, round(avg(a) * 100, 6) + 0.0 AS mean, count(*) AS datasets, count(*) = (SELECT count(DISTINCT dataset) FROM m) AS complete FROM f GROUP BY 1")
def suite_mean(spark, sf):
    return reports.suite_mean(_metric_rows(spark, sf), 7).select("method", r6("mean").alias("mean"), "datasets", "complete")


@query(f"WITH {M}, b AS (SELECT client, CASE WHEN d < 24 THEN 'common' WHEN d < 32 THEN 'global' ELSE 'personal' END AS branch, sum(v * v) AS e FROM m GROUP BY 1, 2) SELECT client, branch, round(sqrt(e) / sum(sqrt(e)) OVER (PARTITION BY client), 6) + 0.0 AS share FROM b")
def branch_energy(spark, sf):
    m = v.long_form(pr.class_means(vectors(spark, sf), ["client", "y"]), ["client"], "w")
    branch = F.when(F.col("d") < 24, "common").when(F.col("d") < 32, "global").otherwise("personal")
    return reports.energy_shares(m.withColumn("branch", branch), ["client"], "branch", "v").select("client", "branch", r6("share").alias("share"))


@query(f"WITH {M}, e AS (SELECT client, d, sum(v * v) AS e FROM m GROUP BY 1, 2), p AS (SELECT client, e / sum(e) OVER (PARTITION BY client) AS p FROM e) SELECT client, round(-sum(p * ln(greatest(p, 1e-12))), 6) + 0.0 AS entropy FROM p GROUP BY 1")
def coord_entropy(spark, sf):
    m = v.long_form(pr.class_means(vectors(spark, sf), ["client", "y"]), ["client"], "w")
    return reports.entropy(m.groupBy("client", "d").agg(F.sum(F.col("v") * F.col("v")).alias("e")), ["client"], "e").select("client", r6("entropy").alias("entropy"))


@query(f"WITH {M} SELECT client, round(avg(sqrt(n)), 6) + 0.0 AS mean_norm FROM (SELECT client, y, sum(v * v) AS n FROM m GROUP BY 1, 2) GROUP BY 1")
def norm_diagnostics(spark, sf):
    return pr.class_means(vectors(spark, sf), ["client", "y"]).groupBy("client").agg(r6(F.avg(v.norm("w"))).alias("mean_norm"))


@query(f"WITH {M}, a AS (SELECT y, d, sum(n * v) / sum(n) AS v FROM m GROUP BY 1, 2) SELECT client, round(avg(dist), 6) + 0.0 AS before, round(avg(dist) * (1 - 0.035::DOUBLE * 0.5), 6) + 0.0 AS later FROM (SELECT client, m.y, sqrt(sum((m.v - a.v) * (m.v - a.v))) AS dist FROM m JOIN a USING (y, d) GROUP BY 1, 2) GROUP BY 1")
def sync_metrics(spark, sf):
    s = vectors(spark, sf)
    m = pr.class_means(s, ["client", "y"]).join(s.groupBy("client", "y").agg(F.count("*").alias("n")), ["client", "y"])
    common = pr.consensus(m, "y", "w").withColumnRenamed("w", "cc")
    merged = m.join(F.broadcast(common), "y").withColumn("w2", pr.gated_merge("w", "cc", 0.035, F.lit(0.5)))
    away = lambda a: v.norm(F.zip_with(a, "cc", lambda p, q: p - q))
    return merged.groupBy("client").agg(r6(F.avg(away("w"))).alias("before"), r6(F.avg(away("w2"))).alias("later"))


# --- windows and order ---


_WIN = f"WITH {E}, k AS (SELECT *, CASE kind WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS y, row_number() OVER (PARTITION BY \"user\" ORDER BY sec, event) - 1 AS pos FROM e), w AS (SELECT a.\"user\", a.pos AS start, b.y, b.value FROM k a JOIN k b ON a.\"user\" = b.\"user\" AND b.pos BETWEEN a.pos AND a.pos + 7 WHERE a.pos % 4 = 0), v AS (SELECT \"user\", start, y, count(*) AS c FROM w GROUP BY ALL), t AS (SELECT \"user\", start, count(*) AS n, count(DISTINCT y) AS kinds, sum(value) AS total FROM w GROUP BY 1, 2 HAVING count(*) = 8), b AS (SELECT \"user\", start, y AS label FROM v QUALIFY row_number() OVER (PARTITION BY \"user\", start ORDER BY c DESC, y) = 1) SELECT \"user\", start, CAST(label AS INT) AS label, round(total, 5) + 0.0 AS total, CAST(n AS INT) AS width FROM t JOIN b USING (\"user\", start)"


def _series(spark, sf):
    kinds = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
    y = F.lit(4)
    for k, i in kinds.items():
        y = F.when(F.col("kind") == k, i).otherwise(y)
    return events(spark, sf).withColumn("y", y)


def _windows(spark, sf, strict):
    w = prep.windows(_series(spark, sf), "user", ["sec", "event"], 8, 4, "value", "y", strict)
    return w.select("user", F.col("start").cast("bigint").alias("start"), "label", (F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 5) + 0.0).alias("total"), F.size("x").alias("width"))


@query(_WIN)
def sliding_windows(spark, sf):
    return _windows(spark, sf, False)


@query(_WIN.replace("b.pos BETWEEN a.pos AND a.pos + 7", "b.pos BETWEEN a.pos AND a.pos + 1").replace("a.pos % 4", "a.pos % 2").replace("count(*) = 8", "count(*) = 2 AND count(DISTINCT y) = 1"))
def strict_windows(spark, sf):
    w = prep.windows(_series(spark, sf), "user", ["sec", "event"], 2, 2, "value", "y", True)
    return w.select("user", F.col("start").cast("bigint").alias("start"), "label", (F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 5) + 0.0).alias("total"), F.size("x").alias("width"))


def _chrono_sql(keys: str) -> str:
    return (
        f"WITH {E}, r AS (SELECT event, row_number() OVER (PARTITION BY {keys} ORDER BY sec, event) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM e),"
        " c AS (SELECT *, greatest(round_even(n * 0.6::DOUBLE, 0), 1) AS a FROM r), d AS (SELECT *, greatest(round_even(n * 0.8::DOUBLE, 0), a) AS b FROM c)"
        " SELECT event, CASE WHEN n >= 2 AND r = n THEN 'test' WHEN r <= a THEN 'train' WHEN r <= b THEN 'val' ELSE 'test' END AS split FROM d"
    )


@query(_chrono_sql('"user"'))
def chrono_split(spark, sf):
    return prep.chronological_split(events(spark, sf), ["user"], ["sec", "event"], 0.6, 0.2).select("event", "split")


@query(_chrono_sql('"user", kind'))
def per_label_chrono_split(spark, sf):
    return prep.chronological_split(events(spark, sf), ["user", "kind"], ["sec", "event"], 0.6, 0.2).select("event", "split")


@query(f"WITH {E}, r AS (SELECT *, sec - lag(sec) OVER (PARTITION BY \"user\" ORDER BY sec, event) AS dt, row_number() OVER (PARTITION BY \"user\" ORDER BY sec, event) - 1 AS pos FROM e), m AS (SELECT \"user\", quantile_cont(dt, 0.5) AS m FROM r WHERE dt > 0 GROUP BY 1) SELECT event, CAST(greatest(coalesce(round_even(200000.0::DOUBLE / m, 0), 1), 1) AS BIGINT) AS step FROM r LEFT JOIN m USING (\"user\") WHERE pos % CAST(greatest(coalesce(round_even(200000.0::DOUBLE / m, 0), 1), 1) AS BIGINT) = 0")
def downsample(spark, sf):
    return prep.downsample(events(spark, sf), "user", ["sec", "event"], F.col("sec"), 200000.0).select("event", "step")


@query(f"WITH {E} SELECT \"user\", CAST(floor(sec / 3600) AS BIGINT) AS hour, min(event) AS event FROM e GROUP BY 1, 2")
def dedupe_first(spark, sf):
    e = events(spark, sf).withColumn("hour", F.floor(F.col("sec") / 3600))
    return prep.first_per(e, ["user", "hour"], ["event"]).select("user", "hour", "event")


@query(f"WITH {E} SELECT event, round(sec - lag(sec) OVER (PARTITION BY \"user\" ORDER BY sec, event), 3) + 0.0 AS dt FROM e")
def first_diff(spark, sf):
    w = Window.partitionBy("user").orderBy("sec", "event")
    return events(spark, sf).select("event", (F.round(F.col("sec") - F.lag("sec").over(w), 3) + 0.0).alias("dt"))


@query(f"WITH {S} SELECT sample, CAST((row_number() OVER (PARTITION BY client ORDER BY {rng.sql_digest(SEED, '3', '0', 'sample')}, sample) - 1) // 16 AS BIGINT) AS batch FROM s")
def minibatch(spark, sf):
    return prep.minibatches(vectors(spark, sf), "client", [rng.digest(SEED, F.lit(3), F.lit(0), F.col("sample")), F.col("sample")], 16).select("sample", "batch")


@query(f"WITH {S}, c AS (SELECT client, count(*) AS n FROM s GROUP BY 1) SELECT client, CAST(floor(round(sum(n) OVER (ORDER BY client) / (SELECT sum(n) FROM c)::DOUBLE, 9) * (SELECT count(*) FROM documents)) AS BIGINT) AS cut FROM c")
def cumulative_cut(spark, sf):
    c = vectors(spark, sf).groupBy("client").agg(F.count("*").alias("n"))
    total = table(spark, sf, "documents").agg(F.count("*").alias("t"))
    share = F.sum("n").over(Window.orderBy("client")) / F.sum("n").over(Window.partitionBy())
    return c.crossJoin(F.broadcast(total)).select("client", F.floor(F.round(share, 9) * F.col("t")).alias("cut"))


@query("SELECT event_id, ['a', 'b', 'c'][1 + (event_id + 0) % 3] AS first, ['a', 'b', 'c'][1 + (event_id + 1) % 3] AS second FROM events")
def method_rotation(spark, sf):
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    turn = lambda i: F.get(names, ((F.col("event_id") + i) % 3).cast("int"))
    return table(spark, sf, "events").select("event_id", turn(0).alias("first"), turn(1).alias("second"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS iteration FROM events) WHERE iteration >= 3 GROUP BY 1")
def warmup_filter(spark, sf):
    it = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    rows = table(spark, sf, "events").withColumn("iteration", it).where("iteration >= 3")
    return rows.groupBy("event_type").agg(r6(F.percentile("value", 0.5)).alias("median"), F.count("*").alias("n"))


# --- top-k, samples, splits, partitions ---


@query(f"WITH {SPLIT} SELECT sample, client, y, split FROM t")
def train_test_split(spark, sf):
    return split(spark, sf).select("sample", "client", "y", "split")


_P = H + ", m AS (SELECT y, d, avg(v) AS w FROM h WHERE split = 'train' GROUP BY 1, 2), k AS (SELECT y, sqrt(sum(w * w)) AS n FROM m GROUP BY 1), j AS (SELECT h.sample, h.client, h.y, m.y AS p, round(sum(h.v * m.w) / (greatest(sqrt(sum(h.v * h.v)), 1e-8) * greatest(any_value(k.n), 1e-8)), 9) AS s FROM h JOIN m USING (d) JOIN k ON k.y = m.y WHERE h.split = 'test' GROUP BY 1, 2, 3, 4), b AS (SELECT sample, client, y, p AS pred, s FROM j QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, p) = 1)"


def predictions(spark, sf):
    h = storage.settle(encoded(spark, sf), "encoded")
    protos = pr.class_means(h.where("split = 'train'"), ["y"], "h")
    return pr.predict(h.where("split = 'test'"), protos, [], "h")


@query(f"WITH {_P} SELECT client, avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM b GROUP BY 1")
def encode_predict_accuracy(spark, sf):
    return predictions(spark, sf).groupBy("client").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query(f"WITH {_P} SELECT sample, CAST(pred AS INT) AS pred, round(s, 6) + 0.0 AS score FROM b")
def argmax_predict(spark, sf):
    return predictions(spark, sf).select("sample", F.col("pred").cast("int").alias("pred"), r6("score").alias("score"))


@query(f"WITH {_P}, c AS (SELECT client, avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0 END) AS a FROM b GROUP BY 1) SELECT round(avg(a), 9) AS accuracy, count(*) AS clients FROM c")
def macro_accuracy(spark, sf):
    return pr.macro_accuracy(predictions(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"), "clients")


@query(f'WITH {_P} SELECT round(count(*) FILTER (WHERE pred = y) / count(*)::DOUBLE, 9) AS accuracy, count(*) AS "rows" FROM b')
def micro_accuracy(spark, sf):
    return pr.micro_accuracy(predictions(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"), "rows")


@query(f"WITH {_P} SELECT client, y, count(*) AS n, count(*) FILTER (WHERE pred <> y) AS wrong, round(count(*) FILTER (WHERE pred <> y) / count(*)::DOUBLE, 6) + 0.0 AS ratio FROM b GROUP BY 1, 2")
def error_ratio(spark, sf):
    return pr.error_ratio(predictions(spark, sf), ["client", "y"]).select("client", "y", "n", "wrong", r6("ratio").alias("ratio"))


_ZERO = "m AS (SELECT y, d, CASE WHEN y % 3 = 0 THEN 0 ELSE avg(v) END AS w FROM l GROUP BY 1, 2), j AS (SELECT l.sample, m.y AS p, round(sum(l.v * m.w), 9) AS s FROM l JOIN m USING (d) WHERE m.y % 3 <> 0 GROUP BY 1, 2)"


@query(f"WITH {L}, {_ZERO} SELECT sample, CAST(p AS INT) AS pred FROM j QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, p) = 1")
def zero_row_predict(spark, sf):
    s = vectors(spark, sf)
    protos = pr.class_means(s, ["y"]).withColumn("w", F.transform("w", lambda a: F.when(F.col("y") % 3 == 0, 0.0).otherwise(a)))
    return pr.predict(s, protos, [], metric="dot").select("sample", F.col("pred").cast("int").alias("pred"))


@query(f"WITH {L}, a AS (SELECT client, d, avg(abs(v)) AS r FROM l GROUP BY 1, 2) SELECT client, d, round(r, 6) + 0.0 AS relevance FROM a QUALIFY row_number() OVER (PARTITION BY client ORDER BY round(r, 9) DESC, d) <= 5")
def topk_features(spark, sf):
    r = v.long_form(vectors(spark, sf), ["client"], "x").groupBy("client", "d").agg(F.avg(F.abs("v")).alias("r"))
    rank = F.row_number().over(Window.partitionBy("client").orderBy(F.desc(F.round("r", 9)), "d"))
    return r.withColumn("k", rank).where("k <= 5").select("client", "d", r6("r").alias("relevance"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey < (SELECT count(*) // 10 FROM customer)")
def prefix_limit(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    n = c.agg(F.floor(F.count("*") / 10).alias("n"))
    return c.crossJoin(F.broadcast(n)).where("c_custkey < n").drop("n")


@query(f"SELECT o_orderkey FROM orders ORDER BY {rng.sql_digest(SEED, 'o_orderkey')}, o_orderkey LIMIT 1000")
def seeded_sample(spark, sf):
    return prep.sample_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, SEED)


@query(
    f"WITH RECURSIVE {I}, c AS (SELECT client, y, count(*) AS n FROM i GROUP BY 1, 2), q AS (SELECT *, sum(n) OVER (PARTITION BY client) AS t FROM c),"
    " f AS (SELECT client, y, n, t, CASE WHEN t <= 200 THEN n ELSE least(greatest(floor(n * 200 / t::DOUBLE), 1), n) END AS q FROM q),"
    " g AS (SELECT *, least(200, t) - sum(q) OVER (PARTITION BY client) AS gap FROM f),"
    " w(client, step, gap, y, n, q) AS (SELECT client, 0, gap, list(y ORDER BY y), list(n ORDER BY y), list(CAST(q AS BIGINT) ORDER BY y) FROM g GROUP BY client, gap"
    "  UNION ALL SELECT client, step + 1, CASE WHEN gap > 0 THEN gap - 1 ELSE gap + 1 END, y, n, list_transform(range(1, len(q) + 1), lambda k: q[k] + CASE WHEN k = best THEN CASE WHEN gap > 0 THEN 1 ELSE -1 END ELSE 0 END)"
    "  FROM (SELECT *, list_position(list_transform(range(1, len(q) + 1), lambda k: CASE WHEN gap > 0 THEN n[k] - q[k] WHEN q[k] > 1 THEN q[k] ELSE -1 END), list_max(list_transform(range(1, len(q) + 1), lambda k: CASE WHEN gap > 0 THEN n[k] - q[k] WHEN q[k] > 1 THEN q[k] ELSE -1 END))) AS best FROM w WHERE gap <> 0)),"
    " z AS (SELECT client, unnest(y) AS y, unnest(q) AS q FROM w WHERE gap = 0),"
    f" r AS (SELECT sample, client, y, row_number() OVER (PARTITION BY client, y ORDER BY {rng.sql_digest(SEED, 'sample')}, sample) AS r FROM i)"
    " SELECT sample FROM r JOIN z USING (client, y) WHERE r <= q"
)
def stratified_cap(spark, sf):
    return prep.stratified_cap(items(spark, sf), "client", "y", "sample", 200, SEED).select("sample")


@query(f"WITH {I}, c AS (SELECT client, count(*) AS n FROM i GROUP BY 1), r AS (SELECT *, n * 20000 / (sum(n) OVER ())::DOUBLE AS raw FROM c), f AS (SELECT *, least(greatest(floor(raw), 1), n) AS f FROM r), t AS (SELECT *, least(20000, sum(n) OVER ()) - sum(f) OVER () AS rest, row_number() OVER (ORDER BY CASE WHEN f < n THEN raw - floor(raw) ELSE -1 END DESC, client) AS k FROM f) SELECT client, n, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t")
def budget_allocation(spark, sf):
    sizes = items(spark, sf).groupBy("client").agg(F.count("*").alias("n"))
    return prep.allocate_budget(sizes, "n", 20000, "client").select("client", "n", "quota")


def _dirichlet_sql(halves: int, keep: str) -> str:
    part = f"y{keep}"
    return (
        f"WITH {SPLIT}, g AS (SELECT y, c.client, {rng.sql_half_gamma(SEED, halves, 'y', 'c.client')} AS g FROM (SELECT DISTINCT y FROM t) CROSS JOIN (SELECT CAST(range AS INT) AS client FROM range(8)) c),"
        " c AS (SELECT y, client, sum(g) OVER (PARTITION BY y ORDER BY client) / sum(g) OVER (PARTITION BY y) AS c FROM g),"
        f" k AS (SELECT sample, y, row_number() OVER (PARTITION BY {part} ORDER BY {rng.sql_digest(SEED, 'sample')}, sample) - 1 AS pos, count(*) OVER (PARTITION BY {part}) AS n FROM t)"
        " SELECT sample, min(c.client) AS client FROM k JOIN c USING (y) WHERE CASE WHEN c.client = 7 THEN n ELSE floor(round(c.c, 9) * n) END > pos GROUP BY 1"
    )


@query(_dirichlet_sql(10, ""))
def dirichlet_partition(spark, sf):
    return prep.dirichlet_clients(split(spark, sf).drop("client"), "sample", "y", 8, 10, SEED).select("sample", "client")


@query(_dirichlet_sql(1, ", split"))
def dirichlet_explicit(spark, sf):
    return prep.dirichlet_clients(split(spark, sf).drop("client"), "sample", "y", 8, 1, SEED, ["split"]).select("sample", "client")


@query(f"WITH c AS (SELECT DISTINCT user_id AS client FROM events), r AS (SELECT round, client, row_number() OVER (PARTITION BY round ORDER BY {rng.sql_digest(SEED, 'round', 'client')}, client) AS k, count(*) OVER (PARTITION BY round) AS n FROM c CROSS JOIN (SELECT CAST(range AS INT) AS round FROM range(1, 4))) SELECT round, client FROM r WHERE k <= greatest(ceil(n * 0.3::DOUBLE), 1)")
def participation_sample(spark, sf):
    return prep.participants(events(spark, sf).select(F.col("user").alias("client")), 3, 0.3, SEED)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedupe_ordered(spark, sf):
    from vectorloom.operators.relational import distinct_in_order

    return distinct_in_order(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


# --- encoders ---

_ENC = "SELECT sample, CAST(d AS INT) AS d, round(v, 6) + 0.0 AS v FROM "
_Z = f"WITH {L}, {W}"


@query(f"WITH {H} {_ENC} h")
def encode_cos(spark, sf):
    return cells(encoded(spark, sf), ["sample"], "h")


@query(f"{_Z}, z AS (SELECT sample, p.d, cos(sum(v * w) + 6.283185307179586 * {rng.sql_uniform(SEED, repr('phase'), 'p.d')}) AS c FROM l JOIN p ON l.d = p.f GROUP BY sample, p.d) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM z)")
def encode_cos_phase(spark, sf):
    return cells(encoders.encode_cosine(vectors(spark, sf), weights(spark), phase=encoders.phases(DIMS, SEED)), ["sample"], "h")


@query(f"{_Z} SELECT sample, CAST(p.d AS INT) AS d, CASE WHEN round(sum(v * CASE WHEN w < 0 THEN -1 ELSE 1 END), 9) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM l JOIN p ON l.d = p.f GROUP BY sample, p.d")
def encode_sign(spark, sf):
    w = encoders.weights(encoders.projection(spark, 64, DIMS, SEED, binary=True))
    return v.long_form(encoders.encode_sign(vectors(spark, sf), w), ["sample"], "h")


@query(f"{_Z}, k AS (SELECT f, d FROM p QUALIFY row_number() OVER (PARTITION BY d ORDER BY {rng.sql_digest(SEED, repr('mask'), 'f', 'd')}, f) <= 8), z AS (SELECT sample, p.d, cos(sum(v * w)) AS c FROM l JOIN p ON l.d = p.f JOIN k ON k.f = p.f AND k.d = p.d GROUP BY sample, p.d) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM z)")
def encode_masked(spark, sf):
    w = encoders.masked(weights(spark), encoders.masks(spark, 64, DIMS, 8, SEED))
    return cells(encoders.encode_cosine(vectors(spark, sf), w), ["sample"], "h")


_GROUPS = encoders.contiguous_groups(64, 4)


@query(f"{_Z}, z AS (SELECT sample, p.d, cos(sum(v * w)) * 0.5 AS c FROM l JOIN p ON l.d = p.f AND l.d // 16 = p.d // 8 GROUP BY sample, p.d) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM z)")
def encode_block(spark, sf):
    return cells(encoders.encode_block(vectors(spark, sf), weights(spark), _GROUPS), ["sample"], "h")


_G = "z AS (SELECT sample, l.d // 16 AS g, p.d, cos(sum(v * w)) AS c FROM l JOIN p ON l.d = p.f GROUP BY 1, 2, 3), gf AS (SELECT sample, g, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample, g)) + 1e-8) AS v FROM z)"


@query(f"{_Z}, {_G} SELECT sample, CAST(g AS INT) AS g, CAST(d AS INT) AS d, round(v, 6) + 0.0 AS v FROM gf")
def encode_group_features(spark, sf):
    done = encoders.encode_groups(vectors(spark, sf), weights(spark), _GROUPS)
    parts = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"h{g}").alias("h")) for g in range(4)]))
    return cells(done.select("sample", parts.alias("p")).select("sample", "p.g", "p.h"), ["sample", "g"], "h")


def _signs(n: int, m: int) -> np.ndarray:
    return np.array([[1.0 if (7 * i + 3 * j + i * j) % 5 < 3 else -1.0 for j in range(m)] for i in range(n)])


@query(f"{_Z}, {_G}, a AS (SELECT sample, d, sum(v * 0.5 * CASE WHEN (7 * g + 3 * d + g * d) % 5 < 3 THEN 1 ELSE -1 END) AS c FROM gf GROUP BY 1, 2) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM a)")
def encode_superposition(spark, sf):
    return cells(encoders.encode_superposition(vectors(spark, sf), weights(spark), _GROUPS, _signs(4, DIMS)), ["sample"], "h")


@query(f"{_Z}, {_G}, a AS (SELECT sample, (g * {DIMS} + d) * 11 % 24 AS d, sum(v * 0.5 * CASE WHEN (7 * g + 3 * d + g * d) % 5 < 3 THEN 1 ELSE -1 END) AS c FROM gf GROUP BY 1, 2) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM a)")
def encode_hash(spark, sf):
    slots = np.arange(4 * DIMS) * 11 % 24
    return cells(encoders.encode_hashed(vectors(spark, sf), weights(spark), _GROUPS, slots, _signs(4, DIMS).ravel(), 24), ["sample"], "h")


@query(
    f"{_Z}, f AS (SELECT sample, p.d, cos(sum(v * w)) AS c FROM l JOIN p ON l.d = p.f GROUP BY sample, p.d), fn AS (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) * sqrt(0.7::DOUBLE) AS c FROM f),"
    f" z AS (SELECT sample, p.d, cos(sum(v * w)) * 0.5 AS c FROM l JOIN p ON l.d = p.f AND l.d // 16 = p.d // 8 GROUP BY sample, p.d), zn AS (SELECT sample, d + {DIMS} AS d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) * sqrt(0.3::DOUBLE) AS c FROM z),"
    f" b AS (SELECT * FROM fn UNION ALL SELECT * FROM zn) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM b)"
)
def encode_residual(spark, sf):
    w = weights(spark)
    return cells(encoders.encode_residual(vectors(spark, sf), w, w, _GROUPS, 0.3), ["sample"], "h")


@query()
def encode_mlp_groups(spark, sf):
    s = vectors(spark, sf)
    groups, shares = encoders.learn_groups(s.select("x", "y"), 10, 4, 16)
    return cells(encoders.encode_block(s, weights(spark), groups, shares=shares), ["sample"], "h")


#: Weights of a network in closed form: 64 features, 8 hidden units in 4 groups, 10 classes.
_NET = (
    "n1 AS (SELECT CAST(f.range AS INT) AS f, CAST(h.range AS INT) AS h, sin(f.range * 1.7 + h.range * 2.3) * (1 + h.range / 8.0::DOUBLE) AS w FROM range(64) f, range(8) h),"
    " n2 AS (SELECT CAST(h.range AS INT) AS h, avg(abs(cos(h.range * 0.9 + c.range * 1.3))) AS u FROM range(8) h, range(10) c GROUP BY 1),"
    " rv AS (SELECT h % 4 AS g, f, round(sum(abs(w) * u), 12) AS r FROM n1 JOIN n2 USING (h) GROUP BY 1, 2),"
    " gm AS (SELECT g, f FROM rv QUALIFY row_number() OVER (PARTITION BY g ORDER BY r DESC, f) <= 16),"
    " gs AS (SELECT g, sum(r) / (SELECT sum(r) FROM rv) AS share FROM rv GROUP BY 1)"
)


@query(f"{_Z}, {_NET}, z AS (SELECT sample, p.d, cos(sum(v * w)) * sqrt(any_value(gs.share)) AS c FROM l JOIN p ON l.d = p.f JOIN gm ON gm.f = p.f AND gm.g = p.d // 8 JOIN gs ON gs.g = gm.g GROUP BY sample, p.d) {_ENC} (SELECT sample, d, c / (sqrt(sum(c * c) OVER (PARTITION BY sample)) + 1e-8) AS v FROM z)")
def encode_learned_groups(spark, sf):
    f, h, c = np.arange(64)[:, None], np.arange(8)[None, :], np.arange(10)[None, :]
    groups, shares = encoders.group_relevance(np.sin(f * 1.7 + h * 2.3) * (1 + h / 8), np.cos(h.T * 0.9 + c * 1.3), 4, 16)
    return cells(encoders.encode_block(vectors(spark, sf), weights(spark), groups, shares=shares), ["sample"], "h")


# --- similarity and one-step learning ---


@query(f"WITH {M}, k AS (SELECT y, d, avg(v) AS w FROM l GROUP BY 1, 2) SELECT l.sample, k.y AS k, round(sum(l.v * w), 6) + 0.0 AS dot, round(sum(l.v * w) / (greatest(sqrt(sum(l.v * l.v)), 1e-8) * greatest(sqrt(sum(w * w)), 1e-8)), 6) + 0.0 AS cos FROM l JOIN k USING (d) GROUP BY 1, 2")
def similarity_scores(spark, sf):
    s = vectors(spark, sf)
    protos = pr.class_means(s, ["y"]).select(F.col("y").alias("k"), "w")
    both = s.crossJoin(F.broadcast(protos))  # a few classes
    return both.select("sample", "k", r6(v.similarity("x", "w", "dot")).alias("dot"), r6(v.similarity("x", "w", "cos")).alias("cos"))


@query(f"WITH {M}, a AS (SELECT y, d, sum(n * v) / sum(n) AS v FROM m GROUP BY 1, 2) SELECT client, y, round(sum(m.v * a.v) / (greatest(sqrt(sum(m.v * m.v)), 1e-8) * greatest(sqrt(sum(a.v * a.v)), 1e-8)), 6) + 0.0 AS cos FROM m JOIN a USING (y, d) GROUP BY 1, 2")
def paired_cosine(spark, sf):
    s = vectors(spark, sf)
    common = pr.class_means(s, ["y"]).withColumnRenamed("w", "c")
    return pr.class_means(s, ["client", "y"]).join(F.broadcast(common), "y").select("client", "y", r6(v.cosine("w", "c")).alias("cos"))


_STEP = (
    "c AS (SELECT client, y AS k, d, avg(v) AS w FROM l GROUP BY 1, 2, 3), cn AS (SELECT client, k, sqrt(sum(w * w)) AS n FROM c GROUP BY 1, 2),"
    " j AS (SELECT l.client, l.sample, l.y, c.k, round(sum(l.v * c.w) / (greatest(sqrt(sum(l.v * l.v)), 1e-8) * greatest(any_value(cn.n), 1e-8)), 9) AS s FROM l JOIN c USING (client, d) JOIN cn ON cn.client = c.client AND cn.k = c.k GROUP BY 1, 2, 3, 4),"
    " b AS (SELECT client, sample, y, k AS pred FROM j QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, k) = 1),"
    " w AS (SELECT l.client, l.y AS k, d, v FROM l JOIN b USING (sample) WHERE pred <> b.y UNION ALL SELECT l.client, pred, d, -v FROM l JOIN b USING (sample) WHERE pred <> b.y),"
    " u AS (SELECT client, k, d, sum(v) AS u FROM w GROUP BY 1, 2, 3),"
    " n AS (SELECT c.client, c.k, c.d, c.w + 0.5 * coalesce(u.u, 0) AS w, u.u IS NOT NULL AS changed FROM c LEFT JOIN u USING (client, k, d))"
)


@query(f"WITH {L}, {_STEP} SELECT client, k AS y, d, {R.format('w')} AS v FROM n")
def stale_batch_step(spark, sf):
    s = vectors(spark, sf)
    return cells(pr.stale_step(s, pr.class_means(s, ["client", "y"]), ["client"], 0.5), ["client", "y"], "w")


@query(f"WITH {L}, {_STEP} SELECT client, k AS y, d, round(CASE WHEN changed THEN w / CASE WHEN sum(w * w) OVER (PARTITION BY client, k) = 0 THEN 1 ELSE sqrt(sum(w * w) OVER (PARTITION BY client, k)) END ELSE w END, 6) + 0.0 AS v FROM n")
def averaging_batch_epoch(spark, sf):
    s = vectors(spark, sf)
    moved = pr.stale_step(s, pr.class_means(s, ["client", "y"]), ["client"], 0.5)
    return cells(moved.withColumn("w", F.when(F.col("changed"), v.normalise("w", "safe")).otherwise(F.col("w"))), ["client", "y"], "w")


@query(f"WITH {L}, {_STEP}, e AS (SELECT client, y AS k, count(*) AS n, count(*) FILTER (WHERE pred <> y) AS wrong FROM b GROUP BY 1, 2), t AS (SELECT k, d, sum(0.5 * u) AS t FROM u GROUP BY 1, 2) SELECT c.client, c.k AS y, c.d, round(c.w + 0.5 * wrong / greatest(e.n, 1) * coalesce(t, 0), 6) + 0.0 AS v FROM c JOIN e USING (client, k) LEFT JOIN t USING (k, d)")
def personalize(spark, sf):
    s = vectors(spark, sf)
    protos = pr.class_means(s, ["client", "y"])
    rows = pr.predict(s, protos, ["client"])
    total = pr.memory_sum(pr.push_pull(rows, ["client"]).withColumn("w", v.scale("u", F.lit(0.5))), mode=None).withColumnRenamed("w", "t")
    joined = protos.join(pr.error_ratio(rows, ["client", "y"]), ["client", "y"]).join(total, "y", "left")
    return cells(joined.withColumn("w", F.when(F.col("t").isNull(), F.col("w")).otherwise(v.axpy("w", "t", 0.5 * F.col("ratio")))), ["client", "y"], "w")


@query(f"WITH {L}, {_STEP}, e AS (SELECT client, y AS k, count(*) AS n, count(*) FILTER (WHERE pred <> y) AS wrong FROM b GROUP BY 1, 2) SELECT client, k AS y, round(1 - greatest(least(1 - wrong / e.n::DOUBLE, 0.9), 0.1), 6) + 0.0 AS follow FROM e")
def follow_ratio(spark, sf):
    s = vectors(spark, sf)
    ratio = pr.error_ratio(pr.predict(s, pr.class_means(s, ["client", "y"]), ["client"]), ["client", "y"])
    return ratio.select("client", "y", r6(pr.follow_ratio(F.col("n"), F.col("wrong"))).alias("follow"))


@query(f"WITH {L}, {_STEP}, e AS (SELECT client, y AS k, count(*) AS n, count(*) FILTER (WHERE pred <> y) AS wrong FROM b GROUP BY 1, 2), a AS (SELECT k, d, sum(e.n * c.w) / sum(e.n) AS a FROM c JOIN e USING (client, k) GROUP BY 1, 2) SELECT client, k AS y, d, round(c.w + 0.035::DOUBLE * (1 - greatest(least(1 - wrong / e.n::DOUBLE, 0.9), 0.1)) * (a - c.w), 6) + 0.0 AS v FROM c JOIN e USING (client, k) JOIN a USING (k, d)")
def gated_merge(spark, sf):
    s = vectors(spark, sf)
    protos = pr.class_means(s, ["client", "y"])
    ratio = pr.error_ratio(pr.predict(s, protos, ["client"]), ["client", "y"])
    state = protos.join(ratio, ["client", "y"])
    common = pr.consensus(state, "y", "w").withColumnRenamed("w", "cc")
    gate = pr.follow_ratio(F.col("n"), F.col("wrong"))
    return cells(state.join(F.broadcast(common), "y").withColumn("w", pr.gated_merge("w", "cc", 0.035, gate)), ["client", "y"], "w")


# --- bases, coefficients, centres ---


@query()
def shared_basis(spark, sf):
    s = vectors(spark, sf)
    common, extra, energy = bases.shared_basis(pr.class_means(s, ["client", "y"]), 6, 2)
    b = np.hstack([common, extra])
    projected = bases.project(s, b, "x", "z")
    return projected.select("sample", r6(v.norm("z")).alias("inside"), F.lit(round(energy, 6)).alias("energy"), F.lit(float(np.abs(b.T @ b - np.eye(8)).max().round(6))).alias("off_orthonormal"))


@query(f"WITH {M} SELECT 0.0::DOUBLE AS off_orthonormal, 0.0::DOUBLE AS off_shared, client, CAST(4 AS BIGINT) AS rank FROM (SELECT DISTINCT client FROM m)")
def personal_basis(spark, sf):
    s = vectors(spark, sf)
    protos = pr.class_means(s, ["client", "y"])
    b = np.hstack(bases.shared_basis(protos, 6, 2)[:2])
    own = bases.project(bases.per_client(protos, "client", "w", 4, b), b, "b", "onto")
    pairs = own.alias("p").join(own.alias("q"), "client").select("client", F.abs(v.dot("p.b", "q.b") - F.when(F.col("p.r") == F.col("q.r"), 1.0).otherwise(0.0)).alias("e"))
    off = pairs.groupBy("client").agg(F.round(F.max("e"), 6).alias("off_orthonormal"))
    return own.groupBy("client").agg(F.round(F.max(F.array_max(F.transform("onto", F.abs))), 6).alias("off_shared"), F.count("*").alias("rank")).join(off, "client").select("off_orthonormal", "off_shared", "client", "rank")


@query(f"WITH {M} SELECT client, y, CASE WHEN v < 0 THEN -1 ELSE 1 END AS turn, d AS at FROM m QUALIFY row_number() OVER (PARTITION BY client, y ORDER BY round(abs(v), 9) DESC, d) = 1")
def sign_canonical(spark, sf):
    means = pr.class_means(vectors(spark, sf), ["client", "y"])

    def turn(batches):
        for batch in batches:
            m = np.array(batch.column("w").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1).T
            signs = bases.canonical_signs(m)
            at = np.abs(np.round(m, 9)).argmax(axis=0)
            own = np.arange(m.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("y"), pa.array(np.where(signs[at, own] == m[at, own], 1, -1), pa.int32()), pa.array(at, pa.int32())], ["client", "y", "turn", "at"])

    return means.mapInArrow(turn, "client int, y int, turn int, at int")


@query(f"WITH {L}, c AS (SELECT d, v, sample FROM l WHERE d < 3), g AS (SELECT sum(x.v * x.v) FILTER (WHERE x.d = 0) AS a, sum(x.v * x.v) FILTER (WHERE x.d = 1) AS b FROM c x), o AS (SELECT sum(x.v * y.v) AS o FROM c x JOIN c y USING (sample) WHERE x.d = 0 AND y.d = 1), e AS (SELECT (a + b) / 2 AS m, sqrt(((a - b) / 2) ** 2 + o ** 2) AS r FROM g, o) SELECT 0 AS r, round(sqrt(m + r), 6) + 0.0 AS value FROM e UNION ALL SELECT 1, round(sqrt(greatest(m - r, 0)), 6) + 0.0 FROM e")
def low_rank_vectors(spark, sf):
    plane = vectors(spark, sf).select(F.slice("x", 1, 2).alias("w"))  # two dimensions, whose singular values have a closed form
    values, basis = bases.right_vectors(plane, 2)
    if np.abs(basis.T @ basis - np.eye(2)).max() > 1e-9:
        raise ValueError("right vectors must be orthonormal")
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(values)], "r int, value double")


def _plane(spark: SparkSession, sf: str) -> DataFrame:
    """Class means of clients in the first two dimensions, where eigenvectors have a closed form."""
    return pr.class_means(vectors(spark, sf), ["client", "y"]).withColumn("w", F.slice("w", 1, 2))


def _plane_sql(keys: str) -> str:
    """Direction, largest eigenvalue and trace of the means in the plane, per key; the larger entry of the direction is positive."""
    return (
        f"WITH {M}, xy AS (SELECT client, y, max(v) FILTER (WHERE d = 0) AS x0, max(v) FILTER (WHERE d = 1) AS x1 FROM m GROUP BY 1, 2),"
        f" g AS (SELECT {keys} AS key, sum(x0 * x0) AS a, sum(x1 * x1) AS b, sum(x0 * x1) AS o FROM xy GROUP BY 1),"
        " e AS (SELECT key, 0.5 * atan2(2 * o, a - b) AS t, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + o ** 2) AS top, a + b AS total FROM g),"
        " k AS (SELECT *, CASE WHEN CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END < 0 THEN -1 ELSE 1 END AS turn FROM e)"
    )


@query(_plane_sql("0") + " SELECT client, y, round(turn * (x0 * cos(t) + x1 * sin(t)), 6) + 0.0 AS z, round(top / total, 6) + 0.0 AS energy FROM xy, k")
def plane_shared_basis(spark, sf):
    protos = _plane(spark, sf)
    common, _, energy = bases.shared_basis(protos, 1, 0)
    return bases.project(protos, common, "w", "z").select("client", "y", r6(F.col("z")[0]).alias("z"), F.lit(round(energy, 6) + 0.0).alias("energy"))


@query(_plane_sql("client") + " SELECT key AS client, round(total / top, 6) + 0.0 AS effective_rank, round(turn * cos(t), 6) + 0.0 AS b0, round(turn * sin(t), 6) + 0.0 AS b1 FROM k")
def plane_personal_basis(spark, sf):
    own = bases.per_client(_plane(spark, sf), "client", "w", 1)
    return own.select("client", r6("effective_rank").alias("effective_rank"), r6(F.col("b")[0]).alias("b0"), r6(F.col("b")[1]).alias("b1"))


@query(_plane_sql("client") + " SELECT i.key AS i, j.key AS j, round(degrees(acos(least(abs(cos(i.t - j.t)), 1))), 4) + 0.0 AS degrees FROM k i JOIN k j ON i.key < j.key")
def plane_angles(spark, sf):
    own = bases.per_client(_plane(spark, sf), "client", "w", 1)
    return bases.client_angles(own).select("i", "j", (F.round("degrees", 4) + 0.0).alias("degrees"))


@query()
def effective_rank(spark, sf):
    own = bases.per_client(pr.class_means(vectors(spark, sf), ["client", "y"]), "client", "w", 2)
    return own.groupBy("client").agg(r6(F.max("effective_rank")).alias("effective_rank"))


@query()
def principal_angles(spark, sf):
    own = bases.per_client(pr.class_means(vectors(spark, sf), ["client", "y"]), "client", "w", 3)
    return bases.client_angles(own).select("i", "j", F.round("degrees", 4).alias("degrees"))


@query(f"SELECT client, quota AS kept FROM ({ORACLE['budget_allocation']})")
def capped_total(spark, sf):
    rows = prep.cap_total(items(spark, sf), "client", "y", "sample", 5000, 20000, SEED)
    return rows.groupBy("client").agg(F.count("*").alias("kept"))


@query(f"WITH {M}, q AS (SELECT sample, client, y, d, v FROM l) SELECT sample, CAST(d // 8 AS INT) AS part, round(sum(v * v), 6) + 0.0 AS energy, round(sum(sum(v * v)) OVER (PARTITION BY sample), 6) + 0.0 AS total FROM q GROUP BY sample, d // 8")
def query_cache(spark, sf):
    eye = np.eye(64)
    z = vectors(spark, sf)
    parts = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"z{p}").alias("z")) for p in range(8)]))
    for p in range(8):
        z = bases.project(z, eye[:, 8 * p : 8 * p + 8], "x", f"z{p}")
    e = z.select("sample", "x", parts.alias("p"))
    return e.select("sample", "p.part", r6(F.pow(v.norm("p.z"), 2)).alias("energy"), r6(F.pow(v.norm("x"), 2)).alias("total"))


#: A fixed orthonormal basis: scaled Walsh rows, closed form in both engines.
def _walsh(i: int, d: int) -> float:
    return (-1.0) ** bin(i & d).count("1") / 8.0


_WALSH = "b AS (SELECT r.r, d.d, CASE WHEN bit_count(r.r & d.d) % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END AS b FROM (SELECT CAST(range AS INT) AS r FROM range(12)) r, (SELECT CAST(range AS INT) AS d FROM range(64)) d)"


def _basis() -> np.ndarray:
    return np.array([[_walsh(r, d) for r in range(12)] for d in range(64)])


@query(f"WITH {M}, {_WALSH}, z AS (SELECT sample, client, y, r, sum(v * b) AS z FROM l JOIN b USING (d) GROUP BY 1, 2, 3, 4), c AS (SELECT client, m.y AS k, r, sum(v * b) AS c FROM m JOIN b USING (d) GROUP BY 1, 2, 3), j AS (SELECT sample, c.k, round(sum(z * c) / (greatest(sqrt(sum(z * z)), 1e-8) * greatest(sqrt(sum(c * c)), 1e-8)), 9) AS s FROM z JOIN c USING (client, r) GROUP BY 1, 2) SELECT sample, CAST(k AS INT) AS pred, round(s, 6) + 0.0 AS score FROM j QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, k) = 1")
def coef_score(spark, sf):
    s = vectors(spark, sf)
    coef = bases.project(pr.class_means(s, ["client", "y"]), _basis(), "w", "c").select("client", "y", F.col("c").alias("w"))
    z = bases.project(s, _basis(), "x", "z")
    return pr.predict(z, coef, ["client"], "z").select("sample", F.col("pred").cast("int").alias("pred"), r6("score").alias("score"))


@query(f"WITH {M}, {_WALSH}, c AS (SELECT client, y, r, sum(v * b) AS c FROM m JOIN b USING (d) GROUP BY 1, 2, 3), n AS (SELECT client, y, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT y, r, sum(n * c) / sum(n) AS g FROM c JOIN n USING (client, y) GROUP BY 1, 2), q AS (SELECT client, y, d, sum(g * b) AS t FROM (SELECT DISTINCT client, y FROM m) JOIN g USING (y) JOIN b USING (r) GROUP BY 1, 2, 3) SELECT client, y, d, round(m.v - q.t, 6) + 0.0 AS v FROM m JOIN q USING (client, y, d)")
def bootstrap_residual(spark, sf):
    s = vectors(spark, sf)
    m = bases.project(pr.class_means(s, ["client", "y"]), _basis(), "w", "c").join(s.groupBy("client", "y").agg(F.count("*").alias("n")), ["client", "y"])
    g = pr.consensus(m, "y", "c").withColumnRenamed("c", "g")
    lifted = encoders.multiply(m.join(F.broadcast(g), "y"), _basis().T, "g", "t")
    return cells(lifted.withColumn("w", F.zip_with("w", "t", lambda a, b: a - b)), ["client", "y"], "w")


@query(f"WITH {M}, {_WALSH}, c AS (SELECT client, y, r, sum(v * b) AS c FROM m JOIN b USING (d) GROUP BY 1, 2, 3), q AS (SELECT client, y, b.d, sum(c * b) AS t FROM c JOIN b USING (r) GROUP BY 1, 2, 3) SELECT client, y, CAST(d AS INT) AS d, round(t / greatest(sqrt(sum(t * t) OVER (PARTITION BY client, y)), 1e-8), 6) + 0.0 AS v FROM q")
def reconstruct_memory(spark, sf):
    c = bases.project(pr.class_means(vectors(spark, sf), ["client", "y"]), _basis(), "w", "c")
    lifted = encoders.multiply(c, _basis().T, "c", "t").withColumn("t", v.normalise("t", "clamp"))
    return cells(lifted, ["client", "y"], "t")


@query(f"WITH {M}, {_WALSH}, c AS (SELECT client, y, r, sum(v * b) AS c FROM m JOIN b USING (d) GROUP BY 1, 2, 3), q AS (SELECT client, y, b.d, sum(c * b) AS t FROM c JOIN b USING (r) GROUP BY 1, 2, 3) SELECT client, round(avg(cos), 6) + 0.0 AS cosine, round(avg(err), 6) + 0.0 AS error FROM (SELECT client, y, sum(v * t) / (greatest(sqrt(sum(v * v)), 1e-8) * greatest(sqrt(sum(t * t)), 1e-8)) AS cos, sqrt(sum((v - t) * (v - t))) AS err FROM m JOIN q USING (client, y, d) GROUP BY 1, 2) GROUP BY 1")
def reconstruction_diagnostics(spark, sf):
    c = bases.project(pr.class_means(vectors(spark, sf), ["client", "y"]), _basis(), "w", "c")
    lifted = encoders.multiply(c, _basis().T, "c", "t")
    err = v.norm(F.zip_with("w", "t", lambda a, b: a - b))
    return lifted.groupBy("client").agg(r6(F.avg(v.cosine("w", "t"))).alias("cosine"), r6(F.avg(err)).alias("error"))


_ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query(
    f"WITH {M}, g AS (SELECT y, d, avg(v) AS g FROM l GROUP BY 1, 2), j AS (SELECT l.sample, l.client, l.y, m.y AS k, sum(l.v * g.g) / (greatest(sqrt(sum(l.v * l.v)), 1e-8) * greatest(sqrt(sum(g.g * g.g)), 1e-8)) AS a, sum(l.v * m.v) / (greatest(sqrt(sum(l.v * l.v)), 1e-8) * greatest(sqrt(sum(m.v * m.v)), 1e-8)) AS b FROM l JOIN m ON m.client = l.client AND m.d = l.d JOIN g ON g.y = m.y AND g.d = l.d GROUP BY 1, 2, 3, 4),"
    " t AS (SELECT client, sample, y, k, i, alpha, round(alpha * a + (1 - alpha) * b, 9) AS s FROM j CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS alpha)), p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY sample, i ORDER BY s DESC, k) = 1), a AS (SELECT client, i, alpha, avg(CASE WHEN k = y THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM p GROUP BY 1, 2, 3)"
    " SELECT client, alpha, round(acc, 6) + 0.0 AS accuracy FROM a QUALIFY row_number() OVER (PARTITION BY client ORDER BY round(acc, 9) DESC, i) = 1"
)
def alpha_grid(spark, sf):
    s = vectors(spark, sf)
    own = pr.class_means(s, ["client", "y"])
    shared = own.select("client", "y").join(F.broadcast(pr.class_means(s, ["y"])), "y").select("client", "y", "w")
    return pr.alpha_grid(s, shared, own, ["client"], _ALPHAS).select("client", "alpha", r6("accuracy").alias("accuracy"))


def _kmeans_sql(k: int, steps: int) -> str:
    parts = [f"WITH {L}, o AS (SELECT sample, y, row_number() OVER (PARTITION BY y ORDER BY sample) - 1 AS pos, count(*) OVER (PARTITION BY y) AS n FROM s)"]
    parts.append(f"c0 AS (SELECT o.y, i.i AS centre, l.d, l.v AS c FROM o JOIN (SELECT CAST(range AS INT) AS i FROM range({k})) i ON o.pos = floor(i.i * (o.n - 1) / {k - 1}::DOUBLE) JOIN l ON l.sample = o.sample)")
    for t in range(steps):
        parts.append(f"d{t} AS (SELECT l.sample, l.y, c.centre, round(sqrt(sum((l.v - c.c) * (l.v - c.c))), 9) AS dist FROM l JOIN c{t} c USING (y, d) GROUP BY 1, 2, 3)")
        parts.append(f"a{t} AS (SELECT sample, y, centre FROM d{t} QUALIFY row_number() OVER (PARTITION BY sample ORDER BY dist, centre) = 1)")
        parts.append(f"n{t} AS (SELECT a.y, a.centre, l.d, avg(l.v) AS c FROM a{t} a JOIN l USING (sample) GROUP BY 1, 2, 3)")
        parts.append(f"c{t + 1} AS (SELECT c.y, c.centre, c.d, coalesce(n.c, c.c) AS c FROM c{t} c LEFT JOIN n{t} n USING (y, centre, d))")
    return ", ".join(parts)


@query(_kmeans_sql(3, 3) + f" SELECT y, centre, d, {R.format('c')} AS v FROM c3")
def kmeans_linspace(spark, sf):
    return cells(pr.kmeans(vectors(spark, sf), ["y"], "sample", 3, 3), ["y", "centre"], "c")


@query(_kmeans_sql(3, 1) + ", u AS (SELECT l.sample, l.y, l.d, l.v, l.v / greatest(sqrt(sum(l.v * l.v) OVER (PARTITION BY l.sample)), 1e-8) AS u, sqrt(sum(l.v * l.v) OVER (PARTITION BY l.sample)) AS n FROM l), e AS (SELECT u.sample, c.centre, round(sqrt(sum((u.u - c.c) * (u.u - c.c))), 9) AS dist FROM u JOIN c1 c USING (y, d) GROUP BY 1, 2), b AS (SELECT sample, centre FROM e QUALIFY row_number() OVER (PARTITION BY sample ORDER BY dist, centre) = 1), k AS (SELECT u.sample, u.d, u.n, 0.75 * u.u + 0.25 * c.c AS k FROM u JOIN b USING (sample) JOIN c1 c ON c.y = u.y AND c.centre = b.centre AND c.d = u.d) SELECT sample, d, round(k / greatest(sqrt(sum(k * k) OVER (PARTITION BY sample)), 1e-8) * n, 6) + 0.0 AS v FROM k")
def wasserstein_pull(spark, sf):
    s = vectors(spark, sf)
    return cells(pr.pull(s, pr.kmeans(s, ["y"], "sample", 3, 1), ["y"], 0.25), ["sample"], "x")


# --- rounds and what they leave ---


@query(f"WITH {M} SELECT client, CAST(3 AS INT) AS round, y, round(sqrt(sum(v * v)), 6) + 0.0 AS norm FROM m GROUP BY 1, 3")
def snapshot_roundtrip(spark, sf):
    import uuid

    base = f"{storage.shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    state = pr.class_means(vectors(spark, sf), ["client", "y"])
    storage.save_snapshot(state.withColumn("round", F.lit(1)).unionByName(state.withColumn("round", F.lit(3))), base, "vectors", "averaging", 42, storage.signature({"rate": 0.035}))
    back = storage.load_snapshot(spark, base, dataset="vectors", method="averaging", seed=42, round=3)
    return back.select("client", "round", "y", r6(v.norm("w")).alias("norm"))


@query("SELECT event_id, substr(sha1(props), 1, 10) AS signature FROM events")
def cfg_signature(spark, sf):
    return table(spark, sf, "events").select("event_id", storage.signature_of(F.col("props")).alias("signature"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {S} SELECT client, count(*) FILTER (WHERE len(x) <> 64) AS bad_width, count(*) FILTER (WHERE y NOT BETWEEN 0 AND 9) AS bad_label, count(*) FILTER (WHERE list_aggregate(list_transform(x, lambda a: CASE WHEN isfinite(a) THEN 0 ELSE 1 END), 'sum') > 0) AS bad_value FROM s GROUP BY 1")
def input_validation(spark, sf):
    from vectorloom.operators.checks import bad_samples

    return bad_samples(vectors(spark, sf), 64, 10)


@query(f"WITH {_METRICS}, a AS (SELECT method, round, round(avg(value), 6) AS a FROM m GROUP BY 1, 2), b AS (SELECT l_linestatus AS method, l_linenumber AS round, round(avg(l_discount), 6) AS b FROM lineitem GROUP BY 1, 2) SELECT method, round FROM a JOIN b USING (method, round) WHERE abs(a - b) > 0.0005::DOUBLE")
def contract_violations(spark, sf):
    a = _metric_rows(spark, sf).groupBy("method", "round").agg(F.round(F.avg("value"), 6).alias("value"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("round")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    return reports.violations(a, b, ["method", "round"], "value", 0.0005).select("method", "round")
