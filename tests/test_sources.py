import gzip
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom import sinks
from vectorloom.sources import Spec, archive, binary, cached, load, load_specs, nested, text
from vectorloom.streaming import running_means


def test_labelled_csv_and_spoken_letters(spark, tmp_path):
    (tmp_path / "isolet1+2+3+4.data").write_text("".join(f"0.{i}, 0.5, {1 + i % 3}.\n" for i in range(30)) + "x\n")
    (tmp_path / "isolet5.data").write_text("".join(f"0.{i}, 0.5, {1 + i % 3}.\n" for i in range(12)))
    got = text.spoken_letters(spark, str(tmp_path), clients=3, halves=10)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 30, "test": 12}
    assert {r.y for r in got.collect()} == {0, 1, 2} and got.where(F.size("x") != 2).count() == 0


def test_smartphone_aligns_lines(spark, tmp_path):
    for part in ("train", "test"):
        d = tmp_path / part
        d.mkdir()
        (d / f"X_{part}.txt").write_text("".join(f"  {i}.5  -{i}e-1 \n" for i in range(7)))
        (d / f"y_{part}.txt").write_text("".join(f"{1 + i % 2}\n" for i in range(7)))
        (d / f"subject_{part}.txt").write_text("".join(f"{i // 4}\n" for i in range(7)))
    rows = text.smartphone(spark, str(tmp_path)).where("split = 'train'").orderBy("sample").collect()
    assert [(r.client, r.y, r.x[0]) for r in rows] == [(f"subject_{i // 4}", i % 2, i + 0.5) for i in range(7)]


def test_sensor_log_and_activity_monitor(spark, tmp_path):
    (tmp_path / "log3.log").write_text("".join("\t".join(map(str, [*range(23), i % 3])) + "\n" for i in range(6)))
    rows = text.sensor_log(spark, str(tmp_path / "*.log"), skip=(3, 4)).collect()
    assert len(rows) == 4 and {r.y for r in rows} == {0, 1} and len(rows[0].x) == 21 and rows[0].client == "subject_3"
    (tmp_path / "s1.dat").write_text("0.1 5 1.0 NaN\n0.2 5 3.0 2.0\n0.3 0 9 9\n0.4 7 5.0 4.0\n")
    got = {tuple(r.x): (r.client, r.y) for r in text.activity_monitor(spark, str(tmp_path / "*.dat")).collect()}
    assert got == {(1.0, 3.0): ("s1", 0), (3.0, 2.0): ("s1", 0), (5.0, 4.0): ("s1", 1)}


def test_watch_series_in_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("raw/phone/accel/a.txt", "1,B,10,0.1,0.2,0.3;\n1,A,11,1,2,3;\nbroken\n1,A,12,x,2,3;\n")
        z.writestr("raw/phone/gyro/a.txt", "1,C,10,9,9,9;\n")
    rows = text.watch_series(spark, str(tmp_path / "*.zip")).orderBy("time").collect()
    assert [(r.client, r.y, list(r.x)) for r in rows] == [("user_1", 0, [0.1, 0.2, 0.3]), ("user_1", 1, [1.0, 2.0, 3.0])]


def test_archive_members_are_read_in_ranges(spark, tmp_path):
    draw = np.random.default_rng(6)
    texts = {f"raw/m{i}.txt": ["é" * int(n) + str(k) for k, n in enumerate(draw.integers(0, 40, 200))] for i in range(2)}
    for kind, name in ((zipfile.ZIP_DEFLATED, "a.zip"), (zipfile.ZIP_STORED, "b.zip")):
        with zipfile.ZipFile(tmp_path / name, "w", kind) as z:
            for member, lines_ in texts.items():
                z.writestr(member, "\r\n".join(lines_) if name == "b.zip" else "\n".join(lines_) + "\n")
            z.writestr("raw/other.csv", "no")
            z.writestr("raw/m9.txt", "")
    want = sorted((m, i, v) for m, own in texts.items() for i, v in enumerate(own))
    for size in (37, 1000, 1 << 20):
        for where in ("a.zip", "b.zip"):
            got = archive.archive_lines(spark, str(tmp_path / where), "raw/m", size)
            assert sorted((r.member, r.line, r.value) for r in got.collect()) == want
    whole = archive.archive_lines(spark, str(tmp_path / "a.zip"))
    assert whole.rdd.getNumPartitions() == 2  # one per member
    assert archive.archive_lines(spark, str(tmp_path / "*.zip")).count() == 2 * len(want) == archive.archive_lines(spark, str(tmp_path)).count()


def test_phone_events_drop_rows_without_class(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Index,Arrival_Time,x,y,z,User,Device,gt\n0,1000,1,2,3,a,d,walk\n1,2000,1,2,3,a,d,null\n2,,1,2,3,a,d,sit\n")
    assert [(r.user, r.sec, r.gt) for r in text.phone_events(spark, str(tmp_path / "p.csv")).collect()] == [("a", 1.0, "walk")]


def test_federation_keeps_users_of_both_splits(spark, tmp_path):
    for part, users in (("train", "abc"), ("test", "bcd")):
        (tmp_path / part).mkdir()
        (tmp_path / part / "s.json").write_text(json.dumps({"users": list(users), "user_data": {u: {"x": [[1, 2], [3, 4]], "y": [0, 1]} for u in users}}))
    rows = nested.federation(spark, str(tmp_path))
    assert {r.client for r in rows.collect()} == {"b", "c"} and rows.count() == 8
    assert nested.federation(spark, str(tmp_path), limit=1).select("client").distinct().count() == 1


def test_images(spark, tmp_path):
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    (tmp_path / "x.gz").write_bytes(gzip.compress(struct.pack(">HBB3I", 0, 8, 3, 2, 3, 4) + pixels.tobytes()))
    (tmp_path / "y").write_bytes(struct.pack(">HBBI", 0, 8, 1, 2) + bytes([7, 9]))
    rows = binary.images(spark, str(tmp_path / "x.gz"), str(tmp_path / "y")).orderBy("sample").collect()
    assert [r.y for r in rows] == [7, 9] and np.allclose(rows[1].x, np.arange(12, 24) / 255)


def test_load_prepares_samples(spark, tmp_path):
    data = [(c, i, i % 2, [float(i), 1.0]) for c in range(3) for i in range(20)] + [(9, 0, 0, [1.0, 1.0])]
    spark.createDataFrame(data, "client int, sample int, y int, x array<double>").write.parquet(str(tmp_path / "t"))
    (tmp_path / "specs.json").write_text(json.dumps({"datasets": [{"name": "t", "source": "table", "path": str(tmp_path / "t"), "normalisation": "l2", "most_train": 6}]}))
    spec = load_specs(spark, str(tmp_path / "specs.json"))[0]
    assert spec == Spec("t", "table", str(tmp_path / "t"), "l2", most_train=6)
    n = {(r.client, r.split): r["count"] for r in load(spark, spec).groupBy("client", "split").count().collect()}
    assert n == {(c, s): k for c in range(3) for s, k in (("train", 6), ("test", 6))}


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "y int, z int")
    sinks.write_csv([a, b], str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["x", "y", "z"]
    try:
        sinks.write_csv([a], str(tmp_path / "c"))
        raise AssertionError("overwrote")
    except Exception as e:
        assert "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    sinks.write_report(a, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r/markdown")).count() == 3


def test_running_means_over_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "client int, y int, x array<double>"
    spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 0, [3.0, 4.0]), (1, 0, [5.0, 6.0])], schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = running_means(stream).writeStream.outputMode("update").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.client: (r.n, list(r.w)) for r in spark.table("means").collect()}
    assert got == {0: (2, [2.0, 3.0]), 1: (1, [5.0, 6.0])}


def test_a_half_written_cache_is_made_anew(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "c"))
    (tmp_path / "c" / "_SUCCESS").unlink()
    assert cached(spark, str(tmp_path / "c"), lambda: spark.range(3)).count() == 3


def test_cached_tables_are_made_once(spark, tmp_path):
    made = []
    for _ in range(2):
        assert cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]


def test_phone_windows_join_both_series(spark, tmp_path):
    from vectorloom.sources.registry import Spec, load

    def series(name, k, shift):
        lines = ["Arrival_Time,x,y,z,User,Device,gt"]
        for user in "ab":
            lines += [f"{1000 + 50 * i + shift},{i * k},{i},0,{user},d,{'sit' if i < 60 else 'walk'}" for i in range(140)]
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    spec = Spec("phones", "phone_events", series("acc.csv", 1, 0), options={"gyroscope": series("gyro.csv", 2, 25), "width": 10, "stride": 10}, least=1)
    rows = load(spark, spec).collect()
    assert {r.client for r in rows} == {"a", "b"} and all(len(r.x) == 60 for r in rows) and {r.y for r in rows} == {0, 1}
    first = min((r for r in rows if r.client == "a"), key=lambda r: r.x[1])
    assert np.isclose(first.x[6 * 3 + 3], 2 * (first.x[6 * 3 + 1] - 0.5))  # the gyroscope half a step earlier


def test_fixture_manifest_and_console_table(spark, tmp_path):
    from vectorloom import sinks

    df = spark.createDataFrame([(1, "a", 0.5), (20, None, 1.25)], "k int, name string, v double")
    sinks.write_fixture(df, str(tmp_path / "f"), seed=3)
    assert sorted(sinks.read_fixture(spark, str(tmp_path / "f")).collect()) == sorted(df.collect())
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "f" / "data"))
    with pytest.raises(ValueError):
        sinks.read_fixture(spark, str(tmp_path / "f"))
    assert sinks.aligned(df.orderBy("k")).splitlines() == [" k  name       v", " 1  a     0.5000", "20        1.2500"]
    with pytest.raises(ValueError):
        sinks.aligned(df, most=1)


def mat_file(path, order="<", packed=False, **arrays):
    """A MATLAB 5 file, written by hand."""
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    element = lambda kind, b: struct.pack(f"{order}II", kind, len(b)) + pad(b)
    kinds = {"f8": (9, 6), "u1": (2, 9), "i2": (3, 10)}
    out = b"MATLAB 5.0".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, a in arrays.items():
        number, cls = kinds[a.dtype.str[1:]]
        raw = a.astype(a.dtype.newbyteorder(order)).tobytes(order="F")
        small = struct.pack(f"{order}I", len(name) << 16 | 1) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        body = element(6, struct.pack(f"{order}II", cls, 0)) + element(5, struct.pack(f"{order}2i", *a.shape)) + small + element(number, raw)
        whole = element(14, body)
        out += struct.pack(f"{order}II", 15, len(zlib.compress(whole))) + zlib.compress(whole) if packed else whole
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(out)


@pytest.mark.parametrize("order,packed", [("<", False), ("<", True), (">", True)])
def test_matlab_files(spark, tmp_path, order, packed):
    draw = np.random.default_rng(0)
    emg, glove = draw.normal(size=(30, 3)), draw.normal(size=(30, 2))
    move = (np.arange(30)[:, None] % 4).astype("u1")
    for subject, exercise in ((1, 1), (1, 2), (2, 3)):
        mat_file(tmp_path / "db" / f"S{subject}_A1_E{exercise}.mat", order, packed, emg=emg, glove=glove, restimulus=move, odd=np.array([[1, 2]], "i2"))
    got = binary.hand_movements(spark, str(tmp_path / "db"), "both").collect()
    assert len(got) == 3 * 22 and {r.client for r in got} == {"subject_1", "subject_2"}
    assert {r.y for r in got if r.client == "subject_2"} == {29, 30, 31} and {r.y for r in got if r.client == "subject_1"} == {0, 1, 2, 12, 13, 14}
    want = {tuple(np.round([*e, *g], 9)) for e, g, m in zip(emg, glove, move[:, 0]) if m}
    assert {tuple(np.round(r.x, 9)) for r in got} == want
    mat_file(tmp_path / "usc" / "Subject3" / "a5t2.mat", order, packed, sensor_readings=emg)
    rows = binary.daily_activities(spark, str(tmp_path / "usc")).collect()
    assert len(rows) == 30 and {(r.client, r.trial, r.y) for r in rows} == {("Subject3", 2, 4)} and np.allclose([r.x for r in sorted(rows, key=lambda r: r.sample)], emg)
