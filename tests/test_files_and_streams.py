"""Sources, sinks and streams on files the test writes."""

import os

from pyspark.sql import functions as F

from kerbline.sources import files as I
from kerbline.streaming import streams as K

VOC = "<annotation><filename>{0}.jpg</filename><size><width>640</width><height>480</height></size>{1}</annotation>"
BOX = "<object><name>{0}</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object>"


def test_sources(spark, tmp_path):
    (tmp_path / "img" / "a").mkdir(parents=True)
    for name in ("a/one.JPG", "two.png", "note.txt"):
        (tmp_path / "img" / name).write_bytes(b"x")
    assert sorted(r["filename"] for r in I.read_image_files(spark, str(tmp_path / "img")).collect()) == ["one.JPG", "two.png"]
    os.mkdir(tmp_path / "voc")
    (tmp_path / "voc" / "a.xml").write_text(VOC.format("a", BOX.format("D40") + BOX.format("D00")))
    (tmp_path / "voc" / "b.xml").write_text(VOC.format("b", ""))
    got = {r["filename"]: (r["boxes"], r["n_other"], r["w"]) for r in I.read_voc(spark, str(tmp_path / "voc"), "D40").collect()}
    assert got == {"a.jpg": ([[1.0, 2.0, 30.0, 40.0]], 1, 640), "b.jpg": ([], 0, 640)}
    assert I.read_json_or_empty(spark, str(tmp_path / "absent.json"), "a int").count() == 0
    (tmp_path / "classification_report_rf.txt").write_text("x\naccuracy   0.91 40\nmacro avg 0.9 0.8 0.85 40\n")
    r = I.read_reports(spark, str(tmp_path / "classification_report_rf.txt")).first()
    assert (r["model"], r["accuracy"], r["macro_f1"]) == ("rf", 0.91, 0.85)


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows behind the watermark do not enter a window that was given out; the batch count is the truth."""
    def put(n, seconds):
        df = spark.createDataFrame([(s,) for s in seconds], "s int").select(F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.parquet(f"{tmp_path}/part{n}")
        for f in os.listdir(f"{tmp_path}/part{n}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                os.rename(f"{tmp_path}/part{n}/{f}", f"{tmp_path}/in/{n}.parquet")
                os.utime(f"{tmp_path}/in/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))

    put(0, [10, 20])
    put(1, [20000])
    put(2, [20005])
    put(3, [30, 20010])
    put(4, [40000])
    s = K.read_stream(spark, f"{tmp_path}/in", "at timestamp", per_trigger=1)
    out = K.drain(K.counts(s, [], "at", "1 hour", "1 hour"), "late").orderBy("window_start").collect()
    assert [r["n"] for r in out] == [2, 3]


def test_first_existing_feature_table(spark, tmp_path):
    from kerbline.sources.files import read_feature_rows, read_json_or_empty
    (tmp_path / "b.csv").write_text("key,depth\nx,1.5\ny,n/a\nz,\n")
    rows = read_feature_rows(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], ["depth"])
    assert [tuple(r) for r in rows.collect()] == [("x", 1.5), ("y", 0.0), ("z", 0.0)]
    assert read_feature_rows(spark, [f"{tmp_path}/b.csv"], ["depth"], 2).count() == 2
    assert read_feature_rows(spark, [f"{tmp_path}/a.csv"], ["depth"]) is None
    assert read_json_or_empty(spark, f"{tmp_path}/none.json", "k long").count() == 0


def test_asof_in_state_equals_batch(spark, tmp_path):
    """Frames and starts that arrive late and out of order, in several micro-batches, against the batch join; what the watermark dropped is known."""
    import datetime
    import random

    from kerbline.operators.joins import asof
    rng, base = random.Random(6), datetime.datetime(2026, 1, 1)
    rows = [(f"k{rng.randrange(3)}", base + datetime.timedelta(minutes=m + rng.choice([0, 0, -20, -50])), n, rng.random() < 0.2) for n, m in enumerate(range(0, 1200, 3))]
    schema = "key string, at timestamp, id long, start boolean"
    for k in range(4):
        spark.createDataFrame(rows[k * 100:k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: K.read_stream(spark, f"{tmp_path}/in", schema, per_trigger=1)
    out = K.asof_drive(stream().where("not start"), stream().where("start").withColumnRenamed("id", "sid"), ["key"], "at", "id", "sid", "1 hour", "drive")
    got = {r["id"]: (r["key"], r["at"], r["drive"]) for r in K.drain(out, "asof_state").collect()}
    whole = spark.createDataFrame(rows, schema)
    want = {r["id"]: (r["key"], r["at"], r["drive"]) for r in asof(whole.where("not start").drop("start"), whole.where("start").select("key", "at", "id"), ["key"], "at", "at", "id", "drive").collect()}
    mark = max(r[1] for r in rows) - datetime.timedelta(hours=1)
    assert got == {i: v for i, v in want.items() if v[1] < mark}                  # nothing here is later than an hour


def test_ridge_per_fold(spark):
    import numpy as np

    from kerbline.operators.learning import ridge_folds, ridge_out_of_fold
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1, 50, 0.01] + [5, -20, 3]
    y = x @ [2.0, -0.3, 40.0] + rng.normal(size=240)
    rows = [(i % 2, i % 3, *map(float, v), 7.0, float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(0, 1, None, 1.0, 1.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "repeat int, fold int, a double, b double, c double, flat double, y double")
    got = {(r["repeat"], r["fold"]): r for r in ridge_folds(df, ["repeat", "fold"], ["a", "b", "c", "flat"], "y", 2.0).collect()}
    for repeat in range(2):
        for fold in range(3):
            train = [i for i in range(240) if i % 2 == repeat and i % 3 != fold]
            mean, sd = x[train].mean(0), x[train].std(0)
            z, c = (x[train] - mean) / sd, y[train] - y[train].mean()
            w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ c) / sd
            r = got[repeat, fold]
            assert r["n"] == len(train) and np.allclose(r["coef"], [*w, 0.0]) and np.isclose(r["intercept"], y[train].mean() - w @ mean)
    p = ridge_out_of_fold(df, ["repeat", "fold"], ["a", "b", "c", "flat"], "y")
    assert p.count() == 241 and p.where("prediction is null").count() == 1 and p.columns[-1] == "prediction"


def test_annotation_files_stay_small(spark, monkeypatch):
    from kerbline.plans import flows
    from kerbline.plans.catalog import CATALOG
    from kerbline.plans.registry import Tables
    monkeypatch.setattr(flows, "ROWS_PER_FILE", 1000)
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = t.lineitem.count()
    read = CATALOG["read_voc"][0](t)
    assert read.count() == rows and len(read.inputFiles()) >= rows // 1000


def test_annotation_files_take_less_than_their_table(spark, monkeypatch, tmp_path):
    from kerbline.plans import flows
    from kerbline.plans.catalog import CATALOG
    from kerbline.plans.registry import Tables
    monkeypatch.setattr(flows, "new_folder", lambda s, name: f"{tmp_path}/{name}")
    t = Tables(spark, "/root/testdata/sf0.01")
    read = CATALOG["read_voc"][0](t)
    written = sum(os.path.getsize(f.removeprefix("file://")) for f in read.inputFiles())
    assert written < os.path.getsize(t.path("lineitem")) and read.count() == t.lineitem.count()


def test_asof_keys_share_calls(spark, tmp_path):
    """Calls on the state are bounded by the groups, not by the keys; keys of any plain kind, null and signed zero among them, keep their own starts and come back as they were."""
    import datetime
    import random
    from decimal import Decimal

    from kerbline.operators.joins import asof
    rng, base = random.Random(8), datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    keys = [(None, None, None, None, None), (0.0, 1 << 62, "a", bytearray(b"\xff"), Decimal("1.50")), (-0.0, 1 << 62, "a", bytearray(b"\xff"), Decimal("1.50")), (-0.0, (1 << 62) + 1, "a", bytearray(b"\xff"), Decimal("1.50")), (0.0, 1 << 62, None, bytearray(b""), Decimal("1.50")),
            (float("nan"), -1, "", None, Decimal("-2.25")), (0.1, 5, "é|,", bytearray(b"x"), None)] + [(0.5, i, "z", bytearray(b"y"), Decimal(i)) for i in range(60)]
    schema = "w double, k long, s string, b binary, d decimal(10,2), o timestamp, at timestamp, id long, start boolean"
    rows = [(*rng.choice(keys), base + datetime.timedelta(microseconds=1), base + datetime.timedelta(minutes=m // 3), n, rng.random() < 0.3) for n, m in enumerate(range(0, 3000, 2))]
    for k in range(3):
        spark.createDataFrame(rows[k * 500:k * 500 + 500], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: K.read_stream(spark, f"{tmp_path}/in", schema, per_trigger=1)
    by = ["w", "k", "s", "b", "d", "o"]
    out = K.asof_drive(stream().where("not start"), stream().where("start").withColumnRenamed("id", "sid"), by, "at", "id", "sid", "1 hour", "drive", groups=4)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4
    done = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    assert done.select(*by, "at").schema.simpleString() == spark.createDataFrame([], schema).select(*by, "at").schema.simpleString()
    whole = spark.createDataFrame(rows, schema)
    want = asof(whole.where("not start").drop("start"), whole.where("start").select(*by, "at", "id"), by, "at", "at", "id", "drive")
    mark = max(r[6] for r in rows) - datetime.timedelta(hours=1)
    named = lambda df: sorted(map(repr, df.select("id", F.hash(*by), F.unix_micros("at").alias("at"), "drive").where(F.col("at") < int(mark.timestamp()) * 1_000_000).collect()))
    got = named(done)
    assert got == named(want) and len(got) > 500
