"""Steps whose tasks stay bounded: limits of few groups meet the rows where they are, outline numbers are read once, and rows for fits are stored plainly."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kerbline.operators import learning as L
from kerbline.operators import quality as Q
from kerbline.sources.files import parse_outline


def test_limits_of_few_groups_are_broadcast(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 4, 1e6).otherwise(F.col("id") % 50).alias("v"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept, n in ((Q.sigma_trim(df, ["g"], "v", 2.0, 1), 2996), (Q.trim_percentile(df, ["g"], "v", 0.0, 0.99), 2996)):
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert kept.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_outline_numbers_are_read_once(spark):
    assert str(parse_outline(F.col("v"))).count("slice(") == 1
    rows = [" 3 0.1 0.2  0.3 x 0.5", "1", "", None, "2 0.5"]
    got = spark.createDataFrame([(v,) for v in rows], "v string").select(parse_outline(F.col("v")).alias("o")).collect()
    assert [r.o.label for r in got] == ["3", "1", "", None, "2"] and [r.o.pts for r in got][1:] == [None] * 4
    assert [(p.x, p.y) for p in got[0].o.pts] == [(0.1, 0.2), (0.3, None)]


def test_rows_for_fits_are_stored_plainly(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(L, "new_folder", lambda s, name: f"{tmp_path}/{name}")
    df = spark.range(1000).select((F.col("id") % 3).cast("double").alias("y"))
    assert sorted(r.y for r in L.training_rows(df, "rows").collect()) == sorted(r.y for r in df.collect())
    for f in glob.glob(f"{tmp_path}/rows/*.parquet"):
        column = pq.ParquetFile(f).metadata.row_group(0).column(0)
        assert column.compression == "UNCOMPRESSED" and not column.has_dictionary_page
