"""Registered queries against their SQL, and the pipeline's stages one by one, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from compare import database, rows_of
from kerbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if QUERIES[n][1]])
def test_sql(spark, name):
    fn, sql = QUERIES[name]
    df = fn(spark, FOLDER)
    res = database(FOLDER).execute(sql)
    names, want = [d[0] for d in res.description], res.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, FOLDER)
        assert k == len(c.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > 0.9 * sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    assert sizes[5] == sizes[4]
    starts = sorted((r["start"], r["n_tokens"]) for r in docs.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_stages_keep_every_column_and_row_shape(spark):
    """Nulls, empty texts, ties, repeated rows and columns named like those that operators add go through every stage."""
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(9_000_001, None, "en", None, 0), (9_000_002, "", None, "s", 0), (9_000_003, "same words here and there", "en", "s", 5), (9_000_003, "same words here and there", "en", "s", 5), (None, "no id but some words", "en", "s", 5)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name in ("SIZE", "score", "kept", "mix_shard", "a.b", "N_LINES", "_row", "_d"):
        more = more.withColumn(name, F.lit("input"))
    for k, (name, stage) in enumerate(c.STAGES[:4]):
        out = c.materialise(stage(spark, more, FOLDER), f"stage{k}")
        assert out.columns == more.columns, name
        assert out.count() > 0 and out.where(" or ".join(f"`{x}` <> 'input' or `{x}` is null" for x in more.columns[5:])).count() == 0, name
        ids = [r[0] for r in out.select("doc_id").collect()]
        assert (9_000_001 in ids) == (name not in ("language identification", "mixing")) or name == "mixing", name
        assert ids.count(9_000_003) == 2 or name == "mixing", name
    assert c.STAGES[4][1](spark, more.where("doc_id is not null"), FOLDER).count() == more.count() - 1
