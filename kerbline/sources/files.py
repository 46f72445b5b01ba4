"""File sources and sinks: photo lists, outline labels, VOC annotations, CSV tables, evaluation files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.names import base_name

# fixed values: photo extensions, and the explicit annotation schema (a lone object would be inferred as a struct)
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "bmp")
VOC_SCHEMA = ("filename string, size struct<width:int,height:int>, "
              "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>")


def read_image_files(spark: SparkSession, root: str) -> DataFrame:
    """Photos below a folder, path and name only: the content column is pruned, nothing is decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(PHOTO_EXTENSIONS)})$")).withColumn("filename", base_name(F.col("path")))


def tokens_of(line: Column) -> Column:
    """The words of a text label line."""
    return F.split(F.trim(line), r"\s+")


def points_of(tokens: Column) -> Column:
    """Points of an outline from its tokens after the label; an odd last number is dropped. The numbers are bound once, not read again for every point."""
    numbers = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda v: v.try_cast("double"))
    pairs = lambda v: F.floor(F.size(v) / 2).cast("int")
    points = lambda v: F.when(pairs(v) > 0, F.transform(F.sequence(F.lit(0), pairs(v) - 1), lambda k: F.struct(F.get(v, k * 2).alias("x"), F.get(v, k * 2 + 1).alias("y"))))
    return F.get(F.transform(F.array(numbers), points), F.lit(0))


def parse_outline(line: Column) -> Column:
    """(label, pts) of one text label line; an odd last number is dropped."""
    tokens = tokens_of(line)
    return F.struct(F.get(tokens, 0).alias("label"), F.size(tokens).alias("tokens"), points_of(tokens).alias("pts"))


def read_outlines(spark: SparkSession, path: str, min_tokens: int = 7) -> DataFrame:
    """One row per outline of the text label files below ``path``: file, label and points."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("file"), tokens_of(F.col("value")).alias("_t"))
    return lines.where(F.size("_t") >= min_tokens).select("file", F.get("_t", F.lit(0)).alias("label"), points_of(F.col("_t")).alias("pts"))


def read_voc(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """One row per annotation file: frame size, boxes of the wanted class and the number of other objects."""
    xml = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    objects = F.coalesce("object", F.array().cast("array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"))
    mine = F.filter(objects, lambda o: o["name"] == wanted)
    box = lambda o: F.array(*[o["bndbox"][k] for k in ("xmin", "ymin", "xmax", "ymax")])
    return xml.select("filename", F.col("size.width").alias("w"), F.col("size.height").alias("h"), F.transform(mine, box).alias("boxes"),
                      (F.size(objects) - F.size(mine)).alias("n_other"))


def read_table_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV table with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)


def read_json_or_empty(spark: SparkSession, path: str, schema, one_per_file: bool = True) -> DataFrame:
    """Evaluation JSON with a declared schema; a missing file is an empty table, not an error."""
    try:
        return spark.read.json(path, schema=schema, multiLine=one_per_file)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_report(text: Column) -> Column:
    """(accuracy, macro_f1) of a text classification report; null where a line is missing."""
    number = r"([0-9]*\.?[0-9]+)"
    got = lambda pattern, g: F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).cast("double")
    return F.struct(got(rf"accuracy\s+{number}", 1).alias("accuracy"), got(rf"macro avg\s+{number}\s+{number}\s+{number}", 3).alias("macro_f1"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Accuracy and macro F1 of every text report that states an accuracy."""
    r = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), parse_report(F.col("value")).alias("r"))
    return r.where("r.accuracy IS NOT NULL").select(F.regexp_replace("file", r"^classification_report_|\.[^.]*$", "").alias("model"), "r.accuracy", "r.macro_f1", "file")


def number_or_zero(text: Column) -> Column:
    """Feature value of a text cell; anything that is no number reads as 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def read_feature_rows(spark: SparkSession, candidates: list[str], numeric: list[str], max_rows: int | None = None) -> DataFrame | None:
    """Rows of the first of several CSV tables that exists, None if none does. The numeric columns read as numbers, anything else in them as 0; other
    columns stay text. ``max_rows`` keeps the first rows for a display; by default every row is read."""
    for path in candidates:
        try:
            rows = spark.read.csv(path, header=True, escape='"')
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        rows = rows.withColumns({k: number_or_zero(F.col(k)) for k in numeric})
        return rows if max_rows is None else rows.limit(max_rows)
    return None


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Write results so that a rerun replaces them."""
    w = df.write.mode("overwrite").format(form)
    if form == "csv":
        w = w.option("header", True).option("escape", '"')
    (w.partitionBy(*by) if by else w).save(path)


def append_report(df: DataFrame, path: str) -> None:
    """Add rows to a running report."""
    df.write.mode("append").parquet(path)
