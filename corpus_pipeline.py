"""Corpus pipeline over ``documents``: language, near duplicates, contamination, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import materialise, new_folder
from kerbline.llm.decontaminate import decontaminate
from kerbline.llm.language_id import held_out, identify
from kerbline.llm.minhash import near_dedup
from kerbline.llm.mixing import mix
from kerbline.llm.token_files import read_tokens, write_tokens


def packed(docs: DataFrame, *named: str) -> DataFrame:
    """The columns that a stage reads, and the whole row as ``_doc``: so no column of the input, whatever its name, meets one that an operator adds."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"), *[docs[f"`{c}`"] for c in named])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability of one half or more. Null and empty texts and those without a letter go; rows with a null language or id are not learned
    from; repeated rows share their fate, of equally likely languages the first counts. An empty table stays empty, and columns of any name come back as they were."""
    told = identify(packed(docs, "doc_id", "text", "lang"), F.col("doc_id").isNotNull() & ~held_out(), public_tokenizers.path("piece_bpe_32k.model"))
    return told.where("lang_pred <> 'und' and score >= 0.5").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: four fifths of the five-word shingles or more in common. The smallest id stays; rows that share it all stay, as do null and empty
    texts and rows with a null id. An empty table stays empty, and columns of any name come back as they were."""
    return near_dedup(packed(docs, "doc_id", "text"), percent=80).where("kept").select("_doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items cover less than a twentieth of the words. Null and empty texts stay, repeated rows share their fate. An empty table stays empty, and columns of
    any name come back as they were."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate(packed(docs, "doc_id", "text"), items).where("not contaminated").select("_doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks for; a text that the last block cuts keeps its first words. Null and empty texts stay where their block is drawn, a null
    source is one source, repeated rows share their fate. An empty table stays empty, and columns of any name come back as they were."""
    drawn = mix(packed(docs, "doc_id", "text", "source"))
    return drawn.select(*[F.col("text").alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens and ids_crc32 of every document in them, in order of id. A null text is an empty one; repeated rows are written as
    often as they come. An empty table gives none."""
    path = new_folder(spark, "token_files")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("language identification", language), ("near-duplicate removal", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token files", tokens)]
#: The stages hold fitted models, seeded draws and a tokenizer, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "pipeline")
    return docs
