"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage reads what its predecessor wrote. All but the last return the columns of documents:

    language   drops documents whose language is not determined
    near_dups  keeps one document of each group of near-duplicates
    substrings removes repeated passages from texts
    mix        takes documents for the sources' target weights; a document taken twice is there twice
    pack       cuts the token ids into sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import chunk_dedup, forest_join, language, mixing, packing
from lexiforge.llm.common import discard, materialize, scope
from lexiforge.llm.tokens import public_tokenizer


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. The models are fitted on a bounded sample of docs."""
    return language.keep_accepted(docs, language.fit_on(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8."""
    return forest_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. n_chars follows the new text; every document stays."""
    out = chunk_dedup.dedup_chunks(docs)
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Documents of which the mix takes no word go, those it takes twice are repeated."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    return packing.pack(docs, public_tokenizer("byte_bpe_50k.json"), end_id=1, length=2048, release=True)


STAGES = [
    ("language", language_stage),
    ("near_dups", near_dup_stage),
    ("substrings", substring_stage),
    ("mix", mixing_stage),
    ("pack", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder before the next one reads it. A stage's own tables go when it is written, its output when its successor is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope() as kept:
            done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")


#: The similarity join and the tokenizer cannot be expressed in SQL. Every stage's rows are tested against a plain version on what its predecessor kept (3 against its SQL, 4 by its token ids).
ORACLE_SQL = None
