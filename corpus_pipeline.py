"""The corpus pipeline: five stages over ``documents``, each one of the training-data operators.

Every stage takes the columns of ``COLUMNS`` and leaves out any others its input
has, whatever their names; all but the last return the same columns.  Null and
empty texts have no letter, so language ID drops them; a stage that gets them
all the same treats null as empty.  Rows without doc_id and repeated rows go
through every stage like others, but near-dedup keeps one of those equal in
doc_id and text.  Texts of any length are read whole.  An empty table passes
every stage as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repsight.llm import language, packing, quality, secrets, simhash
from repsight.session import prepare
from repsight.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits per byte from which no known language explains a text; bytes by chance take 8.
STRANGE = 7.5
LOW_QUALITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter and texts that no learned language explains go; a missing lang is filled in."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = language.train(docs)
    found = language.predict(docs, model, append=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < STRANGE)) if model else docs.where(
        F.col("text").rlike(r"\p{L}")
    ).withColumn("lang_pred", F.col("lang"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below ``LOW_QUALITY`` go."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.score(docs, model, append=True).where(F.col("quality_score") >= LOW_QUALITY).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document of the smallest doc_id stays."""
    prepare(spark)
    return simhash.deduplicate(docs.select(*COLUMNS), shingle=4, max_bits=4)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every found span is blotted out, and n_chars follows."""
    prepare(spark)
    return secrets.redact(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of at most 2048 ids: one row per piece, with its ids."""
    prepare(spark)
    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]
#: SQL can't express the models, XXH64 and the tokenizer; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied one after another to all documents of ``sf_dir``, with a checkpoint behind each."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint(eager=True)
    return STAGES[-1][1](spark, docs, sf_dir)
