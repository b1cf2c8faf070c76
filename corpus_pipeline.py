"""A corpus pipeline of four operators, each over all that its predecessor kept.

Stages: quality classifier (rejected documents go), line dedup (frequent lines go), n-gram Jaccard join (one
document of each class stays), packing.  Counted as part of ``eventide.llm``.

Defined cases: null texts count as empty; null ids are scored and deduplicated like others, never joined, and packed;
of repeated rows the join keeps one, and of one id with several texts all or none; blank texts are classes of their own and stay;
very long texts are taken whole; ties: a score at the threshold stays, of equal documents the least id; an empty table gives an empty result; further columns of the documents are carried to the
last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import shared_dir, table
from eventide.llm.jaccard_join import jaccard_classes
from eventide.llm.line_dedup import drop_lines
from eventide.llm.packing import pack
from eventide.llm.quality import THRESHOLD, statistics_of, text_score_column, train


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier is fitted on the labelled ones among them."""
    labels = table(spark, sf_dir, "labels")
    model = train(statistics_of(docs, ["doc_id"]), labels)
    return docs.where(text_score_column(model) >= THRESHOLD)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that ten or more of them share; ``n_chars`` follows the text."""
    out = drop_lines(docs)
    columns = [F.col("kept").alias(c) if c == "text" else F.char_length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id; documents without an id stay.

    Rows of one id are one document: they all stay if one of their texts leads a class, equal ones once.
    """
    firsts = jaccard_classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(firsts, "doc_id", "left_semi").withColumns({"_hash_a": F.xxhash64("text"), "_hash_b": F.xxhash64(F.lit("#"), "text")})
    return kept.dropDuplicates(["doc_id", "_hash_a", "_hash_b"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_frequent_lines),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("packing", pack_sequences),
]

#: No SQL: the classifier's fit, MinHash candidates and online packing are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
