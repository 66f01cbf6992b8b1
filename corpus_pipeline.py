"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality: the nearest-neighbour vote rejects low-quality documents.
2. lines: lines similar to earlier ones are removed from texts.
3. near_duplicates: one document of each group of similar documents stays.
4. substrings: strings of 100 bytes that start earlier in the corpus are removed.
5. packing: what is left is tokenized and packed into sequences of 4,096 tokens.

A text that loses all its lines or bytes stays as an empty document. Null texts are
scored like empty ones. Rows with a null id are never dropped as near duplicates.
Of rows that tie in a group of similar documents the smallest id stays; rows that repeat
id and text are one document and share its fate. Texts are taken whole, however long.
An empty table passes through all stages as an empty one. Further columns may have any
name but ``__rest``; they are carried in one struct.

This module needs ``seagrid.llm``; without it, it can't be imported.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm.common import materialize, table
from seagrid.llm.jaccardjoin import jaccard_components
from seagrid.llm.knnquality import fit, score_documents
from seagrid.llm.linededup import remove_repeated_lines
from seagrid.llm.packing import pack_pieces, tokenize_pieces
from seagrid.llm.suffixdedup import remove_repeats, whole_characters

#: Documents with a lower score are rejected.
LEAST_SCORE = 0.7
#: Up to so many ids of dropped documents are broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000


def _bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and one struct of all other columns, whose names can't meet those of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *others).alias("__rest"))


def _spread(bundled: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; the number of characters is that of the text."""
    types = dict(like.dtypes)
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return bundled.select(*((made[c] if c in made else F.col("__rest").getField(c)).cast(types[c]).alias(c) for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    space = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(_bundled(docs), space, keep=["doc_id", "text", "__rest"])
    return _spread(scored.filter(F.col("score") >= LEAST_SCORE), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _spread(remove_repeated_lines(_bundled(docs), keep=["doc_id", "__rest"]), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_components(docs, words=5, num=80, den=100)
    later = materialize(groups.filter("component_id <> doc_id").select("doc_id"), "later")
    few = later.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(later) if few else later, "doc_id", "left_anti").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_bundled(docs), window=100, keep=["__rest"])
    return _spread(kept.withColumn("text", whole_characters(F.col("kept"))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack_pieces(pieces, payload=[F.crc32("ids").alias("ids_crc32")])


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: Similarity joins with exact thresholds, tokenizers and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
