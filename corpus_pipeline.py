"""The corpus pipeline: each stage reads what its predecessor wrote.

1. Toxicity: documents that score 0.5 or more go. The grammar is learned from the labelled rows.
2. Line dedup: lines spread over ten or more sources go, but for their first place.
3. SimHash near-dedup: of each group of linked fingerprints the document with the smallest id stays.
4. Mixing: of each source as many words as its target, a row for each time a document is taken.
5. SentencePiece: the ids of each text, their digest and that of the decoded text.

Five stages cannot be said in one SQL statement (learned scores, XXH64 fingerprints, byte-pair merges), so there is
no oracle; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import line_dedup, mixing, piece_bpe, simhash_ball, toxicity
from folio.llm.common import documents, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, grammar)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_ball.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, exact=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", near_dedup),
    ("mix sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
