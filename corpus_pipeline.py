"""From raw documents to packed sequences: language, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of the documents table, and returns a DataFrame; all but
the last return those columns. Every stage works on all rows that its predecessor kept. Empty tables pass through; rows
with null texts go in the first stage, as texts without letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import decontaminate, language, packing, repeats, simhash
from tapeloom.llm.store import Scratch
from tapeloom.llm.workers import quoted

#: a document goes if its language's share is lower; over the four or more languages of a corpus this is near a guess
LEAST_SCORE = 0.3
#: a repeated passage of more words goes; no such passage has fewer bytes than that many words of one letter and their gaps
MOST_REPEATED = 50
SHORTEST = 2 * MOST_REPEATED + 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language the network can't tell, go."""
    names = ("predicted language", "language score")
    got = language.predicted(docs, language.fit(docs), names)
    return got.where((F.col(f"`{names[0]}`") != "und") & (F.col(f"`{names[1]}`") >= LEAST_SCORE)).select(*quoted(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints within 4 bits, or five-word shingles of a similarity of 0.8) the row with the
    smallest doc_id stays, of equal ids one text in a fixed order; null ids come last, and all empty texts are one group."""
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or 400 bytes, that occur twice go; so do documents of which nothing is left."""
    return repeats.without_repeats(docs, SHORTEST, MOST_REPEATED + 1).select(*quoted(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go; a null text has none. Without items all stay."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 4,096 tokens. A row is packed as often as it occurs, a null text is its
    end token alone, a longer text falls into pieces; of pieces of one length any may come first."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: the classifier, XXH64 fingerprints and the tokenizer can't be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
