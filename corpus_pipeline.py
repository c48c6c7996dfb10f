"""Documents from raw to encoded, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a table: all but the last the
columns of documents, with what the stage has decided done to the rows. A null
text is handled as an empty one; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import byte_bpe, decontaminate, jaccard, line_dedup, simhash, toxicity
from recordloom.llm.common import staged, table
from recordloom.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    ship(spark)
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; n_chars follows."""
    ship(spark)
    return line_dedup.with_length(line_dedup.drop_repeated(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles, found by SimHash and MinHash) stays."""
    ship(spark)
    return simhash.one_of_each(docs, groups=jaccard.groups)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of the benchmark go."""
    ship(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with the digests of the ids and of what they decode to."""
    ship(spark)
    return byte_bpe.encode(docs.select("doc_id", "text"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: SQL cannot express the severity model or the encoding. The tests hold near duplicates, each other stage's
#: operator, and the whole on a table of which each of the first four stages takes something, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
