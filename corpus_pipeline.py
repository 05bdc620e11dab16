"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again as the next stage's docs. All
stages but the last return the columns of documents; further columns of the
input are left behind. Every stage works on all that its predecessor kept, and
gives an empty result for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeassess.llm.near_copies import near_copies
from lakeassess.llm.packing import TOKENIZER, pack_documents
from lakeassess.llm.quality import fit_lines, judge
from lakeassess.llm.secret_scan import fit_runs, redact
from lakeassess.llm.simhash import one_of_each
from lakeassess.llm.store import ship, stored
from lakeassess.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough content lines.

    The line model is fitted to the labels of ``sf_dir``. Null, empty and very
    short texts go.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, fit_lines(docs, labels)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every group of near duplicates: texts whose sets of
    five-word shingles have a Jaccard similarity of at least 0.8.

    Of rows that repeat a doc_id one stays. Rows without doc_id stay.
    """
    docs = docs.select(*COLUMNS)
    return one_of_each(docs, near_copies(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that an earlier document has too.

    What is left is joined by single spaces; untouched texts stay as they are.
    Documents of which nothing is left go.
    """
    found = remove_repeats(docs.select(*COLUMNS))
    cut = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _counted(cut.where("n_removed = 0 or n_removed < n_words"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; no document goes."""
    docs = docs.select(*COLUMNS)
    return _counted(redact(docs, fit_runs(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of every document lies in sequences of at most 2048."""
    return pack_documents(docs.select(*COLUMNS), public_tokenizers.path(TOKENIZER))


def _stage(run):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, docs, sf_dir)

    return stage


STAGES = [(run.__name__, _stage(run)) for run in (quality, near_duplicates, substrings, secrets, packing)]

# SQL has no fitted model of lines; the pipeline is tested against its parts by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
