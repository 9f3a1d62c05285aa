"""A training-data pipeline of five of the operators in ``pulsegrid.llm``; counts as part of that subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and rereads as the next stage's docs. All but the last return the columns of documents.

All stages take texts whole, very long ones as one row of one task, keep all columns, clashing names too, and turn an
empty table into an empty one. Rows that repeat are rows of their own but where a stage says otherwise.

A stage keeps intermediate tables in the shared folder, which its result reads. They are deleted when
the next stage is called, so a result must be written before that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.line_dedup import remove_repeated_lines
from pulsegrid.llm.packing import pack_documents
from pulsegrid.llm.partenum_join import near_duplicate_components
from pulsegrid.llm.quality_rules import keep_good_documents
from pulsegrid.llm.queries import table, vocabulary
from pulsegrid.llm.scratch import delete_tables, recorded, stored
from pulsegrid.llm.secret_scan import mask_secrets


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_tables: list[str] = []


def staged(stage: Stage) -> Stage:
    """``stage``, deleting the intermediate tables of the stage called before."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_tables(spark, _tables)
        _tables.clear()
        with recorded(_tables):
            return stage(spark, docs, sf_dir)

    return call


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; cutoffs come from the labels of the documents given.

    Null and empty texts have too few words and go. Rows with a null id have no label and are judged like others; of
    repeated rows all stay or go together. A document at a cutoff stays.
    """
    return keep_good_documents(docs, table(spark, sf_dir, "labels"))


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go; so do documents of which no word is left, null and empty texts among them.

    The order of documents is that of ids, null ones last; repeated rows are documents of their own, of which the first
    keeps its lines. Of lines that are equally alike the first stays.
    """
    left = remove_repeated_lines(docs).where(F.translate("text", " \t\n\x0b\x0c\r", "") != "")
    return with_length(left).select(*docs.columns)


@staged
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; five-word shingles, 0.8 or more.

    Rows that repeat an id with another text are judged each by its own text; of rows that repeat both
    one stays. Rows with a null id come last; those of them without words all stay.
    """
    empty = F.col("doc_id").isNull() & (F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") == "")
    rows = docs.where(~empty).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = near_duplicate_components(rows, words=5, percent=80, id_col="__key").select(F.col("doc_id").alias("__key"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__key")
    first = found.distinct().join(rows.select("doc_id", "__key"), "__key").groupBy("component_id").agg(F.min(order).alias("least"))
    kept = rows.join(first.select("least.__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return kept.select(*docs.columns).unionByName(docs.where(empty))


@staged
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes. Null and empty texts stay as they are, and each of repeated rows is masked."""
    return with_length(mask_secrets(docs)).select(*docs.columns)


@staged
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences. A null or empty text is the end id alone; rows with a null or repeated id are packed like others."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), keep_words=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: Tokens, components and masked spans are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        written: list[str] = []
        result = stage(spark, docs, sf_dir)
        with recorded(written):
            docs = stored(result, "stage-" + name.replace(" ", "-"))
        delete_tables(spark, before)
        before = written
    return docs
