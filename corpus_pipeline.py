"""From raw documents to packed sequences: a pipeline of five operators, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, scratch, settle
from gridloom.llm.decontaminate import contaminated
from gridloom.llm.linededup import lines_removed
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import keep_quality
from gridloom.llm.simhash import near_duplicates
from gridloom.llm.tokens import public_path

#: Words of a fingerprint's shingles, fingerprints of a document, differing bits in one of them up to which two documents
#: are compared, and the similarity of five-word shingles asked for. README has the pairs that other values lose.
NEAR_WORDS, NEAR_PRINTS, NEAR_BITS, NEAR_SIMILARITY = 2, 3, 7, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document of which no text stays goes."""
    cut = lines_removed(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    kept = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(kept[c].alias(c) for c in docs.columns))


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written so that it stays the same."""
    return settle(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id, null ids last; of rows with an equal id the
    first as read.

    Groups are of rows, whatever their ids: of repeated rows one stays, different texts under one id are judged each by
    itself, and rows without an id go like any others. Null and empty texts are near-duplicates of each other.
    """
    rows = _numbered(docs)
    found = near_duplicates(rows, NEAR_WORDS, NEAR_BITS, id_col="_row", similarity=NEAR_SIMILARITY, prints=NEAR_PRINTS)
    found = found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = found.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, whatever their ids: a row goes for its own text only, one without an id too."""
    rows = _numbered(docs)
    leaks = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return rows.join(leaks.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack_documents(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the fingerprints and the packing can't be put into SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = settle(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
