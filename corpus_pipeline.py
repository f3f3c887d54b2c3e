"""A corpus pipeline of five of the operators; each stage's result is written and read again.

Every stage takes null ids and texts, empty tables, repeated rows and further columns of any name, and returns
the columns it got (packing: pieces). A row is told by its doc_id and the digest of its text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidkin.llm import decontaminate, packing, secrets, setsketch, toxicity
from vidkin.llm.store import stage


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs under names that clash with nothing, and the new names of doc_id and text."""
    names = [f"c{n}" for n in range(len(docs.columns))]
    return docs.toDF(*names), *[names[docs.columns.index(c)] for c in ("doc_id", "text")]


def _without(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """Rows of docs whose keys aren't those of a row of gone; keys are held null-safe."""
    same = reduce(and_, [k.eqNullSafe(gone[c]) for k, c in zip(keys, gone.columns, strict=True)])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression model scores as toxic go; empty tables and null texts pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels.filter(~held_out)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least doc_id, and of its repeated rows one.
    Rows without an id go where a row with one holds the same words; texts without words have no group."""
    rows, doc_id, text = _plain(docs)
    rows = rows.withColumn("blob", secrets.address(F.col(text)))
    groups = setsketch.near_duplicates(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "blob"), words=5, percent=80, keep=("blob",))
    gone = groups.filter(~F.coalesce("kept", F.col("component_id").isNull())).select(F.col("doc_id").alias("gone"), F.col("blob").alias("gone_blob")).distinct()
    left = _without(rows, gone, rows[doc_id], rows["blob"]).dropDuplicates([doc_id, "blob"])
    return left.drop("blob").toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, each row by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, _, text = _plain(docs)
    rows = rows.withColumn("blob", secrets.address(F.col(text)))
    found = decontaminate.contaminated(rows.select(F.col("blob").alias("doc_id"), F.col(text).alias("text")), benchmark)
    return _without(rows, found.select(F.col("doc_id").alias("gone")).distinct(), rows["blob"]).drop("blob").toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by a mark; all documents stay."""
    scanned, _, _ = secrets.scan(docs)
    found = scanned.filter(F.size("spans") > 0).select(F.col("doc_id").alias("at"), "blob", "spans").dropDuplicates(["at", "blob"])
    rows, doc_id, text = _plain(docs)
    both = rows.join(found.hint("shuffle_hash"), rows[doc_id].eqNullSafe(found["at"]) & (secrets.address(rows[text]) == found["blob"]), "left")
    clean = F.when(F.col("spans").isNull(), F.col(text)).otherwise(secrets.redact(F.col(text), F.col("spans")))
    new = {text: clean}
    if "n_chars" in docs.columns:
        n = rows.columns[docs.columns.index("n_chars")]
        new[n] = F.when(F.col("spans").isNull(), F.col(n)).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return both.withColumns(new).select(*rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Compression lengths and tokenisation can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
