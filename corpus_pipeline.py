"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, lines, near, packing, quality
from quarry.llm.common import made, release, written


def follow(docs: DataFrame, out: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs, of `out`, with its column `text` as the text; n_chars, if there, counts that."""
    changed = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or are depleted by lines common to their host, and those lines from the others.

    Null, empty and blank texts fail. Texts of any length are read whole; each row is a document, also repeated
    rows and null ids; null hosts are one host. Other columns may have any names and stay. An empty table gives an empty one.
    """
    return follow(docs, quality.keep_good(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that ten documents or more have.

    Null texts become ''; empty lines stay. Texts of any length are read whole; each row is a document, also
    repeated rows and null ids. Other columns may have any names and stay. An empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rest = [c for c in docs.columns if c not in own]
    spare = [f"own {c}" for c in rest]
    out = lines.drop_lines(docs.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"`{c}`").alias(s) for c, s in zip(rest, spare, strict=True)]), limit=10)
    out = out.select(*[F.col(f"`{c}`") for c in own], F.col("kept_text").alias("text left"), *[F.col(f"`{s}`").alias(c) for c, s in zip(rest, spare, strict=True)])
    return follow(docs, out, "text left")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, the one of the least (doc_id, hash of the text); null ids last.

    Null, empty and blank texts all stay. Texts of any length are read whole; of repeated rows one stays. Other
    columns may have any names and stay. An empty table gives an empty one.
    """
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that carry an item of the benchmark.

    Null and empty texts stay. Texts of any length are read whole; repeated rows and null ids stay or go together.
    Other columns may have any names and stay. An empty table gives an empty one.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in sequences of 2048 tokens.

    Null and empty texts are the end token alone; longer texts than a sequence are cut; each row is a document, also
    repeated rows and null ids. Other columns are not read. An empty table gives an empty one.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", token_packing)]

#: SQL has no BagMinHash, bands or byte-level BPE; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote is deleted once the next stage's documents are written."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, first, 1)
    return STAGES[-1][1](spark, docs, sf_dir)
