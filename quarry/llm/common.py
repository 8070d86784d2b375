"""Shared helpers: written tables that cut lineage, checked broadcasts, connected components."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few dozen bytes up to which a counted side of a join is broadcast (some 30 MB).
BROADCAST_ROWS = 500_000

#: Arrow batches of tables that are written; 10,000 long texts would be held twice by the executor and by Python.
BATCH_BYTES = 4 << 20

#: The characters that part words, and the upper-case letters that are folded.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, found, True)
    return f"file://{found}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and Spark is local (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found or _own_dir()


#: Paths that new_path() gave and release() has not deleted yet.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for release() to delete."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, Arrow batches that go to Python end at BATCH_BYTES (or with a longer row) if the session sets no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table in the shared folder: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many paths release() would delete now."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Deletes what was written so far to paths that were not given: intermediate tables, line runs, slot maps;
    only those after the first `since` and before the last `last`. DataFrames returned by operators read them: save those first."""
    for path in _made[since : len(_made) - last]:
        _made.remove(path)
        drop_path(spark, path)


def shipped(df: DataFrame) -> DataFrame:
    """df, with this package sent to the executors once, so that their Python workers can import it wherever it lies here."""
    sc = df.sparkSession.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return df
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/quarry.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(f"{folder}/quarry.zip")
    sc._quarry_shipped = True
    return df


def maybe_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a written table of at most so many rows; beyond that Spark chooses another join."""
    return F.broadcast(small) if small.count() <= rows else small


#: Keys of a hot join that are broadcast, at most.
HOT = 100_000


def hot_join(rows: DataFrame, one: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of `one` (null where the key is not in it), which has each key once, and in `size` how
    many of the `total` rows have it. Fewer than HOT keys have more than total / HOT rows: those are
    broadcast and the rest is joined by shuffling, where none fills a task."""
    what = F.struct(*[c for c in one.columns if c != key])
    big = one.filter(F.col(size) > total / HOT).select(F.col(key).alias("hot_key"), what.alias("hot"))
    rest = one.filter(F.col(size) <= total / HOT).select(F.col(key).alias("cold_key"), what.alias("cold"))
    out = rows.join(F.broadcast(big), rows[key] == F.col("hot_key"), "left")
    # Keys already met, and null ones, are dealt out by the whole row instead.
    out = out.withColumn("by", F.when(F.col("hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    out = out.join(rest, F.col("by") == F.col("cold_key"), "left")
    got = F.when(F.col(key).isNotNull(), F.coalesce("hot", "cold"))
    return out.select(*rows.columns, *[got[c].alias(c) for c in one.columns if c != key])


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns `on`, the last a long, are those of a row of `keys`. That has each key once and a column `hot`,
    true on fewer than HOT keys: those are broadcast, and their rows dealt out by all their columns where the rest is joined by shuffling."""
    hot = keys.filter("hot").select(*on, "hot")
    cold = keys.filter("not hot").select(*[F.col(c).alias(f"cold_{c}") for c in on])
    out = rows.join(F.broadcast(hot), on, "left").withColumn("by", F.when(F.col("hot"), F.xxhash64(*rows.columns)).otherwise(F.col(on[-1])))
    same = [F.col(c) == F.col(f"cold_{c}") for c in on[:-1]] + [F.col("by") == F.col(f"cold_{on[-1]}")]
    return out.join(cold, same, "left").filter(F.col("hot") | F.col(f"cold_{on[-1]}").isNotNull()).select(*rows.columns)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def text_hash(text: Column | str) -> Column:
    """64 bits that tell the rows of one doc_id apart; null texts are as empty ones."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def in_training(doc_id: Column | str, mod: int, out: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is not `out`; a null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod != out


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of the nodes on edges; root is the least node that is connected with it.

    Labels spread along edges and by pointer jumping, each round through a written table.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = written(both.union(both.select("y", "x")).distinct(), "edges")
    lab = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    while True:
        near = both.join(lab.select(F.col("node").alias("y"), F.col("root").alias("r")), "y").groupBy(F.col("x").alias("node")).agg(F.min("r").alias("r"))
        far = lab.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        new = lab.join(near, "node").join(far, "root", "left")
        new = new.select("node", F.least("root", "r", F.coalesce("r2", "root")).alias("root"), F.col("root").alias("was"))
        new = written(new, "labels")
        changed = new.filter("root <> was").limit(1).count()
        drop_path(spark, lab.inputFiles()[0].rpartition("/")[0]) if lab.inputFiles() else None
        lab = new.select("node", "root")
        if not changed:
            return lab
