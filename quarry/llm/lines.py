"""Line dedup against levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table of (h1, h2, n): 128 bits of a line key's hash and the number of documents that have it,
dealt by hash to buckets of one sorted Parquet file each. New batches make runs of level 0; when a level
has `fanout` runs they are merged into one of the next level. A batch is dealt and sorted alike and
merged with each run as it lies there, so that no run is shuffled or sorted again; keys that the runs
already hold `limit` times leave it: those need no more counting.
"""

from __future__ import annotations

import functools
import operator
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, HOT, LOWER, UPPER, among, drop_path, free_names, new_path, text_hash, written

RUN = "h1 long, h2 long, n long"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hashes(line: Column) -> Column:
    """(h1, h2) of a line's key, or null where the key is empty."""
    pair = F.transform(F.array(line_key(line)), lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    return F.element_at(pair, 1)


@contextmanager
def trusted_order(spark: SparkSession):
    """Within it, Spark's plans take a bucket of one file to be in the order that its table states."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


class LineRuns:
    """The levels of runs below one folder; `runs` lists (level, path).

    Each run has `buckets` files, by default as many as the session has shuffle partitions, or as the runs
    that the folder holds. Spark reads sorted buckets by tables only: the current database has one
    for each run, without files of its own, until close().
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, limit: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.limit, self.fanout = spark, path or new_path(spark, "runs"), limit, fanout
        self.runs, self.tables, self.made, held = [], {}, 0, None
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(at) if fs.exists(at) else []:
            level, number, held = map(int, s.getPath().getName()[1:].split("-"))
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                to = s.getPath().toString()
                self.runs.append((level, to))
                self.tables[to] = self._name()
                spark.sql(f"CREATE TABLE {self.tables[to]} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {held} BUCKETS LOCATION '{to}'")
            self.made = max(self.made, number + 1)
        self.buckets = buckets or held or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @staticmethod
    def _name() -> str:
        return f"quarry_run_{uuid.uuid4().hex}"

    def read(self, level: int | None = None) -> DataFrame:
        """Rows of the runs, of one level or all; a key may have a row in each run."""
        # By paths: Spark 4.1 groups a union of bucketed tables without a shuffle after it has given up their buckets.
        paths = [p for lv, p in self.runs if level is None or lv == level]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def counts(self) -> DataFrame:
        one = len(self.runs) == 1
        return self.read() if one else self.read().groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def found(self) -> DataFrame:
        """Keys that at least `limit` documents have."""
        return self.counts().filter(F.col("n") >= self.limit).select("h1", "h2")

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch of (h1, h2, n) whose keys the runs hold less than `limit` times, by merging it with each run."""
        rows = batch.select("h1", "h2", "n").repartition(self.buckets, "h1", "h2")
        held = []
        for i, (_, p) in enumerate(self.runs):
            held.append(f"n{i}")
            rows = rows.join(self.spark.table(self.tables[p]).withColumnRenamed("n", held[-1]).hint("merge"), ["h1", "h2"], "left")
        known = functools.reduce(operator.add, [F.coalesce(n, F.lit(0)) for n in held], F.lit(0))
        return rows.filter(known < self.limit).select("h1", "h2", "n")

    def _write(self, level: int, rows: DataFrame) -> None:
        to, name = f"{self.path}/L{level}-{self.made}-{self.buckets}", self._name()
        with trusted_order(self.spark):
            rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", to).saveAsTable(name)
        self.made += 1
        self.tables[to] = name
        self.runs.append((level, to))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (h1, h2, n), each key once: those not found often enough yet become a run."""
        self._write(0, self.fresh(batch))
        level = 0
        while len(old := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._write(level + 1, self.read(level).groupBy("h1", "h2").agg(F.sum("n").alias("n")))
            self.runs = [r for r in self.runs if r not in old]
            for _, p in old:
                self.spark.sql(f"DROP TABLE {self.tables.pop(p)}")
                drop_path(self.spark, p)
            level += 1

    def close(self) -> None:
        """Drops the tables; the files stay and can be opened again."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, keys): the key hashes of each text's lines in order, as a written table."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return written(docs.select("doc_id", text_hash("text").alias("thash"), F.transform(lines, key_hashes).alias("keys")), "lines")


def counted_lines(keyed: DataFrame, batches: int = 1) -> DataFrame:
    """(batch, h1, h2, n, times): the documents of keyed_lines() that have a key, and their lines with it, as a written
    table. A document counts once for a key. Rows are dealt to batches by text."""
    # array_distinct compares structs pairwise; sorted keys need only their neighbours.
    sorted_ = keyed.select(F.pmod("thash", F.lit(batches)).alias("batch"), F.sort_array("keys").alias("keys"))
    first = F.transform("keys", lambda k, i: F.when(k.isNotNull(), F.struct(k.h1.alias("h1"), k.h2.alias("h2"), ((i == 0) | ~k.eqNullSafe(F.get(F.col("keys"), i - 1))).cast("long").alias("first"))))
    one = sorted_.select("batch", F.explode(first).alias("k")).filter("k is not null")
    return written(one.groupBy("batch", "k.h1", "k.h2").agg(F.sum("k.first").alias("n"), F.count(F.lit(1)).alias("times")), "counted")


def add_documents(runs: LineRuns, keyed: DataFrame, batches: int = 1) -> DataFrame:
    """Counts the lines of keyed_lines() into the runs, a batch after the other; returns counted_lines()."""
    counted = counted_lines(keyed, batches)
    for b in range(batches):
        runs.add(counted.filter(F.col("batch") == b).select("h1", "h2", "n"))
    return counted


def drop_lines(docs: DataFrame, *, limit: int = 10, batches: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text added: lines whose key `limit` documents or more have are dropped everywhere.

    The key is the line without blanks at its ends, A-Z lower-cased; empty keys are kept. A null or
    empty text is one empty line and gives ''. Texts of any length are read whole, at a cost in proportion
    to their lines (times their logarithm). Each row is a document of its own, also repeated rows
    and null ids. With `runs`, documents counted there earlier count too. Other columns may have any names and
    stay as they are, but for those named like the three new ones, which are replaced. An empty table gives
    an empty result.
    """
    given, runs = runs, runs or LineRuns(docs.sparkSession, limit=limit)
    keyed = keyed_lines(docs)
    counted = add_documents(runs, keyed, batches)
    # Fewer than HOT keys have so many lines of a batch; each other key has at most batches / HOT of all lines.
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = counted.filter(F.col("times") > total / HOT).select("h1", "h2", F.lit(True).alias("hot")).distinct()
    often = written(runs.found().join(F.broadcast(hot), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("hot", F.lit(False)).alias("hot")), "often")
    if given is None:
        runs.close()
    at = keyed.select("doc_id", "thash", F.posexplode("keys").alias("pos", "k")).select("doc_id", "thash", "pos", "k.h1", "k.h2")
    hits = among(at.filter("h1 is not null"), often, ["h1", "h2"]).groupBy("doc_id", "thash").agg(F.collect_set("pos").alias("gone"))
    d, h, gone, t, lines = free_names(docs, "d", "h", "gone", "t", "cut")
    hits = hits.select(F.col("doc_id").alias(d), F.col("thash").alias(h), F.col("gone").alias(gone))
    marked = docs.withColumn(t, text_hash("text"))
    marked = marked.join(hits, marked["doc_id"].eqNullSafe(hits[d]) & (marked[t] == hits[h]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    marked = marked.withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    return marked.select(*own, F.size(lines).cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
