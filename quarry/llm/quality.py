"""Quality rules: counts on each text, and lines that recur over the documents of a host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import HOT, among, free_names, shipped, text_hash, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, thash long, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<h:long,w:long>>"


def _lines(g: K.Group, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, document, words and hash (of the folded words) of the lines with a word; s, e: the words."""
    ls, le, ld = g.lines()
    fw, lw = np.searchsorted(s, ls), np.searchsorted(s, le)
    some = lw > fw
    ls, le, ld, fw, lw = (x[some] for x in (ls, le, ld, fw, lw))
    return ls, le, ld, lw - fw, K.span(K.prefix(K.span(K.prefix(K.FOLD[g.data]), s, e)), fw, lw)


def _counts(g: K.Group, window: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The counts of a group's documents; its lines with a word as (hash, words) and their ends by document."""
    s, e = g.words()
    doc = g.doc_of(s)
    raw = K.prefix(K.RAW[g.data])
    out = {"n_words": np.bincount(doc, minlength=g.n)}
    inside = ~K.SPACE[g.data] & ((g.data & 0xC0) != 0x80)
    out["word_chars"], out["n_symbols"] = g.per_doc(inside), g.per_doc(SYMBOLS[g.data])
    ls, le, ld, n, h = _lines(g, s, e)
    same = np.unique(K.keyed(K.span(raw, ls, le), ld), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(ld, minlength=g.n) - np.bincount(ld[same], minlength=g.n)
    sh, at = K.shingles(K.span(raw, s, e), doc, window)
    _, where, times = np.unique(K.keyed(sh, doc[at]), return_inverse=True, return_counts=True)
    twice = at[times[where] > 1]
    edge = np.bincount(twice, minlength=len(s) + 1) - np.bincount(twice + window, minlength=len(s) + 1)[: len(s) + 1]
    covered = np.cumsum(edge)[: len(s)] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=g.n)
    key, at, where = np.unique(K.keyed(h, ld), return_index=True, return_inverse=True)
    words = np.bincount(where, n, len(key)).astype(np.int64)
    order = np.argsort(ld[at], kind="stable")
    at = at[order]
    rows = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array(words[order])], ["h", "w"])
    return out, rows, np.searchsorted(ld[at], np.arange(g.n + 1)).astype(np.int32)


def _run(window: int):
    def run(batches):
        for batch in batches:
            for g in K.groups(batch.column(3)):
                out, rows, ends = _counts(g, window)
                own = slice(g.first, g.first + g.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[own], batch.column(1)[own], batch.column(2)[own], *(pa.array(out[c].astype(np.int64)) for c in COUNTS), pa.ListArray.from_arrays(pa.array(ends), rows)],
                    ["doc_id", "thash", "host", *COUNTS, "lines"])

    return run


def _measured(docs: DataFrame, host: str, window: int, line_docs: int) -> tuple[DataFrame, DataFrame]:
    """The counts and lines of each row of docs, and the lines above the limit, (s: their hashes and words), of (doc_id, thash, host)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("thash"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), "text")
    stats = written(shipped(rows).mapInArrow(_run(window), _SCHEMA), "stats")
    lines = stats.select("doc_id", "thash", "host", F.explode("lines").alias("x")).select("doc_id", "thash", "host", "x.h", "x.w")
    found = lines.groupBy("host", "h", "thash").agg(F.count(F.lit(1)).alias("rows")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    over = written(found.filter(F.col("n") > line_docs).select("host", "h", "rows"), "over")
    total = over.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    over = over.select("host", "h", (F.col("rows") > total / HOT).alias("hot"))
    gone = among(lines, over, ["host", "h"]).groupBy("doc_id", "thash", "host").agg(F.collect_set(F.struct("h", "w")).alias("s"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("thash").alias("t"), F.col("host").alias("o"), "s")
    return stats.drop("lines"), gone


def _verdicts(stats: DataFrame, gone: DataFrame, least_words: int, most_repeated: int, least_left: int) -> DataFrame:
    gone = gone.withColumn("removed", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x.w))
    all_ = stats.join(gone, stats.doc_id.eqNullSafe(gone.d) & (stats.thash == gone.t) & (stats.host == gone.o), "left")
    n, removed = F.col("n_words"), F.coalesce("removed", F.lit(0))
    failed = (n < least_words) | (F.col("n_repeat_words") * 100 > n * most_repeated)
    kept = ~failed & ((n - removed) * 100 >= n * least_left)
    return all_.select("doc_id", "thash", "host", *COUNTS, failed.alias("base_failed"), removed.alias("removed_words"), kept.alias("kept"), F.transform("s", lambda x: x.h).alias("gone"))


def quality(docs: DataFrame, *, host: str = "source", window: int = 5, least_words: int = 10, most_repeated: int = 20, line_docs: int = 10, least_left: int = 30) -> DataFrame:
    """One row for each row of docs: doc_id, thash, host, counts, base_failed, removed_words, kept.

    base_failed: fewer than `least_words` words, or over `most_repeated` per cent of them in word
    windows found twice or more. A line (words folded, blanks ignored) is above the limit if more than
    `line_docs` different texts of its host have it. Copies of one text, byte for byte, count once, as
    near-dedup keeps one of those; near copies are texts of their own. A document of which less than
    `least_left` per cent of the words are left without such lines is depleted and not kept.

    Null and empty texts have no words and fail. Texts of any length are read whole. Null hosts are one host, ''.
    Each row is a document, also repeated rows and null ids; doc_id must be an integer. Other columns are not
    read; an empty table gives an empty result.
    """
    return _verdicts(*_measured(docs, host, window, line_docs), least_words, most_repeated, least_left).drop("gone")


def _drop(batches):
    """(..., text, gone): the texts without the lines whose hashes are in `gone`; gone is left out."""
    for batch in batches:
        names = batch.schema.names[:-1]
        for g in K.groups(batch.column(batch.num_columns - 2)):
            part = batch.slice(g.first, g.n)
            *others, texts, gone = part.columns
            owner = np.repeat(np.arange(g.n), pc.fill_null(pc.list_value_length(gone), 0).to_numpy())
            if len(owner):
                bad = gone.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ls, _, ld, _, h = _lines(g, *g.words())
                hit = np.isin(K.keyed(h, ld), K.keyed(bad, owner))
                starts, ends, doc = g.lines()
                left = ~np.isin(starts, ls[hit])  # lines with a word start at places of their own
                out = texts.to_pylist()
                for d in np.unique(owner):
                    mine = np.arange(*np.searchsorted(doc, [d, d + 1]))
                    mine = mine[left[mine]]
                    out[d] = b"\n".join(g.data[a:b].tobytes() for a, b in zip(starts[mine], ends[mine], strict=True)).decode()
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*others, texts], names)


def keep_good(docs: DataFrame, *, host: str = "source", window: int = 5, least_words: int = 10, most_repeated: int = 20, line_docs: int = 10, least_left: int = 30) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns; their texts have lost the lines above the limit.

    Texts without such lines stay byte for byte as they are; of the others the lines left, blank ones too, are
    joined by newlines. Null, empty and blank texts go. Texts of any length are read whole. Each row is a
    document, also repeated rows and null ids; doc_id must be an integer. Other columns may have any
    names and stay as they are. An empty table gives an empty result.
    """
    found = _verdicts(*_measured(docs, host, window, line_docs), least_words, most_repeated, least_left).filter("kept")
    d, t, o, gone = free_names(docs, "d", "t", "o", "gone")
    good = found.select(F.col("doc_id").alias(d), F.col("thash").alias(t), F.col("host").alias(o), F.col("gone").alias(gone)).dropDuplicates([d, t, o])
    own = F.coalesce(docs[host].cast("string"), F.lit(""))
    kept = docs.join(good, docs["doc_id"].cast("long").eqNullSafe(good[d]) & (text_hash("text") == good[t]) & (own == good[o]))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    changed = shipped(kept.select(*others, "text", gone)).mapInArrow(_drop, T.StructType([*(f for f in docs.schema.fields if f.name != "text"), docs.schema["text"]]))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
