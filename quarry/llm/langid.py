"""Language identification by bit-sliced Bloom filters of character n-grams.

One array of bitmasks holds a Bloom filter for each language, a bit for each: the AND of the masks at
an n-gram's positions has the bits of all languages that contain it. A text's n-grams give a count for
each language, from which the hits expected by chance (the filter's fill to the power of the number of
positions) are taken; the largest decides.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import in_training, shipped, text_hash

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)
#: The bits of each byte, the lowest first.
_BITS = np.arange(256)[:, None] >> np.arange(8) & 1


@functools.cache
def _letters() -> np.ndarray:
    """By code point: 0 for what is no letter, else 1."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) of the n-grams of lower-cased words with a blank at either end, and the documents with a letter."""
    lowered = [t.lower() for t in texts]
    raw = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "replace"), np.uint32)
    length = np.array([len(t) + 1 for t in lowered])
    doc = np.repeat(np.arange(len(texts)), length)
    letter = _letters()[raw]
    some = np.bincount(doc[letter], minlength=len(texts)) > 0
    # Anything but letters is one blank.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    c, doc = np.where(letter, raw, 32)[keep].astype(np.uint64), doc[keep]
    v = K.mix(c)
    out, docs = [], []
    sums = K.prefix(v)
    for n in sizes:
        if len(c) < n:
            continue
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        if n > 1:  # a blank may stand at an end, not inside; single blanks tell nothing
            blank = np.concatenate([[0], np.cumsum(c == 32)])
            at = at[blank[at + n - 1] - blank[np.minimum(at + 1, at + n - 1)] == 0]
        else:
            at = at[c[at] != 32]
        out.append(K.span(sums, at, at + n))
        docs.append(doc[at])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), (np.concatenate(docs) if docs else np.zeros(0, np.int64)), some


def _parts(texts: list[str], limit: int = 1 << 20):
    """Runs of whole texts of about `limit` characters; longer texts are cut at blanks, as (first, last, texts, owners)."""
    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            cut = len(t)
            if len(t) - at > limit:
                cut = t.find(" ", at + limit)
                cut = len(t) if cut < 0 else cut
            held.append(t[at:cut])
            owner.append(i)
            size += cut - at
            at = cut
            if size >= limit:
                yield held, np.array(owner)
                held, owner, size = [], [], 0
            if at >= len(t):
                break
    if held:
        yield held, np.array(owner)


class Filters:
    """Bit-sliced Bloom filters: `masks` (words of 64 languages, 2**bits)."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], bits: int = 20, positions: int = 2):
        self.langs, self.bits, self.positions = langs, bits, positions
        self.masks = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), np.uint64)
        for i, lang in enumerate(langs):
            for at in self.places(grams[lang]):
                self.masks[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = np.array([np.count_nonzero(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))]) / (1 << bits)
        self.chance = fill**positions

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [(h >> np.uint64(64 - self.bits * (k + 1))) & np.uint64((1 << self.bits) - 1) for k in range(self.positions)]

    def languages(self, h: np.ndarray) -> np.ndarray:
        """(words, n-grams): the masks of the languages that contain each n-gram."""
        out = None
        for at in self.places(h):
            got = self.masks[:, at.astype(np.int64)]
            out = got if out is None else out & got
        return out

    def counts(self, h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n, languages) n-grams found, and (n,) n-grams."""
        masks = self.languages(h)
        out = np.zeros((n, -(-len(self.langs) // 8) * 8), np.int64)
        for i in range(0, len(self.langs), 8):  # how often each byte of the masks occurs tells eight languages' counts
            byte = (masks[i // 64] >> np.uint64(i % 64) & np.uint64(255)).astype(np.int64)
            out[:, i : i + 8] = np.bincount(doc * 256 + byte, minlength=n * 256).reshape(n, 256) @ _BITS
        return out[:, : len(self.langs)], np.bincount(doc, minlength=n)


def fit(train: DataFrame, *, sample: int = 3000, grams: int = 30_000, sizes: tuple[int, ...] = SIZES, bits: int = 20, share: float = 0.5) -> Filters | None:
    """Filters of (text, lang) rows; None where there is no row to learn from.

    About `sample` rows of each language (by a hash of the text) are counted whole. A language gets its
    `grams` commonest n-grams of those whose rate in it is at least `share` of the highest rate in any
    language. What comes to the driver is bounded by these two parameters and the number of languages.
    """
    train = train.filter("text is not null and lang is not null").select("text", "lang")
    many = {r[0]: r[1] for r in train.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not many:
        return None
    langs = sorted(many, key=lambda k: (-many[k], k))
    unit = F.pmod(text_hash("text"), F.lit(1 << 30))
    part = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, sample / many[k]) * (1 << 30))))])
    train = train.filter(unit < F.element_at(part, F.col("lang")))

    def count(batches):
        for batch in batches:
            texts, lang = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for held, owner in _parts(texts):
                h, doc, _ = ngrams(held, sizes)
                for k in np.unique(lang[owner]):
                    g, n = np.unique(h[(lang[owner] == k)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "g", "n"])

    got = shipped(train).mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).filter("n > 1")
    whole = got.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = got.join(F.broadcast(whole), "lang").withColumn("rate", F.col("n") / F.col("total"))
    rate = rate.withColumn("top", F.max("rate").over(Window.partitionBy("g"))).filter(F.col("rate") >= share * F.col("top"))
    best = rate.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).filter(F.col("r") <= grams).select("lang", "g")
    chosen = best.toPandas()
    return Filters(langs, {k: chosen.g[chosen.lang == k].to_numpy().view(np.uint64) for k in langs}, bits)


def predict(docs: DataFrame, filters: Filters | None, *, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """docs (any columns, text among them) with lang_pred and score, the share of n-grams that speak for it, added.

    `und` and 0 where the text is null or has no letter, and everywhere without filters. Ties go to the
    language with more rows to learn from. Every text is read whole, long ones in parts. Columns of the two
    names are replaced, others stay; repeated rows and null ids pass through; an empty table gives an empty result.
    """
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n = len(texts)
            found, total, some = np.zeros((n, len(model.langs) if model else 1), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
            for held, owner in _parts(texts):
                h, doc, letter = ngrams(held, sizes)
                some[owner[letter]] = True
                if model:
                    c, t = model.counts(h, doc, len(held))
                    np.add.at(found, owner, c)
                    np.add.at(total, owner, t)
            chance = model.chance if model else np.zeros(1)
            true = np.maximum(0, (found - total[:, None] * chance) / (1 - chance))
            best = true.argmax(1)
            score = np.where(some & bool(model), np.clip(true[np.arange(n), best] / np.maximum(total, 1), 0, 1), 0.0)
            names = [model.langs[b] if s and model else UNKNOWN for b, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return shipped(docs).mapInArrow(run, schema)


def identify(docs: DataFrame, *, mod: int = 4, out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs, learned from the rows that are not held out.

    Null ids hash as the text ''; repeated rows each get a row; other columns are not read. An empty
    table gives an empty result.
    """
    learn = in_training("doc_id", mod, out)
    filters = fit(docs.filter(learn).select("text", "lang"), **options)
    found = predict(docs.select("doc_id", "text"), filters, sizes=options.get("sizes", SIZES))
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")
