"""Packing documents into token sequences by the sum-of-squares rule for online bin packing."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

END_ID = 1
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts are encoded in parts of about so many characters, cut where a token boundary is certain.
PART = 1 << 20
#: A run of so many characters without a blank, or of blanks, goes to the slower library, which has no limit on it.
LONG_RUN = 50_000
_CUT = re.compile(r"(?<=[\w.,;:!?])\n(?=\w)")


@functools.cache
def encoder(path: str):
    """text -> ids of the byte-level BPE in a tokenizers file, through tiktoken's faster merge loop."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    odd = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))

    def part(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and odd.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    def encode(text: str) -> np.ndarray:
        if len(text) <= PART:
            return part(text)
        out, at = [], 0
        while at < len(text):
            m = _CUT.search(text, at + PART)
            out.append(part(text[at : m.end() if m else len(text)]))
            at = m.end() if m else len(text)
        return np.concatenate(out)

    return encode


class Packer:
    """Windows of `size` ids. counts[h] is the number of open windows filled to level h."""

    def __init__(self, size: int, most_open: int = 4096):
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open, self.made, self.out = 0, 0, []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.made, at))
            at += len(ids)
        self.made += 1

    def level(self, s: int) -> int:
        """The level h, or 0 for a new window, whose step to h + s adds least to the sum of squared counts; the fullest of equals."""
        c, end = self.counts, self.size - s
        held = np.flatnonzero(c[: end + 1])
        h = np.append(held, 0)
        cost = np.where(h > 0, 1 - 2 * c[h], 0) + np.where(h < end, 1 + 2 * c[h + s], 0)
        return int(h[np.flatnonzero(cost == cost.min())].max())

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) - len(ids) % self.size
        for a in range(0, whole, self.size):
            self.close([(doc, a, ids[a : a + self.size], total)])
        if whole < total:
            self.put((doc, whole, ids[whole:], total))

    def put(self, piece: tuple) -> None:
        s = len(piece[2])
        h = self.level(s)
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if h + s == self.size:
            return self.close(pieces)
        self.open.setdefault(h + s, []).append(pieces)
        self.counts[h + s] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.finish(False)

    def finish(self, last: bool = True) -> None:
        """Fills the windows still open from each other by cutting pieces, so that one at most is left short."""
        rest = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        held, at = [], 0
        for doc, start, ids, total in rest:
            while len(ids):
                take = ids[: self.size - at]
                held.append((doc, start, take, total))
                at, start, ids = at + len(take), start + len(take), ids[len(take) :]
                if at == self.size:
                    self.close(held)
                    held, at = [], 0
        if held and last:
            self.close(held)
        elif held:
            self.open[at] = [held]
            self.counts[at], self.n_open = 1, 1


def _run(path: str, size: int):
    def rows(out: list, part: int) -> pa.RecordBatch:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        cols = list(zip(*out, strict=True))
        cols[5] = (np.array(cols[5], np.int64) + (part << 40)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    def run(batches):
        part, packer, encode = TaskContext.get().partitionId(), Packer(size), encoder(path)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                packer.add(doc.as_py(), np.concatenate([ids, end]))
                if len(packer.out) >= 20_000:
                    yield rows(packer.out, part)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield rows(packer.out, part)

    return run


def pack(docs: DataFrame, *, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences of at most `size` ids: one row for each piece.

    A document is its text's ids and END_ID; windows filled by it alone are closed at once, the rest is
    put by the sum-of-squares rule into an open window of its partition. What is open at the end is cut
    to fill up, so a partition leaves one short sequence at most, and holds `most_open` windows at most.
    sequence_id has the partition in its upper bits and is stable as long as the input's partitions are
    (files are; write other inputs first).

    Null texts are empty: one id. Each row is a document, also repeated rows and null ids. Other columns
    are not read. An empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(str(tokenizer), size), _SCHEMA)
