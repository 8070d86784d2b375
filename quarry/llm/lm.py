"""Language-model scores: an exact add-one unigram base and a hashed maximum-entropy model.

The model factors a token's probability into that of its class and that within the class:
  class         softmax over the classes of sums of weight rows picked by hashed features of the context
                (last word, last two words, last two classes, and past the last word the two classes before);
  head classes  the commonest words, `size` to a class: softmax over the class's words, with hashed
                features (last word, last two classes) of their own;
  tail classes  all other words by their last three bytes: add-one shares of the counts in the class,
                words never seen being one word. So all probabilities of a context sum to 1.
Head words and word endings are dealt to classes by the company they keep: k-means over their counts
beside the commonest words, over all training documents.

The model grows with the corpus: of V distinct training words, counted first, some sqrt(V) are predicted
one by one, in some V**(1/4) classes of V**(1/4) words, and the weight tables have V**(1/4) rows (Shape).
So the tables, which every task of training and scoring holds, take bytes in proportion to sqrt(V): 9 MB
for a million words, 0.9 GB for ten thousand million.

Training is parameter mixing: each partition takes gradient steps (Adagrad by row) on minibatches of
its training documents, starting from shared weights; touched rows are averaged, weighted by their
updates, in a tree of merges; then the next round starts. Each training document belongs to one round
(by hash), in which each of its positions gives a gradient. Tasks are so few that what they send is a
share of the text. Counts are exact and over all training documents. For scoring, some sqrt(V) common words'
counts go with the model; other words, a few per cent of the tokens, meet their counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import in_training, shipped, text_hash, written

#: Word endings told apart, context words and groups of the clustering.
ENDINGS, CONTEXT, GROUPS = 4096, 64, 8
#: The share of the text's bytes that one round of training may send.
SENT = 0.2
FAN_IN, CHUNK = 256, 256
#: Tokens of a gradient step, and of a step of scoring.
BATCH, SCORED = 8192, 2048
#: Weights stay within this.
LIMIT = 12.0
_U = np.uint64
END, START = _U(0x51ED270B90F1E4C7), _U(0x2545F4914F6CDD1D)


_CODE = np.arange(1, 257)
_CODE[65:91] += 32


@dataclass(frozen=True)
class Shape:
    """Head classes, words in each, tail classes, and rows of the two weight tables."""

    heads: int
    size: int
    tails: int
    rows_c: int
    rows_w: int

    @property
    def classes(self) -> int:
        return self.heads + self.tails

    @property
    def bytes(self) -> int:
        return 4 * (self.rows_c * self.classes + self.rows_w * self.size)

    @property
    def common(self) -> int:
        """Words whose counts go with the model: some 128 sqrt(V)."""
        return 128 * self.heads * self.size

    @staticmethod
    def of(vocabulary: int) -> Shape:
        """For so many distinct training words."""
        grow = (max(vocabulary, 1) / 1e6) ** 0.25
        some = lambda n, least: max(least, round(n * grow))
        return Shape(some(24, 2), some(40, 4), max(some(24, 2), GROUPS), some(1 << 14, 256), some(1 << 15, 256))


class Tokens:
    """Folded words of a group's documents with an end behind each document."""

    def __init__(self, g: K.Group):
        s, e = g.words()
        doc = g.doc_of(s)
        self.n = np.bincount(doc, minlength=g.n) + 1
        self.hash = np.full(len(s) + g.n, END, _U)
        self.doc = np.repeat(np.arange(g.n), self.n)
        at = np.arange(len(s)) + doc
        self.hash[at] = K.span(K.prefix(K.FOLD[g.data]), s, e)
        self.tail = np.zeros(len(self.hash), np.int32)
        if len(s):
            # The last three bytes, with 0 before the word's first.
            own = e - s
            ending = _CODE[g.data[e - 1]] + 257 * np.where(own > 1, _CODE[g.data[e - 2]], 0) + 66049 * np.where(own > 2, _CODE[g.data[e - 3]], 0)
            self.tail[at] = (ending * np.int64(2654435761) >> 16) & (ENDINGS - 1)
        self.place = np.arange(len(self.hash)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def back(self, values: np.ndarray, k: int, start) -> np.ndarray:
        """The value k tokens before, or `start` before the document."""
        out = np.empty_like(values)
        out[k:] = values[:-k]
        out[self.place < k] = start
        return out


class Model:
    """The shape and weights."""

    def __init__(self, shape: Shape, words: np.ndarray, counts: np.ndarray, tail_class: np.ndarray, tails: np.ndarray):
        """words, counts: the head words in class order; tail_class: of the endings; tails: (tail classes, 2) tokens and distinct words."""
        self.shape, self.tail_class = shape, tail_class
        self.words, self.counts = np.append(words, _U(0)), np.append(counts, 0).astype(np.int64)
        # Words that share a place stand in levels.
        self.bits = max(4, (16 * len(words)).bit_length())
        at = self.place(words)
        order = np.argsort(at, kind="stable")
        level = np.arange(len(words)) - np.searchsorted(at[order], at[order])
        self.levels = np.full((int(level.max(initial=0)) + 1, 1 << self.bits), len(words), np.int32)
        self.levels[level, at[order]] = order
        inner = np.full((shape.heads, shape.size), -1e9, np.float32)
        inner.ravel()[: len(words)] = np.log(counts + 1.0)
        self.inner = inner
        self.tail_total = tails.sum(1) + 1
        heads = np.zeros(shape.heads)
        np.add.at(heads, np.arange(len(words)) // shape.size, counts + 1.0)
        mass = np.concatenate([heads, self.tail_total])
        self.bias = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
        self.bias[: shape.heads][heads == 0] = -1e9
        self.theta_c, self.theta_w = np.zeros((shape.rows_c, shape.classes), np.float32), np.zeros((shape.rows_w, shape.size), np.float32)

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).astype(np.int64)

    def head(self, h: np.ndarray) -> np.ndarray:
        """Ranks of head words, -1 for others."""
        at, out = self.place(h), np.full(len(h), -1, np.int32)
        for table in self.levels:
            rank = table[at]
            hit = (self.words[rank] == h) & (rank < len(self.words) - 1)
            out[hit] = rank[hit]
        return out

    def features(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Head rank, class, and the rows of both weight tables, of the tokens."""
        s, head = self.shape, self.head(t.hash)
        cls = np.where(head >= 0, head // s.size, s.heads + self.tail_class[t.tail])
        code = cls.astype(_U)
        w1, w2 = t.back(t.hash, 1, START), t.back(t.hash, 2, START)
        c1, c2, c3 = (t.back(code, k, _U(s.classes)) for k in (1, 2, 3))
        keys = [K.mix(w1), K.mix(w1 + _U(3) * w2), K.mix(c1 + _U(100_003) * c2 + _U(1 << 40)), K.mix(c2 + _U(100_003) * c3 + _U(1 << 41))]
        inside = code * _U(0xA24BAED4963EE407) + _U(0x9E3779B97F4A7C15)
        rows_w = np.stack([_row((k ^ inside) * _U(0xBF58476D1CE4E5B9), s.rows_w) for k in (keys[0], keys[2])])
        return head, cls, np.stack([_row(k, s.rows_c) for k in keys]), rows_w

    def class_logits(self, rows: np.ndarray) -> np.ndarray:
        out = self.theta_c.take(rows[0], 0)
        out += self.bias
        for r in rows[1:]:
            out += self.theta_c.take(r, 0)
        return out

    def word_logits(self, cls: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = self.inner.take(cls, 0)
        for r in rows:
            out += self.theta_w.take(r, 0)
        return out

    def log10(self, t: Tokens, count: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; count: its training count. Logits are sums of a few bounded
        weights, so their exponentials need no shift."""
        head, cls, rows_c, rows_w = self.features(t)
        out = np.empty(len(head))
        for a in range(0, len(head), SCORED):
            b = slice(a, a + SCORED)
            z = self.class_logits(rows_c[:, b])
            own = z[np.arange(len(z)), cls[b]]
            np.exp(z, out=z)
            out[b] = own - np.log(z.sum(1))
            at = np.flatnonzero(head[b] >= 0)
            if len(at):
                z = self.word_logits(cls[b][at], rows_w[:, b][:, at])
                own = z[np.arange(len(z)), head[b][at] % self.shape.size]
                np.exp(z, out=z)
                out[a + at] += own - np.log(z.sum(1))
        tail = head < 0
        out[tail] += np.log((count[tail] + 1) / self.tail_total[cls[tail] - self.shape.heads])
        return out / np.log(10)


class Unknown:
    """In place of a model where there is nothing to learn from."""

    @staticmethod
    def log10(t: Tokens, _) -> np.ndarray:
        return np.zeros(len(t.hash))


def _row(key: np.ndarray, rows: int) -> np.ndarray:
    """The row of a table that a key's upper half picks; small numbers sort fast."""
    return ((key >> _U(32)) * _U(rows) >> _U(32)).astype(np.uint16 if rows <= 1 << 16 else np.uint32)


def _sums(x: np.ndarray, first: np.ndarray, size: np.ndarray, few: int = 16) -> np.ndarray:
    """Sums of the runs of rows of x that begin at `first`, sorted by falling min(size, few)."""
    out = x.take(first, 0)
    longer = len(size) - np.searchsorted(np.minimum(size, few)[::-1], np.arange(1, few + 1), "left")
    for k in range(1, few):
        n = longer[k]
        if not n:
            return out
        out[:n] += x.take(first[:n] + k, 0)
    for i in np.flatnonzero(size > few):
        out[i] = x[first[i] : first[i] + size[i]].sum(0)
    return out


class Steps:
    """Adagrad by row on the two tables of a model, counting updates."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.tables = (model.theta_c, model.theta_w)
        self.square = [np.full(len(t), 1e-3, np.float32) for t in self.tables]
        self.seen = [np.zeros(len(t), np.int32) for t in self.tables]

    def update(self, which: int, rows: np.ndarray, grad: np.ndarray) -> None:
        table, square, seen = self.tables[which], self.square[which], self.seen[which]
        for r in rows:
            order = np.argsort(r, kind="stable")
            s = r.take(order)
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(first, len(s)))
            by = np.argsort(np.minimum(size, 16).astype(np.uint8), kind="stable")[::-1]
            first, size = first[by], size[by]
            at = s[first]
            g = _sums(grad.take(order, 0), first, size)
            seen[at] += size
            square[at] += np.einsum("ij,ij->i", g, g) / g.shape[1]
            g *= (self.rate / np.sqrt(square[at]))[:, None]
            new = table.take(at, 0)
            new -= g
            table[at] = np.clip(new, -LIMIT, LIMIT, out=new)

    def learn(self, head: np.ndarray, cls: np.ndarray, rows_c: np.ndarray, rows_w: np.ndarray) -> None:
        for a in range(0, len(head), BATCH):
            b = slice(a, a + BATCH)
            z = self.model.class_logits(rows_c[:, b])
            np.exp(z, out=z)
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(z)), cls[b]] -= 1
            at = np.flatnonzero(head[b] >= 0)
            if len(at):
                own = rows_w[:, b][:, at]
                w = self.model.word_logits(cls[b][at], own)
                np.exp(w, out=w)
                w /= w.sum(1, keepdims=True)
                w[np.arange(len(w)), head[b][at] % self.model.shape.size] -= 1
                self.update(1, own, w)
            self.update(0, rows_c[:, b], z)


def _profile(context: np.ndarray, heads: np.ndarray):
    """(unit, beside, n): how often each head word (by its place in heads) or ending (after those) stands within two tokens of a context word."""
    by_c, by_h = np.argsort(context), np.argsort(heads)

    def find(values, order, h):
        at = np.minimum(np.searchsorted(values[order], h), len(values) - 1)
        return np.where(values[order][at] == h, order[at], -1)

    def run(batches):
        total = np.zeros((len(heads) + ENDINGS) * len(context), np.int64)
        for batch in batches:
            for g in K.groups(batch.column(0)):
                t = Tokens(g)
                head = find(heads, by_h, t.hash)
                unit, near = np.where(head >= 0, head, len(heads) + t.tail), find(context, by_c, t.hash)
                for k in (1, 2):
                    same = t.doc[k:] == t.doc[:-k] if len(t.doc) > k else np.zeros(0, bool)
                    for u, c in ((unit[k:], near[:-k]), (unit[:-k], near[k:])):
                        ok = same & (c >= 0)
                        total += np.bincount(u[ok] * len(context) + c[ok], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // len(context)).astype(np.int32)), pa.array((at % len(context)).astype(np.int32)), pa.array(total[at])], ["unit", "beside", "n"])

    return run


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _groups(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Weighted k-means over the square roots of smoothed rows, from far-apart first centres."""
    x = x + 0.5 * x.sum(0) / max(x.sum(), 1)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1e-9))
    w = np.sqrt(weight + 1e-9)
    centres = x[[int(np.argmax(w))]]
    for _ in range(k - 1):
        far = _far(x, centres).min(1)
        centres = np.concatenate([centres, x[[int(np.argmax(far * w))]]])
    for _ in range(rounds):
        own = np.argmin(_far(x, centres), 1)
        for j in range(k):
            m = (own == j) * weight
            if m.sum():
                centres[j] = m @ x / m.sum()
    return own


def _classes(profile: np.ndarray, head_n: np.ndarray, ending_n: np.ndarray, tails: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the head words that fills classes, and the tail class of each ending."""
    group = _groups(profile, np.concatenate([head_n, ending_n]), GROUPS)
    order = np.lexsort((-head_n, group[: len(head_n)]))
    tail, own = np.zeros(ENDINGS, np.int64), group[len(head_n) :]
    mass = np.bincount(own, ending_n, GROUPS)
    share = np.floor(mass / max(mass.sum(), 1) * (tails - GROUPS)).astype(int) + 1
    first = np.cumsum(share) - share
    for j in range(GROUPS):
        held = np.zeros(share[j])
        for e in sorted(np.flatnonzero(own == j), key=lambda i: (-ending_n[i], i)):
            at = int(np.argmin(held))
            tail[e] = first[j] + at
            held[at] += ending_n[e] + 1e-6
    return order, tail


_MIXED = "part long, which int, chunk int, seen binary, step binary"
_MIXED_ARROW = pa.schema([("part", pa.int64()), ("which", pa.int32()), ("chunk", pa.int32()), ("seen", pa.binary()), ("step", pa.binary())])


def _train(shared, rate: float):
    def run(batches):
        import copy

        model = copy.deepcopy(shared.value)
        steps, old = Steps(model, rate), shared.value
        held: list = []

        def flush():
            if held:
                steps.learn(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
                held.clear()

        for batch in batches:
            for g in K.groups(batch.column(0)):
                held.append(model.features(Tokens(g)))
                if sum(len(x[0]) for x in held) >= BATCH:
                    flush()
        flush()
        part = TaskContext.get().partitionId()
        out = []
        for which, (table, was) in enumerate(zip(steps.tables, (old.theta_c, old.theta_w), strict=True)):
            for c in range(-(-len(table) // CHUNK)):
                own = slice(c * CHUNK, (c + 1) * CHUNK)
                seen = steps.seen[which][own]
                if seen.any():
                    out.append((part, which, c, seen.astype(np.int64).tobytes(), (table[own] - was[own]).astype(np.float16).tobytes()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_MIXED_ARROW.names, x, strict=True)) for x in out], _MIXED_ARROW)

    return run


def _merge(batches):
    """The mean step of one chunk over some partitions, weighted by updates, a batch at a time."""
    seen = sums = None
    for batch in batches:
        for row in batch.to_pylist():
            n = np.frombuffer(row["seen"], np.int64)
            s = np.frombuffer(row["step"], np.float16).astype(np.float64).reshape(len(n), -1) * n[:, None]
            seen, sums = (n, s) if seen is None else (seen + n, sums + s)
            key = row["part"], row["which"], row["chunk"]
    step = (sums / np.maximum(seen, 1)[:, None]).astype(np.float16)
    yield pa.RecordBatch.from_pylist([dict(zip(_MIXED_ARROW.names, (*key, seen.tobytes(), step.tobytes()), strict=True))], _MIXED_ARROW)


def train(texts: DataFrame, model: Model, size: int, *, rounds: int = 2, rate: float = 0.3) -> Model:
    """The model after `rounds` of parameter mixing over (text, round) rows of some `size` bytes."""
    sc = texts.sparkSession.sparkContext
    parts = min(texts.rdd.getNumPartitions(), max(1, int(SENT * size / (model.shape.bytes / 2))))
    for round_ in range(rounds):
        shared = sc.broadcast(model)
        mixed = shipped(texts.filter(F.col("round") == round_).select("text").coalesce(parts)).mapInArrow(_train(shared, rate), _MIXED)
        left = parts
        while True:
            mixed = mixed.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "which", "chunk").applyInArrow(lambda t: pa.Table.from_batches(_merge(t.to_batches())), _MIXED)
            left = -(-left // FAN_IN)
            if left <= 1:
                break
        for row in mixed.collect():  # one row for each chunk of the two tables
            table = (model.theta_c, model.theta_w)[row.which]
            step = np.frombuffer(row.step, np.float16).reshape(-1, table.shape[1])
            table[row.chunk * CHUNK : row.chunk * CHUNK + len(step)] += step
        shared.destroy()
    return model


def _word_counts(batches):
    """(h, tail, n): the words of the training texts, counted by group."""
    for batch in batches:
        for g in K.groups(batch.column(0)):
            t = Tokens(g)
            h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.tail[first].astype(np.int32)), pa.array(n)], ["h", "tail", "n"])


_PARTS = "doc_id long, thash long, held_out boolean, h long, tf long, n_tokens long, n_known long, base double, score double"


def _score(shared, n: int, v: int):
    """For each document a row of what the model and the common words say (tf 0; h is any number), and
    a row for each other word in it: base and score lack log10(c + 1) for each of those."""
    names = [x.split()[0] for x in _PARTS.split(", ")]

    def run(batches):
        model, h, count = shared.value
        for batch in batches:
            for g in K.groups(batch.column(3)):
                t = Tokens(g)
                at = np.minimum(np.searchsorted(h, t.hash), len(h) - 1)
                known = h[at] == t.hash
                c = np.where(known, count[at], 0)
                base = np.bincount(t.doc, np.log10((c + 1) / (n + v + 1)), g.n)
                cols = (t.n, np.bincount(t.doc[known], minlength=g.n), base, np.bincount(t.doc, model.log10(t, c), g.n))
                own = [batch.column(i)[g.first : g.first + g.n] for i in range(3)]
                place = K.keyed(np.arange(g.n).astype(_U), np.full(g.n, batch.num_rows) + own[0].fill_null(0).to_numpy())
                yield pa.RecordBatch.from_arrays([*own, pa.array(place.view(np.int64)), pa.array(np.zeros(g.n, np.int64)), *map(pa.array, cols)], names)
                rest = np.flatnonzero(~known)
                if not len(rest):
                    continue
                first, tf = np.unique(K.keyed(t.hash[rest], t.doc[rest]), return_index=True, return_counts=True)[1:]
                rest = rest[first]
                order = np.argsort(t.doc[rest], kind="stable")
                rest, tf = rest[order], tf[order]
                none = pa.nulls(len(rest))
                own = [x.take(pa.array(t.doc[rest])) for x in own[:2]]
                yield pa.RecordBatch.from_arrays([*own, none.cast(pa.bool_()), pa.array(t.hash[rest].view(np.int64)), pa.array(tf), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())], names)

    return run


def fit(texts: DataFrame, counts: DataFrame, v: int, *, rounds: int = 2) -> Model:
    """The model of a one-column DataFrame of texts and their `v` counted words (h, tail, c), one at least."""
    shape = Shape.of(v)
    end = int(np.array(END).view(np.int64))
    top = [(r.h, r.c) for r in counts.orderBy(F.desc("c"), "h").limit(shape.heads * shape.size).collect()]
    if end not in [h for h, _ in top]:
        top = top[:-1] + [(r.h, r.c) for r in counts.filter(F.col("h") == end).collect()]
    head, head_n = np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], float)
    ends = np.zeros((ENDINGS, 2))
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        ends[r.tail] = r.c, r.n
    mine = texts.sparkSession.createDataFrame([(int(h),) for h in head], "h long")
    for r in counts.join(F.broadcast(mine), "h").select("tail", "c").collect():
        ends[r.tail] -= r.c, 1
    profile = np.zeros((len(head) + ENDINGS, min(CONTEXT, len(head))))
    for r in shipped(texts).mapInArrow(_profile(head[:CONTEXT].view(_U), head.view(_U)), "unit int, beside int, n long").groupBy("unit", "beside").agg(F.sum("n").alias("n")).collect():
        profile[r.unit, r.beside] = r.n
    order, tail_class = _classes(profile, head_n, ends[:, 0], shape.tails)
    tails = np.stack([np.bincount(tail_class, ends[:, k], shape.tails) for k in (0, 1)], 1)
    model = Model(shape, head[order].view(_U), head_n[order], tail_class, tails)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    return train(texts.select("text", F.pmod(F.shiftright(text_hash("text"), 20), F.lit(rounds)).alias("round")), model, size, rounds=rounds)


def scores(docs: DataFrame, *, mod: int = 7, out: int = 2, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Learns from the rows whose crc32(doc_id as text) mod `mod` is not `out`. Tokens are the words, A-Z
    folded, and one end; base_score sums log10((c + 1) / (N + V + 1)). Null and empty texts are one end.
    Texts of any length are read whole. Null ids hash as ''; repeated rows each get a row; of equally common
    words the lesser hash is a head word; other columns are not read. doc_id must be an integer. An empty
    table gives an empty result; with nothing to learn from, every count is 0 and score is base_score, 0.
    Words are told apart by 64-bit hashes.
    """
    held = ~in_training("doc_id", mod, out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("thash"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.filter("not held_out").select("text")
    counts = written(shipped(texts).mapInArrow(_word_counts, "h long, tail int, n long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("n").alias("c")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if n:
        model = fit(texts, counts, v, rounds=rounds)
        common = counts.orderBy(F.desc("c"), "h").limit(model.shape.common).select("h", "c").toArrow()
        h, c = common["h"].to_numpy().view(_U), common["c"].to_numpy()
        known = h[order := np.argsort(h)], c[order]
    else:
        model, known = Unknown(), (np.array([END]), np.zeros(1, np.int64))
    parts = shipped(rows).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast((model, *known)), n, v), _PARTS)
    met = parts.join(counts.select("h", "c"), "h", "left")
    one = met.groupBy("doc_id", "thash").agg(
        F.sum((F.col("tf") == 0).cast("long")).alias("times"), *(F.max(x).alias(x) for x in ("held_out", "n_tokens", "n_known", "base", "score")),
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf"))).alias("more"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rest"))
    # Rows that are repeated were added up; they part again, in two steps, as one array could get too long.
    each = one.withColumn("a", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / 1000))))
    each = each.withColumn("b", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("times") - F.col("a") * 1000))))
    rest = F.col("rest") / F.col("times")
    return each.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce((F.col("more") / F.col("times")).cast("long"), F.lit(0))).alias("n_known"),
                       F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + rest).alias("base_score"), (F.col("score") + rest).alias("score"))
