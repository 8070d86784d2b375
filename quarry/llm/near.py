"""Near-duplicate documents by BagMinHash over multisets of word shingles.

1. One pass over the texts makes for each document a content key (the hash of its folded words; equal
   for exact copies) and a BagMinHash signature: each shingle of weight w runs hierarchical Poisson
   processes over the discretised weights (0,1], (1,2], (2,4], ... up to w. A process of width v has
   rate m*v; each point falls on a random register and a random unit of its interval, and counts if
   that unit is within w. Points come in rising order and a process ends once it is past the
   document's largest register, so a shingle costs a few points, not one for each register. Two
   registers agree with a probability equal to the weighted Jaccard similarity.
2. Bands of registers make buckets of distinct texts. In a bucket, the member that shares most buckets
   leads; those whose signatures agree with it join it, those that do not agree strongly lead in turn.
   Large buckets are split into chunks whose leaders meet again, so no task holds a whole bucket.
3. Components of these links are families. In a family, exact multiset overlaps by postings of
   shingles link documents at the threshold or above. Families above `block` members or BLOCK_BYTES are
   compared by pairs of blocks. No list of pairs is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, free_names, hot_join, maybe_broadcast, shipped, text_hash, written

#: Registers that agree by chance: one byte of each is kept.
CHANCE = 1 / 256
#: Signature agreement from which documents are one family; true pairs at 0.8 lie 8 deviations above.
FAMILY = 0.5
#: Agreement from which a text follows a leader for good: its partners at 0.8 are within FAMILY of that leader.
STRONG = 0.78
#: Between leaders of different chunks of a bucket: partners' leaders may be this far apart.
FAR = 0.25
#: Text of a block in which a family is compared.
BLOCK_BYTES = 16 << 20
#: Postings that a comparison reads in one step.
POSTINGS = 1 << 18
MASK = (1 << 64) - 1


def elements(g: K.Group, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of a group's multisets, ordered by document, and each document's content key.

    A document of fewer than k words has one shingle, all its words. One without words has none and key 0.
    """
    s, e = g.words()
    doc = g.doc_of(s)
    h = K.span(K.prefix(K.FOLD[g.data]), s, e)
    n = np.bincount(doc, minlength=g.n)
    ends = np.cumsum(n)
    whole = K.span(K.prefix(h), ends - n, ends)
    sh, at = K.shingles(h, doc, k)
    few = np.flatnonzero((n > 0) & (n < k))
    sh, d = np.concatenate([sh, whole[few]]), np.concatenate([doc[at], few])
    order = np.lexsort((sh, d))
    sh, d = sh[order], d[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return d[first], sh[first], np.diff(np.append(first, len(sh))), np.where(n > 0, whole, 0).astype(np.uint64)


def bag_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n, m) of n multisets; m is a power of two. Infinite where a multiset is empty."""
    reg = np.full(n * m, np.inf)
    parts = [(doc, K.mix(item), np.ones(len(doc)), np.zeros(len(doc), np.int64), weight)]
    low, level = 1, 1
    while len(more := np.flatnonzero(weight > low)):
        seed = K.mix(item[more] + np.uint64(level * 0xC2B2AE3D27D4EB4F & MASK))
        parts.append((doc[more], seed, np.full(len(more), float(low)), np.full(len(more), low), weight[more]))
        low, level = low * 2, level + 1
    d, seed, width, low_, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    t, worst, k = np.zeros(len(d)), np.full(n, np.inf), 0
    while len(d):
        r = K.mix(seed + np.uint64(k * 0x9FB21C651E98DF25 & MASK))
        t = t - np.log(((r >> np.uint64(12)).astype(np.float64) + 1) * 2.0**-52) / (m * width)
        live = t <= worst[d]
        d, seed, width, low_, w, t, r = (x[live] for x in (d, seed, width, low_, w, t, r))
        unit = low_ + 1 + (K.mix(r) % width.astype(np.uint64)).astype(np.int64)
        hit = unit <= w
        np.minimum.at(reg, d[hit] * m + (r[hit] & np.uint64(m - 1)).astype(np.int64), t[hit])
        if k % 4 == 3 or k > 12:
            held = np.unique(d) if len(d) < n else np.arange(n)
            worst[held] = reg.reshape(n, m)[held].max(1)
        k += 1
    return reg.reshape(n, m)


def bands_of(reg: np.ndarray, rows: int) -> np.ndarray:
    """Keys (n, m / rows) of the bands."""
    x = reg.view(np.uint64).reshape(len(reg), -1, rows)
    key = np.zeros(x.shape[:2], np.uint64) + np.arange(x.shape[1], dtype=np.uint64)
    for i in range(rows):
        key = K.mix(key ^ x[:, :, i])
    return key


SIGNED = "doc_id long, thash long, bytes long, key long, sig binary, bands array<long>"


def signer(m: int, rows: int, k: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            for g in K.groups(texts):
                d, sh, w, key = elements(g, k)
                reg = bag_minhash(d, sh, w, g.n, m)
                some = key != 0
                sig = (K.mix(reg.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
                flat = bands_of(reg, rows).view(np.int64)
                own = slice(g.first, g.first + g.n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[own] for i in range(3)), pa.array(key.view(np.int64), mask=~some), pa.array([x.tobytes() for x in sig], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))],
                    ["doc_id", "thash", "bytes", "key", "sig", "bands"])

    return run


def lead(run: np.ndarray, sig: np.ndarray, family: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of runs: the first row of the part of the run that it belongs to, and whether the row led.

    In turn the first row left in each run leads: rows that agree by `family` or more are of its part,
    and those that agree by STRONG or more need not lead or follow again. So two texts at 0.8 meet: one
    that follows a leader strongly has its partner within `family` of that leader.
    """
    part, led, left = np.arange(len(run)), np.zeros(len(run), bool), np.arange(len(run))
    while len(left):
        r = run[left]
        first = np.ones(len(left), bool)
        first[1:] = r[1:] != r[:-1]
        head = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        led[left[first]] = True
        same = np.concatenate([(sig[left[i : i + 65536]] == sig[head[i : i + 65536]]).mean(1) for i in range(0, len(left), 65536)])
        agree = (same - CHANCE) / (1 - CHANCE)
        near = agree >= family
        if (joined := part[left[near]] != part[head[near]]).any():
            to = np.arange(len(run))
            to[part[left[near]][joined]] = part[head[near]][joined]
            part = to[part]
        left = left[~first & (agree < STRONG)]
    low = np.full(len(run), len(run))
    np.minimum.at(low, part, np.arange(len(run)))
    return low[part], led


def leaders(m: int, family: float):
    """Over rows sorted by (band, chunk, falling degree): each row's part of its bucket, by a key, and whether it led."""

    def run(batches):
        rest = None
        for batch in _and_none(batches):
            t = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                t = rest if t is None else pa.concat_tables([rest, t])
            if t is None or not t.num_rows:
                rest = t
                continue
            band, chunk = t["band"].to_numpy(), t["chunk"].to_numpy()
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (chunk[1:] != chunk[:-1])
            cut = len(band) if batch is None else int(np.flatnonzero(new)[-1])
            rest = t.slice(cut)
            if not cut:
                continue
            t = t.slice(0, cut).combine_chunks()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, m)
            key = t["key"].to_numpy()
            part, led = lead(np.cumsum(new[:cut]), sig, family)
            yield pa.RecordBatch.from_arrays([t["band"].combine_chunks(), pa.array(key), pa.array(key[part]), pa.array(led), t["n"].combine_chunks(), t["deg"].combine_chunks()], ["band", "key", "leader", "led", "n", "deg"])

    return run


def _and_none(it):
    yield from it
    yield None


LED = "band long, key long, leader long, led boolean, n long, deg long"


def pairs_of(parts: str, own: str) -> Column:
    """The pairs (i, j) of i <= j below `parts` that contain `own`."""
    mine = F.col(own).cast("int")
    return F.transform(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int")), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))


def linker(k: int, threshold: float):
    """In one family or pair of blocks: (key, root), root being the least key that exact links connect."""

    def run(table: pa.Table) -> pa.Table:
        keys, texts = table["key"].to_numpy(), table["text"].combine_chunks()
        n, parts = len(keys), []
        for g in K.groups(texts):
            d, sh, w, _ = elements(g, k)
            parts.append(((d + g.first).astype(np.int32), sh, w.astype(np.int32)))
        # A block has millions of shingles: what is no longer needed goes before the next array is made.
        d, sh, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        total = np.bincount(d, w, n)
        start = np.searchsorted(d, np.arange(n + 1))
        order = np.argsort(sh, kind="stable").astype(np.int32)
        sh = sh[order]
        new = np.ones(len(sh), bool)
        new[1:] = sh[1:] != sh[:-1]
        del sh
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new))
        place = np.empty(len(new), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        d2, w2 = d[order], w[order]
        del order, new
        parent = np.arange(n)

        def compare(x: int) -> np.ndarray:
            mine, own = place[start[x] : start[x + 1]], w[start[x] : start[x + 1]]
            ends = np.cumsum(end[mine] - begin[mine])
            both, a = np.zeros(n), 0
            while a < len(mine):  # postings in steps
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, "right")))
                first = begin[mine[a:z]]
                size = end[mine[a:z]] - first
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                both += np.bincount(d2[at], np.minimum(w2[at], np.repeat(own[a:z], size)), n)
                a = z
            return np.flatnonzero(both * (1 + threshold) >= threshold * (total + total[x]) - 1e-9)

        popular = np.bincount(d, (end - begin)[place], n) / np.maximum(total, 1)
        hub = int(np.argmax(popular))
        todo = np.ones(n, bool)
        for x in [hub, *np.argsort(-popular, kind="stable")]:
            if not todo[x] or x != hub and parent[x] == parent[hub]:
                continue
            todo[x] = False
            near = compare(int(x))
            joined = np.unique(parent[np.append(near, x)])
            parent[np.isin(parent, joined)] = joined[0]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, parent, keys)
        return pa.table({"key": keys, "root": least[parent]})

    return run


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, words: int = 5, m: int = 128, rows: int = 4, chunk: int = 4096, block: int = 3000) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size, is_rep, thash (of the text).

    class_id is the least doc_id of the documents connected by multiset Jaccard similarities of
    `threshold` or more over folded (A-Z) shingles of `words` words; texts of fewer words are one
    shingle. Null, empty and blank texts are classes of their own, one for each row (class_id is the
    row's doc_id). Texts of any length are read whole. Repeated rows and equal texts share a class; null ids are
    taken last. Of a class, is_rep holds on the row of the least (doc_id, thash), on all its repetitions if it is
    repeated. doc_id must be an integer. Other columns are not read. An empty table gives an empty result.
    """
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash("text").alias("thash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.col("text"))
    signed = written(shipped(rows_).mapInArrow(signer(m, rows, words), SIGNED), "signed")
    nodes = signed.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "thash")).alias("at"), F.max("bytes").alias("bytes"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("key", "at.doc_id", "at.thash", "bytes", "sig", "bands", "copies"), "nodes")
    flat = nodes.select("key", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = written(flat.join(shared, "band"), "members")
    degree = member.groupBy("key").agg(F.sum(F.col("n") - 1).alias("deg"))
    bucket = member.join(degree, "key").join(nodes.select("key", "sig"), "key")
    links, family = None, FAMILY
    while True:
        bucket = bucket.withColumn("chunk", F.pmod(F.xxhash64("key", "n"), F.ceil(F.col("n") / chunk)))
        bucket = bucket.select("band", "chunk", "key", "n", "deg", "sig").repartition("band", "chunk").sortWithinPartitions("band", "chunk", F.desc("deg"), "key")
        led = written(shipped(bucket).mapInArrow(leaders(m, family), LED), "leaders")
        links = led if links is None else links.union(led)
        top = led.filter((F.col("n") > chunk) & F.col("led")).select("band", "key", "deg")
        size = top.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
        before = led.filter(F.col("n") > chunk).groupBy("band").agg(F.count(F.lit(1)).alias("was"))
        size = written(size.join(before, "band").filter("n > 1"), "sizes")
        stuck = size.filter("n >= was")  # nobody follows anybody: chunks are compared by pairs
        if stuck.limit(1).count():
            apart = top.join(stuck.select("band", "n"), "band").join(nodes.select("key", "sig"), "key")
            apart = apart.withColumn("parts", F.ceil(F.col("n") / chunk)).withColumn("own", F.pmod(F.xxhash64("key", "n"), F.col("parts")))
            apart = apart.withColumn("p", F.explode(pairs_of("parts", "own"))).withColumn("chunk", F.col("p.i") * F.col("parts") + F.col("p.j"))
            apart = apart.select("band", "chunk", "key", "n", "deg", "sig").repartition("band", "chunk").sortWithinPartitions("band", "chunk", F.desc("deg"), "key")
            links = links.union(written(shipped(apart).mapInArrow(leaders(m, FAR), LED), "leaders"))
        size = size.filter("n < was")
        if not size.limit(1).count():
            break
        family = FAR
        bucket = top.join(size.select("band", "n"), "band").join(nodes.select("key", "sig"), "key")
    family = components(links, "key", "leader")
    family = family.join(nodes.select(F.col("key").alias("node"), "doc_id", "thash", "bytes"), "node")
    count = family.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES))
    family = family.drop("bytes").join(count.select("root", F.greatest(parts, F.lit(1)).alias("parts")), "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    family = written(family.select(F.col("node").alias("key"), "root", "parts", "own", "doc_id", "thash"), "families")
    texts = rows_.join(maybe_broadcast(family), rows_.doc_id.eqNullSafe(family.doc_id) & (rows_.thash == family.thash)).select("key", "root", "parts", "own", "text")
    if signed.select(F.col("doc_id").alias("d"), F.col("thash").alias("t")).join(maybe_broadcast(family), F.col("d").eqNullSafe(family.doc_id) & (F.col("t") == family.thash)).count() > family.count():
        texts = texts.dropDuplicates(["key"])  # the rows that tell a text are repeated
    texts = texts.select("key", "root", F.explode(pairs_of("parts", "own")).alias("p"), "text").select("root", "p.i", "p.j", "key", "text")
    linked = written(texts.groupBy("root", "i", "j").applyInArrow(linker(words, threshold), "key long, root long"), "linked").filter("key <> root")
    many = family.filter("parts > 1").limit(1).count()
    classes = components(linked, "key", "root").select(F.col("node").alias("key"), "root") if many else linked.distinct()
    # Classes of different texts first, then rows: a class of many texts or copies is one hot key of either join.
    members = nodes.select("key", "doc_id", "thash", "copies").join(classes, "key", "left").withColumn("cls", F.coalesce("root", "key")).drop("root")
    whole = members.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("rep"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    whole = written(whole, "classes")
    class_of = hot_join(members.select("key", "copies", "cls"), whole, "cls", "texts", nodes.count()).select("key", "rep", "class_size", "copies")
    out = hot_join(signed.select("doc_id", "thash", "key"), written(class_of, "class_of"), "key", "copies", signed.count())
    return out.select(
        "doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("thash") == F.col("rep.thash")))).alias("is_rep"), "thash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near duplicates: of each class of near_duplicates() the row of its representative, with all columns of docs.

    Null, empty and blank texts all stay, as classes of their own. If the representative's row is repeated, one of
    the repetitions stays. Texts of any length are read whole. Other columns may have any names and stay as
    they are. An empty table gives an empty result.
    """
    d, h, t = free_names(docs, "d", "h", "t")
    found = near_duplicates(docs.select("doc_id", "text"), **options).select(F.col("doc_id").alias(d), F.col("thash").alias(h), "is_rep", "class_size")
    found = written(found, "classes")
    same = lambda of: F.col("doc_id").cast("long").eqNullSafe(of[d]) & (F.col(t) == of[h])
    lost = written(found.filter("not is_rep").select(d, h).distinct(), "lost")
    kept = docs.withColumn(t, text_hash("text"))
    kept = kept.join(maybe_broadcast(lost), same(lost), "left_anti")
    again = found.filter("is_rep and class_size > 1").groupBy(d, h).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(d, h)
    again = written(again, "again")
    if again.limit(1).count():  # whole rows are repeated: one stays
        some = maybe_broadcast(again)
        kept = kept.join(some, same(again), "left_anti").unionByName(kept.join(some, same(again), "left_semi").dropDuplicates(["doc_id", t]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
