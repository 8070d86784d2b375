"""Benchmark decontamination by canonical templates, in DataFrame operations only.

Texts are cut into tokens: words and numbers. Two canonical forms are compared:
  names: numbers, units behind a number, and words with a capital become <num>, <unit>, <name>;
  plain: numbers and units only, everything else in lower case, so changed case is found too.
A window is `window` canonical tokens (the whole item if that is shorter). Windows of the benchmark
are hash-joined with the documents through an anchor, the window's longest literal: a document has a
window only if it has its anchor, so tokens are first joined with the anchors and only around those
hits are windows formed and their hashes compared. A window with too few literals in a form is exact there: its
tokens are all taken as literals, numbers too, and must stand in the document as they are. Then the values
behind the placeholders must be consistent along one alignment: where a value of the item is more than one value
in the document, the windows that hold it do not count, unless all values of a window are those of the item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_names, text_hash, written

TOKEN = r"\p{L}[\p{L}\p{M}']*[.!?]?|\d+(?:[.,:/-]\d+)*[.!?]?"
# Words that are units when a number stands before them.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "kilometers", "kilometres",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "ton", "tons", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "usd", "euro", "euros", "eur", "gbp", "percent", "degree", "degrees", "mph", "kmh", "hz", "w", "kw", "v", "j", "kj", "cal", "kcal",
)
FORMS = ("names", "plain")
#: Windows (some 400 bytes each) that are broadcast at once; more go against the documents in blocks.
WINDOW_ROWS = 100_000


def bare(t: Column) -> Column:
    return F.rtrim(t, F.lit(".!?"))


def is_number(t: Column) -> Column:
    return t.between("0", "9~")


def canonical(tokens: Column, form: str, at: Column, before: Column) -> Column:
    """The placeholder or literal of the token at index `at`; `before` is the one before it, or null."""
    t = bare(F.get(tokens, at))
    head = F.substring(t, 1, 1)
    unit = F.coalesce(is_number(before), F.lit(False)) & F.lower(t).isin(*UNITS)
    out = F.when(is_number(t), "<num>").when(unit, "<unit>")
    if form == "names":
        out = out.when(head != F.lower(head), "<name>")
    return out.otherwise(F.lower(t))


def window_of(tokens: Column, form: str, start: Column, size: Column) -> Column:
    """The canonical tokens from index `start`."""
    return F.transform(F.sequence(start, start + size - 1), lambda i: canonical(tokens, form, i, F.when(i > 0, F.get(tokens, i - 1))))


def values(tokens: Column, start: Column, size: Column) -> Column:
    return F.transform(F.sequence(start, start + size - 1), lambda i: F.lower(bare(F.get(tokens, i))))


def windows(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    """Windows of the items: item_id, form, exact, idx, size, n, anchor, off, second, off2, hash, canon, vals. Those with fewer than `literals` literals are exact."""
    items = benchmark.select("item_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    items = items.distinct().withColumn("n", F.size("tokens")).filter(F.col("n") > 0).withColumn("size", F.least(F.lit(window), F.col("n")))
    at = items.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("idx"))
    parts = []
    for form in FORMS:
        one = at.withColumn("form", F.lit(form)).withColumn("canon", window_of(F.col("tokens"), form, F.col("idx"), F.col("size")))
        one = one.withColumn("vals", values(F.col("tokens"), F.col("idx"), F.col("size")))
        one = one.withColumn("exact", F.size(F.filter("canon", lambda t: ~t.startswith("<"))) < F.least(F.lit(literals), F.col("size")))
        one = one.withColumn("canon", F.when(F.col("exact"), F.col("vals")).otherwise(F.col("canon")))
        marked = F.transform("canon", lambda t, i: F.struct(F.when(t.startswith("<"), 0).otherwise(F.length(t)).alias("len"), t.alias("word"), i.alias("off")))
        parts.append(one.withColumn("order", F.sort_array(marked, asc=False)))
    all_ = parts[0].union(parts[1])
    first = F.get("order", F.lit(0))
    second = F.coalesce(F.get("order", F.lit(1)), first)  # a window of one token has no other
    return all_.select("item_id", "form", "exact", "idx", "size", "n", first.word.alias("anchor"), first.off.alias("off"), second.word.alias("second"), second.off.alias("off2"), F.xxhash64("canon").alias("hash"), "canon", "vals")


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash("text").alias("thash"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tokens"))


def _hits(tokens: DataFrame, win: DataFrame) -> DataFrame:
    """The windows of a block, small enough to broadcast, that documents have."""
    win = win.drop("canon")
    # The outer form spares a filter that would cut every text into tokens a second time.
    each = tokens.select("*", F.posexplode_outer("tokens").alias("pos", "tok"))
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("size") <= F.size("tokens")) & (F.lower(bare(F.get("tokens", start + F.col("off2")))) == F.col("second"))
    hit = each.join(F.broadcast(win), (F.lower(bare(F.col("tok"))) == F.col("anchor")) & fits)
    lead = F.when(start > 0, 1).otherwise(0)
    # The id keeps what follows out of the join, whose rows hold whole token arrays and should stay in generated code.
    hit = hit.select("doc_id", "thash", "item_id", "form", "exact", "n", "size", "idx", "hash", "vals", (start - F.col("idx")).alias("shift"), lead.alias("lead"),
                     F.slice("tokens", F.greatest(start + 1 - lead, F.lit(1)), F.col("size") + lead).alias("part"), F.monotonically_increasing_id().alias("barrier"))
    part, lead, size = F.col("part"), F.col("lead"), F.col("size")
    hit = hit.withColumn("canon", F.when(F.col("exact"), values(part, lead, size)).when(F.col("form") == FORMS[0], window_of(part, FORMS[0], lead, size)).otherwise(window_of(part, FORMS[1], lead, size)))
    hit = hit.filter((F.xxhash64("canon") == F.col("hash")) & (F.col("barrier") >= 0))
    slots = F.filter(F.transform(F.arrays_zip("canon", "vals", values(part, lead, size).alias("own")), lambda z: F.when(z["canon"].startswith("<"), F.struct(z["vals"].alias("a"), z["own"].alias("b")))), lambda z: z.isNotNull())
    return hit.select("doc_id", "thash", "item_id", "form", "n", "size", "idx", "shift", slots.alias("pairs"))


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 8, literals: int = 5, cover: int = 13) -> DataFrame:
    """(doc_id, thash, item_id, form, n_windows, covered, item_tokens) of documents that carry an item.

    Windows count if their canonical tokens are equal and the values behind placeholders are consistent
    along their alignment, or all those of the item. An item is carried if `cover` of its tokens, or all it
    has, are in such windows.
    Windows of fewer than `literals` literals, and so items of fewer tokens with placeholders, must be found
    as they are, case aside; an item of a token or two is thus in many documents. Null or empty
    texts and items match nothing. Texts are read whole, at a cost in proportion to their length. Repeated rows
    and null ids: one result for (doc_id, text). Of forms that cover as much, the one with more windows is told,
    then the later by name. Other columns are not read; empty tables give an empty result.
    """
    win = written(windows(benchmark.select("item_id", "text"), window, literals), "windows")
    blocks = max(1, -(-win.count() // WINDOW_ROWS))
    part = F.pmod(F.xxhash64("item_id", "form", "idx"), F.lit(blocks))
    tokens = _tokens(docs) if blocks == 1 else written(_tokens(docs), "tokens")
    hit = reduce(DataFrame.unionByName, [_hits(tokens, win.filter(part == b)) for b in range(blocks)])
    one = hit.groupBy("doc_id", "thash", "item_id", "form", "n", "shift").agg(F.collect_set(F.struct("idx", "size", "pairs")).alias("all"))
    one = one.withColumn("sorted", F.sort_array(F.flatten(F.transform("all", lambda w: w.pairs))))
    before = lambda i: F.get(F.col("sorted"), i - 1)
    clash = F.filter("sorted", lambda p, i: (i > 0) & (before(i).a == p.a) & (before(i).b != p.b))
    one = one.withColumn("clash", F.transform(clash, lambda p: p.a))
    fine = lambda w: F.forall(w.pairs, lambda p: p.a == p.b) | ~F.exists(w.pairs, lambda p: F.array_contains(F.col("clash"), p.a))
    one = one.withColumn("at", F.filter("all", fine)).filter(F.size("at") > 0)
    spans = F.flatten(F.transform(F.flatten(F.collect_list("at")), lambda x: F.sequence(x.idx, x.idx + x.size - 1)))
    found = one.groupBy("doc_id", "thash", "item_id", "form", "n").agg(F.sum(F.size("at")).alias("n_windows"), F.size(F.array_distinct(spans)).cast("long").alias("covered"))
    best = found.groupBy("doc_id", "thash", "item_id", F.col("n").cast("long").alias("item_tokens")).agg(F.max(F.struct("covered", "n_windows", "form")).alias("m"))
    best = best.select("doc_id", "thash", "item_id", "m.form", "m.n_windows", "m.covered", "item_tokens")
    return best.filter(F.col("covered") >= F.least(F.lit(cover), F.col("item_tokens")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that carry no item of the benchmark by matches(), with all their columns.

    Null, empty and blank texts carry nothing and stay; so do all repetitions of a row that stays. Texts of any
    length are read whole. doc_id may be of any type that compares. Other columns may have any names. An empty
    table or benchmark drops nothing.
    """
    d, t = free_names(docs, "d", "t")
    bad = written(matches(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias(d), F.col("thash").alias(t)).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[d]) & (text_hash("text") == bad[t]), "left_anti")
