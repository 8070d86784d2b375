"""Fixtures and brute-force versions for the tests of this folder."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
SF = "/root/testdata/sf0.001"
CLASHING = {"key": "k", "hash": 1, "score": "s", "n": 2, "thash": "t", "lines": "l", "h": 3, "d": 4, "T": "x", "_t": "y", "__t": "z", "__d": 5, "o": "o", "gone": "g", "cut": "c",
            "n_lines": "p", "kept_text": "q", "hot": "r", "key 2": "u", "is_rep": 6, "root": 7}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {'string' if isinstance(v, str) else 'long'}" for c, v in CLASHING.items())

LONG = "\n".join(f"Line {i} of a very long text, with words of its own {i * 7919 % 10007}." for i in range(9000))
EDGES = [
    (1, "The cat sat on the mat and looked at the dog for a long while today."),
    (2, None), (3, ""), (4, " \t\n \n"), (5, "x"), (6, "x"), (7, LONG), (None, "A null id has a text too, of some words."),
    (None, None), (8, "#### $$$ 1234 ----"), (9, "Repeated row of the table, word for word."), (9, "Repeated row of the table, word for word."),
    (10, "a" * 60_000), (11, "é ü ß ñ ç"), (12, "\U0001f600 　   end"), (1, "The same id again with another text."),
]


def frame(spark, rows):
    """Documents of (doc_id, text) rows with columns that clash with names used inside."""
    full = [(i, t, None if t is None else "en", None if i is None else f"src{i % 2}", None if t is None else len(t), *CLASHING.values()) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_sets(texts, k=5):
    out = []
    for t in texts:
        w = words((t or "").translate(FOLD))
        out.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or Counter([tuple(w)] if w else []))
    return out


def near_classes(pairs, threshold=0.8):
    """Least index connected with each of (doc_id, text) pairs by multiset Jaccard, by comparing all that share a shingle."""
    sets = shingle_sets([t for _, t in pairs])
    post = defaultdict(list)
    for i, c in enumerate(sets):
        for s in c:
            post[s].append(i)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, c in enumerate(sets):
        for j in {j for s in c for j in post[s] if j < i}:
            both = sum((c & sets[j]).values())
            if both >= threshold * (sum(c.values()) + sum(sets[j].values()) - both) - 1e-9:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(sets))]


def without_common_lines(texts, limit=10):
    keys = [[x.strip(BLANK).translate(FOLD) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for ks in keys for k in set(ks))
    out = []
    for t, ks in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if not (k and n[k] >= limit)]
        out.append((len(ks), len(ks) - len(kept), "\n".join(kept)))
    return out


def quality(docs):
    """(counts, base_failed, kept, text without lines over the limit) for (text, host) pairs."""
    out, seen = [], defaultdict(set)
    for text, host in docs:
        t, w = text or "", words(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        for x in lines:
            seen[host or "", " ".join(words(x)).translate(FOLD)].add(t)
        out.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)))
    over = {k for k, v in seen.items() if len(v) > 10}
    res = []
    for (text, host), c in zip(docs, out, strict=True):
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        lines = (text or "").split("\n")
        left = [x for x in lines if (host or "", " ".join(words(x)).translate(FOLD)) not in over]
        kept = not failed and 100 * sum(len(words(x)) for x in left) >= 30 * c[0]
        res.append((c, failed, kept, "\n".join(left)))
    return res


def leaking(texts, items, cover=13):
    """Indexes of the texts that carry an item's words (letters and digits, case ignored) for `cover` words in a row, or all it has."""
    norm = lambda t: [m.rstrip(".!?").lower() for m in re.findall(r"[^\W\d_][^\W\d_']*[.!?]?|\d+(?:[.,:/-]\d+)*[.!?]?", t or "")]
    grams = set()
    sizes = set()
    for item in items:
        w = norm(item)
        if len(w) >= 5:
            k = min(cover, len(w))
            sizes.add(k)
            grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for i, t in enumerate(texts):
        w = norm(t)
        if any(tuple(w[j : j + k]) in grams for k in sizes for j in range(len(w) - k + 1)):
            out.add(i)
    return out
