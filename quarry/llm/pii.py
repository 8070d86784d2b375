"""Format-preserving pseudonyms for personal numbers, dates and addresses in texts.

Finds are validated (Luhn and IBAN check digits, calendar dates, allotted number ranges), turned into
an integer of their kind's domain, permuted there by a keyed Feistel network with cycle walking, and
written back in their own format with fresh check digits. A value has the same pseudonym wherever and
however punctuated it stands, as the permutation depends on the key, the kind and the value alone.
With the key, recover() undoes it.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import shipped

ROUNDS = 8
#: The setting of Spark with the key, for setting_key().
SETTING = "spark.quarry.pii.key"


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 (its inverse with `back`)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def f(i: int, x: int) -> int:
        d = hashlib.blake2b(b"%d:%d:" % (i, x) + tweak.encode() + b":%d" % size, key=key[:64], digest_size=min(64, half // 8 + 8)).digest()
        return int.from_bytes(d, "big") & mask

    while True:
        a, b = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ f(i, a), a) if back else (b, a ^ f(i, b))
        value = a << half | b
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    s = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -s % 10


def iban_check(country: str, bban: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{bban}{country}00")) % 97


@dataclass(frozen=True)
class Value:
    """A find's integer within its domain, what the permutation is tied to, and how a new integer is written."""

    number: int
    size: int
    tweak: str
    write: object


def _fill(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced in turn, keeping case."""
    it = iter(chars)
    return "".join((lambda n: n.upper() if c.isupper() else n)(next(it)) if c.isascii() and c.isalnum() else c for c in shape)


def _mixed(text: str) -> tuple[int, int, object]:
    """Number and domain of the letters and digits of a text, each within its own kind, and the way back."""
    low = [c for c in text.lower() if c.isascii() and c.isalnum()]
    number, size = 0, 1
    for c in low:
        base, d = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - 97)
        number, size = number * base + d, size * base

    def chars(n: int) -> str:
        out = []
        for c in reversed(low):
            n, d = divmod(n, 10 if c.isdigit() else 26)
            out.append(str(d) if c.isdigit() else chr(97 + d))
        return "".join(reversed(out))

    return number, size, chars


def _card(m: re.Match) -> Value | None:
    d = re.sub(r"\D", "", m[0])
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    n = len(d) - 2
    return Value(int(d[1:-1]), 10**n, f"card{d[0]}", lambda v: _fill(m[0], (x := f"{d[0]}{v:0{n}d}") + str(luhn(x))))


def _ssn(m: re.Match) -> Value | None:
    a, g, s = map(int, m[0].split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    a -= 1 + (a > 666)

    def write(v: int) -> str:
        v, s = divmod(v, 9999)
        x, g = divmod(v, 99)
        x += 1
        return f"{x + (x >= 666):03d}-{g + 1:02d}-{s + 1:04d}"

    return Value((a * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn", write)


def _iban(m: re.Match) -> Value | None:
    d = re.sub(r" ", "", m[0])
    if not 15 <= len(d) <= 34 or int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 != 1:
        return None
    number, size, chars = _mixed(d[4:])
    return Value(number, size, f"iban{d[:2]}", lambda v: _fill(m[0], f"{d[:2].lower()}{iban_check(d[:2], (x := chars(v)).upper()):02d}{x}"))


def _phone(m: re.Match) -> Value | None:
    d = re.sub(r"\D", "", m[0])
    head, d = d[:-10], d[-10:]
    if d[0] in "01" or d[3] in "01":
        # Not allotted, so only a number in explicit form is one. Such numbers have a domain of their own: first the areas below 200, then the exchanges.
        if m[0][0] != "+" and "(" not in m[0]:
            return None
        low = 200 * 10**7
        at = int(d) if d[0] in "01" else low + ((int(d[:3]) - 200) * 200 + int(d[3:6])) * 10000 + int(d[6:])

        def write(v: int) -> str:
            x, line = divmod(v - low, 10000)
            return _fill(m[0], head + (f"{v:010d}" if v < low else f"{x // 200 + 200}{x % 200:03d}{line:04d}"))

        return Value(at, low + 800 * 200 * 10000, "phone0", write)
    number = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10000 + int(d[6:])
    return Value(number, 800 * 800 * 10000, "phone", lambda v: _fill(m[0], f"{head}{v // 10000 // 800 + 200}{v // 10000 % 800 + 200}{v % 10000:04d}"))


def _abroad(m: re.Match) -> Value | None:
    d, code = re.sub(r"\D", "", m[0]), re.match(r"\+(\d{1,3})", m[0])[1]
    n = len(d) - len(code)
    if not 8 <= len(d) <= 15 or n < 6:
        return None
    return Value(int(d[len(code) :]), 10**n, f"phone+{code}/{n}", lambda v: _fill(m[0], f"{code}{v:0{n}d}"))


def _ip(m: re.Match) -> Value | None:
    o = [int(x) for x in m[0].split(".")]
    if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    n = int.from_bytes(bytes(o), "big")
    for first, bits in ((10 << 24, 24), (127 << 24, 24), (0xAC100000, 20), (0xC0A80000, 16)):
        if n >> bits == first >> bits:
            return Value(n - first, 1 << bits, f"ip{first}", lambda v, first=first: ".".join(map(str, (first + v).to_bytes(4, "big"))))
    kept = ((10 << 24, 1 << 24), (127 << 24, 1 << 24), (0xAC100000, 1 << 20), (0xC0A80000, 1 << 16))
    at = n - sum(size for first, size in kept if first < n)

    def write(v: int) -> str:
        for first, size in sorted(kept):
            v += size if v >= first else 0
        return ".".join(map(str, v.to_bytes(4, "big")))

    return Value(at, (1 << 32) - sum(s for _, s in kept), "ip", write)


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _date(m: re.Match) -> Value | None:
    text = m[0]
    parts = re.findall(r"\d+|[A-Za-z]+", text)
    named = [i for i, p in enumerate(parts) if p.isalpha()]
    if named:
        name = parts[named[0]].lower()
        month = next((i + 1 for i, n in enumerate(_MONTHS) if n == name or n[:3] == name), 0)
        order = "dmy" if named[0] else "mdy"
        day, year = int(parts[1 - named[0]]), int(parts[2])
    else:
        nums = [int(p) for p in parts]
        order = "ymd" if len(parts[0]) == 4 else "dmy" if "." in text or nums[0] > 12 else "mdy"
        day, month, year = (nums[order.index(c)] for c in "dmy")
    try:
        when = datetime.date(year, month, day)
    except ValueError:
        return None
    first = datetime.date(max(1, year // 100 * 100), 1, 1)
    size = datetime.date(year // 100 * 100 + 99, 12, 31).toordinal() - first.toordinal() + 1

    def write(v: int) -> str:
        d = first + datetime.timedelta(v)
        new = []
        for c, old in zip(order, parts, strict=True):
            if old.isalpha():
                word = _MONTHS[d.month - 1][: 3 if len(old) == 3 else None]
                new.append(word.upper() if old.isupper() else word.title() if old[0].isupper() else word)
            else:
                n = {"d": d.day, "m": d.month, "y": d.year}[c]
                new.append(f"{n:0{len(old) if c == 'y' or len(old) == 2 and (old[0] == '0' or not named) else 1}d}")
        it = iter(new)
        return re.sub(r"\d+|[A-Za-z]+", lambda _: next(it), text)

    return Value(when.toordinal() - first.toordinal(), size, f"date{first}", write)


def _email(m: re.Match) -> Value | None:
    local, _, host = m["v"].rpartition("@")
    if len(local) > 64:  # longer names are not valid
        return None
    number, size, chars = _mixed(local)
    return Value(number, size, f"mail{re.sub('[a-z]', 'a', re.sub('[0-9]', '0', local.lower()))}@{host.lower()}", lambda v: f"{_fill(local, chars(v))}@{host}") if size > 1 else None


def _secret(m: re.Match) -> Value | None:
    d = m[0].lower()
    if d.isdigit() or d.isalpha():
        return None
    return Value(int(d, 16), 16 ** len(d), f"hex{len(d)}", lambda v: (lambda x: x.upper() if m[0].isupper() else x)(f"{v:0{len(d)}x}"))


def _word(m: re.Match) -> Value | None:
    number, size, chars = _mixed(m["v"])
    shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", m["v"].lower()))
    return Value(number, size, f"word{shape}", lambda v: _fill(m["v"], chars(v))) if size > 1 else None


def _assigned(m: re.Match) -> Value | None:
    """A value behind password= and the like; one without a digit may be an ordinary word."""
    return _word(m) if re.search("[0-9]", m["v"]) else None


_MON = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: In order of precedence; a find keeps later kinds off its characters.
KINDS = (
    ("email", _email, re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*+(?P<v>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")),
    ("iban", _iban, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("secret", _secret, re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")),
    ("secret", _assigned, re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)(?P<v>[^\s\"']{6,128})")),
    ("secret", _word, re.compile(r"\bAKIA(?P<v>[0-9A-Z]{16})\b")),
    ("ip", _ip, re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")),
    ("date", _date, re.compile(rf"(?<![\d/.-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|\d{{4}}/\d{{2}}/\d{{2}})(?![\d/-])|\b\d{{1,2}} {_MON} \d{{4}}\b|\b{_MON} \d{{1,2}}, \d{{4}}\b")),
    ("ssn", _ssn, re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", _card, re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")),
    ("phone", _phone, re.compile(r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<!\d)\+1\d{10}(?!\d)")),
    ("phone", _abroad, re.compile(r"(?<![\d+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){2,5}(?!\d)")),
)


def finds(text: str, kinds: frozenset[str] | None = None) -> list[tuple[int, int, str, Value]]:
    """(start, end, kind, value) of the valid finds, in order, none overlapping."""
    out: list[tuple[int, int, str, Value]] = []
    taken: list[tuple[int, int]] = []
    for kind, read, pattern in KINDS:
        if kinds is not None and kind not in kinds:
            continue
        part = "v" if "v" in pattern.groupindex else 0
        new = [(*m.span(part), kind, v) for m in pattern.finditer(text) if (v := read(m))]
        if taken and new:
            starts = np.array([a for a, _ in taken])
            ends = np.array([b for _, b in taken])
            new = [x for x in new if (i := int(np.searchsorted(starts, x[1])) - 1) < 0 or ends[i] <= x[0]]
        out += new
        taken = sorted((a, b) for a, b, _, _ in out)
    return sorted(out, key=lambda x: x[0])


def pseudonymise(text: str, key: bytes, kinds: frozenset[str] | None = None, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of what was replaced, in characters of the given text."""
    out, at, spans = [], 0, []
    for a, b, kind, v in finds(text, kinds):
        out += text[at:a], v.write(_permuted(v.number, v.size, key, v.tweak, back))
        spans.append((a, b, kind))
        at = b
    return "".join([*out, text[at:]]), spans


@functools.lru_cache(1 << 16)
def _permuted(number: int, size: int, key: bytes, tweak: str, back: bool) -> int:
    return feistel(number, size, key, tweak, back)


def recover(text: str, key: bytes, kinds: frozenset[str] | None = None) -> str:
    """The text as it was before pseudonymise() with that key."""
    return pseudonymise(text, key, kinds, back=True)[0]


#: Digits, @, = and : have one of these in every find but keys with a prefix.
_SIGN = np.zeros(256, bool)
_SIGN[[*range(48, 59), 61, 64]] = True


def setting_key(spark: SparkSession) -> bytes:
    """The key in spark.quarry.pii.key; where that is not set, a fresh random one that nobody knows, for this call alone."""
    told = spark.conf.get(SETTING, None)
    return told.encode() if told else secrets.token_bytes(32)


def mask(docs: DataFrame, *, key: bytes, kinds: frozenset[str] | None = None) -> DataFrame:
    """docs with text pseudonymised and `spans` (array of start, end, kind) added; both null where text is null.

    Without the key, which has no default, nothing can be undone. Texts without finds stay byte for byte as they
    are. Every text is read whole, at a cost in proportion to its length; those without a digit,
    an @, an = and a key prefix hold no find and are passed over by a vectorised count. A column named spans is replaced.
    Repeated rows, null ids and other columns pass through. An empty table gives an empty result.
    """
    docs = docs.drop("spans")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            look = np.concatenate([np.zeros(0, bool), *(g.per_doc(_SIGN[g.data]) > 0 for g in K.groups(texts))])
            new = texts.to_pylist()
            look |= np.array([t is not None and "AKIA" in t for t in new], bool)
            spans = [[] if ok else None for ok in texts.is_valid().to_pylist()]
            for i in np.flatnonzero(look):
                new[i], got = pseudonymise(new[i], key, kinds)
                spans[i] = [{"start": a, "end": b, "kind": k} for a, b, k in got]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], [*batch.schema.names, "spans"])

    return shipped(docs).mapInArrow(run, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_private (finds), text (pseudonymised) and spans of each row of docs."""
    out = mask(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_private"), "text", "spans")
