"""Personal data (operator 4): rules for four kinds, and a character-level BiLSTM-CRF that adds spans in forms that the rules miss.

The network is trained on windows around rule spans of a bounded sample, and on those spans rewritten into other forms. A text is covered by
overlapping windows; those without a digit, an @ or an opening bracket are all outside, unless a span runs into them from a neighbour. Windows are reconciled
into one sequence of tags for the whole text: each position has its tag from the window that it lies deepest in, and a span goes on across windows, however
long it is. Rule spans stay; an added span must overlap none and hold what its kind needs.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bilstm import BiLstmCrf, encode
from .common import Scratch, small_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]
SIZE, STEP = 96, 48
#: Documents that windows are looked for in; windows fitted on at most, those of least hash; sequences decoded at a time; spans of one text that are fitted on.
SAMPLE_DOCS, TRAIN_WINDOWS, BATCH, PER_TEXT = 20_000, 2400, 512, 16
_TRIGGER = re.compile(r"[0-9@(\[]")
_AT, _DOT = re.compile(r" ?[(\[]at[)\]] ?| @ "), re.compile(r" ?[(\[]dot[)\]] ?")

# fixed values: the patterns of the contract, in forms without needless backtracking
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(d := _digits(value)) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(_digits(value)) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost matches, those that fail the check dropped."""
    if not text:
        return []
    found = {"email": _emails(text)} | {k: [m.span() for m in p.finditer(text)] for k, p in (("ip", _IP), ("card", _CARD), ("phone", _PHONE))}
    return [(k, a, b) for k in KINDS for a, b in found[k] if valid(k, text[a:b])]


def _tagged(text: str, spans: list[tuple[str, int, int]], at: int) -> tuple[str, list[int]]:
    tags = [0] * SIZE
    for kind, a, b in spans:
        for p in range(max(a, at), min(b, at + SIZE)):
            tags[p - at] = TAGS.index(f"{'B' if p == a or p == at else 'I'}-{kind}")
    return text[at : at + SIZE].ljust(SIZE, "\n"), tags


def rewritten(kind: str, value: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Other forms of the same datum, with where it stands in each."""
    d = _digits(value)
    if kind == "phone":
        code, a, b, c = d[:-10], d[-10:-7], d[-7:-4], d[-4:]
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{code} {a} {b} {c}", f"{a} {b} {c}"] if len(d) > 10 else []
    elif kind == "card":
        forms = [x.join(d[i : i + 4] for i in range(0, len(d), 4)) for x in "./"]
    elif kind == "ip":
        forms = [value.replace(".", x) for x in ("[.]", "(.)", " . ")]
    else:
        user, _, host = value.partition("@")
        forms = [f"{user}(at){host}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user} @ {host}"]
    out = [(f, [(0, len(f))]) for f in forms]
    # two in a row are one run of digits to the rules, too long for a card
    return [*out, (f"{value} {value}", [(0, len(value)), (len(value) + 1, 2 * len(value) + 1)])] if kind == "card" else out


def training_windows(text: str) -> list[tuple[str, list[int]]]:
    """Windows around rule spans, PER_TEXT of them at most and evenly over the text, as they are and in all other forms, and around digits that no rule takes."""
    all_ = sorted(base_spans(text), key=lambda s: s[1:])
    starts, reach = [s[1] for s in all_], max((s[2] - s[1] for s in all_), default=0)
    out = []
    for n in range(0, len(all_), max(1, -(-len(all_) // PER_TEXT))):
        kind, a, b = all_[n]
        for turn, (new, spans) in enumerate([(text[a:b], []), *rewritten(kind, text[a:b])]):
            shift = (a * 7 + n * 3 + turn * 29) % (SIZE - 16)  # the span may be cut by the window
            if not turn:
                out.append(_tagged(text, all_[bisect_left(starts, a - SIZE - reach) : bisect_right(starts, b + SIZE)], max(0, a - shift)))
            elif not any(x < b + SIZE and a - SIZE < y for k, (_, x, y) in enumerate(all_) if k != n):
                lead, tail = text[max(0, a - shift) : a], text[b : b + SIZE]
                out.append(_tagged(lead + new + tail, [(kind, len(lead) + x, len(lead) + y) for x, y in spans], 0))
    for m in itertools.islice(_TRIGGER.finditer(text), 0, 400, 100):
        if not any(a < m.start() + SIZE and m.start() - SIZE < b for _, a, b in all_):
            out.append(_tagged(text, [], max(0, m.start() - 30)))
    return out


def fit(windows: list[tuple[str, list[int]]]) -> BiLstmCrf | None:
    """None without windows."""
    if not windows:
        return None
    net = BiLstmCrf(TAGS)
    net.fit(np.stack([encode(t) for t, _ in windows]), np.array([g for _, g in windows]))
    return net


def _has_trigger(column: pa.Array) -> np.ndarray:
    """Rows with a digit, an @ or an opening bracket, by a pass over the bytes."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 0x30) & (data <= 0x39)) | (data == 0x40) | (data == 0x28) | (data == 0x5B), out=sums[1:])
    return sums[offs[1:] - offs[0]] > sums[offs[:-1] - offs[0]]


def learn(spark: SparkSession, docs: DataFrame) -> BiLstmCrf | None:
    """A network from the texts of about SAMPLE_DOCS documents."""
    small_batches(spark)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where("text IS NOT NULL").where(F.shiftrightunsigned(F.xxhash64(F.lit("pii"), "text"), 11).cast("double") / float(2**53) < share)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [w for t, any_ in zip(b.column("text"), _has_trigger(b.column("text")), strict=True) if any_ for w in training_windows(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in got], pa.string()), pa.array([w[1] for w in got], pa.list_(pa.int32()))], ["w", "tags"])

    table = Scratch(spark, "private").table(some.select("text").mapInArrow(make, "w string, tags array<int>").distinct(), "windows")
    rows = table.withColumn("h", F.xxhash64("w", "tags")).orderBy("h", "w", "tags").limit(TRAIN_WINDOWS).collect()
    return fit([(r["w"], r["tags"]) for r in rows])


def _tags(net: BiLstmCrf, texts: list[str]) -> list[np.ndarray]:
    """Tags of all positions of each text. Window k starts at k * STEP and decides its middle, the first and the last also the text's ends."""
    n = [max(1, -(-(len(t) - SIZE) // STEP) + 1) for t in texts]
    out, done = [np.zeros(len(t), np.int8) for t in texts], [np.zeros(k, dtype=bool) for k in n]
    edge = (SIZE - STEP) // 2

    def own(i: int, k: int) -> tuple[int, int]:
        return (0 if k == 0 else k * STEP + edge), (len(texts[i]) if k == n[i] - 1 else min(len(texts[i]), k * STEP + edge + STEP))

    todo = []
    for i, t in enumerate(texts):
        at = np.array([m.start() for m in _TRIGGER.finditer(t)], dtype=np.int64)
        s = np.arange(n[i]) * STEP
        todo += [(i, int(k)) for k in np.flatnonzero(np.searchsorted(at, s + SIZE) > np.searchsorted(at, s))]
    while todo:
        more = set()
        for j in range(0, len(todo), BATCH):
            part = todo[j : j + BATCH]
            got = net.decode(np.stack([encode(texts[i][k * STEP : k * STEP + SIZE].ljust(SIZE, "\n")) for i, k in part]).T).T
            for (i, k), row in zip(part, got, strict=True):
                a, b = own(i, k)
                out[i][a:b] = row[a - k * STEP : b - k * STEP]
                done[i][k] = True
                if a < b:  # a span that reaches the end of what is decoded
                    more |= {(i, x) for x, p in ((k - 1, a), (k + 1, b - 1)) if 0 <= x < n[i] and out[i][p]}
        todo = sorted(x for x in more if not done[x[0]][x[1]])
    return out


def added_spans(net: BiLstmCrf | None, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the network adds to each text's rule spans."""
    out = []
    for t, b, tags in zip(texts, base, _tags(net, texts) if net else [np.zeros(0, np.int8)] * len(texts), strict=True):
        kind = (tags + 1) // 2  # 0 is outside; the first tag of a kind begins a span
        before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
        first = np.flatnonzero((kind > 0) & ((tags % 2 == 1) | (kind != before)))
        last = np.flatnonzero((before > 0) & ((kind != before) | (tags % 2 == 1)))
        last = np.append(last, len(tags)) if len(last) < len(first) else last
        held = np.zeros(len(t) + 1, np.int64)
        for _, x, y in b:
            held[x] += 1
            held[y] -= 1
        held = np.concatenate([[0], np.cumsum(np.cumsum(held) > 0)])
        kept: list[tuple[str, int, int]] = []
        for x, y in zip(first.tolist(), last.tolist(), strict=True):
            name = KINDS[kind[x] - 1]
            # what is no datum as a whole may be several, with blanks between
            for u, v in _pieces(name, t, x, y):
                clear = (u == 0 or not t[u - 1].isalnum()) and (v == len(t) or not t[v].isalnum())
                if clear and held[v] == held[u]:
                    kept.append((name, u, v))
        out.append(kept)
    return out


def _pieces(kind: str, text: str, x: int, y: int) -> list[tuple[int, int]]:
    """text[x:y] without blanks and stops at its ends if it is plausible, else those of its words that are."""
    for parts in ([(x, y)], [m.span() for m in re.compile(r"[^ \n]+").finditer(text, x, y)]):
        trimmed = [(b - len(text[a:b].lstrip(" .,;:\n")), a + len(text[a:b].rstrip(" .,;:\n"))) for a, b in parts]
        if found := [(a, b) for a, b in trimmed if a < b and plausible(kind, text[a:b])]:
            return found
    return []


def plausible(kind: str, value: str) -> bool:
    """What an added span must hold."""
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", value))
        return base_spans(plain)[:1] == [("email", 0, len(plain))]
    if kind == "ip":
        plain = "".join(c for c in value if c not in " []()")
        return bool(_IP.fullmatch(plain)) and valid("ip", plain)
    if not all(c in "0123456789+-()./ " for c in value) or not valid(kind, value):
        return False
    return kind == "card" or (value[0] in "+(0123456789" and any(c in value for c in " -.()"))


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(spark: SparkSession, docs: DataFrame, net: BiLstmCrf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row: counts and digest of the rule spans, all
    spans, and how many of them the network added; positions are code points, ends exclusive.

    Nulls: a null text is empty; a null doc_id is kept. Empty texts have no spans. Repeated rows are returned each. Empty tables: no rows.
    Texts are searched whole; memory grows with one batch of texts."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few thousand numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero(_has_trigger(b.column("text"))) if b.num_rows else []
            texts = [b.column("text")[int(i)].as_py() for i in hit]
            base = [base_spans(t) for t in texts]
            more = added_spans(shared.value, texts, base)
            all_ = [[0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0] for _ in range(b.num_rows)]
            for i, own, extra in zip(hit, base, more, strict=True):
                n = Counter(k for k, _, _ in own)
                all_[i] = [*(n[k] for k in KINDS), hashlib.sha256(_listed(own).encode()).hexdigest(), _listed(own + extra), len(extra)]
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in all_], k) for i, k in enumerate(kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(spark, docs, learn(spark, docs.select("text")))
