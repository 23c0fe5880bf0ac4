"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds spans.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches per kind that pass the
kind's check. The tagger is trained in numpy on spans labelled by the base patterns in a bounded
sample of windows (``windows``) and on rewritings of them (other separators, spelt-out at and dot). A tagged span holds a
digit, an at sign or a spelt-out one by definition, so texts are read in windows around those
marks; everything else is outside by that rule. Windows overlap by half; each character takes its tag
from the window in which it lies furthest from an edge, and spans are formed on the whole text; a mail address is taken to the ends of its name and host, however far these reach.
An added span must pass its kind's check and not overlap a base span.

Defined cases: null and empty texts have no spans; equal texts have equal spans; offsets are code
points, end exclusive; without any base span in the sample the tagger adds nothing; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import TAGS, Tagger, char_ids
from .common import durable, small_batches, tidy, trim, utf8

KINDS = TAGS[1:]
#: The base patterns of the contract.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
HOST = re.compile(r"[A-Za-z0-9-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]|[\[({]at[\])}]|\bdot\b", re.IGNORECASE)
SPELT = re.compile(r"[\[({]?\b(?:at|dot)\b[\])}]?", re.IGNORECASE)
LENGTH, MARGIN = 96, 32
#: Training windows at most.
WINDOWS = 600


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def card_ok(s: str) -> bool:
    d = only_digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as listed."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and LOCAL.match(text[s - 1]):
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if card_ok(m[0])]
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return in_order(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all stretches within MARGIN characters of a mark."""
    stretches: list[list[int]] = []
    for m in MARK.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if stretches and s <= stretches[-1][1]:
            stretches[-1][1] = e
        else:
            stretches.append([s, e])
    out = []
    for s, e in stretches:
        out.append((s, min(e, s + LENGTH)))
        while out[-1][1] < e:
            s += LENGTH // 2
            out.append((s, min(e, s + LENGTH)))
    return out


def examples(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(window, start, end, kind) around each base span that shares its window with no other."""
    out, reach = [], -1  # where the spans before end at most
    for n, (k, s, e) in enumerate(spans):  # by start
        a, b = max(0, s - 30), min(len(text), e + 30)
        if e - s <= 36 and reach <= a and (n + 1 == len(spans) or spans[n + 1][1] >= b):
            out.append((text[a:b], s - a, e - a, k))
        reach = max(reach, e)
    return out


def rewritten(k: str, s: str, r: np.random.Generator) -> str:
    """Another way to write the same datum."""
    d, pick = only_digits(s), lambda *x: x[int(r.integers(len(x)))]
    if k == "phone" and len(d) == 11:
        a, b, c = d[1:4], d[4:7], d[7:]
        return pick(s, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d[0]}-{a}-{b}-{c}", f"{d[0]} {a} {b} {c}", f"1-{a}-{b}-{c}")
    if k == "card" and len(d) == 16:
        j = pick(" ", "-", "", ".")
        return j.join(d[i : i + 4] for i in range(0, 16, 4))
    if k == "email" and "@" in s:
        at, dot = pick(("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("[at]", "."))
        name, host = s.split("@", 1)
        return name + at + host.replace(".", dot)
    return s


def training_set(found: list[tuple[str, int, int, str]], seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Windows as they are, rewritten, and with the datum replaced by numbers that are none."""
    r, ids, tags = np.random.default_rng(seed), [], []
    for text, s, e, k in found:
        number = "".join(map(str, r.integers(0, 10, int(r.integers(1, 9)))))
        for new, tag in ((text[s:e], k), (rewritten(k, text[s:e], r), k), (rewritten(k, text[s:e], r), k), (["Version 2.0.", number, f"{number[:4]}-{number[4:6]}", f"no. {number}", number + "e9a0b7c"][int(r.integers(5))], "o")):
            w = text[:s] + new + text[e:]
            shift = int(r.integers(0, max(1, min(s, LENGTH - 60))))
            w, a = w[shift : shift + LENGTH], s - shift
            x, y = np.zeros(LENGTH, np.int64), np.zeros(LENGTH, np.int64)
            x[: len(w)] = char_ids(w)
            y[a : min(LENGTH, a + len(new))] = TAGS.index(tag)
            ids.append(x)
            tags.append(y)
    return np.array(ids).reshape(-1, LENGTH), np.array(tags).reshape(-1, LENGTH)


def fit(docs: DataFrame, windows: int = WINDOWS) -> Tagger | None:
    """From at most ``windows`` windows around base spans, the first of each kind by a hash of window and document."""
    small_batches(docs.sparkSession)

    most = windows // len(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple]] = {k: [] for k in KINDS}
        for batch in batches:
            for text in filter(None, marked(batch.column(0))):
                for w, s, e, k in examples(text, base_spans(text)):
                    best[k].append((xxhash.xxh64_intdigest(w.encode(), 9) >> 1, w, s, e, k))
            best = {k: sorted(set(rows))[:most] for k, rows in best.items()}  # a window that recurs counts once
        rows = [r for k in KINDS for r in best[k]]
        if rows:
            yield pa.record_batch([pa.array(c, ty) for c, ty in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["h", "w", "s", "e", "k"])

    # one scan; each task sends its first of each kind
    found = durable(docs.select("text").mapInArrow(tidy(run), "h long, w string, s long, e long, k string"), "pii-windows").distinct()
    each = [found.where(F.col("k") == k).orderBy("h", "w", "s").limit(most) for k in KINDS]
    union = each[0]
    for x in each[1:]:
        union = union.unionByName(x)
    rows = sorted((r["w"], r["s"], r["e"], r["k"]) for r in union.collect())
    if not rows:
        return None
    tagger = Tagger()
    tagger.train(*training_set(rows))
    tagger.p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
    trim()
    return tagger


def marked(column: pa.Array) -> list[str | None]:
    """Each text that has a mark, else None; only bytes are looked at to tell."""
    b, off = utf8(column)
    has = ((b >= 48) & (b <= 57)) | (b == 64)
    n = np.concatenate([[0], np.cumsum(has)])[off]
    out: list[str | None] = []
    for i in range(len(off) - 1):
        raw = b[off[i] : off[i + 1]].tobytes() if n[i + 1] > n[i] else None
        if raw is None and off[i + 1] - off[i] >= 3:
            whole = b[off[i] : off[i + 1]].tobytes()
            low = whole.lower()
            if b"dot" in low or b"(at)" in low or b"[at]" in low or b"{at}" in low:
                raw = whole
        out.append(raw.decode() if raw is not None else None)
    return out


def accepted(kind: str, s: str) -> bool:
    """The check that an added span must pass."""
    d = only_digits(s)
    if kind == "card":
        return card_ok(s)
    if kind == "phone":
        return 10 <= len(d) <= 15 and not re.fullmatch(r"[0-9]+", s)
    if kind == "ip":
        return bool(IP.fullmatch(s)) and all(int(p) <= 255 for p in s.split(".") if len(p) < 10)
    plain = SPELT.sub(lambda m: "@" if "at" in m[0].lower() else ".", s)
    plain = re.sub(r"\s*([@.])\s*", r"\1", plain)
    return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain)) and ("@" in s or len(SPELT.findall(s)) >= 2 or bool(re.search(r"[\[({]at[\])}]", s, re.I)))


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger | None, block: int = 256) -> list[list[tuple[str, int, int]]]:
    """What the tagger adds in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if tagger is None:
        return out
    jobs = [(i, s, e) for i, t in enumerate(texts) for s, e in windows_of(t)]
    got: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for a in range(0, len(jobs), block):
        part = jobs[a : a + block]
        ids = np.zeros((len(part), LENGTH), np.int64)
        for k, (i, s, e) in enumerate(part):
            ids[k, : e - s] = char_ids(texts[i][s:e])
        for (i, s, e), tags in zip(part, tagger.decode(ids)):
            if tags[: e - s].any():
                got.setdefault(i, []).append((s, e, tags[: e - s]))
    for i, wins in got.items():
        tag: dict[int, tuple[int, int]] = {}  # place -> (distance to the window's edge, tag)
        for s, e, tags in wins:
            for p in range(s, e):
                edge = min(p - s if s else LENGTH, e - 1 - p if e < len(texts[i]) else LENGTH)
                if p not in tag or edge > tag[p][0]:
                    tag[p] = (edge, int(tags[p - s]))
        run: list[int] = []
        for p in [*sorted(p for p in tag if tag[p][1]), -1]:
            if run and (p != run[-1] + 1 or tag[p][1] != tag[run[0]][1]):
                kind, s, e = TAGS[tag[run[0]][1]], run[0], run[-1] + 1
                while s < e and texts[i][s] in " \t\n,;:":
                    s += 1
                while e > s and texts[i][e - 1] in " \t\n.,;:":
                    e -= 1
                if kind == "email" and s < e:  # a window may begin or end inside the name or the host
                    while s > 0 and LOCAL.match(texts[i][s - 1]):
                        s -= 1
                    while e < len(texts[i]) and HOST.match(texts[i][e]):
                        e += 1
                if e > s and accepted(kind, texts[i][s:e]) and not any(x[1] < e and x[2] > s for x in base[i]):
                    out[i].append((kind, s, e))
                run = []
            if p >= 0:
                run.append(p)
    return out


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Base counts and digest, and all spans, of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = marked(batch.column(1))
            at = [i for i, t in enumerate(texts) if t]
            base = [base_spans(texts[i]) for i in at]
            more = added_spans([texts[i] for i in at], base, sent.value)
            n = batch.num_rows
            num = {k: np.zeros(n, np.int64) for k in (*KINDS, "added")}
            sha, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
            for i, bs, ms in zip(at, base, more):
                for k, _, _ in bs:
                    num[k][i] += 1
                num["added"][i] = len(ms)
                sha[i] = hashlib.sha256(joined(bs).encode()).hexdigest()
                spans[i] = joined(in_order(bs + ms))
            yield pa.record_batch([batch.column(0), *[pa.array(num[k]) for k in KINDS], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(num["added"])], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), OUT)


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span as [KIND]; spans that overlap become one marker, of the first."""
    out, at = [], 0
    for k, s, e in in_order(spans):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with every span of its text masked, and n_chars to match; all columns stay."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    names = docs.columns
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = marked(batch.column(at_text))
            at = [i for i, t in enumerate(texts) if t]
            base = [base_spans(texts[i]) for i in at]
            more = added_spans([texts[i] for i in at], base, sent.value)
            new = batch.column(at_text).to_pylist()
            for i, bs, ms in zip(at, base, more):
                if bs or ms:
                    new[i] = mask_text(texts[i], bs + ms)
            yield batch.set_column(at_text, "text", pa.array(new, batch.schema.field(at_text).type))

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
