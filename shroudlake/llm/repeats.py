"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Every byte covered by a ``depth``-byte string that also starts in a document with a smaller id is
removed. The first most-significant digit of a suffix is not its first bytes but its sampled
anchor: of the 32-byte grams inside the ``depth`` bytes, the one with the least hash. Equal
strings have equal anchors at equal places, so suffixes whose anchor is in one document alone are sorted out at once.
The second digit is the segment: the stretch of all strings that have this very anchor, as one hash. Of equal
segments only the smallest document's stays, as all strings of the others are in it. Only where an
anchor has several segments left are their strings ordered by most-significant-digit passes of 8 bytes
down to ``depth`` bytes and no further; groups with one member leave after each pass, and the groups left are exactly the
repeated strings. Each group keeps its smallest document.

Work is laid out by ``gid``, a hash of the document that sizes groups to about GROUP_BYTES of text.
Texts are exchanged once. A group sends one record for each anchor, then one for each segment of an anchor that
some other document has, and gets bits and bytes back in the order in which it sent them; that order depends on content
alone, so a task that runs again sends and reads the same. An anchor in a third of all documents sends one record for each gid;
an anchor of HOT_SEGMENTS different segments has its strings dealt out singly instead of by anchor. Of equal texts only the one
of the smallest document takes part: the others, if they have ``depth`` bytes, are removed whole.

Defined cases: a null text is empty; texts shorter than ``depth`` keep all bytes; rows that share
a doc_id never remove each other's bytes; rows with a null doc_id are returned unchanged and
remove nothing; very long texts are read in overlapping blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, MUL_A, MUL_B, durable, mix, powers, sized, spans_of

GRAM = 32
GROUP_BYTES = 4 << 20
#: Spark partitions of texts at most; a partition holds as many groups as it must, one in memory at a time.
MOST_PARTITIONS = 8192
#: From so many different segments on, an anchor's strings are dealt out singly.
HOT_SEGMENTS = 512
#: Bytes of text that one numpy step works on; longer texts are read in blocks that overlap.
BLOCK = 1 << 17


def slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for each full window, by doubling."""
    out, have = x, 1
    while have < width:
        more = min(have, width - have)
        out = best(out[: len(out) - more], out[more:])
        have += more
    return out


_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        grown = np.full(max(n, 2 * len(_inverse)), np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        grown[0] = 1
        _inverse = np.cumprod(grown, dtype=np.uint64)
    return _inverse[:n]


NO_ANCHORS = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))


def anchors(b: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(position, gram hash, least and largest offset, segment hash) of each gram that has the least hash of some ``depth``-byte string within its document; ties count all.

    An offset is how far a string that has this anchor starts before it; the offsets of an anchor are without gaps.
    """
    width = depth - GRAM + 1
    if b.size < depth:
        return NO_ANCHORS
    total = np.zeros(b.size + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(b.size), out=total[1:])
    gram = (total[GRAM:] - total[:-GRAM]) * inverse_powers(b.size - GRAM + 1)
    pick = (gram * MUL_A >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    low = slide(pick, width, np.minimum)
    for e in off[1:]:  # strings do not run past a document's end
        low[max(0, e - depth + 1) : e] = 0
    edge = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(slide(np.concatenate([edge, low, edge]), width, np.maximum)[: len(pick)] == pick)
    own, least, most = pick[at], np.full(len(at), width), np.full(len(at), -1)
    for o in range(width):
        has = low[np.clip(at - o, 0, len(low) - 1)] == own
        has &= (at >= o) & (at - o < len(low))
        most[has] = o
        np.minimum(least, o, out=least, where=has)
    segment = (total[at - least + depth] - total[at - most]) * inverse_powers(b.size)[at - most]
    return at, mix(gram[at]), least, most, mix(segment ^ (least * 64 + most).astype(np.uint64) * MUL_B)


def all_anchors(b: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """anchors() over a group of documents, in blocks, and each one's document."""
    got = [NO_ANCHORS]
    for i, j in spans_of(off, BLOCK):
        for s in range(off[i], max(off[i] + 1, off[j] - depth + 1), 1 << 20):  # one step, unless a document alone is longer
            e = min(off[j], s + (1 << 20) + depth - 1)
            p, *rest = anchors(b[s:e], off[i : j + 1] - s if e == off[j] and s == off[i] else np.array([0, e - s]), depth)
            got.append((p + s, *rest))
    p, *rest = (np.concatenate(x) for x in zip(*got))
    return p, *rest, np.searchsorted(off, p, "right") - 1


def bucket_cuts(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in use, their limits) of keys in order; a key's bucket is its high end."""
    used, first = np.unique(((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), return_index=True)
    return used, np.append(first, len(key))


def cut_up(cut: np.ndarray, column: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(column[s:e]).tobytes() for s, e in zip(cut, cut[1:])]


def six(h: np.ndarray) -> np.ndarray:
    """The low six bytes of each number, as rows: enough to tell a bucket's anchors apart, as segments and strings are compared later."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


LOW = np.uint64((1 << 48) - 2)


def group_text(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, ids) of a gid's documents."""
    if not t.num_rows:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    parts = t.column("text").combine_chunks()
    parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
    parts = parts.fill_null(b"").cast(pa.large_binary())
    _, o, d = parts.buffers()
    off = np.frombuffer(o, np.int64)[parts.offset : parts.offset + len(parts) + 1]
    raw = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], t.column("doc_id").to_numpy()


def split_copies(t: pa.Table, side: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(the rows that take part, the rows whose text a smaller document has); side has the copies' (copy, d1)."""
    known = side.filter(side.column("copy").is_valid())
    gone = set(zip(known.column("copy").to_pylist(), known.column("d1").to_pylist()))
    flag = pa.array([x in gone for x in zip(t.column("doc_id").to_pylist(), t.column("d1").to_pylist())] if gone else [False] * t.num_rows, pa.bool_())
    return t.filter(pc.invert(flag)), t.filter(flag)


def context(b: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, depth: int) -> np.ndarray:
    """The bytes of each anchor's segment, placed around the gram in 2 * depth - GRAM bytes; zero elsewhere."""
    side = depth - GRAM
    col = np.arange(-side, GRAM + side, dtype=np.int64)
    out = np.empty((len(at), len(col)), np.uint8)
    for i in range(0, len(at), 1 << 14):
        k = slice(i, i + (1 << 14))
        grid = np.clip(at[k, None] + col, 0, b.size - 1)
        out[k] = np.where((col >= -most[k, None]) & (col < depth - least[k, None]), b[grid], 0)
    return out


def digits(x: np.ndarray) -> np.ndarray:
    """The bytes of each row as columns of 8-byte digits."""
    pad = -x.shape[1] % 8
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, pad)))).view(np.uint64)


def refine(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Group numbers after one more digit."""
    by = np.lexsort((digit, group))
    g, d = group[by], digit[by]
    new = np.ones(len(by), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new) - 1
    return out


def radix(group: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (rows in groups of two or more that agree on all digits, their group)."""
    live = np.arange(len(group))
    group = refine(group, np.zeros(len(group), np.uint64)) if len(group) else group.astype(np.int64)
    for k in range(cols.shape[1]):
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        stay = size[group] > 1 if len(group) else np.zeros(0, bool)
        live, group = live[stay], group[stay]
        if not len(live):
            break
        group = refine(group, cols[live, k])
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    stay = size[group] > 1 if len(group) else np.zeros(0, bool)
    return live[stay], group[stay]


def smaller_before(ctx: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """For each record a bit for each of its offsets o: the string from o bytes before the anchor is also in a record of a smaller document."""
    side, mask = depth - GRAM, np.zeros(len(doc), np.uint64)
    for o in range(side + 1):
        has = np.flatnonzero((least <= o) & (o <= most))
        live, group = radix(np.zeros(len(has), np.uint64), digits(ctx[has][:, side - o : side - o + depth]))
        if len(live):
            low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, doc[has[live]])
            hit = has[live[low[group] < doc[has[live]]]]
            mask[hit] |= np.uint64(1) << np.uint64(o)
    return mask


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def distinct(doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row -> its group, the row of the smallest document of each group); groups are of equal columns, in their order."""
    by = np.lexsort((doc, *reversed(columns)))
    new = heads(*[c[by] for c in columns])
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new) - 1
    return group, by[new]


def covered(b: np.ndarray, at: np.ndarray, least: np.ndarray, most: np.ndarray, whole: np.ndarray, mask: np.ndarray, depth: int) -> np.ndarray:
    """Which bytes lie in a marked string: all offsets of an anchor, or those of its mask."""
    step = np.zeros(b.size + 1, np.int32)
    np.add.at(step, (at - most)[whole], 1)
    np.add.at(step, (at - least + depth)[whole], -1)
    for o in range(depth - GRAM + 1):
        start = at[~whole & (mask >> np.uint64(o) & np.uint64(1)).astype(bool)] - o
        np.add.at(step, start, 1)
        np.add.at(step, start + depth, -1)
    return np.cumsum(step[:-1]) > 0


def results(b: np.ndarray, off: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> pa.Table:
    run = gone.copy()
    if len(run):
        run[1:] &= ~gone[:-1]
        heads = off[:-1][off[:-1] < b.size]
        run[heads] = gone[heads]
    removed, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(run)])
    sha = []
    for i in range(len(ids)):
        own = b[off[i] : off[i + 1]]
        sha.append(hashlib.sha256((own[~gone[off[i] : off[i + 1]]] if removed[off[i + 1]] > removed[off[i]] else own).tobytes()).hexdigest())
    numbers = {"n_bytes": np.diff(off), "n_removed": removed[off[1:]] - removed[off[:-1]], "n_spans": runs[off[1:]] - runs[off[:-1]]}
    return pa.table({"doc_id": pa.array(ids, pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in numbers.items()}, "kept_sha256": pa.array(sha, pa.string())})


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Kinds of side rows that a group gets: its copies, and for each bucket the anchors to go on with, the states of its segments, the masks of its strings.
COPY, SHARED, STATES, MASKS = range(4)
#: States of a segment: alone; in a smaller document too; the smallest of several segments of its anchor, plain or hot.
DONE, COVERED, OPEN, HOT = range(4)
SIDE = "gid int, kind int, bucket int, data binary"


def remove_repeats(docs: DataFrame, depth: int = 50, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs(doc_id, text)."""
    if not GRAM < depth <= GRAM + 63:
        raise ValueError(f"depth must be within {GRAM + 1} and {GRAM + 63} bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    gid = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("gid")
    by_gid = rows.where("doc_id is not null").select("doc_id", "text", gid, F.xxhash64("text").alias("d1")).repartition(min(groups, MOST_PARTITIONS), "gid")
    narrow = rows.where(f"doc_id is not null and octet_length(text) >= {depth}").select("doc_id", gid, F.xxhash64("text").alias("d1"), F.xxhash64("text", F.lit(7)).alias("d2"))
    narrow = durable(narrow, "repeats-texts")
    lead = narrow.groupBy("d1", "d2").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("d1", "d2", "lead")
    # written first: the join's sides are then exchanges of their own, of which Spark splits the hot ones
    copies = narrow.join(sized(lead, "repeats-leads"), ["d1", "d2"]).where("doc_id > lead")
    none = F.lit(None)
    copies = copies.select("gid", F.lit(COPY).alias("kind"), none.cast("int").alias("bucket"), none.cast("binary").alias("data"), F.col("doc_id").alias("copy"), "d1")
    side_rows = lambda df: df.select("gid", "kind", "bucket", "data", none.cast("long").alias("copy"), none.cast("long").alias("d1"))
    press = lambda parts: pa.array([zstandard.ZstdCompressor(level=1).compress(x) for x in parts], pa.binary())

    def sent(t: pa.Table, used: np.ndarray, **columns: pa.Array) -> pa.Table:
        own = t.column("gid")[0].as_py() if t.num_rows else 0
        return pa.table({"bucket": pa.array(used, pa.int32()), "gid": pa.array([own] * len(used), pa.int32()), **columns})

    def opened(t: pa.Table, name: str, kind: type) -> list[np.ndarray]:
        return [np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind) for x in t.column(name)]

    def answer(t: pa.Table, kind: int, sizes: list[int], values: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.Table:
        """Back to each group what became of the records it sent, where anything did."""
        cut = np.concatenate([[0], np.cumsum(sizes)])
        parts = [values[s:e] for s, e in zip(cut, cut[1:])]
        got = [k for k, v in enumerate(parts) if v.any()]
        columns = {"gid": t.column("gid").take(pa.array(got, pa.int64())), "kind": pa.array([kind] * len(got), pa.int32()), "bucket": t.column("bucket").take(pa.array(got, pa.int64()))}
        return pa.table({**columns, "data": pa.array([pack(parts[k]) for k in got], pa.binary())})

    def answers(side: pa.Table, kind: int, used: np.ndarray, cut: np.ndarray, dtype: type) -> np.ndarray:
        """The answers to records that were sent in this order; zero where there is none."""
        out, spot = np.zeros(cut[-1], dtype), {int(u): k for k, u in enumerate(used)}
        mine = side.filter(pc.equal(side.column("kind"), kind))
        for bucket, data in zip(mine.column("bucket").to_pylist(), mine.column("data").to_pylist()):
            k = spot[bucket]
            raw = np.unpackbits(np.frombuffer(data, np.uint8), count=cut[k + 1] - cut[k]) if kind == SHARED else np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)
            out[cut[k] : cut[k + 1]] = raw
        return out

    def first_digit(t: pa.Table, side: pa.Table) -> pa.Table:
        """One record for each distinct anchor of the group: its hash, and whether two of the group's documents have it."""
        t, _ = split_copies(t, side)
        b, off, ids = group_text(t)
        _, key, _, _, _, d = all_anchors(b, off, depth)
        by = np.lexsort((ids[d], key))
        key, doc = key[by], ids[d][by]
        first = np.flatnonzero(heads(key))
        many = (doc[first] != doc[np.append(first[1:], len(key)) - 1]).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        used, cut = bucket_cuts(key[first], groups)
        return sent(t, used, data=pa.array(cut_up(cut, six((key[first] & LOW) | many)), pa.binary()))

    def shared(t: pa.Table) -> pa.Table:
        """Which anchors some other document has too."""
        parts = [from_six(x.as_py()) for x in t.column("data")]
        every = np.concatenate(parts)
        _, inv, n = np.unique(every & LOW, return_inverse=True, return_counts=True)
        many = np.zeros(len(n), bool)
        many[inv[(every & np.uint64(1)) > 0]] = True
        return answer(t, SHARED, [len(p) for p in parts], (n[inv] > 1) | many[inv], lambda v: np.packbits(v).tobytes())

    def records(t: pa.Table, side: pa.Table) -> tuple[np.ndarray, ...]:
        """A group's text, its shared anchors, and for these the segment each belongs to and each segment's smallest document's one."""
        b, off, ids = group_text(t)
        p, key, least, most, seg, d = all_anchors(b, off, depth)
        each, inv = np.unique(key, return_inverse=True)
        keep = answers(side, SHARED, *bucket_cuts(each, groups), np.uint8)[inv] > 0
        p, key, least, most, seg, doc = p[keep], key[keep], least[keep], most[keep], seg[keep], ids[d[keep]]
        group, rep = distinct(doc, key, seg)
        return b, off, ids, p, key, least, most, seg, doc, group, rep

    def second_digit(t: pa.Table, side: pa.Table) -> pa.Table:
        t, _ = split_copies(t, side)
        _, _, _, _, key, _, _, seg, doc, _, rep = records(t, side)
        used, cut = bucket_cuts(key[rep], groups)
        return sent(t, used, key=pa.array(cut_up(cut, six(key[rep])), pa.binary()), seg=pa.array(cut_up(cut, seg[rep]), pa.binary()), doc=press(cut_up(cut, doc[rep])))

    def settle(t: pa.Table) -> pa.Table:
        """Each segment's state. An anchor's segments that differ go on to the strings."""
        keys = [from_six(x.as_py()) for x in t.column("key")]
        key, seg = np.concatenate(keys), np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("seg")])
        doc = np.concatenate(opened(t, "doc", np.int64))
        group, rep = distinct(doc, key, seg)
        _, inv, n = np.unique(key[rep], return_inverse=True, return_counts=True)
        state = np.where(n > 1, np.where(n >= HOT_SEGMENTS, HOT, OPEN), DONE)[inv].astype(np.uint8)[group]
        state[doc > doc[rep][group]] = COVERED
        return answer(t, STATES, [len(k) for k in keys], state, lambda v: zstandard.ZstdCompressor(level=1).compress(v.tobytes()))

    def strings(t: pa.Table, side: pa.Table) -> tuple[np.ndarray, ...]:
        """records(), the states of the segments, and what goes on: key, context, offsets, document and segment of each, in order of their keys.

        The strings of hot anchors go on singly, under their own hash.
        """
        got = records(t, side)
        b, _, _, p, key, least, most, _, doc, _, rep = got
        state = answers(side, STATES, *bucket_cuts(key[rep], groups), np.uint8)
        plain, hot = np.flatnonzero(state == OPEN), np.flatnonzero(state == HOT)
        src = rep[plain]
        out = [(key[src], context(b, p[src], least[src], most[src], depth), least[src], most[src], doc[src], plain)]
        for o in range(depth - GRAM + 1) if len(hot) else ():
            seg = hot[(least[rep[hot]] <= o) & (o <= most[rep[hot]])]
            src, one = rep[seg], np.full(len(seg), o)
            ctx = context(b, p[src], one, one, depth)
            k = np.zeros(len(seg), np.uint64)
            for col in digits(ctx).T:
                k = mix(k * MUL_B + col + np.uint64(o + 1))
            out.append((k, ctx, one, one, doc[src], seg))
        k, ctx, lo, hi, who, seg = (np.concatenate(x) for x in zip(*out))
        by = np.lexsort((hi, lo, *digits(ctx).T, who, k))
        return *got, state, k[by], ctx[by], lo[by], hi[by], who[by], seg[by]

    def contexts(t: pa.Table, side: pa.Table) -> pa.Table:
        t, _ = split_copies(t, side)
        *_, key, ctx, lo, hi, who, _ = strings(t, side)
        used, cut = bucket_cuts(key, groups)
        span = np.stack([lo, hi], 1).astype(np.uint8)
        return sent(t, used, ctx=press(cut_up(cut, ctx)), span=press(cut_up(cut, span)), doc=press(cut_up(cut, who)))

    def sort_bucket(t: pa.Table) -> pa.Table:
        """The strings of a bucket in order; back to each group a mask for each of its contexts."""
        docs_ = opened(t, "doc", np.int64)
        span = np.concatenate(opened(t, "span", np.uint8)).reshape(-1, 2).astype(np.int64)
        ctx = np.concatenate(opened(t, "ctx", np.uint8)).reshape(-1, 2 * depth - GRAM)
        mask = smaller_before(ctx, span[:, 0], span[:, 1], np.concatenate(docs_), depth)
        return answer(t, MASKS, [len(d) for d in docs_], mask, lambda v: zstandard.ZstdCompressor(level=1).compress(v.tobytes()))

    def finish(t: pa.Table, side: pa.Table) -> pa.Table:
        t, same = split_copies(t, side)
        b, off, ids = group_text(same)
        done = results(b, off, ids, np.ones(b.size, bool))
        b, off, ids, p, key, least, most, _, doc, group, rep, state, k, _, _, _, _, seg = strings(t, side)
        mask = np.zeros(len(rep), np.uint64)
        np.bitwise_or.at(mask, seg, answers(side, MASKS, *bucket_cuts(k, groups), np.uint64))
        whole = (state[group] == COVERED) | (doc > doc[rep][group])
        return pa.concat_tables([done, results(b, off, ids, covered(b, p, least, most, whole, mask[group], depth))])

    texts = by_gid.groupBy("gid")
    asked = lambda f, side, made: texts.cogroup(side.groupBy("gid")).applyInArrow(f, f"bucket int, gid int, {made}").groupBy("bucket")
    side = copies.unionByName(side_rows(asked(first_digit, copies, "data binary").applyInArrow(shared, SIDE)))
    side = side.unionByName(side_rows(asked(second_digit, side, "key binary, seg binary, doc binary").applyInArrow(settle, SIDE)))
    side = side.unionByName(side_rows(asked(contexts, side, "ctx binary, span binary, doc binary").applyInArrow(sort_bucket, SIDE)))
    done = texts.cogroup(side.groupBy("gid")).applyInArrow(finish, OUT)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off, ids = group_text(pa.Table.from_batches([batch.set_column(0, "doc_id", pa.nulls(batch.num_rows, pa.int64()).fill_null(0))]))
            t = results(b, off, ids, np.zeros(b.size, bool))
            yield from t.set_column(0, "doc_id", pa.nulls(t.num_rows, pa.int64())).to_batches()

    return done.unionByName(rows.where("doc_id is null").mapInArrow(plain, OUT))
