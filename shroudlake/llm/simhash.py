"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text gets a 64-bit majority fingerprint of its word shingles. Distinct fingerprints are
linked when they differ in at most ``radius`` bits. The 64 bits are grouped by their measured
correlation into parts; a dynamic program gives each part its own threshold (-1: not probed)
so that the thresholds sum to radius - parts + 1 and the estimated work is least. Every
fingerprint is indexed under each probed part's value and probed with all values within that
part's threshold; candidates are verified on all 64 bits. All links come from this index.

Defined cases: a null or empty text has fingerprint zero; repeated rows and equal texts share a
fingerprint and hence a component; rows with a null doc_id keep a null component_id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, mix, sized, small_batches, tidy
from .components import components

BITS = 64
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fixed value: seed of the shingle hash.
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` lower-cased words, space-joined; of the whole sequence if there are fewer."""
    found = WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    return np.fromiter((h(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :])), np.uint64, len(found) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Whole texts, one pass, nothing shuffled."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [majority(shingle_hashes(t.as_py() or b"", shingle)) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(tidy(run), "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(n, 64 x 64 counts of bits set together) over all fingerprints: one summed row reaches the driver for each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(fp), both + bits.T @ bits
        if n:
            yield pa.record_batch([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS), pa.array(both.astype(np.int64).tolist())], ["bit", "n", "row"])

    rows = fps.select("fp").mapInArrow(tidy(run), "bit int, n long, row array<long>").select("bit", "n", *[F.col("row")[i].alias(f"c{i}") for i in range(BITS)])
    got = rows.groupBy("bit").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(BITS)]).orderBy("bit").collect()
    return (int(got[0]["n"]), np.array([[float(r[f"c{i}"]) for i in range(BITS)] for r in got])) if got else (0, np.zeros((BITS, BITS)))


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal width; a seed bit of the least total correlation first, then its closest bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = (len(left) + parts - k - 1) // (parts - k)
        group = [min(left, key=lambda b: corr[b, left].sum())]
        while len(group) < width:
            group.append(max((b for b in left if b not in group), key=lambda b: corr[b, group].sum()))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def part_costs(n: int, p: np.ndarray, group: list[int], top: int) -> list[float]:
    """Estimated work of a part at thresholds -1, 0, .., top: probe rows, and pairs met at that distance or less."""
    q = 2 * p[group] * (1 - p[group])
    dist = np.ones(1)
    for x in q:
        dist = np.convolve(dist, [1 - x, x])
    probes, out = 0.0, [0.0]
    for t in range(top + 1):
        probes += float(np.prod([(len(group) - i) / (i + 1) for i in range(t)]))
        out.append(n * (probes + 1) + 0.5 * n * n * float(dist[: t + 1].sum()))
    return out


def allocate(n: int, p: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds that sum to radius - parts + 1 at the least estimated work, by dynamic programming over parts."""
    costs = [part_costs(n, p, g, radius) for g in groups]
    goal = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, radius + 1):
                if s + t not in step or cost + c[t + 1] < step[s + t][0]:
                    step[s + t] = (cost + c[t + 1], [*ts, t])
        best = step
    return best[goal]


def plan(n: int, both: np.ndarray, radius: int, most_parts: int = 6) -> list[tuple[int, int]]:
    """(bit mask, threshold) of each probed part: the cheapest of the plans for 1.. parts."""
    p = np.diag(both) / max(n, 1)
    found = []
    for parts in range(2, most_parts + 1):
        groups = group_bits(n, both, parts)
        cost, ts = allocate(n, p, groups, radius)
        found.append((cost, [(sum(1 << b for b in g), t) for g, t in zip(groups, ts) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def flips(mask: int, t: int) -> list[int]:
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [sum(c) for k in range(t + 1) for c in itertools.combinations(bits, k)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def part_key(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(signed(mask)))


def indexed(items: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """items (with fp) under each part's value: part, key and the columns of items."""
    each = F.array(*[F.struct(F.lit(k).alias("part"), part_key(mask).alias("key")) for k, (mask, _) in enumerate(parts)])
    return items.select(F.inline(each), *items.columns)


def within(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


#: Pairs that buckets may hold for each fingerprint before leaders thin them out, and rounds of leaders at most.
PAIRS, ROUNDS = 64, 12


def leader_links(named: DataFrame, radius: int, turn: int) -> DataFrame:
    """(src, dst): the members of each bucket of several components that are within ``radius`` bits of one of its two leaders, which a hash picks. named: (part, key, fp, component)."""
    order = F.xxhash64("fp", F.lit(turn))
    led = named.groupBy("part", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.array(F.max_by("fp", order), F.min_by("fp", order)).alias("leaders")).where("a <> b")
    met = named.join(led.select("part", "key", F.explode("leaders").alias("leader")), ["part", "key"]).where((F.col("fp") != F.col("leader")) & within("fp", "leader", radius))
    return met.select(F.least("fp", "leader").alias("src"), F.greatest("fp", "leader").alias("dst")).distinct()


def close_links(fps: DataFrame, radius: int) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column fp, unique) that give the components of all pairs within ``radius``.

    All come from the planned parts: the pairs of each bucket are made and verified. Where the buckets hold more than PAIRS pairs for each
    fingerprint, as large groups of near copies make them, each bucket's members are first linked to its leaders, in rounds while that helps: a group
    becomes a component by links in proportion to its size, and only pairs of different components are made after that.
    """
    n, both = bit_counts(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    parts = plan(n, both, radius)
    index = durable(indexed(fps.select("fp"), parts), "simhash-index")
    group, links = fps.select("fp", F.col("fp").alias("component")), None
    work = index.groupBy("part", "key").agg(F.count("*").alias("m")).agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0]
    for turn in range(ROUNDS):
        if work <= PAIRS * n:
            break
        new = durable(leader_links(index.join(group, "fp"), radius, turn), "simhash-links")
        links = new if links is None else links.unionByName(new)
        group = durable(components(fps.select(F.col("fp").alias("id")), links).withColumnRenamed("id", "fp"), "simhash-base")
        sizes = index.join(group, "fp").groupBy("part", "key", "component").agg(F.count("*").cast("double").alias("m")).groupBy("part", "key").agg(F.sum("m").alias("m"), F.max("m").alias("major"))
        before, work = work, sizes.agg(F.sum((F.col("m") - F.col("major")) * F.col("m"))).first()[0]
        if work > 0.9 * before:
            break
    far = far_links(group.select(F.col("fp").alias("id"), "fp", "component"), parts, radius, grouped=links is not None)
    return far if links is None else links.unionByName(far)


#: Members from which on a bucket is split by further parts.
LARGE = 256


def splits(mask: int, radius: int) -> list[int]:
    """radius + 1 masks over the bits outside ``mask``: two fingerprints within ``radius`` bits agree on one of them."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in rest[k :: radius + 1]) for k in range(radius + 1)]


def far_links(items: DataFrame, parts: list[tuple[int, int]], radius: int, grouped: bool = True) -> DataFrame:
    """(src, dst): the pairs of items (id, fp, component) of different components whose fingerprints are within ``radius`` bits.

    Without groups (grouped false) each item is a component of its own, and each pair of a bucket is made once. Members of a bucket of LARGE and more meet in the smaller buckets that radius + 1 further parts of their other bits make; one
    of these they share. Unflipped probes meet their own bucket: one of any two components is not the bucket's largest, so only members
    outside the largest probe. Flipped probes go to another bucket, from the smaller key to the larger: a probe of that bucket's largest
    component meets the members outside it, every other probe meets all members.
    """
    index = indexed(items, parts)
    large = sized(index.groupBy("part", "key").agg(F.count("*").alias("m")).where(f"m >= {LARGE}").select("part", "key", F.lit(True).alias("large")), "simhash-large")
    subs = F.array(*[F.array(*[F.lit(signed(x)) for x in splits(mask, radius)]) for mask, _ in parts])
    small = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).cast("long").alias("sub")))
    spread = F.transform(F.get(subs, F.col("part")), lambda x, i: F.struct(i.alias("q"), F.col("fp").bitwiseAND(x).alias("sub")))

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.join(large, ["part", "key"], "left").select("part", "key", F.inline(F.when(F.col("large"), spread).otherwise(small)), "id", "fp", "component")

    probes = None
    for k, (mask, t) in enumerate(parts):
        other = flips(mask, t)[1:]
        if other:
            key = part_key(mask)
            moved = F.filter(F.transform(F.lit([signed(f) for f in other]), lambda f: key.bitwiseXOR(f)), lambda v: v > key)  # noqa: B023
            y = items.select(F.lit(k).alias("part"), F.explode(moved).alias("key"), "id", "fp", "component")
            probes = y if probes is None else probes.unionByName(y)
    at = ["part", "key", "q", "sub"]
    index = durable(bucketed(index), "simhash-buckets")
    if not grouped:
        plain = index.drop("component")
        far = lambda sent: sent.drop("component").withColumnsRenamed({"id": "pid", "fp": "pfp"}).join(plain, at).where(within("pfp", "fp", radius))
        met = far(index).where("pid < id")
        met = met if probes is None else met.unionByName(far(bucketed(probes)).where("pid <> id"))
        return met.select(F.least("pid", "id").alias("src"), F.greatest("pid", "id").alias("dst")).distinct()
    sizes = index.groupBy(*at, "component").agg(F.count("*").alias("m"))
    major = durable(sizes.groupBy(*at).agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.count("*").alias("kinds")), "simhash-major")
    named = {"id": "pid", "fp": "pfp", "component": "pcomp"}
    outside = durable(index.join(major.where("kinds > 1"), at).where("component <> major").drop("major", "kinds"), "simhash-outside")
    close = (F.col("pcomp") != F.col("component")) & within("pfp", "fp", radius)
    met = outside.withColumnsRenamed(named).join(index, at).where(close)
    if probes is not None:
        sent = bucketed(probes).join(major, at).withColumnsRenamed(named)
        own = outside.withColumn("outside", F.lit(True))
        met = met.unionByName(sent.where("pcomp <> major").drop("major", "kinds").join(index, at).where(close))
        met = met.unionByName(sent.where("pcomp = major").drop("major", "kinds").join(own, at).where(close).drop("outside"))
    return met.select(F.least("pid", "id").alias("src"), F.greatest("pid", "id").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id reachable by links)."""
    prints = durable(fingerprints(docs, shingle), "simhash-fp")
    each = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    group = components(each.select(F.col("fp").alias("id")), close_links(each.select("fp"), radius))
    named = each.join(group, each.fp == group.id).groupBy("component").agg(F.min("first").alias("component_id"))
    to = each.join(group, each.fp == group.id).join(named, "component").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    out = prints.join(to, "fp").select("doc_id", shown, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out


#: Least-hash bands of the wide probe: BANDS keys of ROWS least hashes each.
BANDS, ROWS = 16, 4
#: A salt of each permutation.
SALTS = mix(mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the least values of ROWS permutations of the set, each a mixing function with its own salt."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        low = np.minimum(low, mix(found[None, i : i + 512] ^ SALTS[:, None]).min(1))
    out = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + low[r::ROWS] + np.uint64(1)
    return out


#: Longs of the parity sketch: bit i is the parity of the number of shingles that fall to i.
PARITY = 4


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """Sketches of two sets differ in no more bits than the sets differ in members."""
    odd = np.bincount((mix(found) >> np.uint64(56)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_similar(similarity: float) -> Column:
    """False only for pairs that are provably below: by their sizes n and pn, or by the bits in which their sketches differ."""
    apart = sum(F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"pp{i}"))) for i in range(PARITY))
    # a hair of slack for rounding
    return (F.least("n", "pn") >= similarity * F.greatest("n", "pn") - 1e-6) & (apart <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("pn")) + 1e-6)


def leader_pairs(buckets: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): each member of a bucket (id, band, key) with the bucket's most central one: the one whose buckets hold most, then the smallest.

    items: (id, n, p0..). Pairs that are provably below ``similarity`` are left out.
    """
    live = durable(buckets.join(buckets.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1"), ["band", "key"]), "copies-buckets")
    weight = live.groupBy("id").agg(F.sum("m").alias("w"))
    leader = live.join(weight, "id").groupBy("band", "key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("leader"))
    met = live.join(leader, ["band", "key"]).where("id <> leader").select("id", "leader").distinct()
    other = items.withColumnsRenamed({c: f"p{c}" for c in items.columns})
    near = met.join(items, "id").join(other, F.col("leader") == F.col("pid")).where(may_be_similar(similarity))
    return near.select(F.least("id", "leader").alias("src"), F.greatest("id", "leader").alias("dst")).distinct()


def bucket_links(buckets: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): all pairs of a bucket's members of different components that are not provably below ``similarity``.

    items: (id, component, n, p0..). One of any two components is not the bucket's largest, so only members outside the largest probe.
    """
    named = buckets.join(items.select("id", "component"), "id")
    sizes = named.groupBy("band", "key", "component").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("band", "key").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    live = named.join(mixed, ["band", "key"]).join(items.drop("component"), "id")
    probes = live.where("component <> major").drop("major")
    probes = probes.withColumnsRenamed({c: f"p{c}" if c != "component" else "pcomp" for c in items.columns})
    met = probes.join(live, ["band", "key"]).where("pcomp <> component").where(may_be_similar(similarity))
    return met.select(F.least("pid", "id").alias("src"), F.greatest("pid", "id").alias("dst")).distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, component_id) of documents whose word-shingle sets have a Jaccard similarity of ``similarity`` or more.

    Equal shingle sets are one text. Candidates are fingerprints within ``radius`` bits, and, since pairs
    at 0.8 differ in up to 15 of 64 bits, where no pigeonhole plan is selective, texts that share a band of least hashes.
    First each text meets the most central one of each of its buckets, so that groups of copies become components by few pairs.
    Then every other candidate pair whose texts are in different components is made, unless sizes or parity sketches
    prove it to be below. All pairs are verified on the whole sets. Texts without a word are one group.
    """
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, digest, keys, n, parity = [], [], [], [], []
            for t in b.column(1):
                all_h = shingle_hashes(t.as_py() or b"", shingle)
                s = np.unique(all_h)
                fp.append(majority(all_h))
                digest.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                keys.append((band_keys(s) if len(s) else np.zeros(BANDS, np.uint64)).view(np.int64))
                n.append(len(s))
                parity.append(parity_sketch(s))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, parity)]
            yield pa.record_batch([b.column(0), as_long(fp), as_long(digest), pa.array(n, pa.int64()), *lists], ["doc_id", "fp", "digest", "n", "keys", "parity"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py() or b"", shingle).tobytes() for t in b.column(1)]
            same = [xxhash.xxh64_intdigest(x, SEED) for x in found]
            rows = pa.record_batch([b.column(0), pa.array(found, pa.binary())], ["doc_id", "words"])
            # a repeated id stands for each of its texts
            yield rows.filter(pa.array(np.array(same, np.uint64).view(np.int64) == b.column(2).to_numpy()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            close = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                close.append(both >= similarity * (len(p) + len(q) - both))
            keep = pa.array(close, pa.bool_())
            yield pa.record_batch([b.column(0), b.column(1)], ["src", "dst"]).filter(keep)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
        wanted = sized(one.join(ids, "id").select(F.col("id").alias("doc_id"), "digest"), "copies-wanted")
        words = durable(texts.join(wanted, "doc_id").select("doc_id", "text", "digest").mapInArrow(tidy(sets), "doc_id long, words binary"), "copies-words")
        sided = pairs.join(words.select(F.col("doc_id").alias("src"), F.col("words").alias("a")), "src").join(words.select(F.col("doc_id").alias("dst"), F.col("words").alias("b")), "dst")
        return durable(sided.select("src", "dst", "a", "b").mapInArrow(tidy(compare), "src long, dst long"), "copies-links")

    each = durable(texts.mapInArrow(tidy(sketch), "doc_id long, fp long, digest long, n long, keys array<long>, parity array<long>"), "copies-sketch")
    same = each.groupBy("digest").agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in ("fp", "n", "keys", "parity")])
    one = durable(same, "copies-distinct")
    buckets = one.select("id", F.posexplode("keys").alias("band", "key"))
    parity = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)]
    pairs = durable(leader_pairs(buckets, one.select("id", "n", *parity), similarity), "copies-pairs")
    sure = verified(pairs)
    group = durable(components(one.select("id"), sure), "copies-groups")
    items = one.join(group, "id")
    sketched = items.select("id", "component", "n", *parity)
    rest = bucket_links(buckets, sketched, similarity)
    n, both = bit_counts(one)
    if n > 1:
        rest = rest.unionByName(far_links(items.select("id", "fp", "component"), plan(n, both, radius), radius)).distinct()
    rest = durable(rest.join(pairs, ["src", "dst"], "left_anti"), "copies-pairs")
    if not rest.isEmpty():
        group = components(one.select("id"), sure.unionByName(verified(rest)))
    return each.join(one.select("digest", "id"), "digest").join(group, "id").select("doc_id", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id. Rows with a null doc_id stay. All columns stay."""
    copies = similar_groups(docs, shingle, similarity).where("component_id < doc_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(sized(copies, "simhash-copies"), docs["doc_id"].cast("long") == F.col("_copy"), "left_anti")
