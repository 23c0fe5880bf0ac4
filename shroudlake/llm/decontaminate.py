"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over some neighbouring token places; the places it skips may differ between a document
and a benchmark item and the seed still hits. Hashes of the kept places of every benchmark
position and every document position are joined; around each hit the aligned tokens of REGION places of the item (the whole item, if it is shorter) are
compared, and a hit counts if enough of them agree. Items of LONG tokens or more have the masks SEEDS, shorter ones from GAPPED tokens on the masks SHORT_SEEDS; items of 4 or 5 tokens are sought
anywhere with all their tokens, still shorter ones, which any text may hold by chance, as a whole text.

Sensitivity, measured on 4,000 random substitutions that leave at least AGREE of an item's tokens (tests repeat it through the operator): the share of items that a seed reaches is 0.98 and more for 12 tokens with 10, 20 or 25 %
of them replaced, and 0.99 and more from 16 tokens on; items of 6 and 7 tokens are always reached with one token replaced, items of 8 to 11 with up to two in 0.97 of cases.

Most positions are sorted out before any row is made for them: the benchmark's seed hashes, and its
pairs of neighbouring tokens (each seed keeps its last two places), are hash sets of the plan if there
are at most LITERALS of each, and only positions that pass become rows; the join then decides.
Without these sets more positions become rows; the result is the same. A row carries the tokens around its position, not the text.

The benchmark's seeds are broadcast only if there are at most BROADCAST_ROWS of them (about 40
bytes each); beyond that the seeds of both sides are exchanged by hash.

Defined cases: null and empty texts and items match nothing; repeated
rows and items each count; rows with a null doc_id or item_id are left out; empty tables give
no pairs; other columns are ignored. Tokens are lower-cased runs of letters and digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, sized

#: Masks of five kept places for items of LONG tokens and more, of four for those from GAPPED tokens on; each keeps its last two places.
SEEDS, SHORT_SEEDS = ("11111", "1101011", "11001011"), ("1111", "110011", "1010011")
LONG, GAPPED, SHORTEST = 12, 6, 4
#: Item places compared around a hit, and the share of agreeing tokens that counts.
REGION, AGREE = 16, 0.75
#: Tokens before and after a position that a hit may look at.
BEFORE, NEAR = REGION - 4, 2 * REGION
BROADCAST_ROWS = 1_000_000
LITERALS = 50_000
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: str) -> Column:
    """A hash of each token, in order."""
    return F.transform(F.filter(F.split(F.lower(F.col(text)), BREAKS), lambda w: w != ""), lambda w: F.xxhash64(w))


def kept(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seed_hash(mask: str, toks: Column, at: Column) -> Column:
    """The hash of the places a mask keeps from position ``at``; null where the mask does not fit."""
    return F.when(at + len(mask) <= F.size(toks), F.xxhash64(F.lit(mask), *[F.get(toks, at + p) for p in kept(mask)]))


def seeded(df: DataFrame, masks: list[str], *carry: str) -> DataFrame:
    """(carry.., at, span, h): each seed's hash at each position, and how many places it spans. df has toks."""
    shortest = min(map(len, masks))
    spots = df.where(F.size("toks") >= shortest).select(*carry, "toks", F.explode(F.sequence(F.lit(0), F.size("toks") - shortest)).alias("at"))
    each = F.array(*[F.struct(F.lit(len(m)).alias("span"), seed_hash(m, F.col("toks"), F.col("at")).alias("h")) for m in masks])
    return spots.select(*carry, "toks", "at", F.inline(each)).where("h is not null")


def region(size: Column, j: Column, span: Column) -> tuple[Column, Column]:
    """The item's places that are compared for a hit at place j: REGION of them around the seed, or all."""
    low = F.greatest(F.lit(0), F.least(j - F.floor((REGION - span) / 2).cast("int"), size - REGION))
    return low, F.least(size, low + REGION)


def members(hashes: DataFrame) -> str | None:
    """The distinct hashes(h) as a SQL list; none if there are more than LITERALS."""
    got = [r[0] for r in hashes.distinct().limit(LITERALS + 1).collect()]
    least = -(1 << 63)
    return "(" + ",".join(f"{x}L" if x > least else f"(-{(1 << 63) - 1}L - 1L)" for x in [*got, 0]) + ")" if len(got) <= LITERALS else None


def candidates(texts: DataFrame, masks: list[str], index: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, at, base, near, h) of the positions that pass the filters; near has the tokens from position base on that a hit looks at. texts has doc_id and toks."""
    pair = "zip_with(toks, slice(toks, 2, size(toks)), (a, b) -> xxhash64(a, b))"
    seeds, pairs = members(index.select("h")), members(items.select(F.explode(F.expr(pair)).alias("h")))

    def probe(m: str) -> str:
        """The mask's hash at place i, where it fits and its last two tokens are neighbours in the benchmark."""
        n = len(m)
        fits = f"i = 0 AND size(toks) = {n}" if n < SHORTEST else f"i + {n} <= size(toks)"
        last = f" AND get(ok, i + {n - 2})" if pairs and n > 1 else ""
        return f"CASE WHEN {fits}{last} THEN xxhash64('{m}', " + ", ".join(f"get(toks, i + {p})" for p in kept(m)) + ") END"

    # each list of literals is in the plan once
    known = f"transform({pair}, p -> p IN {pairs})" if pairs else "cast(null AS array<boolean>)"
    shortest = min(map(len, masks))
    test = f"h IN {seeds}" if seeds else "h IS NOT NULL"
    some = f"filter(sequence(0, size(toks) - {shortest}), i -> coalesce(exists(array({', '.join(map(probe, masks))}), h -> {test}), false))"
    # explode of one element: a step that the optimiser does not merge, so a text is cut into tokens once
    once = lambda df, *cols: df.select("doc_id", F.explode(F.array(F.struct(*cols))).alias("r")).select("doc_id", "r.*")
    long_enough = once(texts, F.col("toks")).where(F.size("toks") >= shortest)
    at = once(once(long_enough, F.col("toks"), F.expr(known).alias("ok")), F.col("toks"), F.expr(some).alias("some")).where("size(some) > 0")
    spot = f"transform(some, i -> struct(i AS at, size(toks) AS n, greatest(i - {BEFORE}, 0) AS base, slice(toks, greatest(i - {BEFORE}, 0) + 1, {NEAR}) AS near))"
    rows = at.select("doc_id", F.explode(F.expr(spot)).alias("r")).select("doc_id", "r.*")
    rows = durable(rows, "benchmark-hits")  # few positions; the literals stay out of the plans that follow
    own = lambda m: seed_hash(m, F.col("near"), F.col("at") - F.col("base"))
    hashed = [F.when(F.col("n") == len(m), own(m)) if len(m) < SHORTEST else own(m) for m in masks]
    return rows.select("doc_id", "at", "base", "near", F.explode(F.array(*hashed)).alias("h")).where("h is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, n_hits, agreement): the documents that hold benchmark text, each with the items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens("text").alias("toks")).where("item_id is not null and size(toks) >= 1")
    items = durable(items, "benchmark-items")
    lengths = sorted(r[0] for r in items.where(F.size("toks") < LONG).select(F.size("toks")).distinct().collect())  # fewer than LONG
    whole, gapped = [n for n in lengths if n < GAPPED], list(SHORT_SEEDS) if any(n >= GAPPED for n in lengths) else []
    sides = [seeded(items.where(F.size("toks") >= LONG), list(SEEDS), "item_id"), *[seeded(items.where(F.size("toks") == n), ["1" * n], "item_id") for n in whole]]
    if gapped:
        sides.append(seeded(items.where(F.size("toks").between(GAPPED, LONG - 1)), gapped, "item_id"))
    index = durable(reduce(DataFrame.unionByName, sides).select("item_id", F.col("at").alias("j"), "span", "h"), "benchmark-seeds")
    masks = [*SEEDS, *gapped, *["1" * n for n in whole if f"{'1' * n}" not in (*SEEDS, *gapped)]]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens("text").alias("toks")).where("doc_id is not null")
    probes = candidates(texts, masks, index, items)
    small = index.count() <= BROADCAST_ROWS
    named = items.withColumnRenamed("toks", "item")
    hits = probes.join(F.broadcast(index) if small else index, "h").join(F.broadcast(named) if small else named, "item_id")
    low, high = region(F.size("item"), F.col("j"), F.col("span"))
    place = lambda p: p + F.col("at") - F.col("j") - F.col("base")
    same = F.size(F.filter(F.sequence(low, high - 1), lambda p: (place(p) >= 0) & (F.get("near", place(p)) == F.get("item", p))))
    scored = hits.select("doc_id", "item_id", (same / (high - low)).alias("agreement"))
    return scored.where(F.col("agreement") >= agree).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_hits"), F.round(F.max("agreement"), 6).alias("agreement"))


def sql() -> str:
    """overlaps() as DuckDB SQL over documents and benchmark."""
    cut = f"list_filter(regexp_split_to_array(lower(text), '{BREAKS}'), lambda w: w <> '')"
    masks = ", ".join(f"('{m}', {kept(m)}, {len(m)}, {low}, {high})" for group, low, high in ((SEEDS, LONG, 1 << 40), (SHORT_SEEDS, GAPPED, LONG - 1)) for m in group)
    seeds = lambda t, key, pos, where: f"SELECT {key}, {pos}, m, span, list_transform(k, lambda p: toks[{pos} + p + 1]) AS h FROM (SELECT {key}, toks, m, k, span, unnest(range(len(toks) - span + 1)) AS {pos} FROM {t}, masks WHERE len(toks) >= span AND {where})"
    return f"""
WITH masks(m, k, span, few, many) AS (VALUES {masks}),
d AS (SELECT row_number() OVER () AS r, doc_id, {cut} AS toks FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT row_number() OVER () AS s, * FROM (SELECT item_id, {cut} AS toks FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(toks) >= 1),
lengths AS (SELECT DISTINCT len(toks) AS n FROM i WHERE len(toks) < {GAPPED}),
used AS (SELECT m FROM masks WHERE EXISTS (SELECT 1 FROM i WHERE len(i.toks) BETWEEN few AND many)),
idx AS ({seeds("i", "s", "j", "len(toks) BETWEEN few AND many")} UNION ALL SELECT s, 0, 'all' || len(toks), len(toks), toks FROM i WHERE len(toks) < {GAPPED}),
probes AS ({seeds("d", "r", "pos", "m IN (SELECT m FROM used)")}
  UNION ALL SELECT r, pos, 'all' || n, n, toks[pos + 1 : pos + n] FROM (SELECT r, toks, n, unnest(range(len(toks) - n + 1)) AS pos FROM d, lengths WHERE n >= {SHORTEST} AND len(toks) >= n)
  UNION ALL SELECT r, 0, 'all' || n, n, toks FROM d JOIN lengths ON len(toks) = n WHERE n < {SHORTEST}),
met AS (SELECT doc_id, item_id, pos, j, d.toks AS toks, i.toks AS item, greatest(0, least(j - ({REGION} - idx.span) // 2, len(i.toks) - {REGION})) AS low FROM probes JOIN idx USING (m, h) JOIN d USING (r) JOIN i USING (s)),
hits AS (SELECT *, least(len(item), low + {REGION}) AS high FROM met),
scored AS (SELECT doc_id, item_id, len(list_filter(range(low, high), lambda p: p + pos - j >= 0 AND toks[p + pos - j + 1] = item[p + 1])) / (high - low) AS agreement FROM hits)
SELECT doc_id, item_id, count(*) AS n_hits, round(max(agreement), 6) AS agreement FROM scored WHERE agreement >= {AGREE} GROUP BY doc_id, item_id
"""


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold benchmark text; all columns stay."""
    found = sized(overlaps(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct(), "benchmark-leaks")
    return docs.join(found, docs["doc_id"].cast("long") == F.col("_leak"), "left_anti")
