"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic. The cells' token weights are raked: in each
round they are scaled to the source targets, then the language targets, then the topic targets, until
every marginal is within TOLERANCE of its target (at most ROUNDS rounds).
A document's probability is its cell's raked weight over its own weight, divided by the largest
such ratio, so expected token shares of the sample meet the targets with the largest sample;
a hash of doc_id decides.

By default the targets are the shares raised to TEMPERATURE and normalised, which lifts small
categories. Targets can be given per category; categories without one share what is left. Every category
has its own cells, however small; a target of a category that has no tokens raises ValueError.
Topics are a table of (name, mark) that the caller may replace; the tables have no topic column.

Only token sums of cells are gathered: the cell table is raked in one partition and broadcast if it has at most
BROADCAST_CELLS rows, else raked and joined by exchange. Texts are never exchanged in the first case.

Defined cases: a null source or language is the category '(none)'; null and empty texts have no
tokens and their cell's probability, 1 where a cell has no tokens; rows with a null doc_id are never sampled;
repeated rows share their fate; an empty table gives an empty result; other columns are ignored by mix() and kept by sample(),
where topic, n_tokens and probability of the mixture replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

ROUNDS, STEP, TOLERANCE, TEMPERATURE, BROADCAST_CELLS = 24, 4, 1e-11, 0.9, 100_000
#: The default topics, by the first mark that a text contains.
TOPICS = (("licence", "icensed under"), ("contact", "@"), ("table", " | "), ("shout", "!! "), ("symbols", "*** "), ("secret", "token = "))
DIMS = ("source_group", "lang_group", "topic")
WORD = r"[^\x20\x09-\x0D]+"

Targets = dict[str, dict[str, float]]


def topic_of(text: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    out = F.lit("prose")
    for name, mark in reversed(topics):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def features(topics: tuple[tuple[str, str], ...] = TOPICS) -> dict[str, Column]:
    """Each row's cell and token count, from source, lang and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "source_group": F.coalesce("source", F.lit("(none)")), "lang_group": F.coalesce("lang", F.lit("(none)")),
        "topic": topic_of(text, topics), "n_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
    }


def with_targets(cells: DataFrame, targets: Targets | None) -> DataFrame:
    """cells(.., tokens) with each one's share, and for each dimension the target weight of its category."""
    everything = Window.partitionBy()
    out = cells.withColumn("share", F.col("tokens") / F.sum("tokens").over(everything))
    for d in DIMS:
        w = Window.partitionBy(d)
        out = out.withColumn(f"_{d}", F.pow(F.sum("share").over(w), F.lit(TEMPERATURE)))
        own = (targets or {}).get(d)
        if own:
            absent = set(own) - {r[0] for r in cells.where(F.col(d).isin(*own)).select(d).distinct().collect()}
            if absent:
                raise ValueError(f"no tokens in {d}: {sorted(absent)}")
            given = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), F.lit(float(v)))])[F.col(d)]
            rest = max(0.0, 1 - sum(own.values()))
            out = out.withColumn("_given", given).withColumn("_free", F.when(F.col("_given").isNull(), F.col(f"_{d}") / F.count("*").over(w)))
            out = out.withColumn(f"_{d}", F.coalesce("_given", F.col(f"_{d}") * rest / F.sum("_free").over(everything))).drop("_given", "_free")
        # each category is counted once in the normalising sum
        out = out.withColumn(f"_{d}", F.col(f"_{d}") / F.sum(F.col(f"_{d}") / F.count("*").over(w)).over(everything))
    return out.withColumn("raked", F.col("share"))


def rake(cells: DataFrame, targets: Targets | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells(source_group, lang_group, topic, tokens) with the share and the raked share of each; written every STEP rounds, when the marginals are tested."""
    cells = durable(cells, "mixing-cells")
    one = cells.count() <= BROADCAST_CELLS
    together = lambda df: df.coalesce(1) if one else df
    out = durable(with_targets(together(cells), targets), "mixing-cells")
    for done in range(0, rounds, STEP):
        out = together(out)
        for _ in range(min(STEP, rounds - done)):
            for d in DIMS:
                out = out.withColumn("raked", F.col("raked") * F.col(f"_{d}") / F.sum("raked").over(Window.partitionBy(d)))
        out = durable(out, "mixing-cells")
        off = [out.groupBy(d).agg(F.abs(F.sum("raked") / F.max(f"_{d}") - 1).alias("off")).select("off") for d in DIMS[:-1]]
        worst = off[0].union(off[1]).agg(F.max("off")).first()[0]  # the last dimension is met by construction
        if worst is None or worst <= TOLERANCE:
            break
    return out.select(*DIMS, "share", "raked")


def unit(doc_id: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def probabilities(rows: DataFrame, targets: Targets | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source_group, lang_group, topic, probability) for each cell with tokens; marked for broadcast if small."""
    cells = rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    ratio = rake(cells, targets, rounds).withColumn("ratio", F.col("raked") / F.col("share"))
    out = durable(ratio.select(*DIMS, F.round(F.col("ratio") / F.max("ratio").over(Window.partitionBy()), 6).alias("probability")), "mixing-odds")
    return F.broadcast(out) if out.count() <= BROADCAST_CELLS else out


def decided(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """rows with the probability of their cell and whether they are sampled."""
    out = rows.join(odds, list(DIMS), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.withColumn("sampled", F.coalesce(unit(F.col("doc_id").cast("long")) < F.col("probability"), F.lit(False)))


def mix(docs: DataFrame, targets: Targets | None = None, topics: tuple[tuple[str, str], ...] = TOPICS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, source_group, lang_group, topic, n_tokens, probability, sampled) of every row."""
    made = features(topics)
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in made.items()]), "mixing")
    return decided(rows, probabilities(rows, targets, rounds)).select("doc_id", *DIMS, "n_tokens", "probability", "sampled")


def sample(docs: DataFrame, targets: Targets | None = None, topics: tuple[tuple[str, str], ...] = TOPICS, rounds: int = ROUNDS) -> DataFrame:
    """The sampled rows of docs, with all columns and the mixture's topic, n_tokens and probability. Two scans of docs."""
    made = features(topics)
    odds = probabilities(docs.select(*[c.alias(n) for n, c in made.items()]), targets, rounds)
    own = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens", "probability")]
    inner = {n: f"_mix{i}" for i, n in enumerate(own)}
    rows = docs.select(*[F.col(f"`{n}`").alias(inner[n]) for n in own], F.col("doc_id"), *[c.alias(n) for n, c in made.items()])
    kept = decided(rows, odds).where("sampled")
    return kept.select(*[F.col(inner[n]).alias(n) for n in own], "topic", "n_tokens", "probability")


def sql() -> str:
    """mix() with default targets as DuckDB SQL over documents."""
    topic = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN '{n}'" for n, m in TOPICS) + " ELSE 'prose' END"
    q = [
        "b AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t FROM documents)",
        f"f AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS n_tokens FROM b)",
    ]
    q.append("r AS (SELECT doc_id, source AS source_group, lang AS lang_group, topic, n_tokens FROM f)")
    q.append("c AS (SELECT source_group, lang_group, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)")
    q.append("s AS (SELECT *, tokens / sum(tokens) OVER () AS share FROM c)")
    prev = "s"
    for d in DIMS:
        q.append(f"p_{d} AS (SELECT *, pow(sum(share) OVER (PARTITION BY {d}), {TEMPERATURE}) AS w_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d} FROM {prev})")
        q.append(f"q_{d} AS (SELECT * REPLACE (w_{d} / sum(w_{d} / n_{d}) OVER () AS w_{d}) FROM p_{d})")
        prev = f"q_{d}"
    q.append(f"k AS (SELECT *, share AS raked FROM {prev})")
    prev = "k"
    for i in range(ROUNDS):
        for d in DIMS:
            q.append(f"k{i}_{d} AS (SELECT * REPLACE (raked * w_{d} / sum(raked) OVER (PARTITION BY {d}) AS raked) FROM {prev})")
            prev = f"k{i}_{d}"
    q.append(f"z AS (SELECT source_group, lang_group, topic, round(raked / share / max(raked / share) OVER (), 6) AS probability FROM {prev})")
    unit_sql = "('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0"
    return (
        "WITH " + ",\n".join(q) + "\nSELECT doc_id, r.source_group, r.lang_group, r.topic, n_tokens, coalesce(probability, 1.0) AS probability, "
        f"coalesce({unit_sql} < coalesce(probability, 1.0), false) AS sampled FROM r LEFT JOIN z USING (source_group, lang_group, topic)"
    )
