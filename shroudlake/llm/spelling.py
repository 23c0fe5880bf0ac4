"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers, so anagrams share it, and one added, removed or exchanged letter changes it by one letter's value or by the
difference of two. Both kinds of change meet in an equi-join: each word sends its key less the value of one of its letters, once for each distinct letter, and its
whole key; equal values are an exchange (less a letter on both sides) or an addition (less a letter on one side, whole on the other). No two pairs of letters
have the same difference of fifth powers in the range of letters taken, so a pair of words meets on one value only.

Anagrams of one another are many where words are made of the same syllables, so the value is not all that a row is joined on: an edit lies in the first or in the
second half of the longer word, the other half is the same in both, and a row carries a hash of that half. The order of the letters is then verified by edit distance. Groups
are what shares a value and half a word, and rows are dealt by them; skewed ones are split by the join.

Words are counted in each task first, then by word. Forms are followed to the last by doubling: each is much more frequent than the one before, so a few rounds end it.

Defined cases: a null text has no words; texts of a null doc_id lose no letters, as there is nothing to hash; repeated rows count again; an empty table gives no words;
other columns are ignored. A word that nothing is near has n_near 0, no form, and is its own root. Words of any length are taken whole; keys are sums modulo a prime.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SQL_CRC, durable, small_batches, sql_crc, tidy

#: What a run of letters is, A-Z in lower case, and the share of runs that lose a letter.
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
EVERY = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Keys are taken modulo this prime, 2^61 - 1, so no word is too long for them.
PRIME = (1 << 61) - 1
#: Distinct words that a task counts before it passes them on.
HELD = 200_000


def worn(run: str, seed: int | None, every: int = EVERY) -> str:
    """The run without one letter, if its hash after the document's says so. seed: the checksum of the document's id and a colon."""
    if seed is None:
        return run
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer()
                if raw is None:
                    continue
                seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for run, times in Counter(RUN.findall(raw.to_pybytes().translate(LOWER).decode())).items():
                    if len(run) >= least_length and len(word := worn(run, seed)) >= least_length:
                        found[word] += times
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()

    small_batches(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def places(words: DataFrame) -> DataFrame:
    """(word, n, kind, key, half): a row for each value that a word is joined on, with the hash of the half that stays the same.

    kind has twice the number of letters that key stands for, and 1 more where the first half stays the same.
    """
    values = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    w = words.select("word", "n", F.transform(values, lambda x: x * x * x * x * x).alias("v"))
    w = w.select("*", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: (a + x) % PRIME).alias("k"), F.size("v").alias("l"))
    w = w.withColumns({"m": F.floor(F.col("l") / 2).cast("int"), "mm": F.floor((F.col("l") + 1) / 2).cast("int")})
    hashed = lambda a, b: F.xxhash64(F.substring("word", a, b))
    row = lambda kind, key, half: F.struct(kind.cast("int").alias("kind"), key.alias("key"), half.alias("half"))
    less = lambda x: F.pmod(F.col("k") - x, F.lit(PRIME))
    shorter = (F.col("l") - 1) * 2
    end, start = hashed(F.col("m") + 1, F.col("l")), hashed(F.lit(1), F.col("m"))
    first = F.transform(F.array_distinct(F.slice("v", F.lit(1), F.col("m"))), lambda x: row(shorter, less(x), F.col("end")))
    second = F.transform(F.array_distinct(F.slice("v", F.col("m") + 1, F.col("l"))), lambda x: row(shorter + 1, less(x), F.col("start")))
    # as the shorter word of a pair: the longer one's halves are of the length + 1
    whole = F.array(row(F.col("l") * 2, F.col("k"), hashed(F.col("mm"), F.col("l"))), row(F.col("l") * 2 + 1, F.col("k"), hashed(F.lit(1), F.col("mm"))))
    rows = w.withColumns({"end": end, "start": start}).select("word", "n", "l", F.explode(F.concat(first, second, whole)).alias("r"))
    return rows.select("word", "n", "l", "r.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words that one inserted, deleted or replaced code point turns into each other, once: word comes before near."""
    rows = durable(places(words), "spelling-places")
    other = rows.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("l").alias("near_l"), "kind", "key", "half")
    met = rows.join(other, ["kind", "key", "half"]).where("word < near AND levenshtein(word, near, 1) = 1")
    # a letter that is removed from a run of its kind may be in either half: then the row of the first half, the same in both, counts
    half = F.floor(F.greatest("l", "near_l") / 2).cast("int")
    once = (F.col("kind") % 2 == 1) | (F.substring("word", F.lit(1), half) != F.substring("near", F.lit(1), half))
    return met.where(once).select("word", "n", "near", "near_n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the last form that a word leads to."""
    now = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = durable(now.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n): a word's form is its most frequent near word, if that is ratio times as frequent; root is where forms lead to."""
    words = durable(words, "spelling-words")
    pairs = near_pairs(words)
    side = lambda a, a_n, b, b_n: F.struct(F.col(a).alias("w"), F.struct((-F.col(b_n)).alias("n"), F.col(b).alias("form")).alias("best"))
    both = pairs.select(F.inline(F.array(side("word", "n", "near", "near_n"), side("near", "near_n", "word", "n"))))
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    taken: Column = -F.col("best.n") >= F.col("n") * ratio
    rows = words.join(best, words["word"] == best["w"], "left").select(
        "word", F.when(taken, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.n")).alias("form_n")
    )
    rows = durable(rows, "spelling-forms")
    roots = followed(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """grouped() over the words of docs(doc_id, text)."""
    return grouped(word_counts(docs, least_length, least_count), ratio)


def sql() -> str:
    """variants() as DuckDB SQL over documents: near words by what is left when one place is taken out."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE {SQL_CRC},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, run),
hashed AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {sql_crc("doc_id::VARCHAR || ':' || run")} END AS h FROM runs, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(1000000) AS r(i) WHERE i < length(word)),
near AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT holes.word, words.word, words.n FROM holes JOIN words ON rest = words.word UNION SELECT words.word, holes.word, holes.n FROM holes JOIN words ON rest = words.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
named AS (SELECT word, min(near) AS form, top FROM near JOIN best USING (word) WHERE near_n = top GROUP BY word, top),
forms AS (SELECT words.word, words.n, CASE WHEN top >= {RATIO} * words.n THEN form END AS form, CASE WHEN top >= {RATIO} * words.n THEN top END AS form_n FROM words LEFT JOIN named USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, forms.n AS n, coalesce(n_near, 0) AS n_near, form_n FROM forms JOIN roots USING (word) LEFT JOIN best USING (word)"""
