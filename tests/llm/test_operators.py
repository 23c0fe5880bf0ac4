"""Each operator against a brute-force form, a round trip or held-out accuracy, with nulls, empty and repeated rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F

from shroudlake.llm import archives, bilstm_crf, decontaminate, importance, mixing, pii, quality_rules, queries, repeats, simhash, toxicity, wrappers

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp string"  # the last two clash with names inside


def docs_of(spark, texts, start=1):
    return spark.createDataFrame([(i + start, t, "en", "s", None, 0, "x") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_repeats(pairs, depth=50):
    seen, out = {}, []
    for i, t in sorted(pairs, key=lambda p: p[0]):
        b = (t or "").encode()
        for q in range(len(b) - depth + 1):
            seen.setdefault(b[q : q + depth], i)
    for i, t in pairs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - depth + 1):
            if seen[b[q : q + depth]] < i:
                gone[q : q + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark):
    p = "The quick brown fox jumps over the lazy dog and runs away from all the hounds. "
    texts = [None, "", "short", p + "alpha", "beta " + p, p, p, "é" * 60, "é" * 61, "z" * 200, "z" * 130, p[3:60] + "q", "x" + p[10:] + p[:40] + "tail " + p]
    got = repeats.remove_repeats(docs_of(spark, texts), group_bytes=200)
    assert sorted(map(tuple, got.collect())) == brute_repeats(list(enumerate(texts, 1)))
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_repeats_hot_anchor_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", 2)
    line = "this very line is in all of the documents of this table, word for word, always\n"
    texts = [line + f"own text number {i} " * 3 for i in range(30)]
    texts += [line[k : k + 52] + f"{i}{i * 7}" + line[k:] for i in range(8) for k in (0, 5, 11)]  # one anchor, many segments
    got = repeats.remove_repeats(docs_of(spark, texts), group_bytes=300)
    assert sorted(map(tuple, got.collect())) == brute_repeats(list(enumerate(texts, 1)))
    free = spark.createDataFrame([(None, line), (1, line)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(free).collect()) == [(0, 0), (1, 0)]


def test_repeats_of_random_pieces_and_long_texts(spark, monkeypatch):
    r = np.random.default_rng(12)
    pieces = ["".join(r.choice(list("abcé \n"), int(r.integers(20, 120)))) for _ in range(12)]
    texts = ["".join(pieces[k][int(r.integers(0, 9)) :] for k in r.integers(0, 12, int(r.integers(1, 9)))) for _ in range(60)]
    texts += ["".join(r.choice(list("abcdefgh "), 2_200_000)), texts[3]]
    texts += [texts[-2][1_048_000:1_049_000] + "!" + texts[-2][-300:]]
    got = repeats.remove_repeats(docs_of(spark, texts), group_bytes=3000)
    assert sorted(map(tuple, got.collect())) == brute_repeats(list(enumerate(texts, 1)))


def test_simhash_matches_brute_force(spark, documents):
    texts = [r.text for r in documents.orderBy("doc_id").limit(80).collect()] + [None, "", "one", "one two", "One two"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = {}
    for i, t in enumerate(texts, 1):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fingerprint == f"{prints[i]:016x}"
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r.component_id for i, r in got.items()} == root
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_pigeonhole_plan_is_complete():
    r = np.random.default_rng(1)
    bits = (r.random((400, 64)) < r.random(64)).astype(float)
    for radius in (1, 2, 3):
        parts = simhash.plan(400, bits.T @ bits, radius)
        for _ in range(300):
            x = int(r.integers(0, 1 << 63))
            y = x
            for b in r.choice(64, radius, replace=False):
                y ^= 1 << int(b)
            assert any(((x ^ y) & mask).bit_count() <= t for mask, t in parts)


def reached(prints, radius=3):
    """print -> the least that is reachable, by plain search."""
    root, x = {}, np.array(sorted(prints), np.int64)
    for p in x:
        if int(p) in root:
            continue
        todo, root[int(p)] = [p], int(p)
        while todo:
            for q in x[np.bitwise_count(x ^ todo.pop()) <= radius]:
                if int(q) not in root:
                    root[int(q)] = int(p)
                    todo.append(q)
    return root


PLANS = {"one": ((22, 1), (21, 0), (21, 0)), "half": ((32, 1), (32, 1)), "four": ((16, 0), (16, 0), (16, 0), (16, 0))}


@pytest.mark.parametrize("name", PLANS)
@pytest.mark.parametrize("pairs", [1, 1 << 30])  # with and without leaders
def test_simhash_links_are_complete(spark, monkeypatch, name, pairs):
    parts, at = [], 0
    for width, t in PLANS[name]:
        parts.append((((1 << width) - 1) << at, t))
        at += width
    monkeypatch.setattr(simhash, "plan", lambda *_: parts)
    monkeypatch.setattr(simhash, "LARGE", 8)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    # x and y differ by one bit in each part of the first plan, and most of x's bucket is of y's component and most of y's of x's
    x, y = 0, 1 | 1 << 22 | 1 << 43

    def arm(v, at):
        steps = [v, v ^ 3 << at, v ^ 15 << at]
        return [*steps, *[steps[-1] ^ 1 ^ 1 << at + 4 + k for k in range(6)], steps[-1] ^ 1]

    r = np.random.default_rng(8)
    change = lambda v, k: v ^ sum(1 << int(b) for b in r.choice(62, k, replace=False))
    more = [int(v) for v in r.integers(0, 1 << 62, 30)]
    more += [change(v, int(r.integers(1, 5))) for v in more for _ in range(3)]
    dense = int(r.integers(0, 1 << 62))  # a group around a text that is not in it
    more += [change(dense, int(r.integers(2, 6))) for _ in range(150)]
    prints = sorted({*arm(x, 30), *arm(y, 50), *more})
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {c.id: c.component for c in simhash.components(fps.select(F.col("fp").alias("id")), simhash.close_links(fps, 3)).collect()}
    assert got == reached(prints) and got[y] == 0


def test_simhash_of_null_ids_and_repeated_rows(spark):
    df = docs_of(spark, ["a b c d", None, "a b c d"]).union(docs_of(spark, ["a b c d"]).withColumn("doc_id", F.lit(None).cast("long"))).union(docs_of(spark, [""], start=2))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 1), (None, None), (2, 2)], key=str)


def test_near_copy_stage_at_four_fifths(spark):
    r = np.random.default_rng(2)
    base = [f"w{x}" for x in r.integers(0, 5000, 300)]
    near = [*base[:150], "changed", *base[151:]]
    far = [*base[:100], *[f"v{x}" for x in r.integers(0, 5000, 200)]]
    df = docs_of(spark, [" ".join(base), " ".join(near), " ".join(far), " ".join(base), None])
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 3, 5]
    assert simhash.keep_one(df).columns == df.columns


def test_bands_miss_few_pairs_at_four_fifths():
    r = np.random.default_rng(10)
    missed = 0
    for _ in range(6000):
        c = r.integers(0, 1 << 64, 100, dtype=np.uint64)  # 90 each, 80 shared
        missed += not (simhash.band_keys(c[:90]) == simhash.band_keys(c[10:])).any()
    assert missed <= 8  # independent bands miss 0.02 %


def test_near_copies_of_hubs_that_are_not_the_smallest(spark):
    r = np.random.default_rng(9)

    def edited(words, k):
        out = list(words)
        for at in r.choice(len(out), k, replace=False):
            out[at] = f"x{r.integers(0, 1 << 40)}"
        return out

    hub = [f"w{x}" for x in r.integers(0, 5000, 300)]
    other = edited(hub, 10)  # too far from the first hub, but in its buckets
    texts = [edited(h, 6) for h in (hub, other) for _ in range(20)]
    texts = [" ".join(t) for t in [*texts[:10], hub, *texts[10:30], other, *texts[30:]]]
    found = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in range(4):
        for a, x in enumerate(found):
            for b, y in enumerate(found):
                if len(x & y) >= 0.8 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    got = {g.doc_id: g.component_id for g in simhash.similar_groups(docs_of(spark, texts)).collect()}
    assert len(set(root)) < 5 and [got[i + 1] - 1 for i in range(len(texts))] == root


def test_decontamination_tolerates_substitutions(spark):
    r = np.random.default_rng(3)
    item = [f"b{x}" for x in r.integers(0, 9999, 30)]
    swap = item.copy()
    swap[5] = swap[14] = swap[22] = "other"
    clean = " ".join(f"c{x}" for x in r.integers(0, 9999, 200))
    texts = [clean, clean + " " + " ".join(item), " ".join(swap).upper() + " " + clean, None, "", "tiny item of six words here"]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "tiny item of six words here"), (9, None), (10, "two words")], "item_id long, text string")
    got = decontaminate.overlaps(docs_of(spark, texts), bench)
    assert sorted((x.doc_id, x.item_id) for x in got.collect()) == [(2, 7), (3, 7), (6, 8)]
    assert sorted(x.doc_id for x in decontaminate.clean(docs_of(spark, texts), bench).collect()) == [1, 4, 5]
    assert decontaminate.overlaps(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_edge_cases(spark):
    r = np.random.default_rng(13)
    item, short = [f"b{x}" for x in r.integers(0, 9999, 40)], "only three words"
    long = " ".join(["filler"] * 60_000 + item + ["filler"] * 60_000)
    texts = [long, short, f"{short} and more", short.upper() + "!", " ".join(item[:11]), ""]
    df = docs_of(spark, texts).withColumns({"toks": F.lit(1), "item_id": F.lit(2), "h": F.lit(3)})
    df = df.union(df.where("doc_id = 2")).union(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, short), (None, short), (3, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_hits for x in decontaminate.overlaps(df, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 2)} and got[2, 2] == 2 * got[4, 2]
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0 and decontaminate.clean(df, bench).columns == df.columns


def test_archive_round_trip(spark):
    big, other = "<p>" + "é" * 700, "<p>" + "y" * 1200
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c", "s"), (4, "http://d", "s"), (5, "http://e", None), (6, "http://f", other), (None, "x", big)]
    made = "page_id long, url string, html string"
    got = {r.page_id: r for r in archives.round_trip(spark.createDataFrame(rows, made)).collect()}
    # a row without a page_id has a record too
    assert {k: (v.record_type, v.refers_to) for k, v in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    for page, _, html in rows:
        body = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())


def test_archive_of_nulls_copies_and_nothing(spark):
    big, made = "z" * 5000, "page_id long, url string, html string, digest string, response long"
    rows = [(None, "a", big, "x", 1), (None, None, big, "x", 1), (7, "b", "q" * 3000, "x", 1), (7, "c", "q" * 3000, "x", 1), (3, "d", "q" * 3000, "x", 1), (7, "e", "other", "x", 1), (8, "f", "long " * 400_000, "x", 1)]
    got = archives.round_trip(spark.createDataFrame(rows, made)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(0, 5000, "response", 0)] * 2 + [(7, 3000, "response", 0)] * 2 + [(3, 3000, "revisit", 7), (7, 5, "response", 0), (8, 2_000_000, "response", 0)]
    )
    assert archives.round_trip(spark.createDataFrame([], made)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_by_version(version):
    data = archives.arc_head(version, "f.arc") + archives.arc_record(version, "http://x/a b", b"HTTP/1.1 200 OK\r\n\r\nbody\n\nmore", "f.arc", 0)
    (r,) = archives.read_arc(data)
    assert r["URL"] == "http://x/a%20b" and archives.split_http(r["body"])[1] == b"body\n\nmore"
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-10]))


def test_main_text(spark):
    page = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li>menu</li></ul></nav><div class='ad'>buy</div><article><h1>Head  &amp; line</h1><p>One <b>bold</b>\n text<p>Two<br>Three<div class='comments'><p>me first</p></div></article><aside>side</aside><footer>&copy; x</footer></body></html>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", page[:300])]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nOne bold text\nTwo\nThree" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text.startswith("Head & line")


def test_steady_texts_are_whole_and_on_distinct_pages(spark):
    lead = "a shared passage that opens every part of the series " * 5
    rows = [(i, f"http://a/{i}", f"<div><p>{lead}part {i}</p></div>") for i in range(1, 5)]
    rows += [(10 + i, f"http://b/{i}", "<div><p>said once, held four times</p></div>" if i < 4 else f"<div><h2>t</h2><p>other {i}</p></div>") for i in range(6)]
    rows += [(20 + i, f"http://c/{i}", f"<table><tr><td>licence</td></tr></table><p>text {i}</p>" if i < 3 else f"<div><p>own {i}</p></div>") for i in range(9)]
    rows += [(30 + i, f"http://d/{i}", f"<div>legal line</div><p>text {i}</p>") for i in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == lead + f"part {i}" for i in range(1, 5))
    assert all(got[10 + i] == "said once, held four times" for i in range(4))
    assert all(got[20 + i] == f"licence\ntext {i}" for i in range(3))
    assert all(got[30 + i] == f"text {i}" for i in range(4))


def texts_of(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}


def test_marks_do_not_outweigh_the_text(spark):
    pages = ["<body class='has-sidebar'><article><p>one</p></article>", "<body class='no-header'><p>two</p>", "<article class='post search-result'><p>three</p></article>", "<div class='search-page'><p>four is long</p></div><div class='ad'>buy</div>"]
    got = texts_of(spark, [(i, f"http://m{i}/", p) for i, p in enumerate(pages)] + [(9, "http://n/", None)])
    assert got == {0: "one", 1: "two", 2: "three", 3: "four is long", 9: ""}


def test_the_wrapper_finds_menus_without_telling_names(spark):
    words = lambda i, k: " ".join(f"w{i * 37 + j}" for j in range(k))
    page = lambda i: f"<div><ul><li>Start</li><li>All series</li><li>Imprint</li></ul></div><h2>{words(i, 3)}</h2>" + "".join(f"<p>{words(i + 50 * j, 20)}</p>" for j in range(1 + i % 3)) + "<p>All rights stay with us</p><div><a href='/x'>see " + words(i, 4) + "</a></div>"
    rows = [(i, f"http://a/{i}", page(i)) for i in range(6)]
    want = {i: "\n".join([words(i, 3), *[words(i + 50 * j, 20) for j in range(1 + i % 3)]]) for i in range(6)}
    assert texts_of(spark, rows) == want
    # without the host's other pages there is nothing to tell the menu by
    assert "Imprint" in texts_of(spark, rows[:1])[0]
    assert texts_of(spark, [*rows, *rows]) == want and texts_of(spark, rows[:0]) == {}


def test_wrappers_fold_and_align():
    a = wrappers.stream(wrappers.tokenise("<ul><li>a</li><li>b</li></ul><p>x</p>"))
    b = wrappers.stream(wrappers.tokenise("<ul><li>a</li></ul><h2>new</h2><p>y</p>"))
    w = wrappers.align(a, b)
    assert any(x[0] == "+" for x in w) and any(x[0] == "?" for x in w)
    assert wrappers.align(w, b) == wrappers.align(wrappers.align(w, b), b) or len(wrappers.align(w, b)) == len(w)


def test_quality_counts_match_brute_force(spark, documents):
    texts = [r.text for r in documents.limit(120).collect()] + [None, "", "  \n", "a b c a b c", "l\nl\n\nl"]
    zero = quality_rules.Model(np.zeros(1 << 18, np.float32), np.zeros(1 << 18, np.float32), 10.0)
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, texts), zero).collect()}
    for i, t in enumerate(texts, 1):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c, cover, seen, dup = collections.Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and got[i].kept == (not got[i].base_failed)


def test_quality_and_toxicity_learn(spark):
    r = np.random.default_rng(4)
    text = lambda bad: " ".join(f"{'zap' if bad and r.random() < 0.1 else 'w'}{r.integers(0, 200)}" for _ in range(80))
    bad = [i % 3 == 0 for i in range(240)]
    df = docs_of(spark, [text(b) + (" vile" if b else "") for b in bad])
    labels = spark.createDataFrame([(i + 1, int(not b), int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    seen = labels.where(~queries.held_out(F.col("doc_id")))
    scores = {x.doc_id: x.score for x in toxicity.score(df, toxicity.fit(df, seen)).collect()}
    assert all((scores[i + 1] >= 0.3) == b for i, b in enumerate(bad))
    kept = {x.doc_id: x.kept for x in quality_rules.judge(df, quality_rules.fit(df, labels)).collect()}
    assert np.mean([kept[i + 1] != b for i, b in enumerate(bad)]) > 0.9
    assert toxicity.score(docs_of(spark, [None, ""]), toxicity.fit(df, labels.limit(0))).count() == 2


def test_held_out_fold(spark):
    got = spark.range(200).select("id", queries.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_importance_keeps_k(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = importance.resample(documents, labels, share=0.5)
    n, k = documents.count(), out.where("kept").count()
    assert out.count() == n and k == round(n / 2)
    least = out.where("kept").agg(F.min("gumbel_key")).first()[0]
    assert out.where(~F.col("kept")).agg(F.max("gumbel_key")).first()[0] <= least
    assert importance.resample(docs_of(spark, []), labels).count() == 0


def test_importance_share_is_of_all_labels(spark):
    df = docs_of(spark, [f"text number {i}" for i in range(100)])
    labels = spark.createDataFrame([(i + 1, int(i % 4 == 0)) for i in range(100)] + [(1, 0), (None, 1), (200, None)], "doc_id long, quality int")
    assert importance.resample(df, labels, rows=7).where("kept").count() == 25


def test_importance_keeps_exactly_k_of_repeated_rows(spark):
    df = docs_of(spark, [None, "", "a b c"] * 3 + ["a b c"] * 20).union(docs_of(spark, ["x y"] * 6).withColumn("doc_id", F.lit(4).cast("long"))).union(docs_of(spark, ["n"]).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(9, 1), (10, 0)], "doc_id long, quality int")
    for share in (0.0, 0.1, 0.43, 0.9, 1.0):
        out = importance.resample(df, labels, share=share).collect()
        assert len(out) == 36 and sum(r.kept for r in out) == round(share * 35) and not any(r.kept for r in out if r.doc_id is None)


def test_mixing_of_small_sources_and_nothing(spark):
    rows = [(i, "w " * 500, "en", "large", None, 0, "x") for i in range(2000)] + [(5000, "w w", "xx", "tiny", None, 0, "x")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, DOC)).collect()}
    assert got[5000].source_group == "tiny" and got[5000].lang_group == "xx" and got[5000].probability == 1.0
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows[:3], DOC), targets={"source_group": {"absent": 0.5}})
    empty = docs_of(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).columns == [*empty.columns, "topic", "n_tokens", "probability"]
    clash = docs_of(spark, ["a b"]).withColumns({"topic": F.lit("own"), "sampled": F.lit(0), "share": F.lit(1), "probability": F.lit("p")})
    assert mixing.sample(clash).first().topic == "prose"


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (5 + i % 7), "en" if i % 3 else "fr", f"s{i % 4}", None, 0, "x") for i in range(1, 2001)] + [(None, None, None, None, None, 0, "x")]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.mix(df, targets={"source_group": {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}}).collect()
    mass = collections.Counter()
    for r in got:
        mass[r.source_group] += r.n_tokens * r.probability
    total = sum(mass.values())
    assert all(abs(mass[f"s{k}"] / total - (k + 1) / 10) < 0.01 for k in range(4))
    assert len(got) == 2001 and not [r for r in got if r.doc_id is None][0].sampled
    assert set(mixing.sample(df).columns) >= set(df.columns)


def test_tagger_gradient():
    t = bilstm_crf.Tagger(hidden=3, embed=2)
    r = np.random.default_rng(5)
    ids, tags = r.integers(1, 50, (2, 6)), r.integers(0, 5, (2, 6))
    _, grad = t.loss(ids, tags)
    for name in ("T", "O", "Uf", "Wb", "vb", "c"):
        at = tuple(0 for _ in t.p[name].shape)
        old, e = t.p[name][at], 1e-5
        t.p[name][at] = old + e
        up = t.loss(ids, tags)[0]
        t.p[name][at] = old - e
        down = t.loss(ids, tags)[0]
        t.p[name][at] = old
        assert abs((up - down) / (2 * e) - grad[name][at]) < 1e-4


def test_base_spans_and_masking(spark):
    t = "mail a.b@ex-1.example.com, ip 10.0.0.300 and 10.0.0.30; card 4111 1111 1111 1111, +1 (743) 555-3824 é@x.y"
    got = pii.base_spans(t)
    assert [(k, t[s:e]) for k, s, e in got] == [("email", "a.b@ex-1.example.com"), ("ip", "10.0.0.30"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert pii.mask_text(t, got).count("[") == 4
    out = pii.find(docs_of(spark, [None, "", t, t]), None).orderBy("doc_id").collect()
    assert [r.n_email for r in out] == [0, 0, 1, 1] and out[2].base_sha256 == hashlib.sha256(pii.joined(got).encode()).hexdigest()
    assert pii.mask(docs_of(spark, [t]), None).first().text.startswith("mail [EMAIL], ip")


def brute_base(text):
    """The four patterns run plainly: (kind, start, end) in order."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x * 2 - 9 * (x * 2 > 9) if i % 2 else x for i, x in enumerate(reversed(d))]
        out += [("card", m)] if 12 <= len(d) <= 19 and sum(doubled) % 10 == 0 else []
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    kinds = ("email", "ip", "card", "phone")
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda x: (x[1], kinds.index(x[0])))


def test_base_spans_match_plain_patterns(spark, documents):
    extra = ["999.1.1.1 1.2.3.4.5 0001.0.0.255", "4111-1111-1111-1111 4111111111111111 12345", "+1 (743) 555.3824 +12 +123456789012345678", "a@b a@b.c.d@e.f", "é 10.0.0.1 😀 x@y.zz", "7" * 5000, None, ""]
    texts = [r.text for r in documents.collect()] + extra
    for r in pii.find(docs_of(spark, texts), None).collect():
        want = brute_base(texts[r.doc_id - 1] or "")
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert pii.find(docs_of(spark, []), None).count() == 0


def test_importance_matches_brute_force(spark):
    r = np.random.default_rng(14)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 40, int(r.integers(0, 60)))) for _ in range(60)] + [None, "", "é w1 \u2003 W1"]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 40)], "doc_id long, quality int")
    bucket = lambda t: importance.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 50)[1]
    count = lambda some: sum((np.bincount(bucket(t or ""), minlength=50) for t in some), np.zeros(50))
    p, q = count(texts[i - 1] for i in range(1, 40) if i % 3 == 0) + 1, count(texts) + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    out = {x.doc_id: x for x in importance.resample(docs_of(spark, texts), labels, buckets=50).collect()}
    for i, t in enumerate(texts, 1):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert out[i].n_grams == max(0, 2 * n - 1) and abs(out[i].log_weight - ratio[bucket(t or "")].sum()) < 1e-9
    best = sorted(out.values(), key=lambda x: -x.gumbel_key)[: round(len(texts) / 3)]
    assert {x.doc_id for x in out.values() if x.kept} == {x.doc_id for x in best}


def test_quality_verdict_matches_plain_sums(spark):
    r = np.random.default_rng(15)
    model = quality_rules.Model(r.normal(size=1 << 18).astype(np.float32), r.normal(size=1 << 18).astype(np.float32), 0.2, 1.5, -0.1)
    texts = [" ".join("".join(r.choice(list("abcé漢"), 4)) for _ in range(int(n))) for n in r.integers(0, 120, 20)] + [None, "", "x", "é" * 300]
    got = {x.doc_id: x for x in quality_rules.judge(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts, 1):
        b = np.frombuffer((t or "").encode(), np.uint8)
        (_, w), (_, c) = quality_rules.grams(b, np.array([0, len(b)]), 18)
        n_words = len((t or "").split())
        assert len(w) == max(0, 2 * n_words - 1) and len(c) == max(0, len(t or "") - 2) + max(0, len(t or "") - 3)
        z = 0.2 + (model.word[w].mean(dtype=float) if len(w) else 0) + (model.char[c].mean(dtype=float) if len(c) else 0)
        assert abs(got[i].probability - 1 / (1 + np.exp(-(1.5 * z - 0.1)))) < 1e-6
        assert got[i].kept == (not got[i].base_failed and got[i].probability >= quality_rules.KEEP)
    odd = docs_of(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert quality_rules.judge(odd, model).first().doc_id is None and quality_rules.judge(docs_of(spark, []), model).count() == 0


def test_toxicity_of_repeated_rows_and_nothing(spark):
    model = toxicity.fit(docs_of(spark, ["vile words here", "fine words there"] * 30), spark.createDataFrame([(i, i % 2) for i in range(1, 61)], "doc_id long, toxic int"))
    df = docs_of(spark, ["vile words here"] * 3 + [None, "", "vile " * 300_000])
    scores = [x.score for x in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert len(set(scores[:3])) == 1 and scores[3] == scores[4] and scores[0] > 0.5 and 0 <= scores[5] <= 1
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_tagger_finds_other_forms(spark):
    r = np.random.default_rng(6)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    phone = lambda: f"+1 ({r.integers(200, 999)}) {r.integers(200, 999)}-{r.integers(1000, 9999)}"
    train = [" ".join(word() for _ in range(12)) + f" {phone()} " + " ".join(word() for _ in range(12)) for _ in range(150)]
    tagger = pii.fit(docs_of(spark, train))
    tests = [" ".join(word() for _ in range(12)) + f" {r.integers(200, 999)}-{r.integers(200, 999)}-{r.integers(1000, 9999)} " + " ".join(word() for _ in range(12)) for _ in range(20)]
    found = pii.added_spans(tests, [pii.base_spans(t) for t in tests], tagger)
    assert sum(bool(f) for f in found) >= 14
    quiet = [" ".join(word() for _ in range(40)) + " 1234 in 2019" for _ in range(20)]
    assert not any(pii.added_spans(quiet, [[] for _ in quiet], tagger))


def test_decontamination_recall(spark):
    r = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(400)]
    items, texts, want, k = [], [], set(), 0
    for size in (6, 8, 12, 16, 24, 40):
        for share in (0.1, 0.2):
            for _ in range(30):
                k += 1
                item = [str(x) for x in r.choice(vocabulary, size)]
                same = r.random(size) >= share
                text = [x if s else "other" for x, s in zip(item, same)]
                items.append((k, " ".join(item)))
                texts.append(" ".join([*r.choice(vocabulary, 30), *text, *r.choice(vocabulary, 30)]))
                region = min(size, decontaminate.REGION)
                if max(same[i : i + region].mean() for i in range(size - region + 1)) >= decontaminate.AGREE:
                    want.add((size, share, k))
    got = {x.doc_id for x in decontaminate.overlaps(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).where("doc_id = item_id").collect()}
    for size in (6, 8, 12, 16, 24, 40):
        for share in (0.1, 0.2):
            own = {x for s, p, x in want if (s, p) == (size, share)}
            assert len(own & got) >= 0.9 * len(own), (size, share)


def test_decontamination_finds_any_single_substitution(spark):
    bench = spark.createDataFrame([(n, " ".join(f"t{n}x{i}" for i in range(n))) for n in (4, 5, 6, 7, 8, 12, 13)], "item_id long, text string")
    texts, want = [], set()
    for n in (4, 5, 6, 7, 8, 12, 13):
        for gone in [None, *range(n)]:
            texts.append("before " + " ".join("else" if i == gone else f"t{n}x{i}" for i in range(n)) + " after")
            if gone is None or n >= 6:
                want.add((len(texts), n))
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs_of(spark, texts), bench).collect()} == want


class Marks:
    """Stands for a tagger that finds the host of an address and the last letters of its name."""

    def decode(self, ids):
        host, out = bilstm_crf.char_ids(" at example dot co"), np.zeros(ids.shape, np.int64)
        for row, tags in zip(ids, out):
            for at in range(5, len(row) - len(host) + 1):
                if (row[at : at + len(host)] == host).all():
                    tags[at - 5 : at + len(host)] = bilstm_crf.TAGS.index("email")
        return out


def test_addresses_are_taken_whole():
    name = "a_very_long_local_part_of_more_than_forty_characters"
    texts = [f"write to {name} at example dot com today", f"{name * 4} at example dot com", "kim.lee at example dot com-pany now"]
    found = pii.added_spans(texts, [[], [], []], Marks())
    assert [[t[s:e] for _, s, e in own] for t, own in zip(texts, found)] == [[f"{name} at example dot com"], [f"{name * 4} at example dot com"], ["kim.lee at example dot com-pany"]]
    many = " ".join(f"u{i}@mail{i}.example.com" for i in range(20_000))
    assert len(pii.examples(many, pii.base_spans(many))) == 0
    apart = "x" * 70
    assert [w for w, *_ in pii.examples(f"a@b.org {apart} c@d.org {apart}", pii.base_spans(f"a@b.org {apart} c@d.org {apart}"))] == [f"a@b.org {apart}"[:37], f"{apart} c@d.org {apart}"[41:][:67]]


def test_pages_that_break_simple_readers(spark):
    import time

    began = time.time()
    rows = [(1, "<p>start</p>" + "<a " * 700_000 + "'"), (2, "<p title='x>one</p><p>two</p>"), (3, "<p>before <math><mi>x</mi></math> mid <svg><text>gone</text></svg> <button>gone</button> after</p>"), (4, "<div>" * 2000 + "deep")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert got == {1: "start", 2: "one\ntwo", 3: "before x mid after", 4: "deep"} and time.time() - began < 60


def test_marks_do_not_empty_a_page(spark):
    words = "some words of an article that goes on for a while and says a lot of things. " * 5
    pages = [(k, "http://x.org/", f"<div class='entry'><p>{words}{k}</p></div>") for k in range(4)] + [(9, "http://x.org/9", f"<div class='widget-text'><p>{words}own</p></div><div class='comments'><p>talk</p></div>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == f"{words}own" and got[1] == f"{words}1"


def test_long_streams_are_aligned_between_anchors():
    r = np.random.default_rng(4)
    a = [("t", int(x)) for x in r.integers(0, 50, 3000)]
    b = [x for x in a if r.random() > 0.05]
    a[500:500], b[900:900] = [("t", f"own{i}") for i in range(900)], [("t", f"other{i}") for i in range(700)]
    for k in range(0, 2400, 60):
        a[k] = ("t", f"once{k}")
        b[min(len(b) - 1, k)] = ("t", f"once{k}")
    pairs = wrappers.anchored(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:])) and len(pairs) > 500
    same = [("t", int(x)) for x in r.integers(0, 3, 4000)]
    walked = wrappers.anchored(same, same[5:])
    assert all(same[i] == same[5 + j] for i, j in walked) and len(walked) > 1000
