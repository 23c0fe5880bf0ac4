"""Licence scans, transaction logs and spelling variants against plain code, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudlake.llm import licenses, queries, spelling, translog

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, word string, n long, block int, kind string, pos long, rank int, labels string"  # the last seven clash with names inside


def docs_of(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, "w", 1, 2, "k", 3, 4, "l") for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# licences


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_base_matches_plain_search(spark, documents):
    own = [(r.doc_id, r.text, "s") for r in documents.collect()]
    more = [None, "", "  ", "Apache License", "apache licenses", "xapache license", "GNU  General\nPublic—License gnu general public, license", "MIT License MIT-license mit license", "CC BY cc by-nc CC-BY ccby", "éApache license Éapache License", "mit " * 5, "cc by " * 60_000]
    rows = own + [(10_000 + i, t, None) for i, t in enumerate(more)] + [(None, "the MIT License", "s"), (1, "CC BY", "s"), (1, "CC BY", "s")]
    got = licenses.scan(docs_of(spark, rows)).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *plain_base(t)) for i, t, _ in rows), key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    assert licenses.scan(docs_of(spark, [])).count() == 0


def value(text):
    return licenses.evaluated(licenses.postfix(re.findall(r"[()]|[^\s()]+", text)))


def test_expressions_bind_as_they_should():
    assert value("MIT or Apache-2.0 and GPL-2.0")[0] == "(mit or (apache-2.0 and gpl-2.0))"
    assert value("(MIT or Apache-2.0) and GPL-2.0")[0] == "((mit or apache-2.0) and gpl-2.0)"
    assert value("GPL-2.0 with Classpath-exception-2.0 and MIT or BSD-3-Clause")[0] == "(((gpl-2.0 with classpath-exception-2.0) and mit) or bsd-3-clause)"
    assert value("a or b or c")[0] == "((a or b) or c)"
    assert [value(x)[2] for x in ("GPL-3.0 or MIT", "GPL-3.0 and MIT", "GPL-2.0 with Classpath-exception-2.0", "GPL-2.0 with autoconf-exception", "Apache-2.0+")] == [True, False, True, False, True]
    assert value("MIT and")[0] == "mit" and value("(MIT or (")[0] == "mit" and value("((MIT")[0] == "mit" and value("MIT )")[0] == "mit"
    assert value("and MIT") is None and value("") is None and value("()") is None
    assert value("(" * 5000 + "MIT" + ")" * 5000)[0] == "mit"


def test_expressions_agree_with_truth_tables():
    r = np.random.default_rng(3)
    free = {"MIT": True, "GPL-3.0": False, "BSD-3-Clause": True, "AGPL-3.0": False}

    def make(depth):
        if not depth or r.random() < 0.2:
            return str(r.choice(list(free)))
        a, op, b = make(depth - 1), r.choice(["or", "AND", "and", "OR"]), make(depth - 1)
        return f"({a} {op} {b})" if r.random() < 0.6 else f"{a} {op} {b}"

    for _ in range(300):
        text = make(4)
        plain = re.sub(r"MIT|GPL-3.0|BSD-3-Clause|AGPL-3.0", lambda m: str(free[m[0]]) if m[0] != "GPL-3.0" else "False", re.sub(r"AGPL-3.0", "False ", text)).replace("AND", "and").replace("OR", "or")
        assert value(text)[2] == eval(plain), text  # noqa: S307


def test_tags_notices_and_versions():
    def scan(t):
        names = ("n_words", "n_base", "first", "last", "base", "labels", "score", "permissive", "expressions", "notices")
        return dict(zip(names, licenses.scan_text(t.encode())))

    assert scan("# SPDX-License-Identifier: (MIT OR X-own) */\nnext")["labels"] == "mit,x-own"
    assert scan("License: see below")["labels"] == "" and scan("License: MIT. It is")["labels"] == "mit"
    assert scan("the license")["labels"] == "" and scan("license\nMIT")["labels"] == ""
    assert scan("Licensed under the GNU General Public License, version 3.")["labels"] == "gpl,gpl-3.0"
    assert scan("under CC BY-NC 4.0.")["labels"] == "cc-by,cc-by-nc-4.0" and scan("CC BY-NC")["labels"] == "cc-by,cc-by-nc"
    assert scan("Permission is hereby granted, free of charge, to any person obtaining a copy")["labels"] == "mit"
    assert scan("GNU Lesser General Public License v2.1 or later")["labels"] == "lgpl-2.1"
    assert [e["word"] for e in scan("one\nSPDX-License-Identifier: MIT\n\nlicense: gpl-2.0 with llvm-exception")["expressions"]] == [1, 5]


# transaction logs


def plain_log(rows, toxic):
    """Replays (doc_id, text, source) one by one."""
    out, open_tx, store, commits = [], {}, {}, 0
    log = []
    for i, t, s in rows:
        if i is None:
            continue
        h = zlib.crc32(str(i).encode())
        key = h // 100 % 30000
        crc = None if t is None or i in toxic else zlib.crc32(f"{key}:{t}".encode())
        log.append((i, (s is not None, s or ""), crc is not None, crc or 0, h, key))

    def epoch():
        have = [c for c in store.values()]
        out.append(("state", -(-commits // 64), len(have), sum(have)))

    for i, s, there, crc, h, key in sorted(log):
        kind = h % 17
        tx = open_tx.setdefault(s, [[]])
        if kind in (3, 4):
            tx.append([])
        elif kind in (5, 6):
            out += [("rollback", d, i, k) for d, k, _, _ in tx[-1]]
            tx[-1] = []
        elif kind == 2:
            out += [("abort", d, i, k) for level in tx for d, k, _, _ in level]
            open_tx[s] = [[]]
        elif kind < 2:
            for level in tx:
                for _, k, have, c in level:
                    store.pop(k, None)
                    if have:
                        store[k] = c
            open_tx[s] = [[]]
            commits += 1
            if commits % 64 == 0:
                epoch()
        else:
            tx[-1].append((i, key, there, crc))
    out += [("abort", d, None, k) for tx in open_tx.values() for level in tx for d, k, _, _ in level]
    if commits % 64:
        epoch()
    return sorted(out, key=str)


def replayed(spark, rows, toxic=()):
    labels = spark.createDataFrame([(i, 0, 1, "x") for i in toxic] + [(i, 1, 0, "x") for i in toxic] + [(None, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = translog.reassemble(translog.document_log(docs_of(spark, rows), labels))
    return sorted(map(tuple, got.collect()), key=str)


def test_log_matches_plain_replay(spark):
    r = np.random.default_rng(5)
    ids = [int(i) for i in r.choice(60_000, 6000, replace=False)]
    source = lambda: [None, "", "hot", "hot", "hot", "b", "c"][int(r.integers(0, 7))]
    rows = [(i, None if r.random() < 0.1 else "" if r.random() < 0.1 else f"text {i % 50}", source()) for i in ids]
    rows += [(None, "no id", "hot"), (-5, "negative", "b"), (1 << 60, "late", "c"), *rows[:40], (rows[0][0], "another", rows[0][2]), (3, "x" * 2_000_000, "hot")]
    toxic = {int(i) for i in r.choice(ids, 300)}
    assert replayed(spark, rows, toxic) == plain_log(rows, toxic)


def test_log_of_few_rows(spark):
    assert replayed(spark, []) == []
    kinds = collections.defaultdict(list)
    for i in range(400):
        kinds[min((zlib.crc32(str(i).encode()) % 17 + 1) // 2, 4)].append(i)  # 0-1 commits, 2 or 3 end and begin
    rows = [(i, "t", "one") for i in range(40)]
    assert replayed(spark, rows) == plain_log(rows, set())
    ends = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 17 < 2]
    rows = [(i, None, None) for i in ends[:200]]
    assert replayed(spark, rows) == plain_log(rows, set())  # commits without changes
    changes = [(i, "t", "s") for i in range(3000) if zlib.crc32(str(i).encode()) % 17 > 6][:50]
    assert replayed(spark, changes) == plain_log(changes, set())  # no end but the log's
    assert replayed(spark, rows + rows[:70]) == plain_log(rows + rows[:70], set())  # repeated commits count


def test_store_is_the_last_state(spark):
    rows = [(i, f"t{i}", ["a", "b"][i % 2]) for i in range(3000)]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    log = translog.numbered(translog.document_log(docs_of(spark, rows), labels))
    stored = translog.store(translog.fates(log)).collect()
    last = [r for r in plain_log(rows, set()) if r[0] == "state"]
    end = max(last, key=lambda r: r[1])
    assert len(stored) == end[2] and sum(zlib.crc32(f"{r.key}:t{r.pos}".encode()) for r in stored) == end[3]


# spelling variants


def plain_words(rows, least_length=7, least_count=2):
    n = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def plain_variants(n, ratio=10):
    holes = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)  # another letter here
    near = {w: set() for w in n}
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    for w in n:
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys():
            near[w].add(v)
            near[v].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_spelling_matches_plain_search(spark, documents):
    rows = [(r.doc_id, r.text, "s") for r in documents.collect()]
    rows += [(None, "Wonderful Wonderful straße ÀÉÿ×÷abcdefg ", "s"), (7, None, "s"), (8, "", "s"), (9, "abcdefg " * 500 + "abcdefh abcdefh abcdef abcdefgg abcdefgg", "s"), rows[0], rows[0]]
    rows += [(11, ("y" * 4_000 + " ") * 2 + ("y" * 3_999 + " ") * 25, "s")]
    got = found(spelling.variants(docs_of(spark, rows)))
    assert got == plain_variants(plain_words(rows)) and len(got) > 500 and any(r[1] for r in got)
    assert found(spelling.variants(docs_of(spark, []))) == []


def test_spelling_of_made_up_words(spark):
    r = np.random.default_rng(9)
    n = {}
    for _ in range(60):  # few letters, so that anagrams, runs of a letter and chains are many
        w = "".join(r.choice(list("abcé"), int(r.integers(7, 11))))
        n[w] = int(10 ** r.uniform(0.3, 4))
        for _ in range(12):
            k, c = int(r.integers(0, len(w) + 1)), str(r.choice(list("abcéz")))
            v = [w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[k:] + w[:k]][int(r.integers(0, 4))]
            if len(v) >= 7:
                n[v] = int(10 ** r.uniform(0.3, 3))
                w = v if r.random() < 0.3 else w
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = found(spelling.grouped(words))
    assert got == plain_variants(n)
    assert max(r[4] for r in got) > 5
    chain = {"abcdefghijklm"[: 7 + i]: 2 * 10**i for i in range(6)}
    assert found(spelling.grouped(spark.createDataFrame(list(chain.items()), "word string, n long"))) == plain_variants(chain)
    assert {r[2] for r in plain_variants(chain)} == {"abcdefghijkl"}


def test_pairs_are_found_once(spark):
    words = spark.createDataFrame([("aaaaaaa", 5), ("aaaaaaaa", 6), ("abababab", 3), ("babababa", 3), ("bababab", 4)], "word string, n long")
    pairs = sorted((r.word, r.near) for r in spelling.near_pairs(words).collect())
    assert pairs == [("aaaaaaa", "aaaaaaaa"), ("abababab", "bababab"), ("bababab", "babababa")]


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_transaction_log", "op13_spelling_variants"])
def test_columns_of_the_queries(spark, name):
    got = dict(queries.queries()[name](spark, DATA).dtypes)
    want = {
        "op11_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
        "op12_transaction_log": {"kind": "string", "id": "bigint", "n": "bigint", "value": "bigint"},
        "op13_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    }[name]
    assert want.items() <= got.items()


def test_nulls_in_every_column(spark):
    rows = docs_of(spark, [(None, None, None), (4, None, None)]).withColumns({c: F.lit(None).cast("string") for c in ("word", "labels")})
    assert licenses.scan(rows).count() == 2 and spelling.variants(rows).count() == 0
    assert translog.reassemble(translog.document_log(rows, spark.createDataFrame([(None, None)], "doc_id long, toxic int"))).count() <= 1
