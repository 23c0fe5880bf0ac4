"""The pipeline's stages: columns, decisions, and that each works on what its predecessor kept."""

import numpy as np

import corpus_pipeline
from shroudlake.llm import pii
from shroudlake.llm.common import durable

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, DATA), name)
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and now, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first, name
        if name == "personal_data":
            assert now == ids and not any(pii.base_spans(r.text) for r in docs.collect())
        ids = now
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "mixture"]


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark):
    r = np.random.default_rng(21)
    prose = lambda n: " ".join("".join(r.choice(list("abcdefghij"), int(r.integers(2, 9)))) for _ in range(n))
    one, leak, long = prose(120), spark.read.parquet(f"{DATA}/benchmark.parquet").first().text, prose(60_000)
    texts = [(1, one), (2, one), (2, one), (3, None), (4, ""), (None, one), (None, None), (5, f"{prose(80)} {leak} {prose(80)}"), (6, long), (7, one + " a.b@example.com")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOC)
    none = spark.createDataFrame([], DOC)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DATA)
        assert out.columns[:5] == df.columns and stage(spark, none, DATA).count() == 0, name
        got[name] = sorted((x.doc_id or 0, len(x.text or "")) for x in out.collect())
    every = sorted((i or 0, len(t or "")) for i, t in texts)
    # no text: fails the base rules; one of a group stays, and rows without an id; leaks go; nothing is lost by masking; rows without an id are never sampled
    assert not {3, 4} & {i for i, _ in got["quality_rules"]}
    assert got["near_duplicates"] == [x for x in every if x[0] in (0, 1, 3, 5, 6)]
    assert got["decontamination"] == [x for x in every if x[0] != 5]
    assert [i for i, _ in got["personal_data"]] == [i for i, _ in every] and (7, len(one) + 8) in got["personal_data"]
    assert {i for i, _ in got["mixture"]} <= set(range(1, 8)) and len(got["mixture"]) >= 1
