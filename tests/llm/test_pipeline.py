"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

import pytest

import corpus_pipeline
from holdfast.llm import langid, mixing, pii
from holdfast.llm.common import Scratch

from .test_operators import brute_jaccard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.save(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(spark, stages):
    assert [n for n, *_ in stages] == ["language_id", "ngram_jaccard", "pii", "mixing", "sentencepiece"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_language_stage(stages):
    _, before, after = stages[0]
    model = langid.train(before)
    want = {r["doc_id"] for r in before.collect() if (lambda found: found[0] != "und" and found[1] >= 0.5)(langid.classify(r["text"], *model))}
    assert {r["doc_id"] for r in after.collect()} == want


def test_jaccard_stage(stages):
    _, before, after = stages[1]
    rows = {r["doc_id"]: r for r in before.collect()}
    found = brute_jaccard([(i, r["text"]) for i, r in rows.items()], 5, 4, 5)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: r["text"] for i, r in rows.items() if found[i][1] == i}


def test_pii_stage(stages):
    _, before, after = stages[2]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert pii.base_spans(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]] or "<" in r["text"]


def test_mixing_stage(spark, stages):
    _, before, after = stages[3]
    want = Counter({r["doc_id"]: r["reps"] for r in mixing.mix(before, Scratch(spark, "test")).collect()})
    assert Counter(r["doc_id"] for r in after.collect()) == +want


def test_encoding_stage_and_run(spark, stages):
    _, before, after = stages[4]
    assert after.count() == before.count() and after.filter("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(str, whole.collect())) == Counter(map(str, after.collect()))


def test_run_on_an_empty_table_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    some = docs.limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "src1", 0), (7, "Ω" * 3, None, None, 3)], docs.schema)
    some.unionByName(some).unionByName(odd).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert out and all(r["round_trip"] for r in out)


def test_nothing_stays_in_scratch_but_what_is_read(spark, tmp_path):
    from holdfast.llm import neardup

    for name, run in (("neardup", lambda s: neardup.link(spark.read.parquet(f"{SF}/embeddings.parquet"), s)), ("jaccard", lambda s: __import__("holdfast.llm.jaccard").llm.jaccard.join(spark.read.parquet(f"{SF}/documents.parquet"), s))):
        scratch = Scratch(spark, name)
        df = run(scratch)
        kept = {f.rsplit("/", 2)[1] for f in df.inputFiles()} if df.inputFiles() else set()
        import os

        assert set(os.listdir(scratch.root.removeprefix("file://"))) == kept and df.count() > 0
