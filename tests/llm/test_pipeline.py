"""Each stage of the pipeline against the operators' verdicts or a brute-force version, on the smallest tables and on hard rows."""

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from meterline.llm import decontam, langid, toxicity
from meterline.shared import staged_paths
from pyspark.sql import functions as F

from .test_operators import HARD, copies_by_hand, frame

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_the_operators_pass(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    verdicts = [
        lambda d: ids(langid.learn_and_identify(d).where(f"lang_pred <> 'und' and score >= {langid.MIN_SCORE}")),
        lambda d: ids(toxicity.toxicity(d, labels).where("predicted = 0")),
        lambda d: sorted(copies_by_hand([(r.doc_id, r.text) for r in d.collect()])),
        lambda d: ids(decontam.contamination(d, bench).where("not contaminated")),
    ]
    for (name, stage), passed in zip(corpus_pipeline.STAGES, verdicts):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        want = passed(docs)
        if name == "near-duplicates":  # few pairs at the least similarity aren't candidates
            assert set(want) <= set(ids(out)) and len(ids(out)) <= len(want) + 2
        else:
            assert ids(out) == want
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    n = {r.doc_id: len(r.text) for r in docs.collect()}
    got: dict = {}
    for r in packed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert got == n


def test_run(spark):
    before = list(staged_paths)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing" and len(corpus_pipeline.STAGES) == 5
    found = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in found.select("doc_id").collect()}
    assert staged_paths[:-1] == before  # only the result stays
    assert ids and ids < set(pq.read_table(f"{SF}/documents.parquet")["doc_id"].to_pylist())


@pytest.mark.parametrize("hard", [HARD, [], [(None, None), (None, None)]])
def test_every_stage_on_hard_rows(spark, hard):
    """Nulls, empty and very long texts, repeated rows, empty tables, columns that clash with the stages' own names."""
    docs = frame(spark, hard)
    for c in ("key", "fp", "root", "n", "start", "host", "__text_key"):
        docs = docs.withColumn(c, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(hard), name
    kept = {name: stage(spark, docs, SF).count() for name, stage in corpus_pipeline.STAGES[:-1]}
    if hard == HARD:
        # Without a lang no profile is learnt: texts with a letter stay. No word of theirs is toxic, and none is in the benchmark.
        assert kept == {"language": 4, "toxicity": 8, "near-duplicates": 5, "decontamination": 8}
        assert {r.n for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id = 5").collect()} == {1}
