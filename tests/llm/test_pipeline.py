"""The pipeline's stages, each against what its operator decides."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from srcloom.llm import quality, toxicity
from srcloom.llm.common import table
from test_bpe import LIBRARY
from test_decontaminate import plain
from test_simhash import plain_components, plain_fingerprint

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = table(spark, SF_DIR, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_DIR).cache()
        kept.append((docs, after))
        docs = after
    return kept


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near duplicates", "decontamination", "tokens"]
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_classifiers_reject_what_they_score_so(spark, stages):
    labels = table(spark, SF_DIR, "labels")
    before, after = stages[0]
    scored = toxicity.with_scores(before, toxicity.train(before, labels), ["doc_id"])
    assert ids(after) == ids(scored.where("score < score_cut"))
    before, after = stages[1]
    scored = quality.with_scores(before, quality.train(before, labels), ["doc_id"])
    assert ids(after) == ids(scored.where(F.col("score") >= quality.CUT))
    assert 0.5 < after.count() / before.count() < 1


def test_one_of_each_group(stages):
    before, after = stages[2]
    groups = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()])
    assert ids(after) == sorted({*groups.values()})


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3]
    rows = before.collect()
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    judged = plain([r.text for r in rows], items)
    assert ids(after) == sorted(r.doc_id for r, (n, hit, _) in zip(rows, judged) if not (hit > 0 and 20 * hit >= n))


def test_tokens(stages):
    before, after = stages[4]
    counts = {r.doc_id: len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids) for r in before.collect()}
    assert {r.doc_id: r.n_tokens for r in after.collect()} == counts


def test_run_is_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(stages[-1][1].collect())
