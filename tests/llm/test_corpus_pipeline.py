"""The pipeline's stages against plain Python over their own inputs."""

from collections import Counter

import pytest

import odd_rows
from conftest_paths import SF
from test_jaccard import by_hand


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    docs, out = corpus_pipeline.read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        out.append((before, docs))
    return out


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_filters_keep_what_their_operators_keep(spark, stages):
    from martlet.llm import kneser_ney, toxicity
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = stages[0]
    judged = kneser_ney.judge(before, labels.where("quality = 1").select("doc_id"))
    assert ids(after) == ids(judged.where("kept"))
    before, after = stages[1]
    assert ids(after) == ids(toxicity.judge(before, labels).where("predicted = 0"))
    assert all(n == 1 for n in ids(after).values())


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    classes = by_hand([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == Counter({c for c, _ in classes.values()})


def test_mix_and_encoding(stages):
    before, after = stages[3]
    known = ids(before)
    assert all(d in known and n <= 2 for d, n in ids(after).items())
    assert ids(stages[4][1]) == ids(after)
    assert stages[4][1].where("n_tokens > 0").count() == after.where("length(text) > 0").count()


def test_odd_rows_pass_every_stage(spark):
    import corpus_pipeline
    for docs in (odd_rows.documents(spark), odd_rows.nothing(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF), "odd")
        docs.count()


def test_registered(spark):
    import __spark_entry__
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
