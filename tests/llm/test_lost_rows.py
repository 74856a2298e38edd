"""Rows that a stage must judge by their own text, whatever their doc_id."""

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import prose


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_dedup_keeps_one_row_of_each_component(spark):
    r = random.Random(11)
    a, b, c, d, e, f = (prose(r, 80) for _ in range(6))
    # a: without ids only; b: without an id, alone; c, d: two texts under one id; e: a copy under the id of another text; f: an id beside none
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (2, e), (9, e), (9, f), (None, f)]
    out = got(corpus_pipeline.near_dedup(spark, frame(spark, rows), ""))
    assert out == sorted([(None, a), (None, b), (7, c), (7, d), (2, e), (9, f)], key=str)


def test_dedup_of_odd_rows_keeps_every_component(odd, pairs, spark):
    out = got(corpus_pipeline.near_dedup(spark, odd, "").select("doc_id", "text"))
    prints = [brute.fingerprint(t) for _, t in pairs]
    groups = brute.components([(i, p) for i, p in enumerate(prints)])
    kept = [groups[pairs.index(row)] for row in out]
    assert sorted(kept) == sorted(set(groups))
    for (doc_id, _), g in zip(out, kept, strict=True):
        named = [d for (d, _), h in zip(pairs, groups, strict=True) if h == g and d is not None]
        assert doc_id == min(named, default=None)


def test_decontamination_judges_rows_by_their_text(spark, tmp_path):
    r = random.Random(12)
    item, clean, other = prose(r, 12), prose(r, 60), prose(r, 60)
    bad = f"{prose(r, 30)} {item} {prose(r, 30)}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, bad), (None, clean), (None, None), (5, bad), (5, other), (6, other)]
    out = got(corpus_pipeline.decontaminate(spark, frame(spark, rows), str(tmp_path)))
    assert out == sorted([(None, clean), (None, None), (5, other), (6, other)], key=str)


def test_columns_with_the_stages_own_names(spark, tmp_path):
    r = random.Random(13)
    item, clean = prose(r, 12), prose(r, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, clean, 7, 7, 7, 7, 7, 7), (2, clean, 8, 8, 8, 8, 8, 8), (3, f"{clean} {item}", 9, 9, 9, 9, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decon_k1 int, Decon_K2 int, kept_id int, kept_hash int, text_hash int, n_chars int")
    out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2}
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {1} and out.where("doc_id = 2").count() == 0
    assert corpus_pipeline.quality(spark, docs, "").count() == 3


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    from modeloom.llm import _io

    class Conf(dict):
        def getConf(self):
            return self

    class Session:
        conf = Conf()
        sparkContext = Conf()

    Session.sparkContext.master = "yarn"
    with pytest.raises(RuntimeError):
        _io.shared_dir(Session)


def test_staged_tables_are_deleted(spark):
    import os

    from modeloom.llm import _io

    with _io.Staging() as scope:
        a = _io.stage_table(spark.range(5), "scoped")
        b = _io.stage_table(a, "scoped")
        _io.discard(a)
        assert scope.paths == [b._staged] and not os.path.exists(a._staged)
    scope.release(spark)
    assert not os.path.exists(b._staged)
