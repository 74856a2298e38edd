from collections import Counter

import corpus_pipeline
from modeloom.llm import _io
from modeloom.llm.registry import oracle_sql, queries
from tests.llm import brute


def test_stages_bear_odd_rows(odd, pairs, empty, spark, tmp_path):
    (tmp_path / "x").mkdir()
    bench = spark.createDataFrame([(1, "no document has these words at all, not one of them so far")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == 0 if docs is empty else n > 0, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema.simpleString() == docs.schema.simpleString(), name


def test_quality_stage(odd, pairs, spark):
    got = sorted(str(r.doc_id) for r in corpus_pipeline.quality(spark, odd, "").collect())
    from modeloom.llm import quality_rules

    assert got == sorted(str(r.doc_id) for r in quality_rules.quality(odd).where("kept").collect())


def test_dedup_stage(odd, pairs, spark):
    # a component without any doc_id keeps one row too: it is one document of its group
    got = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, "").collect())
    prints = [(d, brute.fingerprint(t)) for d, t in pairs]
    groups = brute.components([(i, p) for i, (_, p) in enumerate(prints)])
    named = {}
    for (d, _), g in zip(prints, groups, strict=True):
        named.setdefault(g, []).append(d)
    assert got == Counter(min((d for d in ds if d is not None), default=None) for ds in named.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and ids
    docs = {r.doc_id: r.text for r in _io.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    items = [tuple(r) for r in _io.table(spark, "/root/testdata/sf0.001", "benchmark").select("item_id", "text").collect()]
    for d in ids:
        assert not brute.quality(docs[d])[-1]
        assert not brute.contamination(docs[d], items)[-1]


def test_registry_names():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(names)
