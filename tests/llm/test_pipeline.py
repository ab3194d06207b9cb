"""The pipeline's stages, each against what it must do to its own input."""

from __future__ import annotations

import corpus_pipeline
from quarrymill.llm import quality

from .test_join_operators import links_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= set(before)
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "quality rules":
            for i, t in before.items():
                n = quality.counts_of(t)
                assert (i not in ids) or not (n[0] < 10 or 100 * n[4] > 20 * n[0])
        if name == "n-gram Jaccard join":
            assert ids == {c for _, c in links_of(list(before.items()), 5, 80).values()}
        if name == "secret scans":
            assert ids == set(before)
        if name == "best-fit packing":
            assert ids == set(before)
    assert len(ids) > 0.5 * len(texts)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty, long, repeated and clashing rows through every stage, and an empty table."""
    long = " ".join(f"word{k % 977} other{k % 631}" for k in range(30_000))
    clean = "The {} report gives the figures of the year and what the board makes of them in some detail for {} readers"
    rows = [(k, clean.format(f"w{k}", f"v{k}"), "en", "s", 9) for k in range(40)]
    rows += [(40, None, "en", "s", 1), (41, "", "en", "s", 1), (42, long, None, None, 1), (None, clean.format("n", "n"), "en", "s", 1), (None, clean.format("n", "n"), "en", "s", 1), (43, clean.format("w1", "v1"), "en", "s", 1), (43, clean.format("w1", "v1"), "en", "s", 1), (44, clean.format("w2", "v2") + " password=hunter2hunter2", "en", "s", 1)]
    extra = [(*r, 1, "x", 0.5, "k") for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, keys string, score double, grp string"
    docs = spark.createDataFrame(extra, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "best-fit packing":
            assert docs.columns == before
        if name == "quality rules":
            assert 40 not in ids and 41 not in ids and ids.count(None) == 2 and ids.count(43) == 2 and set(range(40)) <= set(ids)
        if name == "toxicity":
            assert set(range(40)) <= set(ids) and ids.count(None) == 2
        if name == "n-gram Jaccard join":
            assert 43 not in ids and ids.count(None) == 2 and 1 in ids
        if name == "secret scans" and 44 in ids:
            t = docs.where("doc_id = 44").first()
            assert "hunter2" not in t.text and "[assign]" in t.text and t.n_chars == len(t.text)
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_toxic_stage_and_packing_by_their_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    words = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()
    full = {r.doc_id for r in docs.collect() if sum(w in (r.text or "").lower() for w in words) >= 3}
    assert len(full) > 5 and not kept & {i for i in full if labels.get(i, 1)}
    clean = {i for i, t in labels.items() if not t}
    assert len(clean & kept) >= 0.99 * len(clean)
    packed = stages["best-fit packing"](spark, docs, SF).collect()
    where = {}
    for r in packed:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
