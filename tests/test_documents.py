"""Document queries on rows that the generated tables don't have."""

from __future__ import annotations

import pytest

from quarrymill.plans import documents


def test_quality_scores_every_document(spark, tmp_path):
    texts = ["가나다라 " * 20, "a" * 95 + "가나다라마", "a" * 100, "짧다", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.quality for r in documents.txt03_quality(spark, str(tmp_path)).collect()}
    want = {0: 0.5 * 99 / 100 + 0.5, 1: 0.5 + 0.5 * 10 * 0.05, 2: 0.5, 3: 0.2, 4: 0.0, 5: 0.0}
    assert got == pytest.approx(want)
