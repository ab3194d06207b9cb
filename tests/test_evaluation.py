"""Evaluation queries on rows that the generated tables don't have."""

from __future__ import annotations

from quarrymill.plans import evaluation


def test_corrections_that_copy_a_holdout_text_are_left_out(spark, tmp_path):
    """100 is a holdout id; 101 holds a passage's text but for case and spaces; 102 only contains it; 103's text is null."""
    save = lambda df, name: df.write.parquet(str(tmp_path / f"{name}.parquet"))
    save(spark.createDataFrame([(100, "Some held out  passage")], "item_id long, text string"), "benchmark")
    save(spark.createDataFrame([(100, "own text"), (101, " some HELD\tout passage\n"), (102, "some held out passage and more"), (103, None)], "doc_id long, text string"), "documents")
    save(spark.sql("""select id as event_id, 1L as user_id, 'view' as event_type, timestamp_ntz'2024-01-01 00:00:00' as ts, '{"k": 1}' as props from range(100, 104)"""), "events")
    got = evaluation.spl10_merge_with_cap(spark, str(tmp_path)).collect()
    assert sorted(r.classification_id for r in got) == [102, 103]
