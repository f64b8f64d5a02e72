"""The physical plans keep the properties the design relies on."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()      # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["score_nb", "tfidf", "encode_sequence"])
def test_per_document_steps_do_not_shuffle(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "Exchange hashpartitioning" not in plan and "ShuffleQueryStage" not in plan, plan


def test_top_n_limits_before_the_class_shuffle(spark):
    plan = _plan(E.queries()["top_tokens"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # partial counts before the (class, token) exchange
    assert "partial_count" in plan


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["top_tokens"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan


def test_model_tables_are_broadcast_not_shuffled(spark):
    plan = _plan(E.queries()["score_nb"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


def test_new_table_text_is_shuffled_once_for_all_models(spark):
    """Scoring a new table: the three model branches read one stored,
    doc_id-partitioned copy of the text; none re-scans, re-normalises or
    re-shuffles it."""
    plan = _plan(E.queries()["score_conversations"](spark, SF_SMALL))
    assert "REPARTITION_BY_NUM" not in plan and "ArrowEvalPython" not in plan, plan
