import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tagweave import session
from tagweave.operators import scan
from tagweave.plans import corpus
from tagweave.plans import fixtures as fx

FOLDER = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


@pytest.mark.parametrize("name", [
    "flatten_sections", "build_sections", "build_units", "regroup_words", "words_from_tags", "word_spans", "token_spans",
    "ffill_labels", "word_accuracy", "word_piece_labels", "explode_examples", "align_pieces"])
def test_rows_cut_from_a_document_are_not_shuffled(spark, name):
    moved = exchanges(contract.queries()[name](spark, FOLDER))
    assert moved
    # only documents are dealt, as whole texts; what is cut from them meets in windows, groups and joins where it is
    if name != "align_pieces":
        assert [line for line in moved if "REPARTITION_BY_NUM" not in line] == []
    assert all("word" not in line for line in moved)


@pytest.mark.parametrize("name", ["flatten_sections", "regroup_words", "word_spans", "token_spans", "word_accuracy"])
def test_joins_that_are_not_broadcast_move_no_rows(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanges(contract.queries()[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and [line for line in moved if "REPARTITION_BY_NUM" not in line] == []


def test_keyed_keeps_all_rows(spark):
    table = fx.table(spark, FOLDER, "documents").select("doc_id", "text")
    dealt = fx.keyed(spark, FOLDER, "documents", "doc_id", "text")
    assert dealt.exceptAll(table).count() == table.exceptAll(dealt).count() == 0
    assert dealt.count() == table.count()


def test_shuffle_partitions_follow_the_bytes_of_the_table(spark, monkeypatch):
    """Distinct words of a large table are dealt to more tasks; the next query starts from the setting again."""
    before = spark.conf.get(session.PARTITIONS_CONF)
    session.prepare(spark)
    monkeypatch.setattr(fx, "PART_BYTES", 64)
    fx.keyed(spark, "/root/testdata/sf0.001", "documents", "doc_id", "text")
    raised = int(spark.conf.get(session.PARTITIONS_CONF))
    session.prepare(spark)
    assert raised > 100 > int(before) and spark.conf.get(session.PARTITIONS_CONF) == before


def test_last_flags_are_carried_without_a_sort(spark):
    """A running last of a flag over blocks equals the last of its values; block rows come from hash aggregates."""
    rng = random.Random(3)
    rows = [(d, i, rng.choice([True, False, None])) for d in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "d int, i long, v boolean")
    done = scan.running(df, "d", "i", lasts={"l": F.col("v")}, inclusive=True, block=4)
    assert "SortAggregate" not in done._jdf.queryExecution().executedPlan().toString()
    got = {(r.d, r.i): r.l for r in done.collect()}
    for d in range(3):
        last = None
        for _, i, v in rows[40 * d:40 * d + 40]:
            last = last if v is None else v
            assert got[d, i] == last


def test_overlap_of_rows_dealt_alike_moves_none(spark):
    moved = exchanges(contract.queries()["label_tokens_by_overlap"](spark, FOLDER))
    assert moved and [line for line in moved if "REPARTITION_BY_NUM" not in line] == []


def test_sections_of_units_are_made_where_the_words_are(spark, monkeypatch):
    """Units are not stored, as a stored table loses the parts by document and all its rows would be dealt again."""
    stored = []
    monkeypatch.setattr("tagweave.plans.corpus.settle", lambda df, *a: stored.append(df) or session.settle(df, *a))
    session.prepare(spark)
    sections = corpus.word_sections(fx.tagged(spark, FOLDER), fx.UNIT_MARK, block=fx.WHOLE)
    moved = exchanges(sections)
    assert not stored and moved and [line for line in moved if "REPARTITION_BY_NUM" not in line] == []
    assert sorted(sections.collect()) == sorted(corpus.word_sections(fx.tagged(spark, FOLDER), fx.UNIT_MARK).collect())
    assert len(stored) == 1
