"""Run grouping against plain loops, with blocks of a few rows so that runs cross them."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tagweave.operators import runs
from tagweave.operators.scan import deal_by_cost, ranged, running

P = "PUNCT"
M = "[MASK]"
END = "[WORD_END]"


def random_docs(seed, n=30):
    rng = random.Random(seed)
    docs = {
        "starts closed": [(".", P), ("a་", "N"), (".", P)],
        "twice closed": [("a", "N"), (".", P), (".", P), ("b་", "V"), (".", P)],
        "never closed": [("a", "N"), ("b", "V")],
        "empty words": [("", "N"), (".", P), ("", "N"), ("a་", "V"), (".", P), ("", "V")],
        "long": [(f"w{i}", "N") for i in range(40)] + [("x་", "V"), (".", P)],
    }
    for d in range(n):
        words = []
        for _ in range(rng.randrange(0, 25)):
            kind = rng.random()
            words.append((".", P) if kind < 0.2 else ("".join(rng.choices("abc", k=rng.randrange(0, 3)))
                                                      + ("་" if kind > 0.6 else ""), rng.choice("NVA")))
        docs[f"d{d}"] = words
    return docs


def frame(spark, docs, parts=4):
    rows = [(d, i, w, t) for d, words in docs.items() for i, (w, t) in enumerate(words)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id string, pos long, word string, tag string").repartition(parts)


def units_by_hand(words):
    """Cut before and after punctuation and after closing words; an open last piece goes."""
    pieces, current = [], []
    for i, (word, tag) in enumerate(words):
        current.append((i, word, tag))
        following = words[i + 1][1] if i + 1 < len(words) else None
        if tag == P or word.endswith("་") or following == P:
            pieces.append(current)
            current = []
    joined = [(p[0][0], "".join(w for _, w, _ in p), "+".join(t for *_, t in p)) for p in pieces]
    return [u for u in joined if u[1] or u[2] == P]


def closed_runs(items, closes):
    out, current = [], []
    for item in items:
        current.append(item)
        if closes(item):
            out.append(current)
            current = []
    return out


@pytest.mark.parametrize("block,parts", [(3, 1), (3, 8), (1 << 16, 4)])
def test_units_and_sections(spark, block, parts):
    docs = random_docs(3)
    units = runs.build_units(frame(spark, docs, parts), block=block).cache()
    got = {}
    for r in units.orderBy("doc_id", "unit_pos").collect():
        got.setdefault(r.doc_id, []).append((r.unit_pos, r.word, r.tag))
    want = {d: units_by_hand(w) for d, w in docs.items() if units_by_hand(w)}
    assert got == want

    by_hand = {(d, n): ([u[1] for u in s], [u[2] for u in s])
               for d, us in want.items() for n, s in enumerate(closed_runs(us, lambda u: u[2] == P))}
    for sections in (runs.build_sections(units, block=block), runs.build_sections(units, section="section_pos")):
        assert {(r.doc_id, r.section_pos): (r.words, r.tags) for r in sections.collect()} == by_hand
    kept = runs.drop_punct_only(runs.build_sections(units, section="section_pos"))
    assert {(r.doc_id, r.section_pos) for r in kept.collect()} == {k for k, (_, t) in by_hand.items() if set(t) != {P}}


def test_flat_sections(spark):
    docs = random_docs(4)
    got = {(r.doc_id, r.section_pos): [tuple(i) for i in r["items"]]
           for r in runs.flatten_sections(frame(spark, docs), block=3).collect()}
    want = {(d, n): s for d, words in docs.items() for n, s in enumerate(closed_runs(words, lambda w: w[1] == P))
            if any(t != P for _, t in s)}
    assert got == want


def label_rows(seed):
    rng = random.Random(seed)
    labels = [M, "N", "V", "N+" + END, "A+N+" + END, END]
    return {f"e{i}": [rng.choice(labels) for _ in range(rng.randrange(0, 20))] for i in range(30)}


def label_frame(spark, data):
    rows = [(e, i, i * 10, lab) for e, labels in data.items() for i, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "example_id string, pos long, token int, label string").repartition(4)


def test_regroup_words(spark):
    data = label_rows(5)
    got = {(r.example_id, r.word_pos): (r.tokens, r.tag)
           for r in runs.regroup_words(label_frame(spark, data), block=4).collect()}
    want = {}
    for e, labels in data.items():
        real = [(i * 10, lab.split("+")) for i, lab in enumerate(labels) if lab != M]
        for n, word in enumerate(closed_runs(real, lambda x: END in x[1])):
            tags = sorted({t for _, parts in word for t in parts} - {END})
            want[e, n] = ([t for t, _ in word], "+".join(tags))
    assert got == want


@pytest.mark.parametrize("keep_head", [False, True])
def test_words_from_tags(spark, keep_head):
    data = {**label_rows(6), "masks": [M, M], "starts": ["N", M], "late": [M, "V"]}
    got = {(r.example_id, r.word_pos): (r.tokens, r.tag)
           for r in runs.words_from_tags(label_frame(spark, data), keep_head=keep_head, block=4).collect()}
    want = {}
    for e, labels in data.items():
        starts = [i for i, lab in enumerate(labels) if lab != M]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(labels)]), 1):
            want[e, n] = ([i * 10 for i in range(a, b)], labels[a])
        if keep_head and labels:
            want[e, 0] = ([i * 10 for i in range(starts[0] if starts else len(labels))], "")
    assert got == want


@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, inclusive):
    rng = random.Random(9)
    rows = [(g, i * 3, rng.choice([None, 1, 2, 3])) for g in "xyz" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, o long, v int").repartition(5)
    got = running(df, "g", "o", {"s": F.col("v")}, {"l": F.col("v")}, inclusive=inclusive, totals=True, block=10)
    want = []
    for g, items in groupby(rows, lambda r: r[0]):
        values = [(o, v) for _, o, v in items]
        for k, (o, v) in enumerate(values):
            seen = [x for _, x in values[:k + inclusive] if x is not None]
            want.append((g, o, v, sum(seen), sum(x or 0 for _, x in values), seen[-1] if seen else None))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_long_open_document_is_not_collected(spark):
    plan = runs.build_units(frame(spark, random_docs(2)))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Window")]
    assert "collect_list" in above and "__closed" in above.split("collect_list")[1]


def test_ranges_of_all_order_columns(spark):
    """Short lines, one very long one, and line keys that are no numbers."""
    rng = random.Random(9)
    rows = [(d, f"l{line:02}", i, rng.randrange(5)) for d in "ab" for line in range(12)
            for i in range(400 if (d, line) == ("a", 5) else rng.randrange(6))]
    df = spark.createDataFrame(rows, "d string, line string, idx int, v int").repartition(4)
    cut = ranged(df, "d", ("line", "idx"), blocks=9)
    sizes = [r["count"] for r in cut.groupBy("__blk").count().collect()]
    assert len(sizes) > 5 and max(sizes) < len(rows) / 3
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    found = running(cut, "d", ("line", "idx"), sums={"s": F.col("v")}, lasts={"o": odd}, totals=True)
    again = running(found, "d", ("line", "idx"), sums={"n": F.lit(1)}, inclusive=True)
    got = {(r.d, r.line, r.idx): (r.s, r.s_total, r.o, r.n) for r in again.collect()}
    for d in "ab":
        total, last, n = 0, None, 0
        every = sum(r[3] for r in rows if r[0] == d)
        for _, line, idx, v in sorted(r for r in rows if r[0] == d):
            n += 1
            assert got[d, line, idx] == (total, every, last, n)
            total, last = total + v, v if v % 2 else last
    assert ranged(df.filter("false"), "d", ("line", "idx")).count() == 0


def test_one_line_of_ten_million_items_is_many_tasks(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit("doc").alias("d"), F.lit(0).alias("line"), F.col("id").alias("idx"))
    cut = ranged(df, "d", ("line", "idx"), blocks=64)
    largest, blocks = cut.groupBy("__blk").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert blocks > 48 and largest < 3 * n / 64
    summed = running(cut, "d", ("line", "idx"), sums={"at": F.lit(1)})
    assert summed.filter("at <> idx").isEmpty() and summed.count() == n
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(d#" in plan and "Exchange SinglePartition" not in plan


def test_rows_dealt_by_cost(spark):
    costs = [5000, 3000, *[20] * 900, *[0] * 50, None, -4]
    df = spark.createDataFrame(list(enumerate(costs)), "id int, cost int").repartition(5)
    dealt = deal_by_cost(df, F.col("cost"), "id", 8)
    assert dealt.columns == df.columns and dealt.rdd.getNumPartitions() == 8
    spent = {r.p: r.c for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("cost").alias("c")).collect()}
    mean = 26_000 / 8
    assert sorted(spent.values())[-1] <= mean + 5000 and sum(c > 1.1 * mean for c in spent.values()) <= 2
    assert len(spent) >= 6 and sorted(r.id for r in dealt.collect()) == list(range(len(costs)))
    assert deal_by_cost(df.filter("cost = 0"), F.col("cost"), "id", 4).count() == 50
    assert deal_by_cost(df.filter("false"), F.col("cost"), "id", 4).count() == 0


def test_whole_groups_in_one_window(spark):
    """Without blocks the sums, totals and last values are those with blocks, from one read of the input."""
    rng = random.Random(4)
    df = spark.createDataFrame([(d, i, rng.choice([None, 1, 2, 3])) for d in range(5) for i in range(rng.randrange(1, 40))], "d long, pos long, v long")
    for inclusive in (False, True):
        for totals in (False, True):
            options = dict(sums={"s": F.col("v"), "n": F.lit(1)}, lasts={"l": F.col("v")}, inclusive=inclusive, totals=totals)
            one, many = running(df, "d", "pos", block=None, **options), running(df, "d", "pos", block=7, **options)
            assert one.columns == many.columns and one.dtypes == many.dtypes
            assert sorted(one.collect(), key=lambda r: (r.d, r.pos)) == sorted(many.collect(), key=lambda r: (r.d, r.pos))
            assert one._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_ranges_move_and_store_nothing(spark, tmp_path):
    """A block is a column; rows that lie together by their group stay there, also with null order keys."""
    rng = random.Random(8)
    rows = [(d, rng.choice([None, 1, 2, 3]), i) for d in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "d long, line int, idx long")
    cut = ranged(df, "d", ("line", "idx"), blocks=16, stored=False)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString() and not cut.inputFiles()
    placed = sorted(((r.d, r.line or 0, r.idx), r["__blk"]) for r in cut.collect())
    assert [b for _, b in placed] == sorted(b for _, b in placed) and len({b for _, b in placed}) == 16
    got = {(r.d, r.line, r.idx): r.n for r in running(cut, "d", ("line", "idx"), sums={"n": F.lit(1)}).collect()}
    for d in range(6):
        for n, row in enumerate(sorted((r for r in rows if r[0] == d), key=lambda r: (r[1] or 0, r[2]))):
            assert got[row] == n
