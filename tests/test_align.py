import random

import pytest

from tagweave.operators import align
from tagweave.operators.runs import MASK, WORD_END


def tilings(seed):
    """Words and pieces of the same texts, with empty ones among them."""
    rng = random.Random(seed)
    words, pieces = {}, {}
    for s in range(25):
        text = "".join(rng.choices("abcd", k=rng.randrange(1, 60)))
        for store, longest in ((words, 7), (pieces, 20)):
            cuts, at = [], 0
            while at < len(text):
                size = min(rng.randrange(0, longest), len(text) - at)
                cuts.append((at, at + size, text[at:at + size]))
                at += size
            store[s] = cuts
    return words, pieces


def frames(spark, words, pieces):
    rng = random.Random(7)
    tags = {(s, i): rng.choice(["n", "v", "Adj"]) for s, ws in words.items() for i in range(len(ws))}
    w = spark.createDataFrame([(s, 0, i, x[2], tags[s, i]) for s, ws in words.items() for i, x in enumerate(ws)],
                              "doc_id int, section_pos long, pos long, word string, tag string")
    p = spark.createDataFrame([(s, 0, i, x[2]) for s, ps in pieces.items() for i, x in enumerate(ps)],
                              "doc_id int, section_pos long, idx long, value string")
    return align.word_spans(w.repartition(4), block=5), align.token_spans(p.repartition(4), block=5), tags


def test_spans_tile_the_section(spark):
    words, pieces = tilings(1)
    w, p, _ = frames(spark, words, pieces)
    assert {(r.doc_id, r.pos): (r.start, r.end) for r in w.collect()} == {
        (s, i): x[:2] for s, ws in words.items() for i, x in enumerate(ws)}
    assert {(r.doc_id, r.idx): (r.start, r.end) for r in p.collect()} == {
        (s, i): x[:2] for s, ps in pieces.items() for i, x in enumerate(ps)}


@pytest.mark.parametrize("width", [3, 8, 64])
def test_labels_by_overlap(spark, width):
    words, pieces = tilings(2)
    w, p, tags = frames(spark, words, pieces)
    got = {(r.doc_id, r.idx): r.label for r in align.label_tokens_by_overlap(p, w, width=width).collect()}
    for s, ps in pieces.items():
        for i, (a, b, _) in enumerate(ps):
            labels = {tags[s, k].upper() for k, (c, d, _) in enumerate(words[s]) if c < b and d > a}
            labels |= {WORD_END for c, d, _ in words[s] if a < d <= b}
            assert got.pop((s, i)) == ("+".join(sorted(labels)) or MASK)
    assert not got


def test_overlap_takes_one_shuffle_of_its_own(spark):
    words, pieces = tilings(4)
    w, p, _ = frames(spark, words, pieces)
    exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (
        w, p, align.label_tokens_by_overlap(p, w, longest=20))]
    assert exchanges[2] == exchanges[0] + exchanges[1] + 1


def test_spans_that_overlap_each_other_or_cross_many_blocks(spark):
    rng = random.Random(9)
    spans = {kind: [(s, i, a, a + rng.randrange(0, 40)) for s in range(4) for i in range(60) for a in [rng.randrange(200)]]
             for kind in "wp"}
    w = spark.createDataFrame([(s, 0, i, a, b, "t%d" % (i % 9)) for s, i, a, b in spans["w"]],
                              "doc_id int, section_pos long, pos long, start long, end long, tag string")
    p = spark.createDataFrame([(s, 0, i, a, b) for s, i, a, b in spans["p"]],
                              "doc_id int, section_pos long, idx long, start long, end long")
    for width in (8, 64, 1 << 14):
        got = {(r.doc_id, r.idx): r.label for r in align.label_tokens_by_overlap(p, w, width=width).collect()}
        for s, i, a, b in spans["p"]:
            labels = {f"T{k % 9}" for t, k, c, d in spans["w"] if t == s and c < b and d > a}
            labels |= {WORD_END for t, _, c, d in spans["w"] if t == s and a < d <= b}
            assert got[s, i] == ("+".join(sorted(labels)) or MASK)


def test_pieces_to_words(spark):
    w = spark.createDataFrame([("good", 0, 0, "ab"), ("good", 0, 1, "cde"), ("bad", 0, 0, "abc"), ("bad", 0, 1, "d"),
                               ("empty", 0, 0, ""), ("empty", 0, 1, "ab")],
                              "doc_id string, section_pos long, pos long, word string")
    p = spark.createDataFrame([("good", 0, 0, "a"), ("good", 0, 1, "b"), ("good", 0, 2, "cde"), ("good", 0, 3, "rest"),
                               ("bad", 0, 0, "ab"), ("bad", 0, 1, "cd"), ("empty", 0, 0, "ab")],
                              "doc_id string, section_pos long, idx long, value string")
    done = align.align_pieces(align.token_spans(p), align.word_spans(w)).collect()
    assert {r.doc_id: r.status for r in done} == {"good": "ok", "bad": "bad", "empty": "bad"}
    assert [r.word_idx for r in sorted(done, key=lambda r: r.idx) if r.doc_id == "good"] == [0, 0, 1, 2]


def test_alignment_joins_nothing_and_reads_its_sides_once(spark):
    """With and without blocks, also where pieces are empty, words share an end, and a section has words or pieces only."""
    rng = random.Random(11)
    w, p, wanted = [], [], {}
    for s in range(60):
        text = "".join(rng.choices("abc", k=rng.randrange(0, 12)))
        cuts = [sorted(rng.choices(range(len(text) + 1), k=rng.randrange(0, 5))) for _ in range(2)]
        spans = [list(zip([0, *c], [*c, len(text)])) for c in cuts]
        w += [(1, s, a, b) for a, b in spans[0]] if s % 7 else []
        p += [(1, s, i, text[a:b], a, b) for i, (a, b) in enumerate(spans[1])] if s % 5 else []
        ends = {b for _, b in spans[0]}
        good = all(a < b for a, b in spans[0]) and ends <= {b for _, b in spans[1]}
        wanted[s] = ("ok" if good else "bad", [sum(b in ends for _, b in spans[1][:i]) for i in range(len(spans[1]))])
    words = spark.createDataFrame(w, "doc_id long, section_pos long, start long, end long")
    pieces = spark.createDataFrame(p, "doc_id long, section_pos long, idx long, value string, start long, end long")
    for block in (None, 3, 1 << 16):
        done = align.align_pieces(pieces, words, block=block)
        assert done.columns == [*pieces.columns, "word_idx", "status"]
        got = {}
        for r in sorted(done.collect(), key=lambda r: r.idx):
            got.setdefault(r.section_pos, (r.status, []))[1].append(r.word_idx)
        assert got == {s: v for s, v in wanted.items() if s % 7 and s % 5}
        status = {r.section_pos: r.status for r in align.alignment_status(words, pieces, block=block).collect()}
        assert status == {s: v[0] if s % 5 else "bad" for s, v in wanted.items() if s % 7}
    plan = align.align_pieces(pieces, words, block=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 2


def test_a_long_text_is_cut_in_one_run(spark):
    text = "ab\n😀e" * 60_000 + "z"
    df = spark.createDataFrame([(1, 0, text), (1, 1, "")], "doc_id long, section_pos long, text string")
    rows = sorted(align.fixed_pieces(df).collect(), key=lambda r: r.idx)
    assert [r.value for r in rows] == [text[i:i + 4] for i in range(0, len(text), 4)]
    assert [(r.idx, r.start, r.end) for r in rows[-2:]] == [(74999, 299996, 300000), (75000, 300000, 300001)]
