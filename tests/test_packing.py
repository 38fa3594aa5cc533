import hashlib
import random

import pytest

from tagweave.operators import examples, packing


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def by_hand(doc, lines, budget, prob, seed):
    """Sequences as (place of the opening, lines), one line after the other."""
    pieces = [line[a:a + budget] for line in lines for a in range(0, len(line), budget)]
    out, at, i = [], 0, 0
    while i < len(pieces):
        target = budget
        if draw(doc, at, f"{seed}-short") % 1_000_000 < round(prob * 1_000_000):
            target = draw(doc, at, f"{seed}-target") % (budget - 1) + 2
        taken = [pieces[i]]
        i += 1
        while i < len(pieces) and sum(map(len, taken)) + len(pieces[i]) <= target:
            taken.append(pieces[i])
            i += 1
        out.append((at, taken))
        at += sum(map(len, taken))
    return out


def corpus(seed, docs=12, longest=9):
    rng = random.Random(seed)
    return {d: [[rng.randrange(5, 90) for _ in range(rng.randrange(0, longest))] for _ in range(rng.randrange(1, 60))]
            for d in range(docs)}


def frame(spark, docs):
    rows = [(d, i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id int, line_no long, tokens array<int>").repartition(5)


@pytest.mark.parametrize("block_tokens,budget,prob", [(1 << 16, 16, 0.3), (32, 16, 0.3), (20, 7, 0.5), (17, 16, 0.0), (11, 2, 1.0)])
def test_packing_equals_one_line_after_the_other(spark, block_tokens, budget, prob):
    docs = corpus(budget) | {90: [[1]], 91: [[], []], 92: [[7] * 100], 93: [[1]] * 70}
    got = {}
    for r in packing.pack_lines(frame(spark, docs), budget, prob, 5, block=8, block_tokens=block_tokens).collect():
        got.setdefault((r.doc_id, r.seq_at), []).append((r["at"], list(r.tokens)))
    want = {(d, at): taken for d, lines in docs.items() for at, taken in by_hand(d, lines, budget, prob, 5)}
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == want


def test_one_long_document_is_many_blocks(spark):
    """The plan deals blocks, not documents, and long documents are entered right after many blocks."""
    docs = corpus(3, docs=2, longest=30) | {5: [[i % 50] * (1 + i % 13) for i in range(3000)]}
    df = frame(spark, docs)
    got = packing.pack_lines(df, 40, 0.1, 1, block_tokens=64)
    want = {(d, at) for d, lines in docs.items() for at, _ in by_hand(d, lines, 40, 0.1, 1)}
    assert {(r.doc_id, r.seq_at) for r in got.select("doc_id", "seq_at").distinct().collect()} == want
    assert "hashpartitioning(doc_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "blk" in plan
    with pytest.raises(ValueError):
        packing.pack_lines(df, 64, block_tokens=64)


@pytest.mark.parametrize("pairs", [True, False])
def test_sequences(spark, pairs):
    docs = corpus(8) | {90: [[1]], 91: [[5, 6]], 92: [[], []]}
    rows = packing.pretraining_sequences(frame(spark, docs), 20, pairs, 0.2, 5).collect()
    by_doc = {}
    for r in rows:
        assert r.input_ids[0] == 2 and r.input_ids[-1] == 3 and len(r.input_ids) == len(r.segment_ids) <= 20
        assert r.segment_ids == sorted(r.segment_ids)
        ids = [t for t in r.input_ids if t not in (2, 3)]
        cut = r.segment_ids.count(0) - 2
        two = 1 in r.segment_ids
        assert two == (pairs and len(ids) > 1)
        if two:
            assert r.input_ids[cut + 1] == 3 and 0 < cut < len(ids)
        by_doc.setdefault(r.doc_id, []).append((r.seq_at, ids[cut:] + ids[:cut] if r.is_swapped else ids))
    assert {d: [t for _, s in sorted(v) for t in s] for d, v in by_doc.items()} == {
        d: [t for line in lines for t in line] for d, lines in docs.items() if any(lines)}
    assert not pairs or 0.3 < sum(r.is_swapped for r in rows) / len(rows) < 0.7


def test_ready_examples_are_masked_copies(spark):
    """Sequences, each several times with other masks; control tokens are never hidden."""
    seqs = packing.pretraining_sequences(frame(spark, corpus(4)), 24, True, 0.1, 5)
    done = examples.mask_tokens(examples.dupe(seqs, 3), 90, special_ids=(2, 3), key=("doc_id", "seq_at", "dupe"),
                                tokens="input_ids", favor_short=True).collect()
    assert len(done) == 3 * seqs.count()
    assert all(r.input_ids[p] not in (2, 3) for r in done for p in r.positions)
    assert len({(r.doc_id, r.seq_at, tuple(r.positions)) for r in done}) > 2 * len(done) / 3
