import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tagweave.llm import decontaminate, quality, toxicity

from .conftest import EDGE, prose

SMALL = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op6_toxicity(spark, SMALL)
    assert got.count() == docs.count()
    held = got.filter("held_out").join(labels, "doc_id").collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in held) / len(held)
    pairs = [(a.score, b.score) for a in held if a.toxic for b in held if not b.toxic]
    assert right > 0.93 and sum(x > y for x, y in pairs) / len(pairs) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in held)


def test_toxicity_edges(table, spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    one_kind = toxicity.fit(table(EDGE), labels.filter("toxic = 0"))
    assert one_kind.trees is None and {r.score for r in toxicity.score(table(EDGE), one_kind).collect()} == {0.0}
    rows = [(100 + n, prose(n, 30) + (" you worthless idiot" if n % 2 else "")) for n in range(60)]
    labels = spark.createDataFrame([(100 + n, n % 2) for n in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(table(rows), labels)
    got = toxicity.score(table([*EDGE, *rows]), model)
    assert got.columns == ["doc_id", "score"] and got.count() == len(EDGE) + 60
    assert all(0 <= r.score <= 1 for r in got.collect())
    known = toxicity.Lexicon(model.lexicon)
    assert known["idiot"] > 0 and known["worthless"] > 0 and not known["text"]
    kept = toxicity.keep_clean(table([*EDGE, *rows]), model)
    assert kept.count() < len(EDGE) + 60 and "score" in kept.columns
    assert toxicity.score(table([]), model).count() == 0


def test_text_features():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "lowei*": 4.0})
    value = lambda t: dict(zip(toxicity.FEATURES, toxicity.text_features(t, lexicon)))
    assert value("you are an IDIOT")["near_rate"] == 25 and value("an idiot")["near_rate"] == 0
    assert value("loweichen sind")["lexicon_best"] == 4 and value("lowe")["lexicon_hits"] == 0
    assert value("an id1ot")["hidden_weight"] == 3 and value("")["log_words"] == 0
    assert value("STOP!!!")["shouted_rate"] == 1 and value("soooo")["stretched_rate"] == 100


def test_base_counts(table, spark):
    rows = [*EDGE, (9, "a b c d e x a b c d e f"), (10, "l one\n l one\nl one\n\n\nl one " + "#|<" * 4),
            (11, " ".join("ab" * 40)), (12, "\x0b\x1c   w")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(table(rows), labels).collect()
    want = []
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want.append((key, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
                     len(lines) - len(set(lines)), len(covered), failed, not failed, ""))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert quality.judge(table([]), labels).count() == 0


def test_repeated_words_with_many_kinds():
    words = [f"w{n}" for n in range(9000)] + [f"w{n}" for n in range(100, 106)]
    assert quality.repeated_words(words) == 12 and quality.repeated_words([]) == 0


def test_binomial_tail_is_exact():
    for n, rate in ((50, 0.1), (400, 0.005), (2000, 0.01)):
        for k in range(0, 30, 3):
            exact = sum(math.comb(n, i) * rate ** i * (1 - rate) ** (n - i) for i in range(k + 1))
            got = quality.at_most(k, n, rate)
            assert got == pytest.approx(exact, rel=1e-9) if k <= n * rate else got == 1
    assert quality.last_safe([0, 0, 30, 0], 5000, 0.005, 0.01) == 2 and quality.last_safe([0], 10, 0.005, 0.01) == 0


def test_cutoffs_hold_their_risk(spark, table):
    """Good documents of one stratum are many, of the other few; rules exist for the first only."""
    draw = random.Random(1)
    signs = "".join(f" ##x{k}##" for k in range(12))  # different words, so that the base lets them pass
    many = [(n, prose(n, 12) + " #" * (draw.random() < 0.001)) for n in range(3000)]
    bad = [(5000 + n, prose(n, 12) + signs) for n in range(100)]
    few = [(9000 + n, prose(n, 12)) for n in range(40)]
    docs = table(many + bad).union(table([*few, (9999, prose(1, 12) + signs)], lang=None))
    labels = spark.createDataFrame([(k, 1) for k, _ in many + few] + [(k, 0) for k, _ in bad] + [(1, 1), (None, 1)],
                                   "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert sum(not got[k].kept for k, _ in many) <= quality.RISK * 3000
    assert not any(got[k].kept for k, _ in bad) and "symbol_rate" in got[5000].failed
    assert all(got[k].kept for k, _ in few) and got[9999].kept
    assert not any(r.base_failed for r in got.values())


def test_ordinary_strata_have_rules(spark, table):
    """310 good documents in each of four strata are enough for a rule that rejects none of them."""
    docs, labelled = table([]), []
    for k, lang in enumerate(("de", "en", "es", "fr")):
        good = [(10_000 * k + n, prose(n, 12)) for n in range(310)]
        bad = [(10_000 * k + 5000 + n, prose(n, 12) + " ##") for n in range(30)]
        docs = docs.union(table(good + bad, lang=lang))
        labelled += [(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad]
    got = quality.judge(docs, spark.createDataFrame(labelled, "doc_id long, quality int")).collect()
    assert {r.doc_id for r in got if r.kept} == {d for d, g in labelled if g}
    assert quality.labels_needed(4) <= 310 < quality.labels_needed(4, 0.005)


def test_all_rules_together_keep_the_risk():
    """Each rule alone would reject 1 in 100 good documents, other ones each time."""
    sizes = [len(c) for c in quality.CUTOFFS.values()]
    first = np.array([sizes] + [[0 if r == k else n for k, n in enumerate(sizes)] for r in range(len(sizes))])
    good, bad = np.array([9400] + [100] * 6), np.array([0] + [50 + r for r in range(6)])
    force = quality.safe_cutoffs(first, good, bad, 0.02, 0.05)
    assert (force > 0).sum() == 1 and good[(first < force).any(1)].sum() <= 0.02 * good.sum()
    # one rule rejects too many, the others none: it stays out, they go on
    good = np.array([9000, 0, 1000, 0, 0, 0, 0])
    force = quality.safe_cutoffs(first, good, bad, 0.02, 0.05)
    assert force.tolist() == [n if k != 1 else 0 for k, n in enumerate(sizes)]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_found_and_clean_left_alone(table, spark):
    bench = [(n, prose(7000 + n, 16 + 3 * n)) for n in range(12)]
    rows = [(n, prose(n, 50 + 11 * n)) for n in range(40)]
    verbatim = [(100 + n, prose(n, 33 * n) + " " + t + " " + prose(n + 300, 61)) for n, t in bench]
    draw = random.Random(2)
    changed = []
    for n, t in bench[4:]:
        words = t.split(" ")
        for at in draw.sample(range(len(words) * 2 // 3), max(2, len(words) // 7)):
            words[at] = "another"
        changed.append((200 + n, prose(n, 80) + "\n" + " ".join(words).upper() + "\n" + prose(n + 900, 40)))
    got = decontaminate.leaks(table([*EDGE, *rows, *verbatim, *changed]), items(spark, [*bench, (90, None), (91, "")]))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k % 100) for k, _ in verbatim + changed}
    kept = decontaminate.without_leaks(table([*EDGE, *rows, *verbatim]), items(spark, bench))
    assert kept.count() == len(EDGE) + len(rows)


def test_leak_edges(table, spark):
    some, none = table(EDGE), items(spark, [])
    assert decontaminate.leaks(some, none).count() == 0
    assert decontaminate.leaks(table([]), items(spark, [(1, "a few words of text")])).count() == 0
    assert {r.doc_id for r in decontaminate.leaks(some, items(spark, [(1, "A repeated row!")])).collect()} == {7}


def test_items_in_blocks_and_passes(table, spark, monkeypatch):
    bench = [(n, prose(7000 + n, 20 + 40 * (n % 3))) for n in range(9)]
    rows = [(n, prose(n, 70) + " " + t + " " + prose(n + 50, 30)) for n, t in bench]
    want = [(n, n) for n in range(9)]
    for size in (1 << 27, 200_000):  # all blocks in one pass, and one or two a pass
        monkeypatch.setattr(decontaminate, "BLOCK", 3)
        monkeypatch.setattr(decontaminate, "SPACE_BYTES", size)
        got = decontaminate.leaks(table(rows), items(spark, bench))
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want
    monkeypatch.setattr(decontaminate, "SPACE_BYTES", 10_000)
    with pytest.raises(ValueError, match="in parts"):
        decontaminate.leaks(table(rows), items(spark, bench))


def everyday(seed, words):
    """Half of the words from thirty, the others from a small vocabulary."""
    draw = random.Random(seed)
    known = prose(4242, 1500).replace(".", "").split(" ")
    return " ".join(draw.choice(known[:30] if draw.random() < 0.5 else known) for _ in range(words))


def test_items_of_any_length(table, spark):
    sizes = [8, 10, 15, 24, 33, 48, 49, 72, 100, 200, 300, 500, 800, 1500]
    bench = [(10 * k + n, everyday(9000 + 10 * k + n, size)) for k, size in enumerate(sizes) for n in range(6)]
    rows = [(n, everyday(n, 37 + 13 * (i % 40)) + " " + t + " " + everyday(n + 500, 61)) for i, (n, t) in enumerate(bench)]
    clean = [(1000 + n, everyday(n + 2000, 300)) for n in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table([*rows, *clean]), items(spark, bench)).collect()}
    assert {(n, n) for n, _ in bench} <= got
    assert not any(d != i for d, i in got if len(dict(bench)[i].split(" ")) >= 24)


def test_leaks_against_all_pairs(spark):
    """The search loses at most a tenth of what the same check finds without it, on real tables."""
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    known = decontaminate.read_items(bench)
    want = set()
    for row in docs.collect():
        words = decontaminate.words_of(row.text or "")
        held = set(words)
        for x in known:
            if sum(w in held for w in x.words) >= decontaminate.PARAPHRASE * len(x.words) and any(
                    decontaminate.verify(x, words, at) for at in range(0, len(words), decontaminate.HALF)):
                want.add((row.doc_id, x.item))
    assert found <= want and len(found) >= 0.9 * len(want) > 0


def test_space_joins_words_that_documents_use_alike(spark, table):
    """Paraphrases with other words for the rare ones of an item: documents have these words beside each other."""
    pairs = [[(f"left{n}", f"right{n}") for n in range(6 * k, 6 * k + 6)] for k in range(4)]
    common = [f"the{n}" for n in range(14)]
    draw, rows = random.Random(4), []
    for n in range(400):
        said = [w for one, other in pairs[n % 4] for w in [one, one, *[other] * (draw.random() < 0.3)]]
        draw.shuffle(said)
        rows.append((n, " ".join(said)))
    rows += [(1000 + n, " ".join(draw.sample(common, 14) * 3)) for n in range(2000)]

    def said(topic, side):
        return " ".join(f"{common[2 * i]} {pairs[topic][i][side]} {common[2 * i + 1]}" for i in range(6))
    bench = [(k, said(k, 0)) for k in range(4)]
    # items of other things that hold one of the other words each: without them no passage could say these
    bench += [(100 + n, prose(8000 + n, 40) + f" right{n}") for n in range(24)]
    leaked = [(5000 + k, said(k, 1)) for k in range(4)]

    def search(held):
        got = decontaminate.leaks(table([*rows, *leaked]), items(spark, bench), held=held)
        return {(r.doc_id, r.item_id) for r in got.filter("doc_id >= 5000").collect()}
    assert search(decontaminate.HELD) == {(5000 + k, k) for k in range(4)}
    assert search(1.0) == set()  # plain TF-IDF: with all of the items' weight these are no candidates


def test_rows_without_key_are_judged_by_their_text(table, spark):
    bench = [(1, prose(7001, 30))]
    leak = prose(1, 40) + " " + bench[0][1]
    rows = [(None, leak), (None, prose(2, 40)), (5, leak), (5, prose(3, 40)), (5, leak), (6, prose(4, 40)), (None, None), (7, "")]
    kept = decontaminate.without_leaks(table(rows), items(spark, bench))
    assert kept.columns == table(rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        ((d, t) for d, t in rows if t != leak), key=str)


def test_nystroem_finds_singular_vectors():
    draw = np.random.default_rng(1)
    left, right = np.linalg.qr(draw.standard_normal((300, 6)))[0], np.linalg.qr(draw.standard_normal((40, 6)))[0]
    values = np.array([50, 20, 9, 4, 2, 1.0])
    a = left * values @ right.T
    start = draw.standard_normal((40, 14))
    vectors, sizes = decontaminate.singular(start, a.T @ (a @ start), 4)
    assert np.allclose(sizes, values[:4], rtol=1e-3)
    assert np.allclose(np.abs((vectors * right[:, :4]).sum(0)), 1, atol=1e-3)


def test_common_words():
    draw = random.Random(3)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]
    for _ in range(500):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 20))] for _ in range(2))
        assert decontaminate.common_words(a, b) == plain(a, b)


def test_registered_leaks_hold_all_verbatim_ones(spark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.op2_decontamination(spark, SMALL).collect()}
    read = lambda t, k: duckdb.sql(f"select {k}, text from '{SMALL}/{t}.parquet'").fetchall()
    texts = {d: f" {' '.join(decontaminate.words_of(t))} " for d, t in read("documents", "doc_id")}
    want = {(d, i) for i, t in read("benchmark", "item_id") for d, text in texts.items()
            if f" {' '.join(decontaminate.words_of(t))} " in text}
    assert want and want == found


def test_ascii_words_without_the_pattern(monkeypatch):
    from tagweave.llm import shingles
    texts = ["".join(map(chr, range(128))), "a_b A9", "", "\x1c\x1d x\x85", "İa b", "naïve 漢字"]
    want = [shingles.WORD.findall(t.lower()) for t in texts]
    assert list(map(shingles.words_of, texts)) == want
    monkeypatch.setattr(shingles, "WORD", None)
    assert [shingles.words_of(t) for t in texts if t.isascii()] == [w for w, t in zip(want, texts) if t.isascii()]


def test_sums_of_halves():
    draw = np.random.default_rng(2)
    values = draw.standard_normal((50, 7)).astype(np.float32)
    half = np.sort(draw.integers(0, 900, 3000)) * 2
    ids = draw.integers(0, 50, len(half))
    want = np.zeros((1800, 7))
    np.add.at(want, half, values[ids])
    assert np.allclose(decontaminate._sums(values, ids, half, 1800), want, atol=1e-4)
    assert not decontaminate._sums(values, ids[:0], half[:0], 5).any()
