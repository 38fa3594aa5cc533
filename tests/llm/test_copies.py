import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import jaccard, lines
from tagweave.llm.components import connected
from tagweave.llm.shingles import shingle_set

from .conftest import EDGE, prose


def changed(text, seed, times):
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[draw.randrange(len(words))] = f"other{draw.randrange(10 ** 6)}"
    return " ".join(words)


def copies():
    """Near copies of three texts, exact copies, and texts of their own."""
    rows = []
    for group in range(3):
        base = prose(group, 120)
        rows += [changed(base, 100 * group + n, n % 4) for n in range(25)]
    rows += [prose(50 + n, 60) for n in range(30)] + [prose(50, 60)] * 3
    random.Random(1).shuffle(rows)
    return list(enumerate(rows))


def brute_classes(rows):
    found = {}
    for key, text in rows:
        words = re.findall(r"[^\W_]+", text.lower())
        size = min(5, len(words))
        found[key] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()
    links, root = dict.fromkeys(found, 0), {k: k for k in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(found, 2):
        x, y = found[a], found[b]
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(k, find(k) if found[k] else None, links[k]) for k in found}


def test_jaccard_equals_brute_force(table, monkeypatch):
    rows = copies()
    want = brute_classes(rows)
    assert {tuple(r)[:3] for r in jaccard.jaccard_classes(table(rows)).collect()} == want
    # buckets cut into parts give the same
    monkeypatch.setattr(jaccard, "PART", 4)
    assert {tuple(r)[:3] for r in jaccard.jaccard_classes(table(rows)).collect()} == want


def test_jaccard_edges(table):
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(table([*EDGE, (9, "ONE")])).collect()), key=str)
    want = [(None, None, 0, None)] * 2 + [(k, None, 0, None) for k in (1, 2, 3, 4)]
    want += [(5, 5, 1, 5), (9, 5, 1, 5), (6, 6, 0, 6), (7, 7, 1, 7), (7, 7, 1, 7), (8, 8, 0, 8)]
    assert got == sorted(want, key=str)
    assert jaccard.jaccard_classes(table([])).count() == 0
    kept = jaccard.one_of_each(table([*EDGE, (9, "ONE")]))
    # 9 copies 5, and one of the two equal rows of 7 stays
    assert kept.count() == len(EDGE) - 1 and kept.filter("doc_id = 9").count() == 0 and "sig" in kept.columns


def test_one_of_each_judges_rows_by_their_text(table):
    same, other, own = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(None, same), (4, same.upper()), (None, same), (5, other), (5, own), (6, own), (3, other), (None, prose(4, 60)),
            (None, None), (None, None), (2, ""), (2, "")]
    kept = jaccard.one_of_each(table(rows))
    assert kept.columns == table(rows).columns
    want = [(4, same.upper()), (3, other), (5, own), (None, prose(4, 60)), (None, None), (None, None), (2, ""), (2, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert jaccard.one_of_each(table([])).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard.least_matches()
    assert list(least) == sorted(least) and least[0] > 0
    for n, m in zip(range(jaccard.STEP, jaccard.HASHES + 1, jaccard.STEP), least):
        below = sum(math.comb(n, k) * 0.8 ** k * 0.2 ** (n - k) for k in range(m))
        assert below < 1e-6  # a pair at the threshold is hardly ever dropped


def test_short_texts_are_one_shingle():
    assert len(shingle_set("Two words")) == 1 and len(shingle_set("...")) == 0
    assert (shingle_set("a b c d e f") == shingle_set("A, b; c d e f!")).all()


def test_components(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 5)] + [(1000, n) for n in range(1001, 1100)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: 0 for n in range(61)} | {100: 100, 200: 100, 300: 300} | {n: 1000 for n in range(1000, 1100)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    draw = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 12))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain_distance(a, b)
        a, b = " ".join(a), " ".join(b)
        assert lines.alike(a, b, 0.8) == (share(a, b) <= 0.2 + 1e-9)


def share(a, b):
    """Part of the words of the longer line to edit."""
    a, b = a.split(" "), b.split(" ")
    return plain_distance(a, b) / max(len(a), len(b))


def brute_lines(rows, distance=3):
    norm = lines.norm_of
    names = {}
    for _, text in rows:
        for line in text.split("\n"):
            if norm(line).count(" ") >= 4:
                names.setdefault(norm(line), len(names))
    words = list(names)
    sims = [int(s) & (1 << 64) - 1 for s in lines.sketched(words, 1)[3]]
    bags = [Counter(w.split(" ")) for w in words]
    sizes = [b.total() for b in bags]
    root = list(range(len(words)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(words)), 2):
        # words that two lines do not share have to be edited, so most pairs need no full comparison
        most = max(sizes[a], sizes[b])
        near = (min(sizes[a], sizes[b]) >= lines.SIMILARITY * most - 1e-9
                and (bags[a] & bags[b]).total() >= lines.SIMILARITY * most - 1e-9 if distance is None
                else (sims[a] ^ sims[b]).bit_count() <= distance)
        if near and lines.SIMILARITY <= 1 - share(words[a], words[b]) + 1e-9:
            root[find(b)] = find(a)
    seen, out = set(), []
    for key, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if norm(line) in names:
                if find(names[norm(line)]) in seen:
                    continue
                seen.add(find(names[norm(line)]))
            kept.append(line)
        out.append((key, "\n".join(kept), text.count("\n") + 1 - len(kept)))
    return out


def line_rows():
    shared = [prose(n, 55) for n in range(4)]
    rows = []
    for n in range(30):
        own = [prose(1000 + n, 12), "Short line.", ""]
        near = shared[n % 4].replace("a", "e", 1) if n % 3 else shared[n % 4].upper()
        rows.append((n, "\n".join([*own, near, *([near] if n % 5 == 0 else [])])))
    return rows


def test_line_dedup_equals_brute_force(table, monkeypatch):
    rows = line_rows()
    want = brute_lines(rows)
    assert any(n for _, _, n in want)
    got = lines.dedup_lines(table(rows)).select("doc_id", "text", "n_removed")
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(lines, "PART", 2)  # buckets cut into parts
    assert sorted(map(tuple, lines.dedup_lines(table(rows)).select("doc_id", "text", "n_removed").collect())) == want


def test_more_blocks_meet_the_same_lines():
    few, many = lines.block_masks(10), lines.block_masks(10 ** 12)
    assert len(few) == 4 and len(many) > len(few)
    draw = random.Random(3)
    for _ in range(300):
        apart = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(apart & m == 0 for m in few) and any(apart & m == 0 for m in many)


def test_line_edges(table):
    long = "\n".join(prose(n % 40, 6) for n in range(2000))
    rows = [*EDGE, (9, long), (10, prose(39, 6) + "\nmore of it here and there")]
    got = lines.dedup_lines(table(rows))
    back = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert got.count() == len(rows) and back[1].text is None and back[2].text == ""
    assert back[9].n_removed == 1960 and back[10].text == "more of it here and there"
    assert [r.text for r in got.filter("doc_id = 7").collect()] == ["a repeated row"] * 2
    assert lines.dedup_lines(table([])).count() == 0
    kept = lines.keep_unrepeated(table([(1, prose(1, 60)), (2, prose(1, 60)), (3, ""), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_sketches_do_not_hang_on_the_cut(monkeypatch):
    texts = [prose(n, 40 * n) + "\n" * (n % 3) + "Ünï 漢字 Words,here.and THERE\n\n" + "x " * n for n in range(9)]
    whole = lines.sketched(texts, 2)
    one_by_one = [lines.sketched([t], 2) for t in texts]
    for k in (1, 2, 3):
        assert whole[k].tolist() == [v for found in one_by_one for v in found[k].tolist()]
    monkeypatch.setattr(lines, "_PIECE", 50)
    assert all((x == y).all() for x, y in zip(lines.sketched(texts, 2), whole))


def test_simhash_counts_bits():
    words = np.random.default_rng(1).integers(0, 1 << 63, 2000, np.uint64)
    sizes = np.array([1, 7, 255, 256, 700, 781])
    got, at = lines.simhash(words, sizes), 0
    for n, sim in zip(sizes, got):
        plain = sum(np.unpackbits(words[at + k:at + k + 1].view(np.uint8)).astype(int) * 2 - 1 for k in range(n))
        assert int(sim) == int.from_bytes(np.packbits(plain > 0).tobytes(), "big", signed=True)
        at += n


def test_few_edits_are_counted_by_diagonals(monkeypatch):
    draw = random.Random(8)
    some = lambda: [draw.choice("abc") for _ in range(draw.randrange(14))]
    pairs = [(a, some() if draw.random() < 0.5 else [x for x in a for x in draw.choice(([x], [x], [x], [], [x, "b"]))])
             for a in (some() for _ in range(3000))]
    distances = [lines.edit_distance(a, b) for a, b in pairs]
    long = [str(n) for n in range(400)]
    assert not lines.within(long, ["x", *long[:-1]], 1) and lines.within(long, ["x", *long[:-1]], 2)
    assert lines.within(long, long[50:], 50) and not lines.within(long, long[50:], 49)
    # the whole line is not gone through word by word
    monkeypatch.setattr(lines, "edit_distance", None)
    for (a, b), d in zip(pairs, distances):
        assert [lines.within(a, b, most) for most in (0, 1, 2, 5, 9)] == [d <= most for most in (0, 1, 2, 5, 9)]
    assert lines.alike(" ".join(long), " ".join(["x", *long[:300], *long[301:]]), 0.95)


def test_equal_lines_only_hash_alike():
    texts = [prose(n, 9) for n in range(3000)]
    found = lines.sketched([*texts, *[t.upper() + "!" for t in texts]], 5)
    assert len(set(found[2][:3000].tolist())) == 3000 and (found[2][:3000] == found[2][3000:]).all()


def edited(text, seed, times):
    """A line with words replaced, put in or taken out."""
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        at, kind = draw.randrange(len(words)), draw.randrange(3)
        words[at:at + (kind != 1)] = [f"new{draw.randrange(10 ** 6)}"] if kind < 2 else []
    return " ".join(words)


def alike_lines():
    """Lines of 9 to 130 words and edits of them, some at the very bound of the similarity."""
    rows = [edited(prose(n, size), 10 * n + k, k * size // 30)
            for n, size in enumerate([9, 10, 11, 14, 19, 20, 21, 29, 30, 45, 60, 100, 130] * 4) for k in range(5)]
    return list(enumerate([*rows, "ab " * 40, "ab " * 43, "ab ba " * 20, "a b c d e f g h i", "a b c d x e f g h i"]))


def without_simhash(rows):
    """What stays of one-line texts by edit similarity of all pairs."""
    norms = [lines.norm_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(root[:], 2):
        x, y = norms[a].split(" "), norms[b].split(" ")
        if abs(len(x) - len(y)) <= 0.1 * max(len(x), len(y)) + 1e-9 and share(norms[a], norms[b]) <= 0.1 + 1e-9:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return {rows[a][0] for a in range(len(rows)) if root[a] == a}


def test_every_pair_at_the_similarity_is_found(table, monkeypatch):
    rows = alike_lines()
    want = without_simhash(rows)
    assert len(want) < len(rows) - 100
    assert {r.doc_id for r in lines.keep_unrepeated(table(rows)).collect()} == want
    monkeypatch.setattr(lines, "PART", 2)  # buckets cut into parts
    assert {r.doc_id for r in lines.keep_unrepeated(table(rows)).collect()} == want


def test_jaccard_refuses_thresholds_that_would_lose_pairs(table):
    with pytest.raises(ValueError, match="below"):
        jaccard.jaccard_classes(table([(1, prose(1, 20))]), threshold=0.5)
    assert jaccard.jaccard_classes(table([(1, prose(1, 20))]), threshold=0.9).count() == 1


def test_tallies_differ_by_two_an_edit_at_most():
    draw = np.random.default_rng(4)
    a, b = draw.integers(-1 << 63, (1 << 63) - 1, (2, 500))
    plain = [sum(min(d := ((int(x) >> k) - (int(y) >> k)) % 16, 16 - d) for k in range(0, 64, 4)) for x, y in zip(a, b)]
    assert lines.apart(a, b).tolist() == plain
    for n in range(200):
        pair = [prose(n, 90), edited(prose(n, 90), n, n % 9)]
        _, _, _, words, _, sizes = lines._cut(pair, 5)
        tally = lines.tallies(words, sizes)
        assert lines.apart(tally[:1], tally[1:])[0] <= 2 * (n % 9)


def test_lines_that_meet_by_chance_are_not_compared(table, monkeypatch):
    draw, phrase = random.Random(6), "extraordinarily straightforward circumstances notwithstanding"
    rows = [(n, f"{phrase} " + " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(26))) for n in range(40)]
    rows.append((40, rows[0][1] + " more"))
    close = lambda: lines.sharing(lines.hashed(table(rows), marks=True).filter("size(marks) > 0"))
    assert close().select("line").distinct().count() == 2
    monkeypatch.setattr(lines, "PART", 3)  # marks of many lines are cut into parts
    assert close().select("line").distinct().count() == 2
