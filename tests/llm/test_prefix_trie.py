import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from tagweave.llm import prefix_trie

SMALL = "/root/testdata/sf0.001"


def rebuild(rows):
    """Conversation -> (role, text) turns after the exchange of first turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", bytes(turn_id(role or "", text or "")), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
    return out


def turn_id(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p],
                    saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(*prefix_trie._OUT).collect()), key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(3)
    return df.selectExpr("*", "'a' AS key", "1 AS depth", "'b' AS turns", "2 AS part", "3 AS n")


def built(spark, rows):
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.in_order(frame(spark, rows))))


def chat(seed, convs, longest=9, kinds=3):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["", "a", "bé", None, "long " * 9][:kinds + 2]))
            for c in convs for t in range(draw.randint(1, longest))]


EDGES = [(None, 0, "user", "no conversation"), (7, None, "user", "x"), (7, None, "user", "x"), (7, 0, None, None),
         (-3, 0, "user", "x"), (-5, 0, "user", "y"), (10 ** 15, 0, "user", "x"), (4, 1, "r", "second"), (4, 0, "r", "first")]


@pytest.mark.parametrize("tree_keys", [50_000, 5, 1])
def test_against_brute_force(spark, monkeypatch, tree_keys):
    """The same nodes whether one partition holds all strings or every string has its own."""
    monkeypatch.setattr(prefix_trie, "TREE_KEYS", tree_keys)
    rows = chat(1, range(40)) + [(c, t, "user", "hello") for c in range(100, 130) for t in range(4)] + EDGES
    assert found(built(spark, rows)) == brute(rebuild(rows))


def test_empty_and_turnless(spark):
    assert built(spark, []).count() == 0 and built(spark, EDGES[:1]).count() == 0
    # 6 takes its first turns from 5, which is not there, and has none beyond those given up
    lone = next(c for c in range(6, 500, 5) if zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(lone, 0, "user", "gone")]
    assert found(built(spark, rows)) == brute(rebuild(rows)) and brute(rebuild(rows))[0][1] == 0


def test_many_equal_conversations(spark, monkeypatch):
    """The ids of a large group are hashed over many ranges, in numerical order."""
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 4)
    monkeypatch.setattr(prefix_trie, "TREE_KEYS", 2)
    rows = [(c, t, "user", f"turn {t}") for c in itertools.chain(range(-20, 150), [10 ** 9]) for t in range(3)]
    assert found(built(spark, rows)) == brute(rebuild(rows))


def test_one_long_conversation(spark):
    """Ten thousand turns are one path of ten thousand nodes."""
    rows = [(5, t, "user", f"t{t}") for t in range(10_000)] + [(6, t, "user", f"t{t}") for t in range(5_000)]
    assert found(built(spark, rows)) == brute(rebuild(rows))


def test_layouts_grow():
    """Nodes take 4, 16, 48 and 256 places as their children need them; a full byte of children is found again."""
    for count, kind in ((4, 4), (5, 16), (16, 16), (17, 48), (48, 48), (49, 256), (256, 256)):
        labels = random.Random(count).sample(range(256), count)
        root = prefix_trie.grown([bytes([b, 1]) for b in labels])
        assert len(root.places) == kind and root.size == count
        assert all(root.find(b).value == n for n, b in enumerate(labels))
        assert root.find(next((b for b in range(256) if b not in labels), 0)) is None or count == 256


def test_paths_are_compressed():
    """A string is one node below the last branch, however long; a prefix of it splits the path."""
    root = prefix_trie.grown([b"a" * 64, b"a" * 32, b"a" * 40 + b"b" * 24])
    first = root.find(97)
    assert first.path == b"a" * 32 and first.value == 1 and first.size == 1
    fork = first.find(97)
    assert fork.path == b"a" * 8 and fork.value == -1 and sorted(fork.labels[:2]) == [97, 98]
    assert fork.find(98).path == b"b" * 24 and fork.find(98).value == 2


def test_only_whole_turns_are_nodes(spark):
    """Turns whose ids share their first bytes branch inside a turn; no node is emitted there."""
    width = prefix_trie.WIDTH
    keys = sorted(bytes([1] * (width - 1) + [last]) for last in (1, 2, 3))
    rows = list(prefix_trie.emitted(keys, [[1]] * 3, [1] * 3, [1, 2, 3], ["x"] * 3, None, None))
    assert sorted(r["depth"] for r in rows) == [0, 1, 1, 1]
    root = next(r for r in rows if not r["depth"])
    assert root["n_children"] == 3 and root["digest"] is not None


def test_query(spark):
    got = prefix_trie.op12_prefix_trie(spark, SMALL)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got.columns == list(prefix_trie._OUT)
    assert found(got) == brute(rebuild(rows))
