import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm import bpe, token_counts
from tagweave.llm.bpe import Encoder
from tagweave.llm.common import Recent
from tagweave.llm.pretokens import splitter

from .conftest import EDGE

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(open(PATH, encoding="utf-8").read())


def test_encoder_equals_library(library, encoder):
    draw = random.Random(4)
    letters = "aAbe stTh'\n 12éñ漢字😀؀.,!? 　﻿\U000187f8"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    texts += [END, f"a{END}b {END}{END}", "<|endof" + "text|", " " * 300, "a" * 5000, "", "\U0001e6c0 x"]
    ids, counts = encoder.encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at:at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
        at += n


def test_pairs_by_definition(encoder):
    draw = random.Random(5)
    for _ in range(5000):
        left, right = draw.randrange(3000), draw.randrange(3000)
        whole = encoder.merged(encoder.spell[left] + encoder.spell[right])
        assert encoder.apart(left, right) == (whole == [left, right])


def test_walk_shares_prefixes(encoder):
    words = sorted({b"a", b"ab", b"abandon", b"abandoned", b"abandonment", b"zebra", b"zebras"})
    assert list(encoder.walk(words)) == [tuple(encoder.merged(w)) for w in words]


def test_long_text_in_blocks(monkeypatch):
    from tagweave.llm import pretokens
    text = "some words, and more's words " * 500
    whole = [p for block in splitter({})(text) for p in block]
    monkeypatch.setattr(pretokens, "_LONG", 100)
    monkeypatch.setattr(pretokens, "_BLOCK", 7)
    assert [p for block in splitter({})(text) for p in block] == whole and "".join(whole) == text


def test_decode_any_ids(library):
    decoder = bpe.Decoder(open(PATH, encoding="utf-8").read())
    draw = random.Random(6)
    for _ in range(500):
        ids = [draw.randrange(50257) for _ in range(9)]
        assert decoder.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_edges(table, library):
    got = sorted(bpe.round_trip(table(EDGE), PATH).collect(), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text in EDGE:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((key, len(ids), digest(",".join(map(str, ids))), digest(text or "")))
    assert list(map(tuple, got)) == sorted(want, key=lambda r: f"Row(doc_id={r[0]!r}, n_tokens={r[1]}, ids_sha256={r[2]!r}, decoded_sha256={r[3]!r})")


def test_clashing_names_and_empty_tables(table):
    kept = bpe.encode(table(EDGE), PATH, keep=("doc_id", "ids"))
    assert kept.columns == ["doc_id", "ids"] and kept.filter("doc_id = 5").first().ids
    assert bpe.round_trip(table([]), PATH).count() == 0
    assert token_counts.count_tokens(table([]), PATH).count() == 0


def test_decode_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [15496, None, 99999])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(df, PATH).orderBy("doc_id").collect()] == ["", "", "Hello"]


def test_counts(table, library):
    rows = [*EDGE, (9, f"x{END}y's  z{END}"), (10, "supercalifragilistic " * 50)]
    got = token_counts.count_tokens(table(rows), PATH, size=10).collect()
    want = [(k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_recent_values_stay():
    known = Recent(4)
    for n in range(50):
        new = known.missing({0, n})
        known.young.update((k, k) for k in new)
        assert (0 in new) == (n == 0) and len(known.young) + len(known.old) <= 8
    assert known.missing({49, 0, 1}) == [1]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_counts_do_not_hang_on_the_table(table):
    rows = [(n, f"frequent words and rare{n}" * (n % 5 + 1)) for n in range(40)]
    small, large = (token_counts.count_tokens(table(rows), PATH, size=s).orderBy("doc_id").collect() for s in (1, 9999))
    assert small == large
    assert token_counts.count_tokens(table(rows), PATH).agg(F.sum("n_tokens")).first()[0] > 0


def test_round_trip_is_one_pass(table, capsys):
    bpe.round_trip(table(EDGE), PATH).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_walk_follows_places_not_all_lengths(encoder):
    words = sorted({b"zqxjkvwp" * 40, b"understanding", b"understandings"})
    encoder.forget_places()
    assert list(encoder.walk(words)) == [tuple(encoder.merged(w)) for w in words]
    steps = encoder.steps
    assert 0 < steps < 60  # repeated letters go by places that are known
    assert list(encoder.walk(words)) == [tuple(encoder.merged(w)) for w in words] and encoder.steps == steps
