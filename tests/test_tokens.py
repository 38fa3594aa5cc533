import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions import text as txt
from tagweave.operators import runs, tagging, tokens, vocab

TIBETAN = "བཀྲ་ཤིས་བདེ་ལེགས། ཞེས་པ་ནི།"


def pieces_of(spark, model, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    done = tokens.encode(rows, model, options=tokens.Encoding(**options)).collect()
    return [r.pieces for r in sorted(done)]


def test_marks_are_barriers(spark, model):
    for pieces in pieces_of(spark, model, [TIBETAN, "the་cat"], marks=txt.MARKS):
        assert len(pieces) > 1 and all(not set(p[:-1]) & set(txt.MARKS) for p in pieces)


def test_underlines_only_between_parts(spark, model):
    got = pieces_of(spark, model, ["ab", "ab  cd ", " ", "the cat [MASK] x"], by_space=True)
    assert ["".join(p) for p in got] == ["ab", "ab▁cd", "", "the▁cat▁[MASK]▁x"]
    assert got[1].count("▁") == 1 and "[MASK]" in got[3]


def test_digit_and_comma_are_parted(spark, model):
    got = pieces_of(spark, model, ["9,", "x9,", "9, 99,10", "a, b"])
    assert ["".join(p) for p in got] == ["▁9,", "▁x9,", "▁9,▁99,10", "▁a,▁b"]
    assert [p.count(",") for p in got[:3]] == [1, 1, 2]


def test_the_ten_marks():
    names = ["INITIAL YIG MGO MDUN MA", "CLOSING YIG MGO SGAB MA", "SBRUL SHAD", "INTERSYLLABIC TSHEG",
             "DELIMITER TSHEG BSTAR", "SHAD", "RIN CHEN SPUNGS SHAD", "GTER TSHEG"]
    assert txt.MARKS[:8] == tuple(unicodedata.lookup("TIBETAN MARK " + n) for n in names)
    assert txt.MARKS[8:] == (unicodedata.lookup("TIBETAN SIGN RDEL DKAR GSUM"), unicodedata.lookup("TIBETAN KU RU KHA"))


def test_text_columns(spark):
    df = spark.createDataFrame([(TIBETAN + " [MASK]12 É  x",)], "t string")
    t = F.col("t")
    row = df.select(txt.presplit(t).alias("cut"), txt.syllables(t).alias("s"), txt.clean_text(t, keep_accents=False).alias("c"),
                    txt.unescape(txt.protect_specials(t, ["[MASK]", "1"]), ["[MASK]", "1"]).alias("same"),
                    txt.unify_tsheg(F.lit("a༌b")).alias("u"), txt.split_registers(F.lit("a[eor]b")).alias("r")).first()
    assert "".join(row.cut) == TIBETAN + " [MASK]12 É  x" and all(not set(p[:-1]) & set(txt.MARKS) for p in row.cut)
    assert row.s[0] == "བཀྲ" and "" not in row.s
    assert row.c.endswith("[mask]12 e x") and row.same == TIBETAN + " [MASK]12 É  x"
    assert row.u == "a་b" and row.r == ["a", "b"]


@pytest.mark.parametrize("specials", [["[MASK]", "1"], ["ab", "abc", "b"], []])
def test_texts_that_hold_stand_ins_come_back(spark, specials):
    rng = random.Random(5)
    private = [chr(0xF0000 + i) for i in range(9)]
    texts = [None, "", *["".join(rng.choices([*private, *"ab1c", "[MASK]"], k=rng.randrange(12))) for _ in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", txt.protect_specials(F.col("t"), specials))
    rows = df.withColumn("back", txt.unescape(F.col("p"), specials)).collect()
    assert all(r.back == r.t for r in rows)
    for r in rows:
        assert r.p is None or not any(token in r.p for token in specials)
    with pytest.raises(ValueError):
        txt.protect_specials(F.col("t"), ["x", private[0]])


CORPUS = ["the cat, the hat", "that [MASK] chat 9, 10", "a cat  sat on the mat", TIBETAN, "9, 99,"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "doc_id int, text string")


@pytest.fixture(scope="module")
def model(spark, corpus, tmp_path_factory):
    pieces = vocab.train_vocab(corpus, 80)
    path = vocab.save_model(spark, pieces, str(tmp_path_factory.mktemp("m") / "m.model"))
    return tokens.SubwordModel.load(spark, path)


def test_model_file_ids(model):
    processor = model.processor()
    assert [processor.PieceToId(p) for p in ("<pad>", "<unk>", "[CLS]", "[SEP]", "[MASK]")] == [0, 1, 2, 3, 4]
    assert processor.bos_id() == processor.eos_id() == -1


def test_encode_and_back(spark, corpus, model):
    rows = tokens.decode(tokens.encode(corpus, model), model).collect()
    for r in rows:
        plain = " ".join(CORPUS[r.doc_id].split())
        assert r.text.split() == plain.replace("[MASK]", "").split()
        assert r.cut == 0 and len(r.tokens) == len(r.pieces)
    assert 4 in next(r.tokens for r in rows if r.doc_id == 1)
    bare = {r.doc_id: r.pieces for r in rows}
    assert bare[4].count(",") == 2


def test_wrap_and_truncate(corpus, model):
    rows = tokens.encode(corpus, model, options=tokens.Encoding(wrap=True, max_length=6)).collect()
    assert all(r.tokens[0] == 2 and r.tokens[-1] == 3 and len(r.tokens) <= 6 for r in rows)
    full = {r.doc_id: len(r.tokens) for r in tokens.encode(corpus, model).collect()}
    assert all(r.cut == max(0, full[r.doc_id] - 4) for r in rows)


def test_any_text_comes_back(spark, model):
    texts = ["\U000f0000 icon \U000f0010", "a\U000f1000b", "\x01 and \x02", "[CLS] [MASK]x[SEP]", "[CLS][CLS]", "", None,
             "1,2 and 12, 3,,4"]
    rows = tokens.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    for r in rows:
        want = (texts[r.doc_id] or "").strip()
        assert "".join(r.pieces).replace("▁", " ").strip() == want
        assert r.tokens.count(2) == want.count("[CLS]") and r.tokens.count(4) == want.count("[MASK]")
    commas = rows[7].pieces
    assert commas.count(",") >= 3 and not any(p[:-1].rstrip(",") and p[-2].isdigit() and p.endswith(",") for p in commas if len(p) > 1)


def test_cuts_glue_to_the_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["[CLS]", "[", "CLS", "a", "1", ",", " ", "་"], k=rng.randrange(12))) for _ in range(200)]
    cut = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tokens.cuts(F.col("t"), ["[CLS]"], ["་"], True).alias("c")).collect()
    for t, parts in cut:
        assert "".join(parts) == t and parts.count("[CLS]") == t.count("[CLS]") and parts.count(" ") == t.count(" ")
        assert all("་" not in p[:-1] for p in parts)
    with pytest.raises(ValueError):
        tokens.cuts(F.col("t"), ["[a b]"], [])


def test_long_text_is_tagged_whole(spark, model):
    longest = max(40, 100_000)
    rows = spark.createDataFrame([(0, "ab" * (longest // 2)), (1, "the cat, the hat " * 50), (2, "")], "i int, text string")
    seen = 9
    def load():
        def run(batch):
            assert all(len(w) <= seen and w[0] == 2 and w[-1] == 3 for w in batch)
            return [w % 2 for w in batch]
        return run
    done = tagging.tag_text(rows, model, load, "parity", {0: "N", 1: "V"}, max_length=seen)
    got = {r.i: r for r in done.collect()}
    assert "".join(got[0].words) == "ab" * (longest // 2)
    assert "".join(got[1].words).replace(" ", "") == "thecat,thehat" * 50
    assert got[2].words == []


def test_windows():
    pieces = ["▁a", "b,", "c", "▁d", "e", "f", "g"]
    assert tagging.window_ends(pieces, 3, [","]) == [2, 3, 6, 7]
    assert tagging.window_ends(pieces, 4, []) == [3, 7]
    assert tagging.window_ends(pieces, 7) == [7] and tagging.window_ends([], 3) == [0]


def test_errors_of_a_model(spark, model):
    rows = spark.createDataFrame([(0, "the cat"), (1, "a [MASK] b")], "i int, text string")
    def load():
        def run(batch):
            if any(4 in w for w in batch):
                raise RuntimeError("bad window")
            return [np.zeros(len(w), int) for w in batch]
        return run
    got = {r.i: set(r.tags) for r in tagging.tag_text(rows, model, load, "picky", {0: "N"}, errors="default", default="?").collect()}
    assert got == {0: {"N"}, 1: {"?"}}
    with pytest.raises(Exception, match="bad window"):
        tagging.tag_text(rows, model, load, "picky2", {0: "N"}).collect()


def test_align_tokens(spark, model):
    sections = spark.createDataFrame([(0, ["the", "cat"]), (1, ["the", "", "cat"]), (2, ["བཀྲ༌", "ཤིས་"])],
                                     "doc_id int, words array<string>")
    rows = {r.doc_id: r for r in tokens.align_tokens(sections, model).collect()}
    assert rows[1].status == "bad" and rows[1].tokens is None
    processor = model.processor()
    assert rows[2].status == "ok"
    assert [processor.DecodeIds(w) for w in rows[2].tokens] == ["བཀྲ་", "ཤིས་"]
    pieces = processor.EncodeAsPieces("thecat")
    ends = list(itertools.accumulate(map(len, pieces)))
    assert rows[0].status == ("ok" if 4 in ends else "bad")


def test_segmenter_of_the_caller(spark):
    lines = spark.createDataFrame([("d", 0, "abcd")], "doc_id string, line_no long, line string")
    rows = tokens.segment_words(lines, lambda batch: [t[:2] + " " + t[2:] for t in batch]).collect()
    assert [tuple(r) for r in rows] == [("d", 0, 0, "ab"), ("d", 0, 1, "cd")]


def test_words_of_a_segment_equal_the_row_form(spark):
    rng = random.Random(2)
    data = {f"e{i}": [rng.choice(["[MASK]", "N", "V"]) for _ in range(rng.randrange(1, 12))] for i in range(30)}
    rows = spark.createDataFrame([(e, list(range(len(x))), x) for e, x in data.items()],
                                 "example_id string, tokens array<int>, labels array<string>")
    for keep in (False, True):
        arrays = rows.select("example_id", F.posexplode(tagging.grouped_words(F.col("tokens"), F.col("labels"), keep_head=keep)))
        flat = rows.select("example_id", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), F.col("labels").alias("label")))).select(
            "example_id", "pos", "col.token", "col.label")
        long = runs.words_from_tags(flat, keep_head=keep)
        shift = 0 if keep else 1
        assert sorted((r.example_id, r.pos + shift, r.col.tokens, r.col.tag) for r in arrays.collect()) == sorted(
            (r.example_id, r.word_pos, r.tokens, r.tag) for r in long.collect())


def test_segments_by_mark(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab,.\n ", k=rng.randrange(0, 60))) for _ in range(50)] + ["a" * 40 + ",b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tagging.segments_by_mark(F.col("t"), 12, [",", "."]).alias("s")).collect()
    for t, segments in rows:
        assert "".join(segments) == t and all(segments)
        for one, following in zip(segments, segments[1:]):
            first = next(i for i, c in enumerate(following + ".") if c in ",.") + 1
            assert one[-1] in ",." and len(one) + min(first, len(following)) > 12
        assert all(len(s) <= 12 or not set(s[:-1]) & set(",.") for s in segments)


def test_wrap_and_unwrap(spark):
    df = spark.createDataFrame([([5, 6],), ([2, 5],), ([2, 5, 3],), ([],)], "tokens array<int>")
    assert [r.tokens for r in tagging.wrap_specials(df, 2, 3).collect()] == [[2, 5, 6, 3], [2, 5, 3], [2, 5, 3], [2, 3]]
    preds = tagging.unwrap(df.withColumnRenamed("tokens", "predictions"))
    assert [r.predictions for r in preds.collect()] == [[], [], [5], []]


def test_predict_keeps_rows_in_place(spark):
    df = spark.createDataFrame([(i, list(range(i % 5))) for i in range(40)], "i int, tokens array<int>")
    rows = tagging.predict(df, lambda: (lambda batch: [np.eye(9)[r] for r in batch]), "identity", batch_size=3).collect()
    assert all(r.predictions == r.tokens for r in rows) and len(rows) == 40


def test_tag_documents(spark, corpus, model):
    labels = {0: "N", 1: "[MASK]"}
    def load():
        start = model.processor()
        return lambda batch: [np.array([0 if start.IdToPiece(int(t)).startswith("▁") else 1 for t in row]) for row in batch]
    done = tagging.tag_documents(corpus, lambda t: tagging.segments_by_mark(t, 10, [",", " "]), [F.upper, F.lower], model,
                                 load, "starts", labels, options=tokens.Encoding(specials=()))
    for r in done.collect():
        assert len(r.words) == len(r.tags) and set(r.tags) <= {"N"}
    assert {r.doc_id for r in done.collect()} == set(range(len(CORPUS)))


def test_distinct_words_are_encoded_once(spark, model):
    words = ["cat", "the", "cat", None, "", "hat", "cat"] * 5
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(words)], "i int, word string, pieces string").repartition(4)
    got = {r.i: r.tokens for r in tokens.encode_words(df, model).collect()}
    alone = {r.word: r.tokens for r in tokens.encode(df.select("word").distinct(), model, "word", tokens.Encoding(marks=txt.MARKS)).collect()}
    assert got == {i: list(alone[w]) if w else [] for i, w in enumerate(words)}
    assert tokens.encode_words(df.filter("false"), model).count() == 0


def test_long_texts_reach_python_in_bounded_batches(spark):
    import pandas as pd
    import pyarrow as pa

    @F.pandas_udf("long")
    def rows_at_once(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 3000, 1, 1).withColumn("text", F.repeat(F.lit("abcdefghij"), 1000))
    assert rows.select(F.max(rows_at_once("text"))).first()[0] < 1000
    found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 3000 and max(found) < 1000


def test_words_are_encoded_where_they_are(spark):
    """No row and no word is moved, and words in which something is cut come out as `encode` gives them."""
    words = ["ab", "a,b", "1,5", "b1,a", "a[MASK]b", "a་b", " a  b ", "", None, "zz", "ab"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, word string")
    chunks = vocab.chunk_counts(spark.createDataFrame([("ab 1 5 , abab b [MASK]",)], "text string"))
    model = tokens.SubwordModel(spark, vocab.model_bytes(vocab.bpe_pieces(chunks, 30)))
    done = tokens.encode_words(df, model)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    options = tokens.Encoding(marks=tokens.MARKS)
    want = {r.i: r.tokens if r.word else [] for r in tokens.encode(df, model, "word", options).collect()}
    assert {r.i: r.tokens for r in done.collect()} == want


def test_known_words_keep_their_ids_over_many_batches(spark, model):
    """Known, new, long, cut and empty words side by side, with batches of a few rows, and texts decoded from what is kept."""
    rng = random.Random(2)
    pool = ["cat", "the", "hat", "", None, "a,b", "a་b", "x[MASK]y", "long" * 40, *("".join(rng.choices("catheb", k=5)) for _ in range(50))]
    words = [rng.choice(pool) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(words)), "i int, word string").coalesce(1)
    options = tokens.Encoding(marks=tokens.MARKS)
    alone = {r.word: (r.tokens, r.text) for r in tokens.decode(
        tokens.encode(df.select("word").distinct(), model, "word", options), model).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        done = tokens.decode(tokens.encode_words(df, model), model).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.i: r.tokens for r in done} == {i: alone[w][0] if w else [] for i, w in enumerate(words)}
    assert {r.i: r.text for r in done} == {i: alone[w][1] if w else "" for i, w in enumerate(words)}


def test_words_of_one_part_are_encoded_in_one_call(model):
    """The ids are those of the loop over parts, and the loop takes over where a piece is not known."""
    rows = [["cat"], ["the"], ["thecat"]]
    alone = [tokens._id_lists(model, tokens.Encoding(), [row, ["[MASK]"]]) for row in rows]
    ids, sizes, odd = tokens._id_lists(model, tokens.Encoding(), rows)
    assert [ids[a:b].tolist() for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))] == [a[0][:a[1][0]].tolist() for a in alone]
    assert odd == {}
    assert tokens._id_lists(model, tokens.Encoding(), [["cat"], ["中"]])[2]
