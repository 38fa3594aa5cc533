"""One query per operator over the given tables, each with the same result in SQL where there is one."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import labels as lab
from tagweave.functions import text as txt
from tagweave.operators import (align, examples, joins, metrics, packing, runs, sampling, scan, stats, tagging, tags, tokens, vocab)
from tagweave.plans import corpus
from tagweave.plans import fixtures as fx
from tagweave.session import BATCH_CONF, scratch_path, settle
from tagweave.sources import store, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_BAR = runs.PUNCT
_MASK = runs.MASK
_END = runs.WORD_END


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""
    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


# Sources and sinks

@query(fx.sql("", """
SELECT line, count(*) AS "count" FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
WHERE line <> '' GROUP BY line"""))
def load_lines(spark, folder):
    path = scratch_path(spark, "lines")
    fx.documents(spark, folder).select("text").write.text(path)
    return text.load_lines(spark, path).groupBy("line").count()


@query(fx.sql("raw_tagged", """
SELECT word, tag, count(*) AS "count" FROM raw_tagged WHERE word NOT LIKE '%|%' GROUP BY word, tag"""))
def load_tagged_corpus(spark, folder):
    path = scratch_path(spark, "tagged")
    tagged_lines(spark, folder).select("line").write.text(path)
    return tags.split_tagged(text.load_tagged_corpus(spark, path)).groupBy("word", "tag").count()


def tagged_lines(spark, folder):
    """One line of `word|tag` items per section of a document."""
    rows = fx.raw_tagged(spark, folder).withColumn("item", F.concat_ws("|", "word", "tag"))
    numbered = scan.running_sums(rows, "doc_id", "pos", {"line_no": (F.col("tag") == "punc").cast("int")})
    return numbered.groupBy("doc_id", "line_no").agg(runs.ordered(["pos"], F.col("item")).alias("i")).select(
        "doc_id", "line_no", F.array_join("i.v0", " ").alias("line"))


@query("""
WITH maps AS (SELECT * FROM (VALUES ('n.count', 'NOUN'), ('n.prop', 'NOUN'), ('v.past', 'VERB'), ('adj', 'PUNCT'),
    ('punc', 'PUNCT')) m(source_tag, target_tag)), """ + fx.sql("raw_tagged", """
SELECT source_tag, target_tag, count(*) AS words FROM raw_tagged JOIN maps ON tag = source_tag
GROUP BY source_tag, target_tag""").removeprefix("WITH "))
def load_tag_map(spark, folder):
    path = scratch_path(spark, "tag-map")
    spark.createDataFrame([(fx.TAG_MAP_TEXT,)], "value string").coalesce(1).write.text(path)
    mapping = text.load_tag_map(spark, path + "/*.txt")
    counts = fx.raw_tagged(spark, folder).groupBy("tag").agg(F.count(F.lit(1)).alias("words"))
    return counts.join(mapping, F.col("tag") == F.col("source_tag")).select("source_tag", "target_tag", "words")


@query(fx.sql("example_words", """
SELECT split, count(*) AS words, count(DISTINCT example_id) AS examples, sum(n_tokens)::BIGINT AS tokens
FROM example_words GROUP BY split"""))
def save_and_load_examples(spark, folder):
    path = scratch_path(spark, "examples")
    store.save_examples(fx.example_words(spark, folder), path)
    whole = store.load_examples(spark, path, "train").unionByName(store.load_examples(spark, path, "test"))
    per_example = whole.groupBy("split", "example_id").agg(
        F.count(F.lit(1)).alias("w"), F.sum(F.size("tokens")).alias("t"))
    return per_example.groupBy("split").agg(
        F.sum("w").alias("words"), F.count(F.lit(1)).alias("examples"), F.sum("t").alias("tokens"))


@query(fx.sql("words", """
SELECT source || '-maxseq-128-7' AS shard, count(*) AS words FROM words JOIN documents USING (doc_id) GROUP BY source"""))
def build_missing_shards(spark, folder):
    """First a run for some shards, then one for all: only the missing ones are built."""
    out = scratch_path(spark, "shards")
    source = fx.table(spark, folder, "documents").select(
        store.shard_name(F.concat(F.lit("/in/"), "source", F.lit(".txt")), 128, 7).alias("shard"), "text")

    def build(df):
        parts = F.array_remove(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), "")
        return df.select("shard", F.explode(parts).alias("word"))

    store.build_missing_shards(source.filter(F.col("shard").startswith("src1")), out, build)
    done = store.build_missing_shards(source, out, build)
    return done.groupBy("shard").agg(F.count(F.lit(1)).alias("words"))


@query(fx.sql("", """
SELECT count(*) AS lines, sum(length(line))::BIGINT AS characters FROM (
    SELECT unnest(string_split(text, chr(10))) AS line FROM documents
    UNION ALL SELECT unnest(string_split(text, chr(10))) FROM benchmark)"""))
def merge_files(spark, folder):
    base = scratch_path(spark, "merge")
    for name in ("documents", "benchmark"):
        fx.table(spark, folder, name).select("text").write.text(f"{base}/{name}")
    merged = text.merge_files(spark, base + "/*/*.txt")
    return merged.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"))


@query(fx.sql("section_ids", "SELECT doc_id, pos, section_pos FROM section_ids"))
def sections_of_lines(spark, folder):
    """Sections of tagged items that are ordered by line and place in the line; lines may be of any length."""
    rows = fx.tagged(spark, folder).withColumn("line_no", F.expr("pos div 1000")).withColumn("idx", F.expr("pos % 1000"))
    order = ("line_no", "idx")
    cut = scan.ranged(rows, "doc_id", order, stored=False)
    numbered = runs.number_runs(cut, "doc_id", order, F.col("tag") == runs.PUNCT, "section_pos", keep_open=True)
    return numbered.select("doc_id", "pos", "section_pos")


@query(fx.sql("words", "SELECT doc_id, count(*) AS words FROM words GROUP BY doc_id"))
def repartition(spark, folder):
    spread = store.repartition(fx.words(spark, folder), 10, "doc_id")
    return spread.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))


# Projections and filters

@query(fx.sql("raw_tagged", """
SELECT doc_id, pos, word, tag FROM raw_tagged WHERE word NOT LIKE '%|%'"""))
def split_tagged(spark, folder):
    items = fx.raw_tagged(spark, folder).select("doc_id", "pos", F.concat_ws("|", "word", "tag").alias("item"))
    return tags.split_tagged(items)


@query(fx.sql("raw_tagged", """
SELECT doc_id, pos, word, CASE tag WHEN 'n.count' THEN 'NOUN' WHEN 'n.prop' THEN 'NOUN' WHEN 'v.past' THEN 'VERB'
    WHEN 'punc' THEN 'PUNCT' ELSE 'unk' END AS tag FROM raw_tagged"""))
def map_tags(spark, folder):
    return tags.map_tags(fx.raw_tagged(spark, folder), fx.TAG_MAP_1, fx.TAG_MAP_2)


@query(fx.sql("units", """
SELECT doc_id, unit_pos, word, CASE WHEN tag <> 'PUNCT' AND count(*) OVER (PARTITION BY tag) <= 100 THEN 'unk'
    ELSE tag END AS tag FROM units"""))
def replace_rare(spark, folder):
    units = settle(fx.units(spark, folder), "zstd")
    return tags.replace_rare(units, 100).select("doc_id", "unit_pos", "word", "tag")


@query(fx.sql("token_rows", """
SELECT doc_id, label, count(*) AS "count", sum(pos * 100 + piece)::BIGINT AS places FROM (
    SELECT doc_id, pos, piece, CASE WHEN label <> '[MASK]' AND count(*) OVER (PARTITION BY label) < 30000 THEN 'UNK'
    ELSE label END AS label FROM token_rows) GROUP BY doc_id, label"""))
def replace_rare_labels(spark, folder):
    rows = fx.token_rows(spark, folder).select("doc_id", "pos", "piece", "label")
    common = tags.replace_rare(rows, 29999, tags.RARE, "label", protect=[_MASK], salt_by=["doc_id", "pos", "piece"])
    return common.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("pos") * 100 + F.col("piece")).alias("places"))


@query(fx.sql("tagged", """
SELECT tag = 'PUNCT' AS is_punct, count(*) AS words FROM tagged WHERE tag <> 'unk' GROUP BY 1"""))
def filter_tags(spark, folder):
    words = fx.tagged(spark, folder)
    punct = tags.only_tag(words, _BAR).withColumn("is_punct", F.lit(True))
    rest = tags.drop_tag(tags.drop_tag(words, _BAR), "unk").withColumn("is_punct", F.lit(False))
    return punct.unionByName(rest).groupBy("is_punct").agg(F.count(F.lit(1)).alias("words"))


@query(fx.sql("unit_rows section_ids", """
SELECT doc_id, section_pos, string_agg(word, '' ORDER BY pos) AS section, count(*) AS n FROM section_ids
GROUP BY doc_id, section_pos HAVING bool_or(tag = 'PUNCT') AND NOT bool_and(tag = 'PUNCT')"""))
def drop_punct_only(spark, folder):
    sections = runs.drop_punct_only(runs.build_sections(fx.tagged(spark, folder), order=("pos",)))
    return sections.select("doc_id", "section_pos", F.array_join("words", "").alias("section"),
                           F.size("words").cast("long").alias("n"))


_SPANS = dict(
    spans="""SELECT doc_id, section_pos, pos, word, tag, we - length(word) AS ws, we FROM (
        SELECT *, sum(length(word)) OVER (PARTITION BY doc_id, section_pos ORDER BY pos)::BIGINT AS we
        FROM section_rows)""",
    texts="""SELECT doc_id, section_pos, string_agg(word, '' ORDER BY pos) AS txt FROM section_rows
        GROUP BY doc_id, section_pos""",
    pieces="""SELECT doc_id, section_pos, k AS idx, substr(txt, (4 * k + 1)::INT, 4) AS value, 4 * k AS ts,
        least(4 * k + 4, length(txt)) AS te FROM (
        SELECT *, unnest(range((length(txt) + 3) // 4)) AS k FROM texts)""",
)


def _section_rows(spark, folder):
    """Not stored: a stored table loses the parts by document, and to deal its rows again moves more than to number them again."""
    return runs.section_rows(fx.tagged(spark, folder), block=fx.WHOLE)


def _section_spans(rows):
    return align.word_spans(rows, block=fx.WHOLE)


def _cut_sections(rows):
    """Pieces of four characters of the joined sections."""
    sections = rows.groupBy("doc_id", "section_pos").agg(runs.ordered(["pos"], F.col("word")).alias("i")).select(
        "doc_id", "section_pos", F.array_join("i.v0", "").alias("text"))
    return align.fixed_pieces(sections)


def _section_pieces(rows):
    """The pieces with spans found from their running lengths."""
    return align.token_spans(_cut_sections(rows).drop("start", "end"), block=fx.WHOLE)


_STATUS = """SELECT doc_id, section_pos, count(*) AS words, CASE WHEN bool_and(we % 4 = 0 OR we = total) THEN 'ok'
    ELSE 'bad' END AS status FROM (SELECT *, max(we) OVER (PARTITION BY doc_id, section_pos) AS total FROM spans)
    GROUP BY doc_id, section_pos"""


@query(fx.sql("section_rows", "SELECT status, count(*) AS sections, sum(words)::BIGINT AS words FROM st GROUP BY status",
              **_SPANS, st=_STATUS))
def drop_unaligned(spark, folder):
    rows = _section_rows(spark, folder)
    status = settle(align.alignment_status(_section_spans(rows), _section_pieces(rows), block=fx.WHOLE))
    both = tags.drop_unaligned(status).unionByName(tags.unaligned(status))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("sections"), F.sum("words").alias("words"))


_LABEL_CASE = """CASE upper({c}) WHEN 'NOUN' THEN 0 WHEN 'PROPN' THEN 1 WHEN 'VERB' THEN 2 WHEN 'ADJ' THEN 3
    WHEN 'PUNCT' THEN 5 WHEN '[MASK]' THEN 6 ELSE 4 END"""


@query(fx.sql("tagged", f"SELECT doc_id, pos, {_LABEL_CASE.format(c='tag')} AS label_id FROM tagged"))
def normalise_labels(spark, folder):
    rows = fx.tagged(spark, folder)
    return tags.normalise_labels(rows, fx.LABELS, "tag", salt_by=["doc_id", "pos"]).select("doc_id", "pos", "label_id")


@query(fx.sql("spread_rows", """
SELECT label, pred, count(*) AS "count" FROM spread_rows WHERE label <> '[MASK]' GROUP BY label, pred"""))
def drop_ignored(spark, folder):
    rows = fx.spread_rows(spark, folder).withColumn(
        "label_id", F.when(F.col("label") == _MASK, tags.IGNORED).otherwise(F.length("label")))
    kept = tags.drop_ignored(rows, label="label_id")
    return kept.groupBy("label", "pred").count()


@query(fx.sql("tagged", """
SELECT tag, count(*) AS support FROM tagged GROUP BY tag HAVING count(*) > 0 AND tag IN ('NOUN', 'VERB', 'PUNCT')"""))
def select_supported_labels(spark, folder):
    counts = fx.tagged(spark, folder).groupBy("tag").agg(F.count(F.lit(1)).alias("support"))
    return tags.select_labels(tags.keep_supported(counts), ["NOUN", "VERB", "PUNCT"], "tag")


@query(fx.sql("words", """SELECT word, count(*) AS "count" FROM words GROUP BY word HAVING count(*) > 100"""))
def keep_frequent(spark, folder):
    return tags.keep_frequent(stats.value_counts(fx.words(spark, folder), "word", sort=False), 100)


@query(fx.sql("", """
SELECT count(*) AS examples, sum(n)::BIGINT AS tokens FROM (
    SELECT len(list_filter(string_split(line, ' '), lambda w: w LIKE '%,')) AS n
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE n > 0"""))
def skip_empty_examples(spark, folder):
    cut = fx.documents(spark, folder).select(F.explode(F.split("text", "\n")).alias("line"))
    tokens = cut.select(F.filter(F.split("line", " "), lambda w: w.endswith(",")).alias("tokens"))
    return tags.skip_empty_examples(tokens).agg(
        F.count(F.lit(1)).alias("examples"), F.sum(F.size("tokens")).alias("tokens"))


@query(fx.sql("tagged", "SELECT doc_id, pos, length(word)::INT AS token, word AS text, tag FROM tagged"))
def explode_examples(spark, folder):
    nested = fx.tagged(spark, folder).withColumn("chunk", (F.col("pos") / 64).cast("long")).groupBy(
        "doc_id", "chunk").agg(runs.ordered(["pos"], F.length("word"), F.col("word"), F.col("tag")).alias("i"),
                               F.min("pos").alias("base"))
    examples_ = nested.select("doc_id", "base", F.col("i.v0").alias("tokens"), F.col("i.v1").alias("texts"),
                              F.col("i.v2").alias("tags"))
    return tags.explode_examples(examples_).select(
        "doc_id", (F.col("base") + F.col("pos")).alias("pos"), "token", "text", "tag")


# Joins

@query(fx.sql("tagged", f"""
SELECT {_LABEL_CASE.format(c='tag')} AS label_id, tag, count(*) AS words FROM tagged GROUP BY 1, 2"""))
def broadcast_lookup(spark, folder):
    ids = {name: i for i, name in fx.LABELS.items()} | {"unk": 4}
    rows = tags.map_labels(fx.tagged(spark, folder), ids, "tag", "label_id", "tag string, label_id int",
                           salt_by=["doc_id", "pos"])
    return rows.groupBy("label_id", "tag").agg(F.count(F.lit(1)).alias("words"))


@query(fx.sql("section_rows", """
SELECT p.doc_id, p.section_pos, p.idx, p.value, CASE WHEN count(s.pos) = 0 THEN '[MASK]'
    ELSE array_to_string(list_sort(list_distinct(flatten(list(CASE
        WHEN s.ws < p.te AND s.we > p.ts AND s.we <= p.te THEN [upper(s.tag), '[WORD_END]']
        WHEN s.ws < p.te AND s.we > p.ts THEN [upper(s.tag)] ELSE ['[WORD_END]'] END)))), '+') END AS label
FROM pieces p LEFT JOIN spans s ON s.doc_id = p.doc_id AND s.section_pos = p.section_pos
    AND ((s.ws < p.te AND s.we > p.ts) OR (s.we > p.ts AND s.we <= p.te))
GROUP BY p.doc_id, p.section_pos, p.idx, p.value""", **_SPANS))
def label_tokens_by_overlap(spark, folder):
    rows = _section_rows(spark, folder)
    labelled = align.label_tokens_by_overlap(_cut_sections(rows), _section_spans(rows), longest=4)
    return labelled.select("doc_id", "section_pos", "idx", "value", "label")


_TRAINED = {"ew": "SELECT * FROM example_words",
            "trained": "SELECT DISTINCT key FROM ew WHERE split = 'train'"}


def _split_vocab(spark, folder, *columns):
    """Words of the examples with their keys; of (example_id, word_pos, key, tokens, tag, split) only `columns` are stored."""
    rows = fx.example_words(spark, folder)
    return settle(rows.withColumn("key", lab.token_key(F.col("tokens"))).select(*columns))


def _vocab_sides(spark, folder):
    """Distinct (key, split) of the words of the examples, stored."""
    rows = fx.example_words(spark, folder)
    return settle(rows.select(lab.token_key(F.col("tokens")).alias("key"), "split").distinct())


@query(fx.sql("example_words", """
SELECT example_id, min(word_pos) AS word_pos, key, min_by(n_tokens, word_pos) AS n_tokens,
    min_by(tag, word_pos) AS tag FROM ew ANTI JOIN trained USING (key) WHERE split = 'test'
    GROUP BY example_id, key""", **_TRAINED))
def oov_occurrences(spark, folder):
    rows = _split_vocab(spark, folder, "example_id", "word_pos", "key", "tokens", "tag", "split")
    test = rows.filter("split = 'test'").select("example_id", "word_pos", "key", "tokens", "tag")
    found = joins.oov_occurrences(test, rows.filter("split = 'train'"))
    return found.select("example_id", "word_pos", "key", F.size("tokens").cast("long").alias("n_tokens"), "tag")


@query(fx.sql("example_words", """
SELECT example_id, word_pos, key FROM ew ANTI JOIN trained USING (key) WHERE split = 'test'""", **_TRAINED))
def filter_test_only_tokens(spark, folder):
    rows = _split_vocab(spark, folder, "example_id", "word_pos", "key", "split")
    test, train = (rows.filter(F.col("split") == s).drop("split") for s in ("test", "train"))
    return joins.filter_test_only_tokens(test, train, "key", salt_by=["example_id", "word_pos"])


@query(fx.sql("predicted", "SELECT doc_id, pos, tag AS label, pred FROM predicted"))
def zip_predictions(spark, folder):
    rows = fx.predicted(spark, folder)
    return joins.zip_predictions(rows.select("doc_id", "pos", "pred"),
                                 rows.select("doc_id", "pos", F.col("tag").alias("label")), ["doc_id", "pos"])


@query(fx.sql("example_words", """
SELECT key FROM example_words WHERE split = 'test' INTERSECT SELECT key FROM example_words WHERE split = 'train'"""))
def in_both(spark, folder):
    rows = _vocab_sides(spark, folder)
    return joins.in_both(rows.filter("split = 'test'").select("key"), rows.filter("split = 'train'").select("key"))


# Aggregations

@query(fx.sql("units", """SELECT tag, count(*) AS "count" FROM units GROUP BY tag"""))
def value_counts(spark, folder):
    return stats.value_counts(fx.units(spark, folder), "tag")


@query(fx.sql("tagged", """
SELECT count(*) FILTER (tag = 'unk') AS hits, count(*) AS total, count(*) FILTER (tag = 'unk') / count(*) AS rate
FROM tagged"""))
def tag_rate(spark, folder):
    return stats.tag_rate(fx.tagged(spark, folder), "unk")


@query(fx.sql("units", """
SELECT count(*) FILTER (n > 100) AS frequent_values, count(*) AS all_values,
    (sum(n) FILTER (n > 100))::BIGINT / sum(n)::BIGINT AS covered, (sum(n) FILTER (n < 100))::BIGINT / sum(n)::BIGINT AS lost
FROM (SELECT tag, count(*) AS n FROM units GROUP BY tag)"""))
def coverage(spark, folder):
    return stats.coverage(stats.value_counts(fx.units(spark, folder), "tag", sort=False), 100)


@query(fx.sql("tagged", "SELECT DISTINCT word FROM tagged WHERE tag = 'PUNCT'"))
def distinct_values(spark, folder):
    return stats.distinct_values(tags.only_tag(fx.tagged(spark, folder), _BAR), "word")


@query(fx.sql("units", """SELECT count(DISTINCT tag) AS "values" FROM units"""))
def distinct_count(spark, folder):
    return stats.distinct_count(fx.units(spark, folder), "tag")


@query(fx.sql("example_words", "SELECT DISTINCT key FROM example_words WHERE split = 'train'"))
def vocabulary(spark, folder):
    return stats.vocabulary(fx.example_words(spark, folder).filter("split = 'train'"))


@query(fx.sql("example_words", """
SELECT 'characters' AS kind, length(key) AS length, count(*) AS "count" FROM keys GROUP BY 2
UNION ALL SELECT 'tokens', len(string_split(key, ' ')), count(*) FROM keys GROUP BY 2""",
              keys="SELECT DISTINCT key FROM example_words"))
def word_length_histogram(spark, folder):
    words = stats.vocabulary(fx.example_words(spark, folder))
    kinds = [stats.word_length_histogram(words, by=by).select(
        F.lit(by).alias("kind"), F.col("length").cast("long").alias("length"), "count") for by in ("characters", "tokens")]
    return kinds[0].unionByName(kinds[1])


@query(fx.sql("example_words", """
SELECT split, count(*) AS examples, sum(n_tokens)::BIGINT AS tokens FROM example_words GROUP BY split"""))
def split_sizes(spark, folder):
    return stats.split_sizes(fx.example_words(spark, folder))


@query(fx.sql("words", "SELECT count(*) AS rows FROM words"))
def count_rows(spark, folder):
    return stats.count_rows(fx.words(spark, folder))


_CONFUSION = dict(
    conf=f"""SELECT {_LABEL_CASE.format(c='label')} AS label, {_LABEL_CASE.format(c='pred')} AS pred, count(*) AS n
        FROM spread_rows GROUP BY 1, 2""",
    totals="""SELECT label, sum(tp) AS tp, sum(p) AS predicted, sum(s) AS support FROM (
        SELECT label, CASE WHEN label = pred THEN n ELSE 0 END AS tp, 0 AS p, n AS s FROM conf
        UNION ALL SELECT pred, 0, n, 0 FROM conf) GROUP BY label""",
    prf="""SELECT i AS label, coalesce(tp, 0)::BIGINT AS tp, coalesce(predicted, 0)::BIGINT AS predicted,
        coalesce(support, 0)::BIGINT AS support FROM range(0, 9) r(i) LEFT JOIN totals ON i = label""",
    per_label="""SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
        CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1, support FROM prf""",
    report="""SELECT label::INT AS label_id, tag, precision, recall, f1, support,
        support / CASE WHEN tag = '[MASK]' THEN sum(support) OVER () ELSE sum(support) FILTER (tag <> '[MASK]') OVER ()
        END::BIGINT AS support_share, tag = '[MASK]' AS is_mask FROM (
        SELECT *, coalesce((MAP {0: 'NOUN', 1: 'PROPN', 2: 'VERB', 3: 'ADJ', 4: 'UNK', 5: 'PUNCT', 6: '[MASK]',
            8: 'RARE'})[label], 'WTF') AS tag FROM per_label)""",
)


def _confusion(spark, folder):
    rows = fx.spread_rows(spark, folder)
    named = rows.groupBy("label", "pred").count()  # few distinct pairs: ids are looked up after counting
    ids = tags.normalise_labels(named, fx.LABELS, "label", "l", salt_by=["label", "pred"])
    ids = tags.normalise_labels(ids, fx.LABELS, "pred", "p", salt_by=["label", "pred"])
    return ids.groupBy(F.col("l").alias("label"), F.col("p").alias("pred")).agg(F.sum("count").alias("count"))


def _label_ids(spark):
    return metrics.label_range(spark.createDataFrame([(i,) for i in fx.LABELS], "label_id int"))


@query(fx.sql("predicted", """SELECT tag AS label, pred, count(*) AS "count" FROM predicted GROUP BY tag, pred"""))
def confusion_counts(spark, folder):
    return metrics.confusion_counts(fx.predicted(spark, folder), "tag", "pred")


@query("""
WITH c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2),
r AS (SELECT label, sum(hit) AS tp, sum(pred) AS predicted, sum(truth) AS support FROM (
        SELECT t AS label, CASE WHEN t = p THEN n ELSE 0 END AS hit, 0 AS pred, n AS truth FROM c
        UNION ALL SELECT p, 0, n, 0 FROM c) GROUP BY label)
SELECT label, round(CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END, 9) AS precision,
    round(CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END, 9) AS recall,
    round(CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (predicted + support) END, 9) AS f1,
    support::BIGINT AS support FROM r""")
def label_metrics(spark, folder):
    """Metrics on given labels: `quality` as the truth, `toxic` as the prediction."""
    rows = metrics.prf_per_label(metrics.confusion_counts(fx.table(spark, folder, "labels"), "quality", "toxic"))
    return rows.select("label", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")], "support")


@query(fx.sql("spread_rows", "SELECT label::INT AS label, precision, recall, f1, support FROM per_label", **_CONFUSION))
def prf_per_label(spark, folder):
    return metrics.prf_per_label(_confusion(spark, folder), _label_ids(spark))


_WEIGHTED = """SELECT '{o}' AS orientation, round(sum(precision * support) / sum(support), 9) AS precision,
    round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1,
    sum(support)::BIGINT AS support FROM """


@query(fx.sql("spread_rows", _WEIGHTED.format(o="truth") + "per_label UNION ALL " + _WEIGHTED.format(o="swapped") + """
(SELECT recall AS precision, precision AS recall, f1, predicted AS support FROM per_label JOIN (
    SELECT label, predicted FROM prf) USING (label))""", **_CONFUSION))
def prf_weighted(spark, folder):
    confusion = _confusion(spark, folder)
    both = [metrics.prf_weighted(confusion, swap).withColumn("orientation", F.lit(name))
            for swap, name in ((False, "truth"), (True, "swapped"))]
    return both[0].unionByName(both[1]).select(
        "orientation", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")], "support")


@query(fx.sql("spread_rows", "SELECT * FROM report", **_CONFUSION))
def metrics_report(spark, folder):
    report = metrics.metrics_report(metrics.prf_per_label(_confusion(spark, folder), _label_ids(spark)), fx.LABELS)
    return metrics.sorted_report(report)


@query(fx.sql("spread_rows", """
SELECT round(sum(precision * support_share), 9) AS precision, round(sum(recall * support_share), 9) AS recall,
    round(sum(f1 * support_share), 9) AS f1 FROM report WHERE NOT is_mask""", **_CONFUSION))
def report_totals(spark, folder):
    report = metrics.metrics_report(metrics.prf_per_label(_confusion(spark, folder), _label_ids(spark)), fx.LABELS)
    totals = metrics.report_totals(report)
    return totals.select(*[F.round(m, 9).alias(m) for m in totals.columns])


_SCOPES = {
    "ew": """SELECT e.*, t.key IS NOT NULL AS seen, row_number() OVER (PARTITION BY example_id, e.key ORDER BY word_pos) = 1
        AS leads FROM example_words e LEFT JOIN (SELECT DISTINCT key FROM example_words WHERE split = 'train') t
        ON e.key = t.key WHERE split = 'test'""",
    "tokens": f"""SELECT seen, leads, CASE WHEN piece = 0 THEN tag ELSE '[MASK]' END AS label,
        CASE WHEN piece = 0 THEN CASE WHEN tag <> 'PUNCT' AND word_pos % 7 = 0
            THEN ({fx._NAMES_SQL})[((n_tokens + 1) % 5 + 1)::INT] ELSE tag END
            WHEN word_pos % 11 = 0 THEN tag ELSE '[MASK]' END AS pred
        FROM (SELECT *, unnest(range(n_tokens)) AS piece FROM ew)""",
    "conf": f"""SELECT scope, {_LABEL_CASE.format(c='label')} AS label, {_LABEL_CASE.format(c='pred')} AS pred, count(*) AS n
        FROM (SELECT 'all' AS scope, label, pred FROM tokens UNION ALL SELECT 'seen', label, pred FROM tokens WHERE seen
            UNION ALL SELECT 'unseen', label, pred FROM tokens WHERE leads AND NOT seen) GROUP BY ALL""",
    "prf": """SELECT scope, i AS label,
        coalesce((SELECT sum(n) FROM conf c WHERE c.scope = s.scope AND c.label = i AND c.pred = i), 0) AS tp,
        coalesce((SELECT sum(n) FROM conf c WHERE c.scope = s.scope AND c.pred = i), 0) AS predicted,
        coalesce((SELECT sum(n) FROM conf c WHERE c.scope = s.scope AND c.label = i), 0)::BIGINT AS support
        FROM (VALUES ('all'), ('seen'), ('unseen')) s(scope), range(0, 9) r(i)""",
    "named": """SELECT *, coalesce((MAP {0: 'NOUN', 1: 'PROPN', 2: 'VERB', 3: 'ADJ', 4: 'UNK', 5: 'PUNCT', 6: '[MASK]',
        8: 'RARE'})[label], 'WTF') AS tag FROM prf""",
    "report": """SELECT scope, label::INT AS label_id, tag, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
        CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1, support,
        support / nullif(CASE WHEN tag = '[MASK]' THEN sum(support) OVER (PARTITION BY scope)
            ELSE sum(support) FILTER (tag <> '[MASK]') OVER (PARTITION BY scope) END, 0)::BIGINT AS support_share,
        tag = '[MASK]' AS is_mask FROM named""",
}


def _scope_report(spark, folder):
    found = joins.occurrence_counts(fx.scored_words(spark, folder), F.col("split") == "train")
    counts = metrics.scoped_confusion(found)
    for side in ("label", "pred"):
        counts = tags.normalise_labels(counts, fx.LABELS, side, f"{side}_id", salt_by=["scope", "label", "pred"])
    ids = counts.groupBy("scope", F.col("label_id").alias("label"), F.col("pred_id").alias("pred")).agg(
        F.sum("count").alias("count"))
    per_label = metrics.prf_per_label(ids, metrics.labels_of_scopes(_label_ids(spark)), by="scope")
    return metrics.metrics_report(per_label, fx.LABELS, by="scope")


@query(fx.sql("example_words", "SELECT * FROM report", **_SCOPES))
def scope_report(spark, folder):
    """Metrics of all words, of those that training saw and of those it never saw, in one pass."""
    return _scope_report(spark, folder)


@query(fx.sql("example_words", """
SELECT scope, round(sum(precision * support_share), 9) AS precision, round(sum(recall * support_share), 9) AS recall,
    round(sum(f1 * support_share), 9) AS f1 FROM report WHERE NOT is_mask GROUP BY scope""", **_SCOPES))
def scope_totals(spark, folder):
    totals = metrics.report_totals(_scope_report(spark, folder), by="scope")
    return totals.select("scope", *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")])


@query(fx.sql("spread_rows", """
SELECT count(*) FILTER (good) AS correct, count(*) AS words, count(*) FILTER (good) / count(*) AS accuracy FROM (
    SELECT doc_id, pos, bool_and(label = pred) AS good FROM spread_rows GROUP BY doc_id, pos)"""))
def word_accuracy(spark, folder):
    # each word starts with its tag and goes on with masks, so words of the stream are words of the text
    return metrics.word_accuracy(fx.spread_rows(spark, folder), _MASK, "doc_id", ("pos", "piece"))


@query(fx.sql("", """
SELECT char, n AS "count" FROM (SELECT char, n, sum(n) OVER (ORDER BY n DESC, char) - n AS before,
    sum(n) OVER () AS total FROM (SELECT unnest(string_split(text, '')) AS char, count(*) AS n FROM documents GROUP BY 1))
WHERE before < 0.995 * total"""))
def char_coverage(spark, folder):
    return stats.char_coverage(stats.char_counts(fx.documents(spark, folder)), 0.995)


# Runs

@query(fx.sql("units", "SELECT * FROM units"))
def build_units(spark, folder):
    return fx.units(spark, folder)


@query(fx.sql("units", """
SELECT doc_id, section_pos, string_agg(word, '|' ORDER BY unit_pos) AS section,
    string_agg(tag, '|' ORDER BY unit_pos) AS tags FROM units GROUP BY doc_id, section_pos HAVING bool_or(tag = 'PUNCT')"""))
def build_sections(spark, folder):
    sections = runs.build_sections(fx.units(spark, folder), section="section_pos")
    return sections.select("doc_id", "section_pos", lab.bar_view(F.col("words")).alias("section"),
                           lab.bar_view(F.col("tags")).alias("tags"))


@query(fx.sql("section_rows", """
SELECT doc_id, section_pos, string_agg(word || '/' || tag, ' ' ORDER BY pos) AS items FROM section_rows
GROUP BY doc_id, section_pos"""))
def flatten_sections(spark, folder):
    sections = runs.flatten_sections(fx.tagged(spark, folder))
    shown = F.transform("items", lambda i: F.concat_ws("/", i.getField("word"), i.getField("tag")))
    return sections.select("doc_id", "section_pos", F.array_join(shown, " ").alias("items"))


@query(fx.sql("token_rows", """
SELECT doc_id, word_pos, string_agg(token::VARCHAR, ' ' ORDER BY piece) AS tokens, array_to_string(list_sort(list_distinct(
    list_filter(flatten(list(string_split(label, '+'))), lambda x: x <> '[WORD_END]'))), '+') AS tag
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS word_pos FROM token_rows)
WHERE label <> '[MASK]' GROUP BY doc_id, word_pos"""))
def regroup_words(spark, folder):
    rows = runs.regroup_words(fx.token_rows(spark, folder), "doc_id", ("pos", "piece"))
    return rows.select("doc_id", "word_pos", lab.token_key(F.col("tokens")).alias("tokens"), "tag")


@query(fx.sql("spread_rows", """
SELECT doc_id, word_pos, string_agg(token::VARCHAR, ' ' ORDER BY piece) AS tokens, min(label) FILTER (piece = 0) AS tag
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY pos) AS word_pos FROM spread_rows)
GROUP BY doc_id, word_pos"""))
def words_from_tags(spark, folder):
    rows = runs.words_from_tags(fx.spread_rows(spark, folder), "doc_id", ("pos", "piece"))
    return rows.select("doc_id", "word_pos", lab.token_key(F.col("tokens")).alias("tokens"), "tag")


@query(fx.sql("section_rows", """SELECT doc_id, section_pos, pos, word, ws AS "start", we AS "end" FROM spans""", **_SPANS))
def word_spans(spark, folder):
    return _section_spans(_section_rows(spark, folder)).select("doc_id", "section_pos", "pos", "word", "start", "end")


@query(fx.sql("section_rows", """SELECT doc_id, section_pos, idx, value, ts AS "start", te AS "end" FROM pieces""", **_SPANS))
def token_spans(spark, folder):
    return _section_pieces(_section_rows(spark, folder)).select("doc_id", "section_pos", "idx", "value", "start", "end")


@query(fx.sql("spread_rows", """
SELECT doc_id, pos, max(label) FILTER (label <> '[MASK]') AS label, count(*) AS places FROM spread_rows
GROUP BY doc_id, pos"""))
def ffill_labels(spark, folder):
    rows = fx.spread_rows(spark, folder).select("doc_id", "pos", "piece", "label")
    filled = metrics.ffill_labels(rows, _MASK, "doc_id", ("pos", "piece"))
    return filled.groupBy("doc_id", "pos", "label").agg(F.count(F.lit(1)).alias("places"))


@query(fx.sql("section_rows", """
SELECT doc_id, section_pos, string_agg(CASE WHEN length(word) > 1 THEN tag || repeat(' [MASK]', length(word) - 1)
    ELSE tag END, ' ' ORDER BY pos) AS labels, sum(length(word))::BIGINT AS n FROM section_rows
GROUP BY doc_id, section_pos"""))
def spread_labels(spark, folder):
    nested = runs.flatten_sections(fx.tagged(spark, folder)).select(
        "doc_id", "section_pos", F.transform("items.word", fx.code_points).alias("tokens"),
        F.col("items.tag").alias("tags"))
    return examples.spread_labels(nested).select(
        "doc_id", "section_pos", F.array_join("labels", " ").alias("labels"), F.size("tokens").cast("long").alias("n"))


@query(fx.sql("tagged", """
SELECT tag, count(*) AS support, count(*) / sum(count(*)) OVER ()::BIGINT AS support_share FROM tagged GROUP BY tag"""))
def support_share(spark, folder):
    counts = fx.tagged(spark, folder).groupBy("tag").agg(F.count(F.lit(1)).alias("support"))
    return stats.support_share(counts)


# Sorts, samples, splits

@query(fx.sql("tagged", """SELECT tag, count(*) AS "count" FROM tagged GROUP BY tag"""))
def sort_counts(spark, folder):
    return stats.sort_counts(fx.tagged(spark, folder).groupBy("tag").count(), "tag", ascending=True)


@query(fx.sql("units", """SELECT tag, count(*) AS "count" FROM units GROUP BY tag ORDER BY 2 DESC, tag LIMIT 10"""))
def top(spark, folder):
    return stats.top(fx.units(spark, folder).groupBy("tag").count(), 10, "count", "tag")


@query(fx.sql("lines", f"""
SELECT doc_id, line_no, CASE WHEN {fx.hash_sql("doc_id || '|' || line_no", fx.SEED)} % 1000000 < 100000 THEN 'test'
    ELSE 'train' END AS split FROM lines"""))
def split_bernoulli(spark, folder):
    rows = fx.lines(spark, folder).select("doc_id", "line_no")
    return sampling.split_bernoulli(rows, 0.1, fx.SEED, ["doc_id", "line_no"])


_RANKED = f"""SELECT doc_id, line_no, row_number() OVER (ORDER BY
    {fx.hash_sql("doc_id || '|' || line_no", fx.SEED)}, doc_id, line_no) AS r, count(*) OVER () AS n FROM lines"""


@query(fx.sql("lines", """
SELECT doc_id, line_no, CASE WHEN r <= floor(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM ranked""", ranked=_RANKED))
def split_exact(spark, folder):
    rows = fx.lines(spark, folder).select("doc_id", "line_no")
    return sampling.split_exact(rows, 0.1, fx.SEED, ["doc_id", "line_no"])


@query(fx.sql("lines", "SELECT doc_id, line_no FROM ranked WHERE r <= 500", ranked=_RANKED))
def sample_lines(spark, folder):
    return sampling.sample_lines(fx.lines(spark, folder).select("doc_id", "line_no"), 500, fx.SEED)


@query(fx.sql("lines", "SELECT doc_id, line_no FROM lines"))
def shuffle_examples(spark, folder):
    rows = fx.lines(spark, folder).select("doc_id", "line_no")
    return sampling.shuffle_examples(rows, fx.SEED, ["doc_id", "line_no"])


# Set operations

@query(fx.sql("example_words", """
SELECT key, 'train' AS side FROM (SELECT key FROM example_words WHERE split = 'train' EXCEPT
    SELECT key FROM example_words WHERE split = 'test')
UNION ALL SELECT key, 'test' FROM (SELECT key FROM example_words WHERE split = 'test' EXCEPT
    SELECT key FROM example_words WHERE split = 'train')"""))
def only_in(spark, folder):
    rows = _vocab_sides(spark, folder)
    train, test = (rows.filter(F.col("split") == s).select("key") for s in ("train", "test"))
    return joins.only_in(train, test).withColumn("side", F.lit("train")).unionByName(
        joins.only_in(test, train).withColumn("side", F.lit("test")))


@query(fx.sql("predicted", "SELECT tag AS label FROM predicted UNION SELECT pred FROM predicted"))
def label_universe(spark, folder):
    rows = fx.predicted(spark, folder)
    return joins.label_universe(rows.select(F.col("tag").alias("label")), rows.select("pred"))


# Text functions

@query(fx.sql("lines", """
SELECT doc_id, line_no, array_to_string([s for s in string_split(replace(line, '.', ''), ',') if s <> ''], ' ') AS line
FROM lines"""))
def syllable_lines(spark, folder):
    return fx.lines(spark, folder).select(
        "doc_id", "line_no", txt.syllable_line(F.col("line"), ".", ",").alias("line"))


@query(fx.sql("words", """
SELECT doc_id, pos, replace(word, ',', '.') AS unified, right(word, 1) AS last, word LIKE '%,' AS closes,
    length(word) AS size FROM words"""))
def word_endings(spark, folder):
    w = F.col("word")
    return fx.words(spark, folder).select(
        "doc_id", "pos", txt.unify_tsheg(w, ",", ".").alias("unified"), txt.last_char(w).alias("last"),
        txt.ends_with(w, ",").alias("closes"), F.length(w).cast("long").alias("size"))


@query(fx.sql("units", """
SELECT doc_id, unit_pos, array_to_string(list_sort(list_distinct([upper(t) for t in string_split(tag, '+')])), '+') AS tags,
    len(string_split(tag, '+')) AS n, list_position(string_split(tag, '+'), 'VERB') - 1 AS verb_at FROM units"""))
def label_sets(spark, folder):
    parts = lab.split_tags(F.col("tag"))
    return fx.units(spark, folder).select(
        "doc_id", "unit_pos", lab.label_set(parts).alias("tags"), F.size(parts).cast("long").alias("n"),
        lab.first_index(parts, F.lit("VERB")).alias("verb_at"))


@query(fx.sql("", """
SELECT doc_id, list_position(s, list_max(s)) - 1 AS best, array_to_string(s[2:len(s)-1], ' ') AS inner_scores FROM (
    SELECT doc_id, [length(x) for x in string_split(text, chr(10))] AS s FROM documents)"""))
def argmax_scores(spark, folder):
    scores = F.transform(F.split("text", "\n"), F.length)
    rows = fx.documents(spark, folder).select("doc_id", scores.alias("s"))
    return rows.select("doc_id", lab.argmax(F.col("s")).alias("best"),
                       F.array_join(lab.strip_ends(F.col("s")).cast("array<string>"), " ").alias("inner_scores"))


@query(fx.sql("", """
SELECT doc_id, lower(strip_accents(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS text FROM documents"""))
def clean_text(spark, folder):
    return fx.documents(spark, folder).select(
        "doc_id", txt.clean_text(F.col("text"), keep_accents=False).alias("text"))


# Tokenisation

@query(fx.sql("", """
SELECT doc_id, len(p) AS pieces, array_to_string(p, '|') AS text FROM (
    SELECT doc_id, [x for x in regexp_extract_all(text, '[^,.]*[,.]|[^,.]+') if x <> ''] AS p FROM documents)"""))
def presplit(spark, folder):
    parts = txt.presplit(F.col("text"), [",", "."])
    return fx.documents(spark, folder).select(
        "doc_id", F.size(parts).cast("long").alias("pieces"), F.array_join(parts, "|").alias("text"))


@query(fx.sql("", """
SELECT doc_id, (length(text) - length(replace(text, 'the', '')))/3 AS swapped,
    length(replace(replace(text, 'the', '#'), 'on', '#')) AS size, text FROM documents""").replace("/3", "//3"))
def protect_specials(spark, folder):
    specials = ["the", "on"]
    safe = txt.protect_specials(F.col("text"), specials)
    count = F.length(safe) - F.length(F.replace(safe, F.lit(chr(0xF0000)), F.lit("")))
    return fx.documents(spark, folder).select(
        "doc_id", count.cast("long").alias("swapped"), F.length(safe).cast("long").alias("size"),
        txt.unescape(safe, specials).alias("text"))


@query(fx.sql("lines", """
SELECT DISTINCT s AS syllable FROM (SELECT unnest(string_split(replace(line, '.', ''), ',')) AS s FROM lines) WHERE s <> ''"""))
def syllable_vocab(spark, folder):
    return vocab.syllable_vocab(fx.lines(spark, folder), drop=".", mark=",")


@query(fx.sql("", """
SELECT doc_id, generate_subscripts(p, 1) - 1 AS part_no, unnest(p) AS part FROM (
    SELECT doc_id, string_split(text, '. ') AS p FROM documents)"""))
def split_registers(spark, folder):
    return fx.documents(spark, folder).select(
        "doc_id", F.posexplode(txt.split_registers(F.col("text"), ". ")).alias("part_no", "part")).withColumn(
        "part_no", F.col("part_no").cast("long"))


@query(fx.sql("section_rows", """
SELECT p.doc_id, p.section_pos, p.idx, p.value, count(s.pos) AS word_idx, any_value(st.status) AS status
FROM pieces p JOIN st USING (doc_id, section_pos)
LEFT JOIN spans s ON s.doc_id = p.doc_id AND s.section_pos = p.section_pos AND s.we < p.te
    AND (s.we % 4 = 0)
GROUP BY p.doc_id, p.section_pos, p.idx, p.value""", **_SPANS, st=_STATUS))
def align_pieces(spark, folder):
    rows = _section_rows(spark, folder)
    return align.align_pieces(_section_pieces(rows), _section_spans(rows), block=fx.WHOLE).select(
        "doc_id", "section_pos", "idx", "value", "word_idx", "status")


# Examples

@query(fx.sql("chars", """
SELECT doc_id, pos, count(*) AS pieces, sum(token * (piece + 1))::BIGINT AS tokens,
    string_agg(CASE WHEN piece = 0 THEN piece || ':' || tag END, ' ' ORDER BY piece) AS labels FROM chars
GROUP BY doc_id, pos"""))
def word_piece_labels(spark, folder):
    rows = fx.tagged(spark, folder).select("doc_id", "pos", fx.code_points(F.col("word")).alias("tokens"), "tag")
    labelled = examples.word_piece_labels(rows)
    return labelled.groupBy("doc_id", "pos").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(F.col("token") * (F.col("piece") + 1)).alias("tokens"),
        F.max(F.when(F.col("label").isNotNull(), F.concat_ws(":", "piece", "label"))).alias("labels"))


def _line_examples(spark, folder):
    """One example per line: word lengths as tokens, the last character's code point as label."""
    w = F.array_remove(F.split("line", " "), "")
    return fx.lines(spark, folder).select(
        "doc_id", "line_no", F.transform(w, F.length).alias("tokens"),
        F.transform(w, lambda x: F.ascii(F.right(x, F.lit(1)))).alias("labels"))


_LINE_EXAMPLES = """SELECT doc_id, line_no, [length(w) for w in ws] AS tokens, [unicode(right(w, 1)) for w in ws] AS labels
    FROM (SELECT doc_id, line_no, [w for w in string_split(line, ' ') if w <> ''] AS ws FROM lines)"""
_PLACED = """SELECT *, coalesce(sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ex"""


@query(fx.sql("lines", """
SELECT doc_id, start // 128 AS seq_no, array_to_string(flatten(list(tokens ORDER BY line_no)), ' ') AS tokens,
    array_to_string(flatten(list(labels ORDER BY line_no)), ' ') AS labels FROM placed GROUP BY doc_id, start // 128""",
              ex=_LINE_EXAMPLES, placed=_PLACED))
def pack_examples(spark, folder):
    packed = examples.pack_examples(_line_examples(spark, folder), 128, order=("line_no",))
    return packed.select("doc_id", "seq_no", lab.token_key(F.col("tokens")).alias("tokens"),
                         lab.token_key(F.col("labels")).alias("labels"))


@query(fx.sql("words", """
SELECT doc_id, pos, word, walk FROM words, range(0, 3) r(walk) WHERE pos >= 3 * walk"""))
def walks(spark, folder):
    return examples.walks(fx.words(spark, folder), 2, 3, "pos").withColumn("walk", F.col("walk").cast("long"))


@query(fx.sql("lines", """
SELECT doc_id, line_no, array_to_string([CASE WHEN i < n THEN tokens[i + 1] ELSE 0 END for i in range(32)], ' ') AS input_ids,
    array_to_string([CASE WHEN i < n THEN labels[i + 1] ELSE -100 END for i in range(32)], ' ') AS label_ids,
    array_to_string([CASE WHEN i < n THEN 1 ELSE 0 END for i in range(32)], ' ') AS attention_mask,
    array_to_string([0 for i in range(32)], ' ') AS token_type_ids, greatest(n - 32, 0)::INT AS cut FROM (SELECT *, len(tokens) AS n FROM ex)""",
              ex=_LINE_EXAMPLES))
def truncate_pad(spark, folder):
    rows = examples.truncate_pad(_line_examples(spark, folder), 32, labels="labels")
    return rows.select("doc_id", "line_no", *[lab.token_key(F.col(c)).alias(c) for c in (
        "input_ids", "label_ids", "attention_mask", "token_type_ids")], "cut")


@query(fx.sql("tagged", """
SELECT (row_number() OVER (ORDER BY late, label) - 1)::INT AS label_id, label FROM (
    SELECT DISTINCT 0 AS late, tag AS label FROM tagged UNION ALL SELECT 1, '[MASK]' UNION ALL SELECT 2, 'UNK')"""))
def build_label_map(spark, folder):
    return examples.build_label_map(fx.tagged(spark, folder), "tag", [_MASK, "UNK"])


_SEQS = """SELECT doc_id, place // 128 AS seq_no, list(token ORDER BY place) AS tokens FROM (
    SELECT doc_id, start + generate_subscripts(tokens, 1) - 1 AS place, unnest(tokens) AS token FROM placed)
    GROUP BY doc_id, place // 128"""
_CUT = fx.hash_sql("doc_id || '|' || seq_no", f"{fx.SEED}-cut")
_SHORT = fx.hash_sql("doc_id || '|' || seq_no", f"{fx.SEED}-short")


_WINDOWS = dict(ex=_LINE_EXAMPLES, placed=_PLACED, seqs=_SEQS,
                cuts=f"""SELECT *, {_SHORT} % 1000000 < 50000 AND cut < len(tokens) AS short FROM (
                    SELECT *, 2 + {_CUT} % 125 AS cut FROM seqs)""",
                halves="""SELECT doc_id, seq_no, 0 AS half, CASE WHEN short THEN tokens[:cut] ELSE tokens END AS tokens
                    FROM cuts UNION ALL SELECT doc_id, seq_no, 1, tokens[cut + 1:] FROM cuts WHERE short""")


@query(fx.sql("lines", """
SELECT doc_id, seq_no, half, array_to_string(tokens, ' ') AS tokens FROM halves""", **_WINDOWS))
def mlm_windows(spark, folder):
    rows = examples.mlm_windows(_line_examples(spark, folder), 128, 0.05, fx.SEED)
    return rows.select("doc_id", "seq_no", "half", lab.token_key(F.col("tokens")).alias("tokens"))


_BUDGET = 125
_AT = "doc_id || '|' || p.ofs"
_SEQ = "doc_id || '|' || seq_at"
_PACKED = dict(
    cut=f"""SELECT doc_id, line_no, k, tokens[k * {_BUDGET} + 1 : (k + 1) * {_BUDGET}] AS tokens FROM (
        SELECT *, unnest(range((len(tokens) + {_BUDGET - 1}) // {_BUDGET})) AS k FROM ex)""",
    places="""SELECT *, len(tokens) AS n, coalesce(sum(len(tokens)) OVER (PARTITION BY doc_id ORDER BY line_no, k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ofs FROM cut""",
    goals=f"""SELECT *, ofs + CASE WHEN {fx.hash_sql(_AT, f"{fx.SEED}-short")} % 1000000 < 100000
        THEN {fx.hash_sql(_AT, f"{fx.SEED}-target")} % {_BUDGET - 1} + 2 ELSE {_BUDGET} END AS goal FROM places p""",
    follows="""SELECT g.doc_id, g.ofs, greatest(g.ofs + g.n, coalesce(max(q.ofs + q.n), 0)) AS next FROM goals g
        LEFT JOIN places q ON q.doc_id = g.doc_id AND q.ofs >= g.ofs AND q.ofs + q.n <= g.goal GROUP BY g.doc_id, g.ofs, g.n""",
    openings="""SELECT doc_id, ofs FROM follows WHERE ofs = 0
        UNION ALL SELECT f.doc_id, f.ofs FROM openings o JOIN follows p ON p.doc_id = o.doc_id AND p.ofs = o.ofs
            JOIN follows f ON f.doc_id = p.doc_id AND f.ofs = p.next""",
    grouped="""SELECT p.doc_id, o.ofs AS seq_at, list(p.tokens ORDER BY p.ofs) AS l, count(*) AS m FROM places p
        ASOF JOIN openings o ON p.doc_id = o.doc_id AND p.ofs >= o.ofs GROUP BY p.doc_id, o.ofs""",
    cuts=f"""SELECT *, flatten(l) AS s, {fx.hash_sql(_SEQ, f"{fx.SEED}-cut")} AS h,
        {fx.hash_sql(_SEQ, f"{fx.SEED}-order")} % 1000000 < 500000 AS coin FROM grouped""",
    split="""SELECT *, CASE WHEN m > 1 THEN len(flatten(l[1:h % (m - 1) + 1])) ELSE h % greatest(len(s) - 1, 1) + 1 END AS c FROM cuts""",
    sides="""SELECT doc_id, seq_at, coin AND c < len(s) AS w, s[:c] AS a, s[c + 1:] AS b FROM split""",
    turned="""SELECT doc_id, seq_at, w, CASE WHEN w THEN b ELSE a END AS a, CASE WHEN w THEN a ELSE b END AS b FROM sides""",
)


@query(fx.sql("lines", """
SELECT doc_id, seq_at, w::INT AS is_swapped,
    array_to_string(list_concat([2], a, [3], CASE WHEN len(b) > 0 THEN list_concat(b, [3]) ELSE [] END), ' ') AS input_ids,
    array_to_string(list_concat([0 for i in range(len(a) + 2)],
        CASE WHEN len(b) > 0 THEN [1 for i in range(len(b) + 1)] ELSE [] END), ' ') AS segment_ids
FROM turned""", ex=_LINE_EXAMPLES, **_PACKED).replace("WITH ", "WITH RECURSIVE ", 1))
def pretraining_pairs(spark, folder):
    """Lines packed into sequences of at most 128 ids, in two segments that are swapped or not."""
    done = packing.pretraining_sequences(_line_examples(spark, folder), 128, True, 0.1, fx.SEED)
    return done.select("doc_id", "seq_at", "is_swapped", lab.token_key(F.col("input_ids")).alias("input_ids"),
                       lab.token_key(F.col("segment_ids")).alias("segment_ids"))


_NAME = "doc_id || '|' || seq_no || '|' || half"
_PLACE = "list_transform(range(len(tokens)), lambda i: {'h': " + fx.hash_sql(f"{_NAME} || '|' || i", "12345-mask") + ", 'i': i})"
_HIDDEN = fx.hash_sql(f"{_NAME} || '|' || p", "12345-hide")
# n-grams one after the other, by rank of their draws, while any of the wanted places are left
_MASKED = dict(
    ranked=f"""SELECT *, list_sort({_PLACE}) AS draws FROM halves""",
    grams="""SELECT *, list_transform(draws, lambda d: {{'i': d.i, 'n': CASE WHEN d.h % 1000000 < {0} THEN 1
        WHEN d.h % 1000000 < {1} THEN 2 ELSE 3 END}}) AS grams,
        least(20, greatest(1, round_even(len(tokens) * 0.15, 0)))::BIGINT AS wanted FROM ranked""".format(
        *examples._length_limits(3, False)),
    steps="""SELECT doc_id, seq_no, half, 0 AS k, wanted AS "left", []::BIGINT[] AS taken, grams, tokens FROM grams
        UNION ALL SELECT doc_id, seq_no, half, k + 1, CASE WHEN ok THEN "left" - n ELSE "left" END,
            CASE WHEN ok THEN list_concat(taken, range(i, i + n)) ELSE taken END, grams, tokens FROM (
            SELECT *, i + n <= len(tokens) AND NOT list_has_any(taken, range(i, i + n)) AS ok FROM (
                SELECT *, grams[k + 1].i AS i, least(grams[k + 1].n, "left") AS n FROM steps
                WHERE k < len(tokens) AND "left" > 0))""",
    chosen="""SELECT doc_id, seq_no, half, tokens, list_sort(arg_max(taken, k)) AS taken FROM steps
        GROUP BY doc_id, seq_no, half, tokens""",
    new=f"""SELECT *, list_transform(taken, lambda p: CASE WHEN {_HIDDEN} % 10 < 8 THEN 4
        WHEN {_HIDDEN} % 10 = 8 THEN ({_HIDDEN} >> 8) % 1000 ELSE tokens[p + 1] END) AS hidden FROM chosen""",
)


@query(fx.sql("lines", """
SELECT doc_id, seq_no, half, array_to_string([CASE WHEN list_contains(taken, i - 1) THEN hidden[list_position(taken, i - 1)]
    ELSE tokens[i] END for i in range(1, len(tokens) + 1)], ' ') AS masked, array_to_string(taken, ' ') AS positions,
    array_to_string([tokens[p + 1] for p in taken], ' ') AS originals FROM new""", **_WINDOWS, **_MASKED).replace(
    "WITH ", "WITH RECURSIVE ", 1))
def mask_tokens(spark, folder):
    """N-grams of up to three hidden in every sequence, with their places and what stood there."""
    rows = examples.mlm_windows(_line_examples(spark, folder), 128, 0.05, fx.SEED)
    done = examples.mask_tokens(rows, 1000, special_ids=(), key=("doc_id", "seq_no", "half"))
    return done.select("doc_id", "seq_no", "half", *[lab.token_key(F.col(c)).alias(c) for c in ("masked", "positions", "originals")])


@query(fx.sql("lines", 'SELECT doc_id, line_no, line, "dupe" FROM lines, range(1, 5) r("dupe")'))
def dupe(spark, folder):
    return examples.dupe(fx.lines(spark, folder), 4).withColumn("dupe", F.col("dupe").cast("long"))


@query(fx.sql("", f"""
SELECT doc_id, seg_no, CASE WHEN s THEN following ELSE line END AS "first", CASE WHEN s THEN line ELSE following END AS "second",
    s::INT AS is_swapped FROM (
    SELECT *, {fx.hash_sql("doc_id || '|' || seg_no", f"{fx.SEED}-order")} % 1000000 < 500000 AS s FROM (
        SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seg_no) AS following FROM (
            SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS seg_no FROM (
                SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))) WHERE following IS NOT NULL"""))
def sentence_order_pairs(spark, folder):
    segments = fx.documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "line")).withColumn("seg_no", F.col("seg_no").cast("long"))
    return examples.sentence_order_pairs(segments, fx.SEED, tokens="line")


# Jobs with a subword model or a tagger

_models: dict[tuple, tokens.SubwordModel] = {}


def _model(spark, folder, extra: int) -> tokens.SubwordModel:
    """A model learnt from all documents: every character and `extra` more pieces."""
    key = (spark.sparkContext.applicationId, folder, extra)
    if key not in _models:
        chunks = settle(vocab.chunk_counts(fx.documents(spark, folder)))
        chars = vocab.alphabet(chunks).count()
        size = chars + len(tokens.CONTROL) + len(vocab.USER_SYMBOLS) + 2 + extra
        _models[key] = tokens.SubwordModel(spark, vocab.model_bytes(vocab.bpe_pieces(chunks, size)))
    return _models[key]


_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_CHUNKS = dict(
    raw="""SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents)
        WHERE w <> '' GROUP BY w""",
    chunks="""SELECT chunk, sum(n)::BIGINT AS n FROM (
        SELECT unnest(regexp_extract_all('▁' || w, '[^()".£€–-]+')) AS chunk, n FROM raw) GROUP BY chunk""",
    states="""SELECT string_split(chunk, '') AS s, n FROM chunks""",
)
_PAIRS = """SELECT p[1] AS "left", p[2] AS "right", sum(n)::BIGINT AS "count" FROM (
    SELECT unnest([[s[i], s[i + 1]] for i in range(1, len(s))]) AS p, n FROM states) GROUP BY 1, 2"""


@query(fx.sql("", "SELECT chunk, n AS \"count\" FROM chunks", **_CHUNKS))
def chunk_counts(spark, folder):
    return vocab.chunk_counts(fx.documents(spark, folder))


@query(fx.sql("", _PAIRS, **_CHUNKS))
def pair_counts(spark, folder):
    return vocab.pair_counts(vocab.initial_states(vocab.chunk_counts(fx.documents(spark, folder))))


_MERGES = 1000
# one merge a round, over a table of chunks (c), pair counts (p) and merges (m), of which a round replaces what changes;
# a chunk is written with every symbol between two signs
_TORN = """unnest([[q[i], q[i + 1]] for i in range(1, len(q))]) AS p, {w} AS k FROM (
    SELECT string_split({s}[2:-2], chr(2) || chr(1)) AS q, w FROM changed)"""


@query("WITH RECURSIVE " + ", ".join(f"{n} AS ({t})" for n, t in _CHUNKS.items()) + f""",
rounds(kind, a, b, c, n, s, w) USING KEY (kind, a, b, c) AS (
  SELECT * FROM (
    SELECT 'c' AS kind, chunk AS a, '' AS b, '' AS c, 0::BIGINT AS n,
        chr(1) || array_to_string(string_split(chunk, ''), chr(2) || chr(1)) || chr(2) AS s, n AS w FROM chunks WHERE length(chunk) > 1
    UNION ALL SELECT 'p', '', "left", "right", "count", NULL, NULL FROM ({_PAIRS})
    UNION ALL SELECT 'm', '', '', '', 0, NULL, NULL)
  UNION (WITH
    best AS MATERIALIZED (SELECT b AS l, c AS r, chr(1) || b || chr(2) || chr(1) || c || chr(2) AS apart, chr(1) || b || c || chr(2) AS joined
      FROM recurring.rounds WHERE kind = 'p' AND n > 0 ORDER BY n DESC, length(b || c), b || c, b LIMIT 1),
    step AS MATERIALIZED (SELECT n + 1 AS i FROM recurring.rounds WHERE kind = 'm' AND a = ''),
    changed AS MATERIALIZED (SELECT a, w, x.s AS old, replace(x.s, apart, joined) AS s
      FROM recurring.rounds x, best WHERE kind = 'c' AND contains(x.s, apart)),
    moved AS MATERIALIZED (SELECT p[1] AS b, p[2] AS c, sum(k)::BIGINT AS k FROM (
        SELECT {_TORN.format(s="s", w="w")} UNION ALL SELECT {_TORN.format(s="old", w="-w")}) GROUP BY 1, 2)
    SELECT * FROM (
      SELECT 'c', a, '', '', 0::BIGINT, s, w FROM changed
      UNION ALL SELECT 'p', '', m.b, m.c, coalesce(o.n, 0) + k, NULL, NULL FROM moved m
        LEFT JOIN (SELECT * FROM recurring.rounds WHERE kind = 'p') o ON o.b = m.b AND o.c = m.c WHERE k <> 0
      UNION ALL SELECT 'm', i::VARCHAR, l, r, i, NULL, NULL FROM best, step
      UNION ALL SELECT 'm', '', '', '', i, NULL, NULL FROM best, step)
    WHERE (SELECT i FROM step) <= {_MERGES})
)
SELECT (n - 1)::BIGINT AS rank, b AS "left", c AS "right" FROM rounds WHERE kind = 'm' AND a <> ''""")
def train_bpe(spark, folder):
    """A thousand merges of the whole corpus, in order."""
    chunks = settle(vocab.chunk_counts(fx.documents(spark, folder)))
    rules = vocab.train_bpe(chunks, _MERGES)[:_MERGES]
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rules)], "rank long, left string, right string")


@query(fx.sql("", f"SELECT doc_id, {_SQUEEZED} AS text, true AS tokens_match FROM documents"))
def encode_and_decode(spark, folder):
    """Ids and pieces of every text; decoding gives the text back."""
    model = _model(spark, folder, 32)
    coded = tokens.encode(fx.documents(spark, folder), model)
    return tokens.decode(coded, model).select(
        "doc_id", "text", (F.size("tokens") == F.size("pieces")).alias("tokens_match"))


@query(fx.sql("", f"""SELECT doc_id, replace({_SQUEEZED}, ' ', '▁') AS text, true AS cut_at_marks, true AS commas_alone
FROM (SELECT doc_id, text || ' 1,5 ' || doc_id || ',' AS text FROM documents)"""))
def tokenise_by_space(spark, folder):
    """Underlines only between parts; no piece goes on after a comma, and one after a digit stands alone."""
    options = tokens.Encoding(by_space=True, marks=(",",))
    texts = fx.documents(spark, folder).withColumn("text", F.concat("text", F.lit(" 1,5 "), F.col("doc_id").cast("string"), F.lit(",")))
    coded = tokens.encode(texts, _model(spark, folder, 32), options=options)
    inside = F.exists("pieces", lambda p: F.contains(F.substring(p, F.lit(1), F.length(p) - 1), F.lit(",")))
    joined = F.exists("pieces", lambda p: p.rlike(r"[0-9],$"))
    alone = F.size(F.filter("pieces", lambda p: p == ",")) >= 2
    return coded.select("doc_id", F.array_join("pieces", "").alias("text"), (~inside).alias("cut_at_marks"),
                        (alone & ~joined).alias("commas_alone"))


@query(fx.sql("words", "SELECT doc_id, pos, word, word AS text FROM words"))
def encode_words(spark, folder):
    model = _model(spark, folder, 32)
    # short rows of which many are equal: larger batches have fewer different ones; their bytes are bounded as before
    spark.conf.set(BATCH_CONF, str(1 << 16))
    return tokens.decode(tokens.encode_words(fx.words(spark, folder), model), model).drop("tokens")


@query()
def align_tokens(spark, folder):
    sections = corpus.word_sections(fx.tagged(spark, folder), fx.UNIT_MARK, block=fx.WHOLE)
    options = tokens.Encoding(marks=(",", "."))
    done = tokens.align_tokens(sections, _model(spark, folder, 32), options)
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.size("words")).alias("words"))


def _lowered(batch):
    return [line.lower() for line in batch]


@query(fx.sql("lines", """
SELECT word, count(*) AS "count" FROM (SELECT unnest(string_split(lower(line), ' ')) AS word FROM lines) GROUP BY word"""))
def segment_words(spark, folder):
    return stats.value_counts(tokens.segment_words(fx.lines(spark, folder), _lowered), "word", sort=False)


def _by_remainder():
    """A stand-in tagger: the label of a token is its id modulo seven, given as scores."""
    def run(batch):
        return [np.eye(7)[row % 7] for row in batch]
    return run


@query(fx.sql("lines", """
SELECT doc_id, line_no, array_to_string([t % 7 for t in tokens[CASE WHEN tokens[1] = 2 THEN 2 ELSE 1 END :
    len(tokens) - CASE WHEN tokens[-1] = 3 THEN 1 ELSE 0 END]], ' ') AS predictions FROM ex""", ex=_LINE_EXAMPLES))
def predict(spark, folder):
    rows = _line_examples(spark, folder)
    done = tagging.predict_examples(rows, _by_remainder, "remainder", 2, 3)
    return done.select("doc_id", "line_no", lab.token_key(F.col("predictions")).alias("predictions"))


@query(ORACLES["predict"])
def predict_by_cost(spark, folder):
    """The predictions of `predict` with the rows dealt to tasks by their tokens."""
    rows = scan.deal_by_cost(_line_examples(spark, folder), F.size("tokens"), ("doc_id", "line_no"), 16)
    done = tagging.predict_examples(rows, _by_remainder, "remainder", 2, 3)
    return done.select("doc_id", "line_no", lab.token_key(F.col("predictions")).alias("predictions"))


@query(fx.sql("lines", """
SELECT doc_id, line_no, CASE WHEN tokens[1] = 2 THEN '' ELSE '2 ' END || array_to_string(tokens, ' ') ||
    CASE WHEN tokens[-1] = 3 THEN '' ELSE ' 3' END AS tokens FROM ex""", ex=_LINE_EXAMPLES))
def wrap_specials(spark, folder):
    rows = tagging.wrap_specials(_line_examples(spark, folder), 2, 3)
    return rows.select("doc_id", "line_no", lab.token_key(F.col("tokens")).alias("tokens"))


def _word_starts(model: tokens.SubwordModel):
    """A stand-in tagger: a piece with an underline starts a word, all else goes on."""
    def load():
        processor = model.processor()
        goes_on = np.array([not processor.IdToPiece(i).startswith(tokens.UNDERLINE)
                            for i in range(processor.GetPieceSize())], dtype=np.int32)
        return lambda batch: [goes_on[row] for row in batch]
    return load


_STARTS = {0: "NOUN", 1: _MASK}


@query(fx.sql("words", """
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS words, count(*) AS n, 'NOUN' AS tag FROM words GROUP BY doc_id"""))
def tag_text(spark, folder):
    model = _model(spark, folder, 32)
    done = tagging.tag_text(fx.documents(spark, folder), model, _word_starts(model), "starts-" + model.name, _STARTS)
    return done.select("doc_id", F.array_join("words", " ").alias("words"), F.size("tags").cast("long").alias("n"),
                       F.array_join(F.array_distinct("tags"), " ").alias("tag"))


@query(fx.sql("", """
SELECT doc_id, regexp_replace(lower(text), '\\s+', '', 'g') AS text, true AS short FROM documents"""))
def tag_documents(spark, folder):
    """Long texts in segments of at most 200 characters, cut after commas and stops."""
    model = _model(spark, folder, 32)
    done = tagging.tag_documents(
        fx.documents(spark, folder), lambda t: tagging.segments_by_mark(t, 200, [",", "."]), [F.lower], model,
        _word_starts(model), "starts-" + model.name, _STARTS)
    return done.groupBy("doc_id").agg(
        runs.ordered(["seg"], F.array_join("words", "")).alias("i"),
        F.bool_and(F.size("words") == F.size("tags")).alias("short")).select(
        "doc_id", F.array_join("i.v0", "").alias("text"), "short")


# Pipelines

@query(fx.sql("units", """
SELECT tag, count(*) AS "count" FROM common JOIN (SELECT doc_id, section_pos FROM common GROUP BY doc_id, section_pos
    HAVING bool_or(tag = 'PUNCT') AND NOT bool_and(tag = 'PUNCT')) USING (doc_id, section_pos) GROUP BY tag""",
              common="""SELECT doc_id, section_pos, CASE WHEN tag <> 'PUNCT' AND count(*) OVER (PARTITION BY tag) <= 100
                  THEN 'unk' ELSE tag END AS tag FROM units"""))
def section_tag_counts(spark, folder):
    return corpus.section_tag_counts(corpus.word_sections(fx.tagged(spark, folder), fx.UNIT_MARK, block=fx.WHOLE))
