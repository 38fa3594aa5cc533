"""The corpus shapes the operators read, derived from the given tables.

Every function takes the session and the folder of the tables. `CTES` holds the same derivations as
SQL, written independently of the Spark ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import runs
from tagweave.operators.sampling import split_bernoulli
from tagweave.session import at_least_partitions

UNIT_MARK = ","
RAW_NAMES = ("n.count", "n.prop", "v.past", "adj", "case.gen")
NAMES = ("NOUN", "PROPN", "VERB", "ADJ", "unk")
TAG_MAP_1 = {"n.count": "NOUN", "n.prop": "NOUN", "v.past": "VERB", "adj": "ADJ", "punc": "PUNCT"}
TAG_MAP_2 = {"NOUN": "NOUN", "VERB": "VERB", "PUNCT": "PUNCT"}
TAG_MAP_TEXT = '[("(n.count|n.prop)", "NOUN"),\n ("(v.past)", "VERB"), ("(adj)", "ADJ"), ("(punc|adj)", "PUNCT")]'
LABELS = {0: "NOUN", 1: "PROPN", 2: "VERB", 3: "ADJ", 4: "UNK", 5: "PUNCT", 6: "[MASK]", 8: "RARE"}
SEED = 7
#: The block of scans over words, pieces and units of `keyed` documents: each is cut from one text, and its rows lie in one part.
WHOLE = None
#: Bytes of a stored table that one part of `keyed` gets; some 250,000 words of text.
PART_BYTES = 1 << 20
#: Parts of `keyed` for each shuffle partition of what is made of them, such as distinct words.
PARTS_A_SHUFFLE = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that comes as fewer splits than there are cores; large ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def keyed(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table dealt to parts by its key, before its rows are cut up.

    What is cut from a row keeps this partitioning, so windows, groups and joins by the key and more columns move
    no cut rows; joins need the setting below for it until the next `prepare`. Parts are as many as the table's bytes ask for, so that the rows of one sort in memory,
    and so are the partitions of later shuffles, until the next `prepare`.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    at_least_partitions(spark, parts // PARTS_A_SHUFFLE)
    return table(spark, folder, name).select(key, *columns).repartition(parts, key)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    cut = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.select("doc_id", F.col("line_no").cast("long"), F.trim("line").alias("line")).filter("line != ''")


def words(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, word)"""
    parts = F.array_remove(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " "), "")
    numbered = keyed(spark, folder, "documents", "doc_id", "text").select("doc_id", F.posexplode(parts).alias("pos", "word"))
    return numbered.withColumn("pos", F.col("pos").cast("long"))


def _by_length(names: tuple[str, ...], shift: Column | None = None) -> Column:
    size = F.length("word") if shift is None else F.length("word") + shift
    return F.element_at(F.array(*[F.lit(n) for n in names]), (size % len(names) + 1).cast("int"))


def raw_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Words with source tags, before the tag maps."""
    tag = F.when(F.col("word").endswith("."), "punc").otherwise(_by_length(RAW_NAMES))
    return words(spark, folder).withColumn("tag", tag)


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, word, tag) with PUNCT closing sections."""
    tag = F.when(F.col("word").endswith("."), runs.PUNCT).otherwise(_by_length(NAMES))
    return words(spark, folder).withColumn("tag", tag)


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """`tagged` with a stand-in prediction `pred` that is wrong for every seventh word."""
    shift = F.when(F.col("pos") % 7 == 0, 1).otherwise(0)
    guess = F.when(F.col("word").endswith("."), runs.PUNCT).otherwise(_by_length(NAMES, shift))
    return tagged(spark, folder).withColumn("pred", guess)


def units(spark: SparkSession, folder: str) -> DataFrame:
    return runs.build_units(tagged(spark, folder), UNIT_MARK, block=WHOLE)


def code_points(word: Column) -> Column:
    return F.transform(F.split(word, ""), F.ascii)


def example_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the sections, an example each: (example_id, word_pos, tokens, tag, split)."""
    rows = runs.section_rows(tagged(spark, folder))
    named = rows.select(F.concat_ws("-", "doc_id", "section_pos").alias("example_id"),
                        F.col("pos").alias("word_pos"), code_points(F.col("word")).alias("tokens"), "tag")
    return split_bernoulli(named, 0.1, SEED)


def scored_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the sections with labels and predictions per token: `example_words` and key, labels, predictions.

    The first token has the tag and its prediction (wrong for every seventh word), the others are masks; in every
    eleventh word the tag is predicted for them as well.
    """
    rows = example_words(spark, folder)
    n = F.size("tokens")
    names = F.array(*[F.lit(name) for name in NAMES])
    wrong = (F.col("tag") != runs.PUNCT) & (F.col("word_pos") % 7 == 0)
    first = F.when(wrong, F.element_at(names, (n + 1) % len(NAMES) + 1)).otherwise(F.col("tag"))
    later = F.when(F.col("word_pos") % 11 == 0, F.col("tag")).otherwise(runs.MASK)
    return rows.select("example_id", "word_pos", "split", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("key"),
                       "tokens", F.concat(F.array("tag"), F.array_repeat(F.lit(runs.MASK), n - 1)).alias("labels"),
                       F.concat(F.array(first), F.array_repeat(later, n - 1)).alias("predictions"))


def token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Characters as tokens, labels in the word-end form: (doc_id, pos, piece, token, label).

    The last token of a word has TAG+[WORD_END]; every third inner token is [MASK].
    """
    rows = predicted(spark, folder).select(
        "doc_id", "pos", "tag", F.length("word").alias("n"), F.posexplode(F.split("word", "")).alias("piece", "c"))
    label = (F.when(F.col("piece") == F.col("n") - 1, F.concat("tag", F.lit("+" + runs.WORD_END)))
             .when(F.col("piece") % 3 == 2, runs.MASK).otherwise(F.col("tag")))
    return rows.select("doc_id", "pos", F.col("piece").cast("long"), F.ascii("c").alias("token"), label.alias("label"))


def spread_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Characters as tokens, labels in the first-token form: (doc_id, pos, piece, token, label, pred)."""
    rows = predicted(spark, folder).select(
        "doc_id", "pos", "tag", "pred", F.posexplode(F.split("word", "")).alias("piece", "c"))
    first = F.col("piece") == 0
    return rows.select("doc_id", "pos", F.col("piece").cast("long"), F.ascii("c").alias("token"),
                       F.when(first, F.col("tag")).otherwise(runs.MASK).alias("label"),
                       F.when(first, F.col("pred")).otherwise(runs.MASK).alias("pred"))


_NAMES_SQL = "['NOUN','PROPN','VERB','ADJ','unk']"
_RAW_SQL = "['n.count','n.prop','v.past','adj','case.gen']"
_HASH_SQL = "('0x' || substr(md5({key} || '|{seed}'), 1, 15))::BIGINT"

CTES = {
    "lines": """SELECT doc_id, o - 1 AS line_no, trim(line) AS line FROM (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS o
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''""",
    "words": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS pos, word FROM (
        SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS o
        FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS l FROM documents)) WHERE word <> ''""",
    "raw_tagged": f"""SELECT doc_id, pos, word, CASE WHEN word LIKE '%.' THEN 'punc'
        ELSE ({_RAW_SQL})[(length(word) % 5 + 1)::INT] END AS tag FROM words""",
    "tagged": f"""SELECT doc_id, pos, word, CASE WHEN word LIKE '%.' THEN 'PUNCT'
        ELSE ({_NAMES_SQL})[(length(word) % 5 + 1)::INT] END AS tag FROM words""",
    "predicted": f"""SELECT doc_id, pos, word, tag, CASE WHEN word LIKE '%.' THEN 'PUNCT' ELSE
        ({_NAMES_SQL})[((length(word) + CASE WHEN pos % 7 = 0 THEN 1 ELSE 0 END) % 5 + 1)::INT] END AS pred
        FROM tagged""",
    # a unit starts at a punctuation word and after every closing word
    "unit_starts": """SELECT *, CASE WHEN tag = 'PUNCT' OR coalesce(lag(tag = 'PUNCT' OR word LIKE '%,')
            OVER (PARTITION BY doc_id ORDER BY pos), true) THEN 1 ELSE 0 END AS starts FROM tagged""",
    "unit_ids": """SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos) AS unit,
        coalesce(sum(CASE WHEN tag = 'PUNCT' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section_pos FROM unit_starts""",
    "unit_rows": """SELECT doc_id, unit, min(pos) AS unit_pos, min(section_pos)::BIGINT AS section_pos,
        string_agg(word, '' ORDER BY pos) AS word, string_agg(tag, '+' ORDER BY pos) AS tag,
        bool_or(tag = 'PUNCT' OR word LIKE '%,') AS closed FROM unit_ids GROUP BY doc_id, unit""",
    "units": """SELECT doc_id, unit_pos, section_pos, word, tag FROM (
        SELECT *, lead(tag) OVER (PARTITION BY doc_id ORDER BY unit) AS following FROM unit_rows)
        WHERE closed OR following = 'PUNCT'""",
    "section_ids": """SELECT *, coalesce(sum(CASE WHEN tag = 'PUNCT' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id
            ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS section_pos FROM tagged""",
    "section_rows": """SELECT * EXCLUDE (n_punct, n_all) FROM (
        SELECT *, count(*) FILTER (tag = 'PUNCT') OVER (PARTITION BY doc_id, section_pos) AS n_punct,
            count(*) OVER (PARTITION BY doc_id, section_pos) AS n_all FROM section_ids)
        WHERE n_punct > 0 AND n_all > n_punct""",
    "example_words": f"""SELECT doc_id || '-' || section_pos AS example_id, pos AS word_pos, word, tag,
        array_to_string([unicode(c) for c in string_split(word, '')], ' ') AS key, length(word) AS n_tokens,
        CASE WHEN {_HASH_SQL.format(key="(doc_id || '-' || section_pos)", seed=SEED)} % 1000000 < 100000
            THEN 'test' ELSE 'train' END AS split FROM section_rows""",
    "chars": """SELECT doc_id, pos, tag, pred, o - 1 AS piece, unicode(c) AS token, n FROM (
        SELECT doc_id, pos, tag, pred, length(word) AS n, unnest(l) AS c, generate_subscripts(l, 1) AS o
        FROM (SELECT *, string_split(word, '') AS l FROM predicted))""",
    "token_rows": """SELECT doc_id, pos, piece, token, CASE WHEN piece = n - 1 THEN tag || '+[WORD_END]'
        WHEN piece % 3 = 2 THEN '[MASK]' ELSE tag END AS label FROM chars""",
    "spread_rows": """SELECT doc_id, pos, piece, token, CASE WHEN piece = 0 THEN tag ELSE '[MASK]' END AS label,
        CASE WHEN piece = 0 THEN pred ELSE '[MASK]' END AS pred FROM chars""",
}
_NEEDS = {
    "raw_tagged": ["words"], "tagged": ["words"], "predicted": ["tagged"], "unit_starts": ["tagged"],
    "unit_ids": ["unit_starts"], "unit_rows": ["unit_ids"], "units": ["unit_rows"],
    "section_ids": ["tagged"], "section_rows": ["section_ids"], "example_words": ["section_rows"],
    "chars": ["predicted"], "token_rows": ["chars"], "spread_rows": ["chars"],
}


def sql(needs: str, body: str, **more: str) -> str:
    """`body` after the common table expressions it names (and theirs), plus its own in `more`."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for inner in _NEEDS.get(name, []):
            add(inner)
        if name not in chosen:
            chosen.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in chosen] + [f"{n} AS ({t})" for n, t in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def hash_sql(key: str, seed: int | str) -> str:
    """The 60-bit order hash of a text key in SQL."""
    return _HASH_SQL.format(key=f"({key})", seed=seed)
