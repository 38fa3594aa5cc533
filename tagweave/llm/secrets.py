"""Secret scans: pattern matches weighed by how many owners the same value has in the whole corpus.

Spans of three kinds are certain: assignments, access keys and long hexadecimal runs. A further kind, opaque
tokens, is only a candidate. Values are hashed, and for each hash the distinct repositories and owners that hold it
are counted over all documents. A candidate that one owner alone holds looks live and becomes a span of kind
`owned`; one that is copied widely is an example. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import table, text_of
from tagweave.operators.joins import attach
from tagweave.session import settle

# The patterns of the certain kinds, in the order in which spans at one place are listed.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
          r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "owned")

#: Opaque tokens: runs of this length or more with a lower-case letter, a capital and two digits.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=(?:[A-Za-z+/_=-]*[0-9]){2})" \
         r"[A-Za-z0-9+/_=-]{20,}"
#: Owners up to which a value counts as owned, and repositories from which it counts as copied widely.
OWNERS, WIDE = 1, 3


def _found(text: Column, kind: str, pattern: str, long_enough: int) -> Column:
    """Matches as structs (kind's number, start, end, value), positions in code points, from left to right.

    The text is split at the matches; what stands between them and the matches themselves add up to positions.
    """
    group = 1 if kind == "assign" else 0
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split(text, pattern)
    pieces = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.coalesce(F.length(piece["whole"]), F.lit(0))
        good = F.length(piece["value"]) >= long_enough
        one = F.array(F.struct(F.lit(KINDS.index(kind)).alias("kind"), begin.alias("start"), end.alias("end"),
                               piece["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pieces, start, step, lambda s: s["out"])).otherwise(none)


def _worth_scanning(text: Column) -> Column:
    """Whether any kind can match at all; a plain scan of the text decides."""
    return text.rlike(r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{20}")


def candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
               repository: str = "source") -> DataFrame:
    """Per row the certain spans `sure` and the candidates `maybe`, with its key, owner and repository."""
    body = F.when(_worth_scanning(text_of(text)), text_of(text)).otherwise(F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{owner}`").cast("string").alias("owner"),
                       F.col(f"`{repository}`").cast("string").alias("repo"), body.alias("body"))
    t = F.col("body")
    hexes = r"[0-9a-f]{%d,}" % LEAST["hex"]  # the greedy runs of 24 and more are the matches that stay
    sure = F.concat(_found(t, "assign", ASSIGN, LEAST["assign"]), _found(t, "access", ACCESS, LEAST["access"]),
                    _found(t, "hex", hexes, LEAST["hex"]))
    return rows.select("doc", "owner", "repo", sure.alias("sure"), _found(t, "owned", OPAQUE, 20).alias("maybe"))


def ownership(values: DataFrame) -> DataFrame:
    """`value`: hash, `owners`, `repos`: distinct owners and repositories that hold it (nulls are one of each)."""
    distinct = values.select("value", F.coalesce("owner", F.lit("")).alias("owner"),
                             F.coalesce("repo", F.lit("")).alias("repo")).distinct()
    pairs = distinct.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("r"))
    owners = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    repos = distinct.select("value", "repo").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "value")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
         repository: str = "source") -> DataFrame:
    """One row per row of `docs`: the key, `sure` and `owned` (arrays of spans), and what the corpus says of them.

    Spans are structs (kind's number, start, end, value); matches of a kind are the leftmost ones that do not
    overlap, and those too short are dropped. `owned` holds opaque tokens that lie outside all certain spans and
    that at most OWNERS owners hold. `n_live` and `n_copied` count the values of certain spans that one owner
    holds, or WIDE repositories or more. A null text has no spans; null owners and repositories count as one of
    their own. Repeated rows are scanned alike and count once for an owner. Rows without a key are scanned too.
    Other columns are not looked at. An empty table gives an empty table.
    """
    found = settle(candidates(docs, text, key, owner, repository))
    some = found.filter((F.size("sure") > 0) | (F.size("maybe") > 0)).withColumn(
        "row", F.xxhash64("doc", "owner", "repo", "sure", "maybe"))
    spans = some.select("doc", "row", "owner", "repo", F.explode(F.concat("sure", "maybe")).alias("s"))
    spans = spans.select("doc", "row", "owner", "repo", "s", F.sha2("s.value", 256).alias("value"))
    told = settle(ownership(spans))
    judged = attach(spans.select("doc", "row", "s", "value").distinct(), told, ["value"], salt_by=["row"])
    live, copied = F.col("owners") <= OWNERS, F.col("repos") >= WIDE
    candidate = F.col("s.kind") == KINDS.index("owned")
    per_row = judged.groupBy("doc", "row").agg(
        F.collect_list(F.when(candidate & live, F.col("s"))).alias("live"),
        F.count_if(~candidate & live).alias("n_live"), F.count_if(~candidate & copied).alias("n_copied"))
    outside = F.filter("live", lambda o: ~F.exists("sure", lambda s: (s["start"] < o["end"]) & (o["start"] < s["end"])))
    known = some.join(per_row.withColumnRenamed("doc", "d"),
                      (F.col("doc").eqNullSafe(F.col("d"))) & (some["row"] == per_row["row"]), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")
    rest = found.filter((F.size("sure") == 0) & (F.size("maybe") == 0))
    zero = F.lit(0).cast("long")
    return known.select(F.col("doc").alias(key), "sure", outside.alias("owned"), "n_live", "n_copied").union(
        rest.select(F.col("doc").alias(key), "sure", none.alias("owned"), zero.alias("n_live"),
                    zero.alias("n_copied")))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("sure", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[number(k) for k in ("assign", "access", "hex")],
                        F.sha2(_listed(F.col("sure")), 256).alias("base_sha256"),
                        _listed(F.concat("sure", "owned")).alias("spans"), "n_live", "n_copied")
