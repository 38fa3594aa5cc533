"""WARC files of text pages, and the resolution of not-modified revisits.

A revisit with status 304 stands for the latest earlier full response of the same canonical URL, if its validators
agree. The as-of join carries ids and headers of revisits only, in blocks of time, so a URL with a large part of all
captures is many tasks; bodies are moved once, to the revisits that name them, and a response that very many name is
copied for parts of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import table
from tagweave.operators.joins import attach
from tagweave.operators.scan import running
from tagweave.session import scratch_path, settle

VERSION = "WARC/1.1"
_BREAK = "\r\n"
#: What parts two records of a file written here. Of the breaks before it only the last character belongs to it: the
#: file reader loses a separator that begins with repeated characters where its buffer ends inside them.
_BETWEEN = f"\n{VERSION}{_BREAK}WARC-Type: "

# Fields of a stored response that a 304 may not replace (RFC 9110 and 9111), in lower case.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
              "trailer", "transfer-encoding", "upgrade")
#: Query parameters that do not tell pages apart.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

HEADERS = "array<struct<name:string,value:string>>"
#: Revisits of one response that are joined to one copy of its body.
COPY_ROWS = 10_000


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or tracking parameters, parameters sorted."""
    bare = F.regexp_replace(url, r"#.*$", "")
    front = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    front = F.regexp_replace(F.regexp_replace(front, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(rest, r"\?.*$", "")
    query = F.when(F.contains(rest, F.lit("?")), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(front, F.when(path == "", F.lit("/")).otherwise(path),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def header(headers: str | Column, name: str) -> Column:
    """The first value of a field; names are compared in lower case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def write(records: DataFrame, folder: str, compression: str | None = None) -> None:
    """Records as WARC text, one file per partition, through Spark's writer.

    Columns: record_id, type, url, ts (seconds), status, reason, headers, body; a null body is empty, null headers
    are none. Text is UTF-8; lengths are in bytes. `compression` may be gzip, as such files mostly are; each file is
    then read by one task, so partitions should be of the size of a task's input.
    """
    fields = F.array_join(F.transform(F.coalesce("headers", F.array().cast(HEADERS)), lambda h: F.concat(
        h["name"], F.lit(": "), h["value"], F.lit(_BREAK))), "")
    http = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" "),
                    F.coalesce("reason", F.lit("")), F.lit(_BREAK), fields, F.lit(_BREAK),
                    F.coalesce("body", F.lit("")))
    date = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = [("WARC-Type", F.col("type")), ("WARC-Record-ID", F.concat(F.lit("<urn:"), "record_id", F.lit(">"))),
             ("WARC-Target-URI", F.col("url")), ("WARC-Date", date),
             ("Content-Type", F.lit("application/http")), ("Content-Length", F.octet_length("http").cast("string"))]
    head = F.concat_ws(_BREAK, F.lit(VERSION), *[F.concat(F.lit(f"{n}: "), v) for n, v in named])
    # a null field (no URL) is left out; the writer adds the last line feed of a record
    (records.withColumn("http", http)
     .select(F.concat(head, F.lit(_BREAK + _BREAK), F.col("http"), F.lit(_BREAK + "\r")).alias("value"))
     .write.text(folder, compression=compression, lineSep="\n"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of WARC text files: those columns, and `complete` (the block has the length it states).

    Files are split at the start of records, so a file is read by many tasks. Names of fields come as written.
    """
    raw = spark.read.option("lineSep", _BETWEEN).text(folder)

    def fields(block: str) -> Column:
        lines = F.filter(F.split(block, _BREAK), lambda s: F.contains(s, F.lit(":")))
        return F.transform(lines, lambda s: F.struct(
            F.regexp_extract(s, r"^([^:]*):", 1).alias("name"),
            F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("value")))

    def bound(df: DataFrame, **made: Column) -> DataFrame:
        # a generator of one row keeps the planner from computing these again at each use
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))

    cut = bound(raw.filter(F.length("value") > 0), parts=F.split("value", _BREAK + _BREAK, 3)).select(
        F.regexp_replace(F.get("parts", F.lit(0)), r"^WARC/1\.[01]\r\nWARC-Type: ", "").alias("head"),
        F.get("parts", F.lit(1)).alias("top"), F.coalesce(F.get("parts", F.lit(2)), F.lit("")).alias("rest"))
    named = bound(cut, warc=fields("head"), headers=fields("top"))
    stated = header("warc", "content-length").cast("long")
    sized = bound(named, stated=stated, before=F.octet_length("top") + 4)
    # all but the last character of the closing breaks, in the last record of a file that as well
    body = F.when(F.col("before") + F.octet_length("rest") == F.col("stated"), F.col("rest")).otherwise(
        F.regexp_replace("rest", r"\r\n\r\n?\z", ""))
    return bound(sized, body=body).select(
        F.regexp_extract(header("warc", "warc-record-id"), r"^<urn:(.*)>$", 1).alias("record_id"),
        F.regexp_extract("head", r"^([a-z]+)", 1).alias("type"), header("warc", "warc-target-uri").alias("url"),
        F.unix_timestamp(header("warc", "warc-date"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.regexp_extract("top", r"^HTTP/[0-9.]+ ([0-9]{3})", 1).cast("int").alias("status"), "headers", "body",
        F.coalesce(F.col("stated") == F.col("before") + F.octet_length("body"), F.lit(False)).alias("complete"))


def validated(new: Column, old: Column) -> Column:
    """Whether a 304 speaks of a stored response: by entity tag (weakly), else date, else payload digest."""
    def tag(headers: Column) -> Column:
        return F.regexp_replace(header(headers, "etag"), r"^W/", "")

    pairs = [(tag(new), tag(old)), *[(header(new, n), header(old, n)) for n in ("last-modified", "digest")]]
    verdict = F.lit(False)
    for mine, stored in reversed(pairs):
        verdict = F.when(mine.isNotNull(), F.coalesce(mine == stored, F.lit(False))).otherwise(verdict)
    return verdict


def merged(new: Column, old: Column) -> Column:
    """The stored fields, with those of the 304 that may replace them in their stead."""
    allowed = F.filter(new, lambda h: ~F.lower(h["name"]).isin(*NOT_MERGED))
    stay = F.filter(old, lambda o: ~F.exists(allowed, lambda a: F.lower(a["name"]) == F.lower(o["name"])))
    return F.concat(stay, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url (canonical), ts, outcome, refers_to, headers, body.

    `records`: record_id (unique), type, url, ts (seconds, not negative), status, headers, body. A full response is
    of type response with status 200. Outcomes: `resolved`; `mismatch` (the latest earlier full response fails the
    validators; it is named but not used); `no_earlier`; `no_url` (no URL or time). Of records at one time those
    with a lesser record id come first. Unless resolved, headers are the revisit's own and the body is null.
    Null headers are none. Repeated revisits come out as often as they occur; of repeated responses one is used.
    Other columns are not looked at. An empty table gives an empty table.
    """
    none = F.array().cast(HEADERS)
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    used = records.select("record_id", "type", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long")
                          .alias("ts"), "status", F.coalesce(F.col("headers").cast(HEADERS), none).alias("headers"), "body")
    # parsed once; the place of a stored row tells repeated responses apart
    rows = settle(used.filter(full | (F.col("type") == "revisit")).select(
        "record_id", "type", "url", "ts", "headers", F.when(full, F.col("body")).alias("body"),
        F.coalesce(full, F.lit(False)).alias("full"), F.monotonically_increasing_id().alias("place")), "zstd")
    dated = F.col("url").isNotNull() & F.col("ts").isNotNull()
    own = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), F.col("place").alias("place")))
    slim = rows.filter(dated).select("record_id", "type", "url", "ts", own.alias("own"),
                                     F.when(F.col("type") == "revisit", F.col("headers")).alias("new"))
    placed = running(slim, "url", ("ts", "record_id"), lasts={"of": F.col("own")}).filter("type = 'revisit'").select(
        "record_id", "url", "ts", "new", F.col("of.id").alias("refers_to"), F.col("of.place").alias("at"))
    lone = rows.filter((F.col("type") == "revisit") & ~dated).select(
        "record_id", "url", "ts", F.col("headers").alias("new"), F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("long").alias("at"))
    revisits = settle(placed.unionByName(lone))
    # a response with very many revisits is copied, one copy for each COPY_ROWS of them
    hot = settle(revisits.filter("at is not null").groupBy("at").count().filter(F.col("count") > COPY_ROWS).select(
        "at", F.ceil(F.col("count") / COPY_ROWS).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = attach(revisits, hot, ["at"], salt_by=["record_id", "ts"]).withColumn(
        "copy", F.pmod(F.xxhash64("record_id", "ts"), copies).cast("int")).drop("copies")
    whole = rows.filter(dated & F.col("full")).select(F.col("place").alias("at"), F.col("headers").alias("old"), "body")
    stored = attach(whole, hot, ["at"], salt_by=["at"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies").withColumn("found", F.lit(True))
    joined = dealt.join(stored, ["at", "copy"], "left")
    outcome = (F.when(F.col("url").isNull() | F.col("ts").isNull(), "no_url").when(F.col("found").isNull(), "no_earlier")
               .when(validated(F.col("new"), F.col("old")), "resolved").otherwise("mismatch"))
    done = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "ts", "outcome", "refers_to",
        F.when(done, merged(F.col("new"), F.col("old"))).otherwise(F.col("new")).alias("headers"),
        F.when(done, F.col("body")).alias("body"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl derived from pages: each fetched in full, some a second time after a change, and revisited twice.

    Pages without `page_id` are left out, as record ids and times come from it.

    The revisits write the URL in another way; some carry an old entity tag, some a date only, some a page that was
    never fetched in full.
    """
    tag = F.md5("html")

    def fields(**values: Column) -> Column:
        given = F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("name"), v.alias("value"))
                          for n, v in values.items()])
        return F.filter(given, lambda h: h["value"].isNotNull())

    n = F.col("page_id")
    loud = F.concat(F.upper(F.regexp_extract("url", r"^([a-z]+)://", 1)),
                    F.regexp_replace("url", r"^[a-z]+://", "://"), F.lit("#top"))
    length = F.octet_length("html").cast("string")
    date = F.concat(F.lit("day "), n.cast("string"))
    first = fields(ETag=F.concat(F.lit('"'), tag, F.lit('"')), Last_Modified=date, Content_Type=F.lit("text/html"),
                   Content_Length=length, X_Age=F.lit("0"))
    second = fields(ETag=F.concat(F.lit('"'), tag, F.lit('-2"')), Last_Modified=F.concat(date, F.lit(" late")),
                    Content_Type=F.lit("text/html"), X_Age=F.lit("0"))
    early = fields(ETag=F.concat(F.lit('W/"'), tag, F.lit('"')), X_Age=F.lit("7"), Content_Type=F.lit("text/plain"))
    late = fields(ETag=F.when(n % 5 != 1, F.concat(F.lit('"'), tag, F.lit('-2"'))),
                  Last_Modified=F.concat(date, F.lit(" late")), X_Age=F.lit("9"))

    def record(kind: str, turn: int, url: Column, headers: Column, body: Column) -> Column:
        return F.struct(
            F.concat(F.lit("page-"), n.cast("string"), F.lit(f"-{turn}")).alias("record_id"), F.lit(kind).alias("type"),
            url.alias("url"), (n * 10 + turn).alias("ts"), F.lit(200 if kind == "response" else 304).alias("status"),
            F.lit("OK" if kind == "response" else "Not Modified").alias("reason"), headers.alias("headers"),
            body.cast("string").alias("body"))

    made = F.array_compact(F.array(
        F.when(n % 4 != 3, record("response", 1, F.col("url"), first, F.col("html"))),
        record("revisit", 3, loud, early, F.lit(None)),
        F.when(n % 3 == 0, record("response", 5, F.col("url"), second, F.concat("html", F.lit("<!-- 2 -->")))),
        record("revisit", 7, loud, late, F.lit(None))))
    return pages.filter("page_id is not null").select(F.explode(made).alias("r")).select("r.*")


def op7_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark, "warc")
    write(captures(table(spark, folder, "pages")), files, "gzip")
    found = resolve(read(spark, files))
    listed = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(
        F.lower(h["name"]), F.lit(":"), h["value"]))), "\n")
    return found.select("record_id", "url", "ts", "outcome", "refers_to", F.sha2(listed, 256).alias("headers_sha256"),
                        F.sha2("body", 256).alias("body_sha256"))
