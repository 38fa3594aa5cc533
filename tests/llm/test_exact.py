import hashlib
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from tagweave.llm import exact

from .conftest import EDGE

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """(key, keep, size) of each row: the greatest key of each text stays, null is the least."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    def best(keys):
        return max(keys, key=lambda k: (k is not None, k or 0))
    return sorted(((k, best(groups[t or ""]), len(groups[t or ""])) for k, t in rows), key=str)


def found(df):
    return sorted(map(tuple, df.select("key", "keep_id", "group_size").collect()), key=str)


def put(df, path, mode="overwrite"):
    for name in ("digest", "keep", "key", "file", "part", "_metadata"):
        df = df.selectExpr("*", f"'x' AS {name}")
    df.write.mode(mode).parquet(path)


def test_edges(spark, table, tmp_path):
    rows = [*EDGE, (20, None), (21, "a repeated row"), (22, "A repeated row"), (None, "one")]
    put(table(rows), str(tmp_path / "t"))
    got = exact.dedup(spark, str(tmp_path / "t"))
    assert found(got) == brute(rows)
    kept = got.filter("kept").groupBy("digest").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len({t or "" for _, t in rows})
    hexes = {r[0] for r in got.select(F.lower(F.hex("digest"))).collect()}
    assert hexes == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}


def test_empty(spark, table, tmp_path):
    put(table([]), str(tmp_path / "t"))
    assert exact.dedup(spark, str(tmp_path / "t")).count() == 0


def test_state_goes_on_and_does_not_expire(spark, table, tmp_path):
    """Files that come later meet the entries of earlier runs; what is in the state is read once only."""
    path, checkpoint, rows = str(tmp_path / "t"), str(tmp_path / "seen"), []
    for run in range(3):
        new = [(run * 100 + n, f"text {n % (20 + run)}") for n in range(60)]
        rows += new
        put(table(new), path, "append")
        assert found(exact.dedup(spark, path, checkpoint)) == brute(rows)
    state = {bytes(r.digest): r for r in exact.entries(spark, checkpoint).collect()}
    assert len(state) == 22 and sum(r.group_size for r in state.values()) == 180
    last = state[hashlib.sha256(b"text 0").digest()]
    assert last.keep_id == 244 and last.keep_file.endswith(".parquet") and last.keep_row is not None


def test_small_batches_give_the_same(spark, table, tmp_path):
    rows = [(n, f"text {n % 7}") for n in range(50)]
    put(table(rows).repartition(6), str(tmp_path / "t"))
    exact.observe(spark, str(tmp_path / "t"), str(tmp_path / "seen"), batch_bytes=1000)
    assert found(exact.dedup(spark, str(tmp_path / "t"), str(tmp_path / "seen"))) == brute(rows)


def test_bytes_decide_not_digests(spark, table, tmp_path):
    """With a digest of two values all texts collide, yet only equal texts are one group."""
    rows = [*EDGE, *[(n, f"text {n % 5}") for n in range(30, 90)]]
    put(table(rows), str(tmp_path / "t"))
    poor = exact.dedup(spark, str(tmp_path / "t"), digest=lambda t: (F.length(t) % 2).cast("string").cast("binary"))
    assert found(poor) == brute(rows)
    assert poor.filter("kept").count() == len({t or "" for _, t in rows})


def test_large_groups_are_dealt(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "GROUP_ROWS", 4)
    rows = [(n, "the same" if n % 3 else f"own {n}") for n in range(200)]
    put(table(rows), str(tmp_path / "t"))
    assert found(exact.dedup(spark, str(tmp_path / "t"))) == brute(rows)


def test_stores_take_no_disk_ahead(spark, table, tmp_path):
    """Many partitions of little state: a store takes what it holds, not blocks of a fixed size."""
    put(table([(n, f"text {n}") for n in range(40)]), str(tmp_path / "t"))
    exact.observe(spark, str(tmp_path / "t"), str(tmp_path / "seen"))
    local = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark._jsc.sc().conf()))
    taken = [f.stat().st_blocks * 512 for f in local.glob("**/MANIFEST-*")]
    assert taken and max(taken) < 1 << 20


def test_query(spark):
    """All columns against SQL-free brute force; no Python in the plan."""
    got = exact.op11_exact_dedup(spark, SMALL)
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (keep, size) for k, keep, size in brute(docs)}
    texts = dict(docs)
    rows = got.collect()
    assert len(rows) == len(docs) and "Python" not in got._jdf.queryExecution().toString()
    for r in rows:
        assert (r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
