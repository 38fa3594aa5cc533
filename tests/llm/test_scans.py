import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tagweave.llm import licenses, secrets

from .conftest import EDGE, prose

PATTERNS = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
LEAST = {"assign": 6, "access": 20, "hex": 24}
LIVE = "aB3dE5gH7jK9mN1pQ3sT"


def brute(text):
    found = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                found.append((m.start(), n, m.end()))
    return ",".join(f"{list(PATTERNS)[n]}:{a}:{b}" for a, n, b in sorted(found))


SECRETS = [
    (20, "😀 password = 'hunter22' and Token:abcdef token=12345 API_KEY=\"x.y/z+w=\""),
    (21, "AKIA" + "A1" * 8 + " AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 20 + "d"),
    (22, "é" * 30 + "0123456789abcdef01234567 " + "f" * 23 + " secret=" + "0" * 40),
    (23, "tokentoken==x token = = y passwd: " + "q" * 6 + " secret\n=\nabcdefg"),
    (24, f"{LIVE} stands alone"), (25, f"key {LIVE.swapcase()} is copied"), (26, f"key {LIVE.swapcase()} too"),
    (27, f"secret={LIVE[:18]}xY9z0 only the certain span counts"),
]


def scanned(df):
    return {r.doc_id: r for r in secrets.scan(df).select(
        "doc_id", secrets._listed(F.col("sure")).alias("sure"), secrets._listed(F.col("owned")).alias("owned"),
        "n_live", "n_copied").collect()}


def test_base_spans(table):
    rows = [*EDGE, *SECRETS]
    got = secrets.scan(table(rows)).select("doc_id", secrets._listed(F.col("sure")).alias("sure"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, brute(t)) for k, t in rows), key=str)
    assert secrets.scan(table([])).count() == 0


def test_ownership(table):
    one = table(SECRETS)
    other = table([(40, f"key {LIVE.swapcase()} elsewhere, token=abcdef"), (41, "token=abcdef")], source="t")
    third = table([(42, "token=abcdef")], source="u")
    alone = scanned(one)
    assert alone[24].owned == "owned:0:20" and alone[25].owned == "owned:4:24" and alone[27].owned == ""
    together = scanned(one.union(other).union(third))
    assert together[24].owned == "owned:0:20" and together[25].owned == "" and together[40].owned == ""
    assert together[41].n_copied == 1 and together[41].n_live == 0 and together[20].n_live == 2


def test_hash_of_no_spans(table):
    listed = secrets.scan(table([(1, None)])).select(F.sha2(secrets._listed(F.col("sure")), 256)).first()[0]
    assert listed == hashlib.sha256(b"").hexdigest()


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def grams(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_licenses_by_brute_force(table):
    by_name = {n: t for n, _, t in licenses.TEMPLATES}
    rows = [(n, prose(n, 40 + 37 * n) + "\n" + t + "\n" + prose(n + 500, 90)) for n, t in enumerate(by_name.values())]
    half = by_name["MIT-terms"].split(" ")
    rows += [(50, " ".join(half[:len(half) // 2])), (51, by_name["MPL-2.0-notice"].replace("form", "kind").upper()),
             (52, " ".join(by_name.values())), (53, prose(3, 3000)), *[e for e in EDGE if e[0] not in range(20)]]
    got = {(r.doc_id, r.license): r for r in licenses.scan(table(rows)).collect()}
    want = {(k, name) for k, text in rows for name, t in by_name.items()
            if len(grams(text or "") & grams(t)) >= 0.8 * len(grams(t)) - 1e-9}
    assert want <= set(got) and set(got) == want
    assert got[3, "Apache-2.0-header"].best and not got[3, "Apache-2.0-short"].best
    assert (50, "MIT-terms") not in got


@pytest.mark.parametrize("n_words", [20, 60, 200, 3000])
def test_licenses_with_text_put_in(table, n_words):
    """However many words stand between the words of a template, its shingles follow each other."""
    terms = dict((n, t) for n, _, t in licenses.TEMPLATES)["MIT-terms"].split(" ")
    rows = []
    for n in range(30):
        inside = prose(n + 900, n_words).split()
        rows.append((n, " ".join([prose(n, 7 * n), *terms[:30], *inside, *terms[30:], prose(n + 60, 40)])))
    got = {r.doc_id: r for r in licenses.scan(table(rows)).filter("license = 'MIT-terms'").collect()}
    full = grams(" ".join(terms))
    want = {k: len(grams(t) & full) for k, t in rows}
    assert all(v >= 0.9 * len(full) for v in want.values())
    assert {k: r.n_shared for k, r in got.items()} == want


def test_the_license_query(spark, table, tmp_path):
    rows = [(1, dict((n, t) for n, _, t in licenses.TEMPLATES)["BSD-terms"]), (2, "none"), (3, None)]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = licenses.op9_license_scan(spark, str(tmp_path))
    assert found.columns == ["doc_id", "license", "family", "n_shared", "n_shingles", "containment", "best"]
    assert [(r.doc_id, r.license, r.containment, r.best) for r in found.collect()] == [(1, "BSD-terms", 1.0, True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_edges(table, spark):
    assert licenses.scan(table(EDGE)).count() == 0 and licenses.scan(table([])).count() == 0
    none = spark.createDataFrame([], "license string, family string, text string")
    assert licenses.scan(table(EDGE), none).count() == 0
    own = spark.createDataFrame([("a", "f", "one two three four five"), ("short", "f", "one two"), ("null", "f", None)],
                                "license string, family string, text string")
    rows = [(1, "x one TWO three, four five y"), (1, "x one TWO three, four five y"), (None, "one two three four five")]
    got = licenses.scan(table(rows), own).collect()
    assert sorted((r.doc_id or 0, r.license, r.containment) for r in got) == [(0, "a", 1.0), (1, "a", 1.0)]
