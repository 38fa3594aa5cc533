import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """Rows (doc_id, text) as a documents table, with columns that carry names the operators use inside."""
    def make(rows, **more):
        full = [(d, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(full, SCHEMA).coalesce(2)
        for name in ("ids", "doc", "norm", "line", "cls", "score", "i", "body", "sig", "row", "n"):
            df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


def prose(seed: int, words: int) -> str:
    """Words that hardly repeat, in sentences."""
    import random
    draw = random.Random(seed)
    out = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(2, 4)))
           for _ in range(words)]
    return " ".join(w + "." if n % 11 == 10 else w for n, w in enumerate(out))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without a key"), (None, None), (4, "..."), (5, "one"),
        (6, "naïve 漢字 😀 \x00 \x01  \U000f0010 end"), (7, "a repeated row"), (7, "a repeated row"),
        (8, "word " * 30_000)]
