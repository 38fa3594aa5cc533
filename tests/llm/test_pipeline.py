import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tagweave.llm import decontaminate

from .test_copies import brute_classes, brute_lines

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs, columns, now = spark.read.parquet(f"{SMALL}/documents.parquet"), None, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        before = dict((r.doc_id, r.text) for r in docs.collect())
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns
            now = dict((r.doc_id, r.text) for r in docs.collect())
            assert now.keys() <= before.keys()
        if name == "toxicity":
            labels = dict(map(tuple, spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect()))
            gone = before.keys() - now.keys()
            assert gone and sum(labels.get(d) == 0 for d in gone) <= 2 and all(now[d] == before[d] for d in now)
        elif name == "line dedup":
            want = {k: t for k, t, cut in brute_lines(list(before.items()), distance=None) if not cut or t.strip()}
            assert now == want
        elif name.startswith("n-gram"):
            assert now.keys() == {k for k, root, _ in brute_classes(list(before.items())) if root in (k, None)}
        elif name.startswith("benchmark"):
            items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            inside = lambda t: any(f" {' '.join(i)} " in f" {' '.join(decontaminate.words_of(t))} " for i in items)
            assert now.keys() == {k for k, t in before.items() if not inside(t)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert counts == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in now.items()}
    assert corpus_pipeline.run(spark, SMALL).count() == len(counts)
