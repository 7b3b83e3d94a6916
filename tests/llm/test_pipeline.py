"""The pipeline's stages, one after the other, each against a plain version on what its predecessor kept."""

import hashlib

import corpus_pipeline
from tapewright.llm import bpe, mixture, toxicity
from tests.llm.test_lines import brute as without_lines
from tests.llm.test_near import _kept as without_near_copies

SF = "/root/testdata/sf0.001"


def test_stages_like_plain_versions(spark):
    from tokenizers import Tokenizer

    toxic, lines, near, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    before = rows(docs)

    clean = toxic(spark, docs, SF)
    model = toxicity.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {i: model.of_texts([t])[0] if model else 0.0 for i, t in before.items()}
    assert rows(clean) == {i: t for i, t in before.items() if scores[i] < toxicity.THRESHOLD}

    texts = rows(clean)
    left = without_lines(sorted(texts.items()))
    want = {i: t for i, t in left.items() if t.split() or not texts[i].split()}
    lined = lines(spark, clean, SF)
    assert rows(lined) == want

    one = near(spark, lined, SF)
    assert set(rows(one)) == without_near_copies(list(want.items()))

    mixed = mix(spark, one, SF)
    taken = {r.doc_id: r.taken for r in mixture.mix(spark, one).collect()}
    out = [(r.doc_id, len((r.text or "").split())) for r in mixed.collect()]
    assert all(sum(n for i, n in out if i == k) == words for k, words in taken.items())

    library = Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in encode(spark, mixed, SF).collect())
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in mixed.collect()]
    assert got == sorted((i, len(x), sha(",".join(map(str, x)))) for i, x in ids)
