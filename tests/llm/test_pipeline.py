import zlib

import numpy as np
import public_tokenizers as P
from test_native import brute_spans
from test_ngram_join import brute
from test_pages_chat_ann import brute_rules
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_against_brute_force(spark, tmp_path):
    words = [f"w{i}" for i in range(900)]
    base = " ".join(words[:120])
    texts = [base, base, base.replace("w60 ", "other "), "too short", "again and again " * 40, " ".join(words[200:300]) + " password=abcdefgh123 end", " ".join(words[300:420]), None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t in enumerate(texts) if brute_rules(t)[6]]
    found = brute(kept, 5, 80, 100)
    one = [(i, t) for i, t in kept if found[i][1] == i]
    assert [i for i, _ in one] == [0, 5, 6]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, text in one:
        for a, _, b in reversed(brute_spans(text)):
            text = f"{text[:a]}[SECRET]{text[b:]}"
        want[i] = [*t.encode(text, add_special_tokens=False).ids, 1]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(want)
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
