import hashlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from folioscope.llm import bpe

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello  world\n\n don't I'LL", "<|endoftext|>x <|endoftext|>", "a" * 5000, "=-" * 700, "  \t\n z ", "日本語テキスト 123 é̂", "🙂🙂 x" * 40, "\x00\x01", "Hello  world\n\n don't I'LL",
]


def test_digest_equals_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1)], "doc_id long, text string, token_ids string, n_tokens int")
    got = {r.doc_id: r for r in bpe.bpe_digest(docs, PATH).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_keeps_columns_and_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH)
    assert out.columns == [*docs.columns, "token_ids", "decoded"]
    assert out.where("not (text <=> decoded)").count() == 0
    both = bpe.bpe_encode(docs, PATH, round_trip="lang")
    assert both.columns == [*(c for c in docs.columns if c != "lang"), "token_ids", "lang"] and both.where("lang").count() == docs.count()
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0
