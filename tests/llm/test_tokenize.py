import base64
import random

import pytest
from pyspark.sql import functions as F

from claimweave.llm import tokenize as K

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return K.Codec(K.default_path())


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_public_encoder_on_random_texts(codec, reference):
    rng = random.Random(3)
    parts = list("abcstmdlrvez''''   \n\t\r 12³½ÅéЖ中！。  ​́ ﻿🧬?-.,_") + ["'s", "'re", "'ll", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(4000)]
    for text, (ids, offsets) in zip(texts, codec.encode_batch(texts)):
        assert ids == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text
        assert (offsets[0] == 0 and offsets == sorted(set(offsets))) if text else offsets == []


def test_very_long_texts_and_slices(codec, reference):
    for text in ("a" * 50_000 + "xyz1é" * 20_000, " " * 3000 + "x", "word " * 300_000):
        assert codec.encode_batch([text])[0][0] == reference.encode_ordinary(text)


def test_every_code_point_has_the_class_of_the_pattern(codec, reference):
    texts = [f"a{chr(i)}b{chr(i)}1{chr(i)}" for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000]
    assert [x for x, _ in codec.encode_batch(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_null_empty_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "It's 12 words", "z"), (3, "It's 12 words", "z")], "doc_id long, text string, ids string")
    out = K.encode(df, offsets=True)
    rows = {(r["doc_id"], tuple(r["ids"])) for r in out.collect()}
    assert out.count() == 4 and out.columns == ["doc_id", "text", "ids", "offsets"]
    assert (1, ()) in rows and (2, ()) in rows
    assert K.decode(out).where("doc_id = 3").first()["decoded"] == "It's 12 words"
    assert K.encode(df.limit(0)).count() == 0
    assert K.count_tokens(df).agg(F.sum("n_tokens")).first()[0] == 8
