import base64
import random

import numpy as np
import pytest
import tiktoken

from stratalith.llm import bpe

ODD = [
    "", " ", "\n", "aaaaaaaaa", " " * 50, "a\x1cb \x1d\x1e c\x85d​ e　f", "<|endoftext|>", "\r\n\r\n x  \n", "’s it's 'll ''d",
    "x" * 5000, "😀" * 40 + " ñandú 中文字", "   a", " b \x0b \x0c", "\x00\x01 y", "it's   \t foo", "ab" * 3000, "123" * 999, "é́",
]


@pytest.fixture(scope="module")
def encoding():
    import os

    folder = os.path.dirname(bpe.VOCABULARY)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _check(texts, encoding, encoder):
    flat, offsets = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == (encoding.encode_ordinary(t) if t else [])
    assert encoder.count(texts).tolist() == np.diff(offsets).tolist()


def test_matches_the_public_library(encoding):
    _check([*ODD, None, "plain words", "plain words"], encoding, bpe.Encoder(bpe.Vocabulary.load()))


def test_random_texts_and_a_table_that_overflows(encoding):
    rnd = random.Random(5)
    alphabet = "abcdefgh  \n\t.,'s1239éßЖ中😀 "
    encoder = bpe.Encoder(bpe.Vocabulary.load(), table_words=50)
    for _ in range(20):
        _check(["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200))) for _ in range(20)], encoding, encoder)


def test_rows_keep_their_ids_and_nulls_are_empty_lists(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "a b", "y")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.with_ids(df).collect())
    assert got[0] == (1, [64, 275]) and got[1] == (2, []) and got[2:] == [(3, []), (3, [64, 275])]
    assert sorted((r.doc_id, r.tokens) for r in bpe.with_counts(df).collect()) == [(1, 2), (2, 0), (3, 0), (3, 2)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.with_ids(df).count() == 0 and bpe.with_counts(df).count() == 0
