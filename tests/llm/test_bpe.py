import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from phenoweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    t = bpe.tokenizer(open(PATH, "rb").read(), P.PATTERN)
    return t, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.vocabulary.ranks, special_tokens={})


def texts(n):
    r = random.Random(7)
    alphabets = ["ab", "abc   \n\t", "aeinrst", "0123456789", "éèüßñ", "汉字テスト", "<|endoftext|>", "=-#*!", "😀‍👩́", "\r\n 　\xa0x"]
    for _ in range(n):
        yield "".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(0, 120)))


def test_same_ids_as_the_library(both):
    t, lib = both
    for text in [*texts(3000), "", " ", "a" * 5000, "ab" * 2000, " " * 3000 + "x", "don't I'll 've"]:
        assert t.encode(text) == lib.encode_ordinary(text)
        assert t.decode(t.encode(text)) == text.encode()


def test_same_ids_on_raw_bytes(both):
    t, lib = both
    r = random.Random(3)
    for _ in range(300):
        data = bytes(r.choice(b"aetn \xc3\xa9\xff0") for _ in range(r.randrange(1, 200)))
        assert t.vocabulary.encode_piece(data) == lib._encode_single_piece(data)


def test_append_and_edit_equal_new_encoding(both):
    v = both[0].vocabulary
    r = random.Random(5)
    for _ in range(200):
        data = bytes(r.choice(b"thernaigo") for _ in range(r.randrange(0, 400)))
        table = bpe.PrefixTable(v)
        for i in range(0, len(data), 7):
            table.append(data[i : i + 7])
            assert table.ids() == v.encode_piece(data[: i + 7])
        lo = r.randrange(0, len(data) + 1)
        hi = min(len(data), lo + r.randrange(0, 5))
        new = bytes(r.choice(b"theraz") for _ in range(r.randrange(0, 6)))
        computed = table.replace(lo, hi, new)
        assert table.data == data[:lo] + new + data[hi:]
        assert table.ids() == v.encode_piece(table.data)
        assert computed <= len(table.data) - lo
    long = bpe.PrefixTable(v, b"the rain in spain " * 500)
    assert long.replace(4000, 4003, b"q") < 400
    assert long.ids() == v.encode_piece(long.data)


def test_operator(spark, both):
    rows = [(1, "Hello, wörld  \n x", "k"), (2, None, "k"), (3, "", None), (None, "same", "k"), (4, "same", "k"), (4, "same", "k"), (5, "long " * 50_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(out) == len(rows) and all(r.matches for r in out)
    by = {r.doc_id: r for r in out}
    for i, text, _ in rows:
        ids = both[1].encode_ordinary(text or "")
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
