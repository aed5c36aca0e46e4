import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from readloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_transducer_equals_tiktoken(lib):
    encoder, tokens = bpe.codec(PATH, P.PATTERN)
    r = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "the ingtionre", "éèüßñ çàthe ", "0123456789 .,'\n\t", "日本語 한국어 😀👩‍👩‍👧", "\x00\x1c\x1d\x85  　 \r\nx", "=-_#*&$% ", "ΣσςİıKſ"]
    texts = ["", " ", "a", "'s 'll it's", "x" * 3000, "ab" * 2000, " " * 500 + "z", "é" * 700, "<|endoftext|>", "é"]
    texts += ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(r.choice(a) for _ in range(r.randint(1, 80))) for a in alphabets for _ in range(150)]
    for t in texts:
        ids = np.frombuffer(encoder.packed(t), "<u4").tolist()
        assert ids == lib.encode_ordinary(t), t
        assert "".join(bpe.decoded(tokens, ids)) == t


def test_lookahead_is_bounded(lib):
    t = bpe.Transducer(bpe.load_ranks(PATH))
    data, read = b"thetionofthering" * 40, 0

    def source():
        nonlocal read
        for read, byte in enumerate(data, 1):
            yield byte

    given = 0
    for token in t.stream(source()):
        given += len(t.token[token])
        assert read - given < max(map(len, t.ranks)) or read == len(data)
    assert given == len(data)


def test_tables_may_be_emptied(lib, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 40)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 5)
    t = bpe.Transducer(bpe.load_ranks(PATH))
    for word in ("internationalisation", "thethethethe", "zzzzzxxxxxyyyy", "éèéèéè", "qwertyuiopasdfghjkl"):
        assert t.piece(word.encode()) == lib.encode_ordinary(word)


def test_stream_decoder_is_incremental():
    data = "é日😀x".encode() + b"\xff\xe2\x82" + b"a\xf0\x9f"
    tokens = [bytes([i]) for i in range(256)]
    d = bpe.StreamDecoder(tokens)
    parts = [d.feed([x]) for x in data] + [d.end()]
    assert "".join(parts) == data.decode("utf-8", "replace")
    assert parts[0] == "" and parts[1] == "é"


def test_operator_edges(spark, lib):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "y"), (None, "a b", None), (1, "Hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    want = set()
    for doc_id, text, _ in rows:
        ids = lib.encode_ordinary(text or "")
        want.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert out == want
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(map(str, back.collect())) == sorted(str(r) for r in docs.selectExpr("doc_id", "coalesce(text, '') text").collect())
