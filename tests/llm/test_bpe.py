import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import Row

from tracequill.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    alphabet = "abcdefgh ijkl\n\t  é日本語ß’'s123 \x1c\x1f\x85 😀-_/"
    return [
        "", " ", "\n\n  x", "don't we'll <|endoftext|>", "a" * 3000, "ab" * 1500, "9" * 700, "a\u0558b \u0c5c1\U0003d000 x\U00011de0 2\u1c89\ua7ce\u0378", "".join(rng.choices("etaoinshr", k=2500)),
        *("".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(200)),
    ]


def test_ids_and_bytes_equal_the_library(spark, library):
    cases = texts()
    df = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash") for i, t in enumerate(cases)])
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(cases):
        assert got[i].ids == library.encode_ordinary(t), t[:50]
        assert bytes(got[i].decoded) == t.encode()


def test_null_repeated_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in bpe.digests(df, PATH, P.PATTERN).collect())
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[1:] == [(1, 0, nothing)] * 2 and got[0][1] == 1
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch, library):
    codec = bpe.codec(PATH, P.PATTERN, bpe.reclassified())
    words = sorted({w for t in texts() for w in codec.split.findall(t)})
    ids, sizes, decoded = codec.encode_words(words)
    for w, i, n, d in zip(words, ids, sizes, decoded, strict=True):
        want = library.encode_ordinary(w)
        assert i == ",".join(map(str, want)) and n == len(want) and d == w.encode()


def test_long_words_equal_the_library():
    rng = random.Random(9)
    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choices(a, k=n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "éa", "x") for n in (1, 2, 201, 5_000)]
    for word in [*words, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=300_000))]:
        assert bpe.contracted(word.encode(), ranks) == library.encode_ordinary(word)


def test_words_that_earlier_blocks_repeat_are_not_encoded_again(monkeypatch, library):
    codec = bpe.Codec(PATH, P.PATTERN, bpe.reclassified())
    encoded = []
    encode = codec.encode_words
    monkeypatch.setattr(codec, "encode_words", lambda words: encoded.append(words) or encode(words))
    first, second = ["qzxabl", " qzyabl", "qzxabl", " once", "z" * 300, "z" * 300], [" qzwabl", "qzxabl", " once", "z" * 300, "qzxabl", " qzwabl"]
    for limit, again in ((bpe.KNOWN_WORDS, [" qzwabl", " once", "z" * 300]), (0, list(dict.fromkeys(second)))):
        monkeypatch.setattr(bpe, "KNOWN_WORDS", limit)
        codec.known = {}
        for words in (first, second):
            block = bpe.Block()
            block.add(1, words)
            block.add(2, [])
            found = dict(zip(block.words, zip(*codec.encode_block(block), strict=True), strict=True))
            for w in words:
                want = library.encode_ordinary(w)
                assert found[w] == (",".join(map(str, want)), len(want), w.encode())
        assert encoded[-1] == again and len(codec.known) <= limit
