import base64
import hashlib
import random
import struct

import public_tokenizers as P
import tiktoken

from ranklake.llm.bpe import Tokenizer, encode, read_ranks


def test_matches_tiktoken_and_round_trips():
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = read_ranks(data)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, rng = Tokenizer(ranks, P.PATTERN), random.Random(5)
    texts = ["", " ", "a\x1cb\x85c​  d", "x" * 3000, " " * 500 + "y", "é̀" * 99, "日本語のテキスト" * 40, "🙂👍🏽" * 20, "don't WE'LL 12345 <|endoftext|>"]
    alphabets = ["ab", "etaoinsrh ", "abcdefghijklmnopqrstuvwxyz", "éèàüñßçœ eta", "0123456789 ,.", "日本語中文 \n\t", "ابتث אבג"]
    texts += ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 300))) for _ in range(1500)]
    tokens = list(ranks)
    texts += [b"".join(rng.choices(tokens, k=12)).decode("utf-8", "ignore") for _ in range(1500)]
    for text in texts:
        ids = ours.encode(text)
        assert ids.tolist() == theirs.encode_ordinary(text), text
        assert "".join(ours.decode(ids)) == "".join(ours.decode(ids, 1)) == text
    assert base64.b64encode(b"a") in data


def test_query_rows(spark):
    """Null, empty, repeated and long texts through Spark, with a column of the operator's own name."""
    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    rows = [(1, None), (2, ""), (3, "Ünïcode text, 123"), (3, "Ünïcode text, 123"), (None, "x"), (4, "long words " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as ids")
    want = []
    for key, text in rows:
        ids = theirs.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, encode(docs, data, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    assert encode(docs.limit(0), data, P.PATTERN).count() == 0


def test_small_caches():
    ranks = read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    small, large = Tokenizer(ranks, P.PATTERN, max_pieces=8, max_transitions=60), Tokenizer(ranks, P.PATTERN)
    texts = ["one two three four five six seven", "two three eight", "", "neun zehn " * 3, "one two x" * 40, "ununterbrochenheitlichkeit" * 20, "one seven"]
    for text in texts * 3:
        assert small.encode(text).tolist() == large.encode(text).tolist()
        assert "".join(small.decode(small.encode(text), block=3)) == text
