import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import byte_bpe, queries, token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "\n\n a  b\n c ", "<|endoftext|> x", "a\x1cb c", "It's we'LL DON'T 'S x's", "Ünïcode É é ÀÉ ß ſ Σας İstanbul", "日本語 テスト 한국어", "á é", " a b\u0085c d",
    "  lead", "trail  ", "tab\there", "1234567 ²³½ 12a3", "...''s!!!'re", "x" * 3000, "a b\n\nc  d \n e", "😀 emoji 👨‍👩‍👧", "\r\n win\r\n", "don't won't'll 'tis", "﻿ bom", "# #", "word " * 3000,
]


def fuzzed(n=1500):
    rng, letters = random.Random(1), "aB é'\n\t \x1c .,!19½ßÀ日́<|'sSt"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_word_encoder_equals_the_library():
    texts = TEXTS + fuzzed()
    library = Tokenizer.from_file(WORDS)
    for most in (400_000, 5):
        coder = token_files.WordEncoder(WORDS, most)
        for k in range(0, len(texts), 200):
            part = texts[k : k + 200]
            for t, got, want in zip(part, coder.encode(part), library.encode_batch(part, add_special_tokens=False), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(t)


def test_word_encoder_remembers_pieces_and_not_what_they_stand_next_to():
    rng = random.Random(2)
    words, marks = ["harbor", "Süd", "don't", "É", "x9"], [".", ",", "!", "?", ")", "(", ";", ":"]
    texts = [" ".join(rng.choice(marks) * rng.randint(1, 3) + rng.choice(words) + rng.choice(marks) for _ in range(400)) for _ in range(20)]
    coder, library = token_files.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for t, got, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(t)
    pieces = {"harbor", "süd", "don", "'t", "é", "x", "9"} | {m * n for m in marks for n in (1, 2, 3)}
    assert set(coder.words) == pieces and not coder.chunks
    odd = ["日本 harbor.", "harbor. – Süd"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]
    assert set(coder.words) == pieces


def test_byte_bpe_equals_tiktoken_and_decodes():
    texts = TEXTS + fuzzed()
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for most in (300_000, 5):
        coder = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, most)
        for k in range(0, len(texts), 200):
            part = texts[k : k + 200]
            for t, got in zip(part, coder.encode(part), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(t), repr(t)
                assert coder.decode(got) == t.encode()


@pytest.mark.parametrize("values", [[], [[]], [[7]], [[0, 2**32 - 1] * 200], [list(range(1000)), [], [5] * 300, [1, 2, 2**31] * 50]])
@pytest.mark.parametrize("chunk", [1, 4096])
def test_pfor_round_trip(values, chunk):
    out = io.BytesIO()
    writer = token_files.PforWriter(out, chunk_blocks=chunk)
    arrays = [np.array(v, np.uint32) for v in values]
    for i, v in enumerate(arrays):
        writer.add(None if i == 1 else i, v)
    assert writer.close() == sum(map(len, values))
    reader = token_files.PforReader(out)
    got = list(reader.documents(step_blocks=3))
    assert [(d, n.tolist()) for d, _, n in got] == [(None if i == 1 else i, list(v)) for i, v in enumerate(values)]
    whole = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    for start, count in ((0, 0), (0, min(3, len(whole))), (len(whole) // 2, len(whole) - len(whole) // 2)):
        assert np.array_equal(reader.read(start, count), whole[start : start + count])


def test_pfor_packs_and_patches():
    v = np.array([1000 + k % 16 for k in range(127)] + [4_000_000], np.uint32)
    out = io.BytesIO()
    writer = token_files.PforWriter(out)
    writer.add(1, v)
    writer.close()
    reader = token_files.PforReader(out)
    assert (reader.least[0], reader.width[0], reader.patched[0]) == (1000, 4, 1)


def test_token_files_query(spark, tmp_path):
    docs = [(7, "b c"), (3, None), (5, "Hello, world!"), (5, "again"), (-2, "x " * 500), (2**40, "日本"), (None, "no id")] + [(100 + k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    got = token_files.token_files(df, WORDS).select("id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_files(df.limit(0), WORDS).count() == 0


def test_byte_bpe_operator(spark):
    df = spark.createDataFrame([(1, "a b", 5), (None, None, None), (1, "a b", 5), (3, "", 2)], "doc_id long, text string, n_tokens int")
    got = sorted(byte_bpe.coded(df, RANKS, public_tokenizers.PATTERN).collect(), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and sum(r["ids_sha256"] == nothing and r["n_tokens"] == 0 for r in got) == 2
    assert {r["decoded_sha256"] for r in got} == {nothing, hashlib.sha256(b"a b").hexdigest()}
    assert byte_bpe.coded(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op5_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for r in queries.op5_byte_bpe(spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
