import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticelake.llm.packing import PieceCache, binary_lengths, pack

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "Hello  world, it's DON'T 'll 123 4.5",
    "Étude naïve ÀÉ ß µ",
    "a\x1cb\x85c d　e f",
    "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "İstanbul ΣΑΣ ﬁ é ́x 中文字 кот 😀👍",
    "",
    "   \n\t",
    "word " * 3000,
    "x" * 5000,
]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 2047, 2048, 2049, 10_000])
def test_binary_lengths(n):
    got = binary_lengths(n)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)
    assert len(set(x for x in got if x < 2048)) == len([x for x in got if x < 2048])


def test_pieces_of_text_encode_like_the_whole():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    chars = "abEÀÿŸªºµʰ é'sß1 \n\t\x0b\x1f !#<|>ñ́‍Σkк中"
    texts = TEXTS + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(1500)]
    cache = PieceCache(PATH, most=300)
    assert cache.by_pieces
    for text in texts:
        assert np.frombuffer(next(cache.encode_texts([text.encode()])), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_another_kind_of_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, cache = Tokenizer.from_file(str(path)), PieceCache(str(path))
    assert not cache.by_pieces
    for text, got in zip(TEXTS, cache.encode_texts([t.encode() for t in TEXTS]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [*enumerate(TEXTS), (100, None), (1, TEXTS[1]), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = pack(docs, PATH).collect()
    want = []
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        start = 0
        for n in binary_lengths(len(ids)):
            want.append((str(i), start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids), tuple(ids[start : start + n])))
            start += n
    assert sorted((str(r.id), r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0} and min(r.sequence_id for r in got) >= 0
    ordered = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert ordered == sorted(ordered)
    narrow = pack(docs, PATH, with_ids=False)
    assert "ids" not in narrow.columns and Counter(r.ids_crc32 for r in narrow.collect()) == Counter(r[3] for r in want)


def test_numbers_are_made_in_place(spark):
    """No piece is moved, whatever its table's size; parts that one task reads have numbers of their own."""
    docs = spark.createDataFrame([(k, "some words " * (k % 90)) for k in range(300)], "doc_id long, text string").repartition(5)
    once = pack(docs, PATH)
    assert "Exchange" not in pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH)._jdf.queryExecution().executedPlan().toString()
    rows = once.coalesce(1).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == once.count()
    assert {(r.id, r.start, r.sequence_id) for r in rows} == {(r.id, r.start, r.sequence_id) for r in once.collect()}


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
