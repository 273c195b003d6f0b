import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import bpe, queries

PIECES = ["a", "the", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "日本", "'s", "'LL", "1", "23", "<|endoftext|>", "!!", "---", "😀", "​", "ing", "ſ", "Ⅷ", "\r\n", "a" * 40, "́", "\x00", "�"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_equals_the_library_on_mixed_pieces(library):
    rng, made = random.Random(1), queries.automaton()
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(made.encode(text), "<u4").tolist() == ids
        assert made.decode(made.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_automaton_accepts_right_encodings_only():
    rest = [c for c in bpe.byte_letters() if c not in "ab"]
    made = bpe.MergeAutomaton({"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4} | {c: i for i, c in enumerate(rest, 5)}, [("a", "a"), ("a", "b"), ("a", "ab")])
    assert [made.encode_word(b"a" * n) for n in (1, 2, 3, 4)] == [[0], [2], [2, 0], [2, 2]]
    assert made.encode_word(b"aab") == [2, 1] and made.encode_word(b"aaab") == [2, 3] and made.encode_word(b"bab") == [1, 3]
    assert not made.has_arc(0, 0) and not made.has_arc(0, 2) and made.has_arc(2, 0)


def test_a_byte_without_a_token_is_refused():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton({"a": 0}, [])


@pytest.mark.parametrize("letters", ["ab", "-", " ", "abcdefghijklmnopqrstuvwxyz", "é日"])
def test_one_very_long_word_takes_linear_time(library, letters):
    rng, made = random.Random(2), queries.automaton()
    text = "".join(rng.choices(letters, k=1_000_000))
    began = time.process_time()
    got = np.frombuffer(made.encode(text), "<u4").tolist()
    assert time.process_time() - began < 60
    assert got == library.encode(text, add_special_tokens=False).ids and made.decode(made.encode(text)) == text


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(map(tuple, queries.op4_bpe(spark, sf).collect())) == sorted(want)


def test_edge_rows_and_clashing_columns(spark):
    made = queries.automaton()
    rows = [(1, None, b"x", "y"), (None, "", None, None), (2, "ab " * 50000, None, None), (2, "ab", None, None), (2, "ab", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, __text string")
    done = bpe.decode(bpe.encode(df, made), made)
    assert done.columns == ["doc_id", "text", "__text", "ids", "decoded"]
    assert [(r.text or "") == r.decoded for r in done.collect()] == [True] * 5
    both = bpe.encode_decode(df, made)
    assert both.columns == done.columns and sorted(map(str, both.collect())) == sorted(map(str, done.collect()))
    assert bpe.encode(df.limit(0), made).count() == bpe.encode_decode(df.limit(0), made).count() == 0
    odd = spark.createDataFrame([(bytearray((99999).to_bytes(4, "little") + (64).to_bytes(4, "little")),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(odd, made).collect()] == [made.spelt[64].decode(), ""]
