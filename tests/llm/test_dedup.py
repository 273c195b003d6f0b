import hashlib
import random
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import queries, simhash, suffix

SF = "/root/testdata/sf0.001"


def texts(spark, path=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def brute_print(text):
    words, out = (text or "").encode(), 0
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    for bit in range(64):
        out |= (2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit
    return out


def brute_components(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    root = {p: p for _, p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    low = {}
    for d, p in prints:
        if d is not None:
            low[find(p)] = min(d, low.get(find(p), d))
    return sorted((str(d), f"{p:016x}", low.get(find(p))) for d, p in prints)


def test_simhash_query_equals_brute_force(spark):
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect())
    assert got == brute_components(texts(spark))


def test_simhash_edge_rows(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (None, "one two three four"), (5, "one two three four"), (5, "one two three four"), (6, "ONE\x0btwo  three four"), (7, "x"), (8, "x y"), (9, "ab " * 30000)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, fp int, key string")
    got = sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_ball_links_reach_what_all_pairs_reach(spark, seed):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for n in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = {(r.fp, r.hub) for r in simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert all((a ^ b).bit_count() <= 3 if (a < 0) == (b < 0) else ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)

    def classes(pairs):
        root = {v: v for v in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for v in signed:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    close = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert classes(links) == classes(close)


def brute_cut(rows):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("path", [SF, "/root/testdata/sf0.01"])
def test_suffix_query_equals_brute_force(spark, path):
    assert sorted(map(tuple, queries.op2_suffix_dedup(spark, path).collect()), key=str) == brute_cut(texts(spark, path))


def cut(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix.cut_repeats(df).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_suffix_dense_repeats(spark, parts):
    rng = random.Random(parts)
    pieces = ["".join(rng.choice("abé ") for _ in range(rng.choice([30, 60, 99, 100, 101, 130, 250]))) for _ in range(8)] + ["a" * 150, "ab" * 90]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 99), (103, "z" * 100), (104, "z" * 100), (105, "q" * 3000)]
    assert cut(spark, rows, parts) == brute_cut(rows)
    assert cut(spark, [(1, "")], parts)[0][1] == 0
    assert suffix.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(3).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, text, 9), (1, text, 9), (None, text, 9)], "doc_id long, text string, doc int")
    assert sorted((str(r.doc_id), len(r.kept)) for r in suffix.cut_repeats(df).collect()) == [("1", 300), ("1", 300), ("None", 0)]


def test_suffix_texts_that_share_an_id_lose_their_own_bytes_only(spark):
    rng = random.Random(9)
    a, b, c = ("".join(rng.choices("abcdefgh", k=n)) for n in (150, 300, 300))
    for key in (2, None):
        df = spark.createDataFrame([(1, a), (key, a + b), (key, c)], "doc_id long, text string")
        got = sorted((len(r.kept), r.n_bytes) for r in suffix.cut_repeats(df).collect())
        assert got == [(150, 150), (300, 300), (300, 450)]


def test_chunks_do_not_change_the_result(monkeypatch):
    text = "".join(random.Random(5).choices("abc", k=5000)).encode()
    whole = suffix.Sampler().stretches(text)
    monkeypatch.setattr(suffix, "CHUNK", 777)
    cut_up = suffix.Sampler().stretches(text)
    assert whole[2][0] == cut_up[2][0] == 0 and whole[3][-1] == cut_up[3][-1] == 4900
    assert set(whole[0].tolist()) == set(cut_up[0].tolist())


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=600))
def test_stretches_cover_all_strings_in_order(data):
    _, _, first, last = suffix.Sampler().stretches(data)
    assert [p for a, b in zip(first, last) for p in range(a, b + 1)] == list(range(max(0, len(data) - 99)))


def test_pairs_of_ranks_cover_each_string_once():
    import numpy as np

    sampler = suffix.Sampler()
    octets = np.random.default_rng(5).integers(97, 101, 3000).astype(np.uint8)
    ranks = sampler._prefix_hashes(octets)
    seen = []
    for h, _, first, last in zip(*sampler.stretches(octets.tobytes())):
        for rank, other, a, b in sampler.pairs(octets, int(first), int(last)):
            assert rank == int(h)
            seen += range(a, b + 1)
            # The pair's 66 bytes lie within each of its strings.
            places = [p for p in np.flatnonzero(ranks == h).tolist() if (p >= suffix.OFFSET and ranks[p - suffix.OFFSET] == other and p - suffix.OFFSET >= b and p + suffix.PREFIX <= a + suffix.LENGTH) or (p + suffix.OFFSET < len(ranks) and int(ranks[p + suffix.OFFSET]) ^ ((1 << 64) - 1) == other and p >= b and p + suffix.OFFSET + suffix.PREFIX <= a + suffix.LENGTH)]
            assert places
    assert seen == list(range(len(octets) - suffix.LENGTH + 1))
