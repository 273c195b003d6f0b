"""The language query against plain loops over characters, n-grams and centroids."""

import math

import pytest

from quillon.llm import langid, queries

SF = "/root/testdata/sf0.001"
MASK = (1 << 32) - 1


def place(gram):
    """The feature of one, two or three letters, 0 for a gap."""
    h = gram[0] * 0x9E3779B1 & MASK
    for letter, shift, times in zip(gram[1:], (15, 13), (0x85EBCA77, 0xC2B2AE3D)):
        h = ((h ^ h >> shift) * times + letter) & MASK
    h = ((h ^ h >> 16) * 0x27D4EB2F + len(gram)) & MASK
    return (h ^ h >> 15) % langid.WIDTH


def counts(text):
    letters = [0]
    for c in text or "":
        low = c.lower()
        letter = ord(low if len(low) == 1 else c) if c.isalpha() else 0
        if letter or letters[-1]:
            letters.append(letter)
    if letters == [0]:
        return None
    if letters[-1]:
        letters.append(0)
    found = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            gram = letters[i : i + n]
            if gram != [0]:
                found[place(gram)] = found.get(place(gram), 0) + 1
    return found


def test_query_equals_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    centres, weights = model.centres.tolist(), model.weights.tolist()
    got = {r.doc_id: r for r in queries.op6_langid(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) > 50
    for r in rows:
        found = counts(r.text)
        if found is None:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        vector = {k: math.log1p(n) * weights[k] for k, n in found.items()}
        length = math.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(x * c[k] for k, x in vector.items()) / length for c in centres]
        assert got[r.doc_id].score == pytest.approx(max(cosines), abs=1e-4)
        assert got[r.doc_id].lang_pred in {name for name, x in zip(model.labels, cosines) if x > max(cosines) - 1e-4}
