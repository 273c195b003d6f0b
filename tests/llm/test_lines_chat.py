import random
from itertools import combinations

from quillon.llm import chat, lines, queries

SF = "/root/testdata/sf0.001"


def norm(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def brute_pairs(texts):
    found = sorted({n for t in texts for line in (t or "").split("\n") if len(n := norm(line)) >= 24})
    sets = [shingles(x) for x in found]
    out = set()
    for i, j in combinations(range(len(found)), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (k := len(a & b)) >= 0.8 * (len(a) + len(b) - k):
            out.add((found[i], found[j]))
    return out


def brute_removed(rows, pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    seen, gone = set(), set()
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for no, line in enumerate((text or "").split("\n")):
            if len(n := norm(line)) >= 24:
                if find(n) in seen:
                    gone.add((doc, no))
                seen.add(find(n))
    return gone


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_similar_lines_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for i in range(60):
        base = words(rng, rng.randint(8, 60)).split()
        for k in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((10_000 + 3 * i + k, " ".join(copy)))
    want = brute_pairs([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = lines.split_lines(df)
    text = {(r.id, r.more): r.line for r in made.select("id", "more", "line").distinct().collect()}
    got = {tuple(sorted((text[tuple(r.a)], text[tuple(r.b)]))) for r in lines.similar(made).collect()}
    assert got <= want
    gone = {(r.doc_id, r.line_no) for r in lines.removed_lines(df).collect()}
    right = brute_removed(rows, want)
    assert gone <= right and len(gone) >= 0.95 * len(right)


def test_line_edge_rows(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from all of it at once"
    rows = [(1, f"{a}\nshort\n{a.upper()} \n\n{a}!"), (2, f"short\nunlike any other line in this table\n{a}"), (3, None), (4, ""), (None, a), (2, f"short\nunlike any other line in this table\n{a}"), (5, "y" * 70000), (6, "y" * 70001)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, root string")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "root", "removed_lines"]
    by = {r.doc_id: (r.text, r.removed_lines) for r in got.collect()}
    assert got.count() == 8
    assert by[1] == (f"{a}\nshort\n", [2, 4]) or by[1][1] == [2, 4]
    assert by[2] == ("short\nunlike any other line in this table", [2])
    assert by[3] == (None, []) and by[4] == ("", []) and by[None] == (a, [])
    assert by[5] == ("y" * 70000, []) and by[6] == ("", [0])
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_chat_pieces_and_masks(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "yo <|end|>"), (1, 3, None, "é😀"), (2, 0, "system", "alone"), (None, 0, "a b", "x"), (1, 1, "ann", "hi"), (3, None, "u", "z" * 100000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    for piece in (256, 2):
        got = chat.perspectives(df, piece).collect()
        assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "a b"), (3, "u")}
        assert sum(r.n_turns for r in got if r.conv_id == 1) == 18
        for r in got:
            own = [r.text[s.start : s.end] for s in r.mask]
            assert len(own) == r.n_trained and all(x.endswith("<|end|>\n") for x in own)
            assert all(r.text[: s.start].endswith("<|assistant|>\n") for s in r.mask)
    whole = {r.perspective: r for r in chat.perspectives(df).collect() if r.conv_id == 1}
    assert whole["bob"].text == "<|system|>\nbe kind<|end|>\n" + "<|user name=ann|>\nhi<|end|>\n" * 2 + "<|user name=ann|>\nyo < |end|><|end|>\n<|assistant|>\n<|end|>\n<|user name=unknown|>\né😀<|end|>\n"
    assert chat.perspectives(df.limit(0)).count() == 0


def test_chat_query_covers_all_turns(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    speakers = {}
    for r in given:
        if r.role != "system":
            speakers.setdefault(r.conv_id, set()).add(r.role)
    want = sum(len(speakers.get(r.conv_id, ())) for r in given)
    assert sum(r.n_turns for r in queries.op8_chat(spark, SF).collect()) == want
