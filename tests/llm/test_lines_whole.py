import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import lines, queries
from test_lines_chat import SF, brute_pairs, brute_removed, norm, words


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.line_no) for r in lines.removed_lines(df).collect()}


def test_pairs_are_linked_where_buckets_hold_unlike_lines(spark):
    rng, rows = random.Random(3), []
    for _ in range(3):
        shared = words(rng, 30)
        for _ in range(60):
            own = words(rng, 20).split()
            copy = list(own)
            copy[rng.randrange(1, 19)] = words(rng, 1)
            copy[rng.randrange(1, 19)] = words(rng, 1)
            rows += [(len(rows), f"{shared} {' '.join(own)}"), (len(rows) + 1, f"{shared} {' '.join(copy)}")]
    want = brute_removed(rows, brute_pairs([t for _, t in rows]))
    assert len(want) > 100 and removed(spark, rows) == want


def test_hub_that_is_like_no_line_hides_no_link(spark, monkeypatch):
    rng = random.Random(5)
    a, b, odd = words(rng, 30), words(rng, 30), words(rng, 30)
    made = lines.split_lines(spark.createDataFrame([(1, f"{a}\n{a} x\n{b}\n{b} y\n{odd}")], "doc_id long, text string"))
    ids = {r.line_no: (r.id, r.more) for r in made.collect()}
    one = spark.createDataFrame([(band, i, ids[4][0], 5) for band in range(40) for i, _ in ids.values()], "band long, id long, hub long, n long")
    monkeypatch.setattr(lines, "buckets", lambda _: one)
    assert {frozenset((tuple(r.a), tuple(r.b))) for r in lines.similar(made).collect()} == {frozenset((ids[0], ids[1])), frozenset((ids[2], ids[3]))}


@pytest.mark.parametrize("most", [1000, 4], ids=["all pairs", "rare shingles"])
def test_buckets_of_unlike_lines_lose_no_link(spark, monkeypatch, most):
    """One bucket of 120 unlike lines and 12 pairs of similar ones, half of them with a passage that all share; no hub shows but a few of the pairs."""
    rng, rows = random.Random(17), []
    shared = words(rng, 12)
    rows += [f"{shared if i % 2 else ''} {words(rng, 14)}" for i in range(120)]
    for i in range(12):
        own = words(rng, 16)
        rows += [f"{shared if i % 2 else ''} {own}", f"{shared if i % 2 else ''} {own} {words(rng, 1)}"]
    rows = list(enumerate(rows))
    made = lines.split_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = sorted(r.id for r in made.collect())
    one = spark.createDataFrame([(7, i, ids[0], len(ids)) for i in ids], "band long, id long, hub long, n long")
    monkeypatch.setattr(lines, "buckets", lambda _: one)
    monkeypatch.setattr(lines, "ALL_PAIRS", most, raising=False)
    pairs = brute_pairs([t for _, t in rows])
    text = {(r.id, r.more): r.line for r in made.collect()}
    got = {tuple(sorted((text[tuple(r.a)], text[tuple(r.b)]))) for r in lines.similar(made).collect()}
    assert len(pairs) == 12 and got == pairs
    want = brute_removed(rows, pairs)
    assert len(want) == 12 and removed(spark, rows) == want


def test_rare_shingles_find_every_pair_of_unequal_length(spark):
    """Of lines of all lengths around a common passage: the pairs at 0.8 or more, all of them, with classes that hold several lines."""
    rng = random.Random(19)
    shared = words(rng, 20)
    texts = []
    for _ in range(40):
        own = words(rng, 6)
        texts += [f"{shared} {own}"[: rng.randint(60, 200)], f"{own} {shared} {own}", f"{own} {shared[rng.randint(0, 40):]}"]
    texts = sorted({norm(x) for x in texts})
    of = {x: k for k, x in enumerate(texts)}
    rows = [(7, k, k if k % 3 else 0, len(texts)) for x, k in of.items()]
    placed = spark.createDataFrame(rows, "band long, id long, root long, lines long")
    lined = spark.createDataFrame([(k, 0, x) for x, k in of.items()], "id long, more long, line string")
    root = {r[1]: r[2] for r in rows}
    got = {(r.a.id, r.b.id) for r in lines._verified(lines._rare_untied(placed, lined), lined).collect()}
    want = {tuple(sorted((of[a], of[b]))) for a, b in brute_pairs(texts) if root[of[a]] != root[of[b]]}
    assert len(want) > 100 and got == want


def test_rare_shingles_meet_a_pair_hardly_more_than_once(spark, monkeypatch):
    """120 unlike lines that are drawn from one passage by many edits, some of them pairs: none is lost, and neither are unlike lines met nor like ones over and over."""
    rng, passage, texts = random.Random(23), words(random.Random(24), 50).split(), []
    for k in range(120):
        own = [words(rng, 1) if rng.random() < 0.06 else w for w in passage]
        texts += [" ".join(own)] + ([" ".join(own[:-1])] if k % 10 == 0 else [])
    of = {x: k for k, x in enumerate(sorted(norm(x) for x in texts))}
    placed = spark.createDataFrame([(7, k, k, len(of)) for k in of.values()], "band long, id long, root long, lines long")
    lined = spark.createDataFrame([(k, 0, x) for x, k in of.items()], "id long, more long, line string")
    seen, pairs = [], lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda df: seen.append(df) or pairs(df))
    got = {(r.a.id, r.b.id) for r in lines._verified(lines._rare_untied(placed, lined), lined).collect()}
    want = {tuple(sorted((of[a], of[b]))) for a, b in brute_pairs(list(of))}
    assert len(want) >= 12 and got == want
    assert seen[0].count() <= 3 * len(want)


def test_bucket_of_one_class_and_some_unlike_lines_needs_no_rare_shingles(spark, monkeypatch):
    """One bucket of 80 lines of one class and 24 lines like no hub, ten of them in pairs and two like lines of the class: none is lost, unlike ones are not verified."""
    rng = random.Random(29)
    base = words(rng, 40).split()
    texts = [" ".join([*base[:k % 40], words(rng, 1), *base[k % 40 + 1 :]]) for k in range(80)]
    for k in range(12):
        own = words(rng, 40).split()
        texts.append(" ".join(own))
        texts.append(" ".join(own[:-1]) if k < 5 else " ".join(base[:34] + own[:4]) if k < 7 else words(rng, 40))
    rows = list(enumerate(texts))
    made = lines.split_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r.line: r.id for r in made.collect()}
    one = spark.createDataFrame([(7, i, ids[norm(texts[0])], len(ids)) for i in ids.values()], "band long, id long, hub long, n long")
    monkeypatch.setattr(lines, "buckets", lambda _: one)
    monkeypatch.setattr(lines, "_rare_untied", None)
    looked, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, texts: looked.append(pairs) or verified(pairs, texts))
    want = brute_removed(rows, brute_pairs(texts))
    assert len(want) >= 84 and removed(spark, rows) == want
    assert sum(pairs.count() for pairs in looked[1:]) <= 2 * len(texts)


def test_rare_shingles_settle_what_has_too_many_untied_pairs(spark, monkeypatch):
    """The same links by all untied pairs and by rare shingles."""
    rng, texts = random.Random(31), []
    for _ in range(40):
        own = words(rng, 16)
        texts += [own, f"{own} {words(rng, 1)}"]
    rows = list(enumerate(texts))
    every = lambda made: made.select("id").distinct().crossJoin(made.agg(F.min("id").alias("hub"), F.count("*").alias("n"))).select(F.lit(7).cast("long").alias("band"), "id", "hub", "n")
    monkeypatch.setattr(lines, "buckets", every)
    want = brute_removed(rows, brute_pairs(texts))
    called, rare = [], lines._rare_untied
    monkeypatch.setattr(lines, "_rare_untied", lambda *given: called.append(1) or rare(*given))
    assert len(want) == 40 and removed(spark, rows) == want and not called
    monkeypatch.setattr(lines, "PAIRS_PER_LINE", 8)
    assert removed(spark, rows) == want and called


def test_query_gives_the_kept_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.s for r in lines.dedup_lines(docs, short_copies=True).selectExpr("doc_id", "sha2(cast(text as binary), 256) AS s").collect()}
    assert {r.doc_id: r.text_sha256 for r in queries.op5_line_dedup(spark, SF).collect()} == want


def test_lines_without_blanks_are_compared_whole(spark):
    rng, rows = random.Random(11), []
    letters = "abcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(20):
        body = draw(500)
        rows += [(len(rows), draw(6) + body), (len(rows) + 1, draw(6) + body)]
        path = draw(120)
        rows += [(len(rows), f"https://example.org/{path}"), (len(rows) + 1, f"https://example.org/{path}?q")]
        row = [draw(9) for _ in range(20)]
        rows += [(len(rows), "\t".join(row)), (len(rows) + 1, "\t".join([draw(3), *row[1:]]))]
    want = brute_removed(rows, brute_pairs([t for _, t in rows]))
    assert len(want) >= 60 and removed(spark, rows) == want


def test_short_copies_go_at_any_length(spark):
    rows = [(1, "Menu\n\n a \nkept"), (2, "menu\n\nA\n \nnew"), (3, " MENU \t\nz"), (None, "menu")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed_lines) for r in lines.dedup_lines(df, short_copies=True).collect()}
    assert got == {1: (rows[0][1], []), 2: ("\n \nnew", [0, 2]), 3: ("z", [0]), None: ("menu", [])}


def test_query_leaves_no_exact_copy(spark):
    docs = {r.doc_id: (r.text or "").split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    gone = {r.doc_id: set(r.removed_lines) for r in queries.op5_line_dedup(spark, SF).collect()}
    kept = [n for i, found in docs.items() for no, x in enumerate(found) if no not in gone[i] and (n := x.strip(" \t\r\x0b\x0c").lower())]
    assert len(kept) == len(set(kept))


def test_clashing_columns_and_an_id_of_another_type(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to count", "k"), (2, "A line that is long enough to count", "k")], "doc_id int, text string, removed_doc string")
    done = lines.dedup_lines(df.withColumn("__doc", F.lit(5)))
    assert done.columns == ["doc_id", "text", "removed_doc", "__doc", "removed_lines"]
    assert sorted((r.doc_id, r.text, r.removed_doc) for r in done.collect()) == [(1, df.first().text, "k"), (2, "", "k")]


def test_recall_by_kind_of_line(spark):
    """Pairs of one edit each, at 0.8 or more, of long words, URLs with one host, prose and Chinese."""
    rng, rows = random.Random(21), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    draw = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    kinds = {
        "prose": lambda: words(rng, 20),
        "long": lambda: " ".join(draw(rng.randint(14, 22)) for _ in range(4)),
        "url": lambda: "https://example.org/" + draw(60),
        "han": lambda: draw(60, [chr(c) for c in range(0x4E00, 0x5000)]),
    }
    owner = []
    for kind, make in kinds.items():
        for _ in range(50):
            line = make()
            at = rng.randrange(len(line) - 1)
            rows += [(len(rows), line), (len(rows) + 1, line[:at] + "#" + line[at + 1 :])]
            owner += [kind, kind]
    want = brute_removed(rows, brute_pairs([t for _, t in rows]))
    got = removed(spark, rows)
    assert got <= want
    for kind in kinds:
        due = {x for x in want if owner[x[0]] == kind}
        assert len(due) > 30 and len(got & due) >= 0.9 * len(due)
