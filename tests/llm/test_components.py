import random
import uuid

import pytest

from quillon.llm import components, lines


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root if find(x) != x}


def graphs():
    rng = random.Random(41)
    path = [(i, i + 1) for i in range(60)]
    order = rng.sample(range(60), 60)
    return {
        "path": path,
        "mixed path": list(zip(order, order[1:])),
        "star": [(99, i) for i in range(50)] + [(-1, i) for i in range(0, 50, 7)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "odd": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
        "none": [(None, 1), (2, 2)],
    }


@pytest.mark.parametrize("kind", list(graphs()))
def test_components_against_union_find(spark, kind):
    edges = graphs()[kind]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == brute(edges)


def test_a_round_takes_few_stages(spark, monkeypatch):
    """Each stage has as many tasks as there are partitions; many of them on few edges cost more than the edges do."""
    context, group, rounds, checkpoint = spark.sparkContext, uuid.uuid4().hex, [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: rounds.append(1) or checkpoint(df))
    edges = spark.createDataFrame(graphs()["mixed path"], "a long, b long")
    context.setJobGroup(group, "components")
    try:
        components.components(edges, "a", "b")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks}
    assert len(rounds) > 3 and len(stages) <= 7 * len(rounds)


def test_bands_are_joined_without_sorting_them(spark):
    """A line has 16 bands, so that sorting them costs more than all else that is done with them."""
    made = lines.split_lines(spark.createDataFrame([(k, f"a line that is long enough to count, number {k % 5}") for k in range(20)], "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lines.buckets(made)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_are_in_lower_case_as_each_would_be_by_itself(spark):
    """A text is put in lower case as a whole; a Greek sigma at the end of a line, and letters that grow, come out as in the line alone."""
    texts = [" ΟΔΟΣ ΚΑΙ ΟΔΟΣ \nΣΟΦΙΑΣ\nΣ", "İSTANBUL\r\n\tÀB\x0b\n", "ΑΣ\nΑ", "Σ\n\nΣΑ"]
    got = {(r.doc_id, r.line_no): r.line for r in lines.split_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1).collect()}
    want = {(k, no): n for k, text in enumerate(texts) for no, x in enumerate(text.split("\n")) if (n := x.strip(" \t\r\x0b\x0c").lower())}
    assert got == want
