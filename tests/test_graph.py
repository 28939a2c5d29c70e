"""Ancestors against a plain walk, on random graphs with merges."""

import random

import pytest

from palimpsest.operators import graph


def plain(parents, start):
    depth, level, found = 0, {start}, {}
    while level:
        depth += 1
        level = {p for c in level for p in parents.get(c, ())} - found.keys() - {start}
        found |= {p: depth for p in level}
    return found


@pytest.mark.parametrize("together", [1, 3, 12])
def test_ancestors_of_random_graphs(spark, together):
    rng = random.Random(together)
    parents = {f"{i:03}": {f"{rng.randrange(max(0, i - 6), i):03}" for _ in range(rng.choice([1, 1, 2, 3]))} for i in range(1, 40)}
    edges = spark.createDataFrame([(c, p) for c, ps in parents.items() for p in ps], "child_id string, parent_id string")
    start = spark.createDataFrame([("039",)], "id string")
    assert {r.id: r.depth for r in graph.ancestors(edges, start, together).collect()} == plain(parents, "039")


def test_history_parents_and_errors(spark):
    commits = spark.createDataFrame([(i, c, i, f"r{i}") for i, c in enumerate("abcd")], "seq long, id string, created_at_ms long, root_hash string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("d", "b")], "child_id string, parent_id string")
    assert [(r.id, r.depth) for r in graph.history(commits, edges, "d").collect()] == [("d", 0), ("b", 1), ("c", 1), ("a", 2)]
    assert [r[0] for r in graph.parents_of(edges, commits, "d").collect()] == ["b", "c"]
    assert [r.parents for r in graph.commit_list(commits, edges).collect()] == [[], ["a"], ["a"], ["b", "c"]]
    with pytest.raises(graph.UnknownCommit):
        graph.history(commits, edges, "x")
    with pytest.raises(Exception, match="missing from the graph"):
        graph.history(commits.where("id <> 'a'"), edges, "d").collect()
