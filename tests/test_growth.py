"""Work that must follow the input: tasks of joins, few paths, folded functions."""

import random

import pytest

from tessel.operators import paths, records
from tessel.plans import catalog, effects


@pytest.mark.parametrize("name", ["cooccur_join", "resolved_members"])
def test_tasks_follow_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(catalog, "TASK_ROWS", 500)
    assert effects.parts_of is catalog.parts_of
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == catalog.parts_of(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) > 10


def test_folding_and_rounds_agree(spark, monkeypatch):
    rng = random.Random(4)
    steps = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 9), rng.choice("abcd"), rng.choice(["a", "b", "c", "d", None])) for _ in range(60)], "function long, step int, target string, used string")
    seeds = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "b", "y"), (2, "b", "y"), (3, "c", "x"), (4, "a", "x"), (None, "a", "x"), (1, None, "x")], "function long, name string, source string")
    seen = []
    for folded in (0, 12, 64):  # all by rounds, one function by rounds, none
        monkeypatch.setattr(records, "FOLDED", folded, raising=False)
        seen.append(sorted(map(tuple, records.tainted(steps, seeds.where("source is not null")).collect()), key=repr))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 8
    monkeypatch.setattr(records, "_in_rounds", None)  # a table of short functions needs none
    assert records.tainted(steps, seeds).count() > 8


def test_few_and_many_paths_agree(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.choice("kl"), rng.randint(0, 30), rng.randint(0, 30)) for _ in range(45)], "kind string, src long, dst long")
    seen = []
    for few in (0, 10, 1000):
        monkeypatch.setattr(paths, "FEW_PATHS", few)
        seen.append([sorted((r.kind, *r.path) for r in paths.maximal_paths(edges, n).collect()) for n in (None, 1, 3)])
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) > 5


def test_a_round_that_trims_little_is_the_last(spark, monkeypatch):
    made = []
    monkeypatch.setattr(paths, "materialize", lambda df, tag, real=paths.materialize: (made.append(tag), real(df, tag))[1])
    ring, tail = [(k, (k + 1) % 4) for k in range(4)], [(k, k + 1) for k in range(100, 130)]
    rings = [(10 * i + a + 1000, 10 * i + b + 1000) for i in range(20) for a, b in ring]
    edges = spark.createDataFrame([("k", a, b) for a, b in rings + tail], "kind string, src long, dst long")
    assert paths.cycles(edges).count() == 20
    assert made.count("edges") <= 3  # a chain of 30 would take 15 rounds
