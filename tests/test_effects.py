"""Effects against plain loops, on empty and null input too."""

import random

import pytest

from tessel.operators import effects


def test_dependencies_and_chains(spark):
    rng = random.Random(1)
    rows = [(rng.choice("pq"), f"f{rng.randrange(6)}", rng.choice(["a", "b", "c", None]), rng.choice(["read", "write"])) for _ in range(60)]
    flags = [(c, f"f{k}", *(rng.choice([True, False, None]) for _ in range(3))) for c in "pq" for k in range(6)]
    df = spark.createDataFrame(rows, "contract string, function string, var string, kind string").repartition(3)
    side = lambda kind: {(c, f, v) for c, f, v, k in rows if k == kind and v}
    writes, reads = side("write"), side("read")
    want = set()
    for c, f in {(c, f) for c, f, _, _ in rows}:
        near = lambda own, c=c, f=f: tuple(sorted({g for d, g, v in writes if d == c and g != f and (c, f, v) in own}))
        want.add((c, f, near(writes), near(reads)))
    assert {(r.contract, r.function, tuple(r.conflicts_with), tuple(r.depends_on)) for r in effects.dependencies(df).collect()} == want
    one, two = ({(c, f): v[k] for c, f, *v in flags} for k in (0, 1))
    pairs = {(c, w, r, v) for c, w, v in writes for d, r, u in reads if (c, v) == (d, u) and w != r}
    functions = spark.createDataFrame(flags, "contract string, function string, calls_out boolean, public boolean, guarded boolean")
    guarded = {(c, f): v[2] for c, f, *v in flags}
    got = {tuple(r) for r in effects.cross_function_edges(df, functions).collect()}
    assert got == {(c, w, r, v) for c, w, r, v in pairs if one[c, w] and not guarded[c, w] and two[c, r]}
    named = functions.withColumnsRenamed({"calls_out": "manipulates", "public": "profitable"})
    chains = {(r.contract, r.source, r.target): list(r.shared) for r in effects.profit_chains(df, named).collect()}
    assert chains == {(c, w, r): sorted({v for d, x, y, v in pairs if (d, x, y) == (c, w, r)}) for c, w, r, _ in pairs if one[c, w] and two[c, r]}
    assert effects.dependencies(df.limit(0)).count() == 0 and effects.profit_chains(df.limit(0), named).count() == 0


def test_chains_of_ancestors(spark):
    chain = spark.createDataFrame([("c", "c", 0), ("c", "b", 1), ("c", "a", 2), ("b", "b", 0), ("b", "a", 1)], "contract string, ancestor string, place int")
    members = spark.createDataFrame([("a", "m"), ("b", "m"), ("a", "n"), ("a", "n")], "ancestor string, member string")
    assert sorted(map(tuple, effects.resolved_members(chain, members).collect())) == [("b", "m", "b", 1), ("b", "n", "a", 0), ("c", "m", "b", 1), ("c", "n", "a", 0)]
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), (None, "a")], "src string, dst string")
    own = spark.createDataFrame([("a", "guard"), ("b", "owner"), ("z", "own")], "contract string, name string")
    assert {r.contract: list(r.protections) for r in effects.inherited(parents, own).collect()} == {"a": ["guard"], "b": ["guard", "owner"], "c": ["guard", "owner"], "z": ["own"]}


def test_blended_fits(spark):
    rows = [(1, "ax", 1.0, 0.0, 1.0, 0.5), (1, "ax", 3.0, 1.0, 1.04, 1.5), (1, "b", 9.0, 9.0, 1.01, 0.9), (2, "ax", 1.0, 0.0, 1.0, 0.5), (2, "ax", 3.0, 1.0, 1.2, 0.5), (3, "b", 1.0, 2.0, 0.0, 0.0), (4, "b", 1.0, 2.0, None, 0.0)]
    got = {r.k: tuple(r)[1:] for r in effects.blend_fits(spark.createDataFrame(rows, "k int, family string, a double, b double, rmse double, confidence double"), ["k"]).collect()}
    assert got[1] == ("ax (blended)", pytest.approx(2.5), pytest.approx(0.75), pytest.approx(1.03), 1.5, True)
    assert got[2] == ("ax", 1.0, 0.0, 1.0, 0.5, False) and got[3] == ("b", 1.0, 2.0, 0.0, 0.0, False) and 4 not in got
