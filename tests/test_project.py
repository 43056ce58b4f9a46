"""Project records, files and JSON against plain Python, on empty and null input too."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessel.functions import documents
from tessel.operators import analytics, events, graph, iterative, matching, records
from tessel.sources import discovery


def test_json_fields(spark):
    texts = ['{"k": 1}', '{"k": 0}', '{"k": 0.0}', '{"k": "0"}', '{"k": ""}', '{"k": []}', '{"k": {}}', '{"k": [0]}', '{"k": null}', '{"k": false}', '{"k": true}', "{}", "[1]", "no", "", None, '{"k": "x", "answer": "a"}', '{"text": {"content": "c"}}', '{"answer": 5, "content": "d"}', '"text"']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    t = F.col("t")
    for r in df.select("id", "t", documents.field_truthy(t, "k").alias("truthy"), documents.field_equals(t, "k", "x").alias("equal"), documents.decoded_payload(t).alias("payload"), documents.answer_text(t).alias("answer")).collect():
        try:
            obj = json.loads(r.t) if r.t else None
            bad = r.t == ""
        except ValueError:
            obj, bad = None, True
        fields = obj if isinstance(obj, dict) else {}
        assert r.truthy == bool(fields.get("k")) and r.equal == (fields.get("k") == "x")
        assert r.payload == (None if r.t is None else json.dumps({"raw": r.t}, separators=(",", ":")) if bad else r.t)
        found = [v if isinstance(v, str) else v["content"] for c in ("answer", "text", "content", "message") if isinstance(v := fields.get(c), str) or (isinstance(v, dict) and "content" in v)]
        assert r.answer == (found[0] if found else r.t)


def test_discovery(spark, tmp_path):
    files = ["src/Vault.sol", "src/deep/er/Token.sol", "src/Empty.sol", "src/Big.sol", "src/testThing.sol", "src/A.t.sol", "src/MyMock.sol", "test/X.sol", "lib/dep/L.sol", "node_modules/a/N.sol", "out/O.sol", "src/readme.md", "mock/M.sol", "src/StubX.sol"]
    for f in files:
        path = tmp_path / "proj" / f
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if "Empty" in f else "x" * (3000 if "Big" in f else 10))
    names = lambda **o: sorted(r.relative_path for r in discovery.discover(spark, str(tmp_path / "proj"), max_kb=2, **o).collect())
    assert names() == ["src/Vault.sol", "src/deep/er/Token.sol"]
    assert names(mocks=True, packages=True) == ["lib/dep/L.sol", "mock/M.sol", "src/MyMock.sol", "src/StubX.sol", "src/Vault.sol", "src/deep/er/Token.sol"]
    assert "test/X.sol" in names(tests=True) and "src/A.t.sol" in names(tests=True) and "out/O.sol" not in names(tests=True)
    assert discovery.latest_file(spark, str(tmp_path / "proj"), "*.md").first().path.endswith("src/readme.md")
    assert discovery.latest_file(spark, str(tmp_path / "proj"), "*.none").count() == 0


def test_model_signals_and_export(spark, tmp_path):
    def put(place, obj):
        path = tmp_path / "models" / place / "results.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(obj if isinstance(obj, str) else json.dumps(obj, indent=2))

    put("a", {"base": "one", "results": [{"candidate": "x", "fit": {"rmse": 2.0, "confidence": 0.1}}, {"fit": {"rmse": 1.0, "confidence": 0.5}}, {"fit": {"rmse": 1.0, "confidence": 0.9}}]})
    put("b", {"base": "two", "ensemble": {"success": True, "result": {"rmse": 0.3}}, "results": []})
    put("c/d", {"base": "one", "ensemble": {"success": False}, "results": [{"fit": {"confidence": 0.2}}]})
    put("e", {"results": [{"fit": {"rmse": 4, "confidence": 1}}]})
    put("f", {"base": "none", "results": []})
    put("g", "not json")
    got = {r.base: (r.rmse, r.confidence) for r in discovery.model_signals(spark, str(tmp_path / "models")).collect()}
    assert got == {"one": (math.inf, 0.2), "two": (0.3, 0.0), "unknown": (4.0, 1.0)}
    rows = spark.createDataFrame([("f", 1, "gone")], "file string, n int, other string")
    discovery.export(rows, str(tmp_path / "csv"), ["file", "n", "label"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["file", "n", "label"] and tuple(back.first()) == ("f", "1", None)
    discovery.export(rows, str(tmp_path / "json"), ["n"], "json")
    assert spark.read.json(str(tmp_path / "json")).first().n == 1


def test_taint_is_one_ordered_pass(spark):
    rng = random.Random(1)
    steps = [(f, s, rng.randrange(5), rng.randrange(5)) for f in range(6) for s in range(12)]
    seeds = [(f, rng.randrange(5), f"p{k}") for f in range(5) for k in range(2)]
    df = spark.createDataFrame([*steps, (0, 3, None, 1), (0, None, 1, 1)], "function int, step int, target int, used int").repartition(3)
    want = set()
    for f in range(6):
        held = {n: {} for n in range(5)}
        for _, name, source in (x for x in seeds if x[0] == f):
            held[name].setdefault(source, -1)
        for _, s, target, used in sorted((x for x in steps if x[0] == f), key=lambda x: x[1]):
            for source, since in list(held[used].items()):
                if since < s:
                    held[target].setdefault(source, s)
        want |= {(f, n, source, since) for n, sources in held.items() for source, since in sources.items()}
    frame = spark.createDataFrame(seeds, "function int, name int, source string")
    assert set(map(tuple, records.tainted(df, frame).collect())) == want
    assert records.tainted(df, frame.limit(0)).count() == 0


def test_records(spark):
    frame = spark.createDataFrame
    found = frame([(1, "Big Reentrancy"), (1, None), (2, "other")], "k int, category string")
    expected = frame([(1, "reentrancy"), (1, "overflow"), (2, "access"), (3, "x"), (3, None)], "k int, expected string")
    assert sorted(map(tuple, records.expected_found(found, expected, ["k"]).collect())) == [(1, 2, 1, True), (2, 1, 0, False), (3, 1, 0, False)]
    edges = frame([(1, 2), (1, 2), (2, 3), (None, 1)], "src int, dst int")
    assert sorted(map(tuple, records.induced(edges, frame([(1,), (2,), (None,)], "node int")).collect())) == [(1, 2), (1, 2)]
    assert records.repeated_patterns(found.limit(0), "k", "category").count() == 0
    assert analytics.dampened(frame([], "g int, sat boolean, exploitable boolean, proven boolean, confidence double"), ["g"]).count() == 0
    row = analytics.dampened(frame([(1, None, None, None, None)], "g int, sat boolean, exploitable boolean, proven boolean, confidence double"), ["g"]).first()
    assert row.p == pytest.approx(0.48 + 0.5 * (0.5 - 0.87))


def test_saturation_fit(spark):
    rows = [("a", float(t), 3 + 5 * (1 - math.exp(-t / 20))) for t in range(1, 41)] + [("b", 1.0, None), ("b", None, 2.0), ("c", 0.0, 1.0)]
    got = records.fit_saturation(spark.createDataFrame(rows, "k string, t double, y double"), ["k"], "t", "y").collect()
    assert [r.k for r in got] == ["a"] and (got[0].a, got[0].b, got[0].rmse) == (pytest.approx(3), pytest.approx(5), pytest.approx(0, abs=1e-6))


def test_medians_and_previous_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(4001)] + [("one", 3.0), ("none", None), *[("same", 1.0)] * 50]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        want[g] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 if v else None
    assert {r.g: r.median for r in analytics.medians(df, ["g"], "v").collect()} == {g: None if m is None else pytest.approx(m) for g, m in want.items()}
    stamped = [(rng.choice("ab"), f"2024-01-0{rng.randint(1, 3)} 00:00:{rng.randint(10, 59)}", k, rng.choice([None, "p", "q"])) for k in range(80)]
    got = analytics.previous(spark.createDataFrame(stamped, "u string, ts string, id int, kind string").withColumn("ts", F.to_timestamp("ts")), ["u"], ["ts", "id"], "kind", "before").collect()
    last, before = {}, {}
    for u, _, k, kind in sorted(stamped, key=lambda r: (r[1], r[2])):
        before[k] = last.get(u)
        last[u] = kind
    assert {r.id: r.before for r in got} == before


def test_graph_rounds(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(30, 28), (None, 1), (5, None)], "src int, dst int")
    got = {(r.src, r.dst) for r in iterative.closure(edges).collect()}
    assert got == {(a, b) for a in range(31) for b in range(31) if a < b} | {(a, b) for a in (28, 29, 30) for b in (28, 29, 30)}
    seen = {(r.node, r.depth) for r in graph.bfs(edges, spark.createDataFrame([(2,), (None,)], "node int"), 3).collect()}
    assert seen == {(2, 0), (3, 1), (4, 2), (5, 3)}
    assert iterative.closure(edges.limit(0)).count() == 0


def test_upsert_keeps_rows_without_a_key(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (None, 1, "b"), (None, 2, "c")], "k int, t int, v string")
    changes = spark.createDataFrame([(1, 0, "d"), (None, 9, "e")], "k int, t int, v string")
    assert sorted(map(tuple, events.upsert(stored, changes, "k", "t").collect()), key=repr) == [(1, 0, "d"), (None, 1, "b"), (None, 2, "c"), (None, 9, "e")]


def test_merged_texts(spark):
    a = spark.createDataFrame([(2, "x"), (1, " y "), (3, None), (4, " ")], "id int, text string")
    b = spark.createDataFrame([(1, "x "), (7, "z"), (7, "z")], "id int, text string")
    assert [tuple(r) for r in matching.merge_ranked([("p", a), ("q", b)], 3).collect()] == [("p", 1, "y"), ("p", 2, "x"), ("q", 7, "z")]
