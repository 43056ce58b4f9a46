"""Every query of the catalogue against its SQL on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from tessel.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_bad_json_lines(spark, tmp_path):
    from pyspark.sql import types as T

    from tessel.sources.files import read_jsonl

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted(r.a for r in read_jsonl(spark, str(tmp_path), schema).collect()) == [1, 2]
    assert read_jsonl(spark, str(tmp_path), schema, keep_bad=True).where("_corrupt_record is not null").collect()[0][1] == "not json"


def test_unicode_normalisation(spark):
    from pyspark.sql import functions as F

    from tessel.functions import text as X

    row = spark.range(1).select(X.normalize_unicode(F.lit("أَحـمد, Hello!")).alias("a"), X.normalize_unicode(F.lit(" ?! ")).alias("b"), X.ascii_digits(F.lit("٣۴5")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("احمد hello", None, "345")


def test_empty_predictions(spark):
    from tessel.operators import analytics as A

    empty = spark.createDataFrame([], "p double, y int")
    assert A.confusion(empty, 0.5).first().f1 == 0.0
    assert A.reliability(empty).count() == 10
    assert A.roc(empty).count() == 101


def test_upsert_takes_the_latest_change(spark):
    from tessel.operators import events as E

    stored = spark.createDataFrame([(1, 5, "a"), (1, 6, "b"), (2, 9, "c")], "k int, t int, v string")
    changes = spark.createDataFrame([(1, 1, "d"), (1, 2, "e"), (3, 1, "f")], "k int, t int, v string")
    assert sorted(map(tuple, E.upsert(stored, changes, "k", "t").collect())) == [(1, 2, "e"), (2, 9, "c"), (3, 1, "f")]
    assert E.upsert(stored.limit(0), changes.limit(0), "k", "t").count() == 0


def test_entry_needs_no_session_to_be_imported():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, timeout=120)
