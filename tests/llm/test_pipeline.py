"""Each stage of the pipeline, and all of them, on planted rows against plain Python."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tessel import storage
from tessel.llm import sentencepiece_codec

SYLLABLES = "ka ro ti mun sel da vor pin ga lo hest ur bri no fal we".split()


def phrase(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(2, 4))) for _ in range(n))


LINE = phrase(9000, 14)
ITEM = phrase(9001, 30)


@pytest.fixture(scope="module")
def rows():
    out = {k: phrase(k, 60) for k in range(60)}
    for k in range(20):
        out[k] += " vile hateful scum"
    for k in range(20, 35):
        out[k] += f"\n{LINE}\n{phrase(500 + k, 40)}"
    for k in (60, 61, 62):  # a group of copies, one of them near
        out[k] = phrase(7000, 200) + (" more" if k == 61 else "")
    out[63] = f"{phrase(7001, 30)} {ITEM} {phrase(7002, 30)}"
    out |= {64: None, 65: "", 66: "two words", 67: "two words", 68: phrase(7003, 9000)}
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    table = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k < 20)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    """What the stages should keep, as {doc_id: text}."""
    kept = {k: t for k, t in rows.items() if "vile" not in (t or "").split()}
    kept = {k: t if t is None or LINE not in t else "\n".join(x for x in t.split("\n") if x != LINE) for k, t in kept.items()}
    group = {k: k for k in kept}
    sets = {k: shingles(t) for k, t in kept.items()}
    for a in kept:
        for b in kept:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    kept = {k: t for k, t in kept.items() if group[k] == k}
    return {k: t for k, t in kept.items() if ITEM not in (t or "")}


def test_all_stages(spark, rows, sf_dir):
    storage.release(storage.left())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {k: r.text for k, r in out.items()} == plain(rows)
    assert all(r.round_trip and r.n_chars == len(r.text or "") for r in out.values())
    assert len(storage.left()) <= 2  # the rows that the last stage reads


def test_each_stage_by_itself(spark, rows, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    toxic = stage["toxicity"](spark, docs, sf_dir)
    assert ids(toxic) == set(rows) - set(range(20)) and toxic.columns == docs.columns
    lines = {r.doc_id: r for r in stage["line dedup"](spark, docs, sf_dir).collect()}
    assert {k for k, r in lines.items() if r.text != rows[k]} == set(range(20, 35)) and all(r.n_chars == len(r.text or "") for r in lines.values())
    near = stage["n-gram Jaccard join"](spark, docs, sf_dir)
    assert ids(near) == set(rows) - {61, 62, 67} and near.columns == docs.columns
    assert ids(stage["benchmark decontamination"](spark, docs, sf_dir)) == set(rows) - {63}
    coded = {r.doc_id: r for r in sentencepiece_codec.decode_documents(stage["SentencePiece"](spark, docs, sf_dir)).collect()}
    assert all(coded[k].decoded == t for k, t in rows.items())
    assert all(f(spark, docs.limit(0), sf_dir).count() == 0 for f in stage.values())
