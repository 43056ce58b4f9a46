"""The corpus operators against plain Python, on odd rows: null, empty, long, repeated."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import audio_fingerprint, decontaminate, jaccard_join, line_templates, quality, secrets, sentencepiece_codec, toxicity, warc_fixity

SCHEMA = "doc_id long, text string, key long, label string"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in rng.integers(0, len(WORDS), n))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    parts = base.split()
    out = [(1, base), (2, base), (3, " ".join([*parts[:60], "zz", *parts[61:]])), (4, " ".join(parts[:-2])), (5, prose(2, 90)), (6, None), (7, ""), (8, "Two words"), (9, "two  WORDS"), (10, prose(3, 9000)), (5, prose(2, 90)), (None, prose(4, 50))]
    out += [(20 + k, " ".join([*parts[: 5 * k], f"e{k}", *parts[5 * k + 1 :]])) for k in range(12)]
    return [(i, t, 7, "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, rows, words, num):
    sets = []
    for _, t, *_ in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(((r[0], len(s), r[0] if not s else least[g]) for r, s, g in zip(rows, sets, group, strict=True)), key=repr)
    got = sorted((tuple(r) for r in jaccard_join.components(docs, words, num).collect()), key=repr)
    assert got == want
    kept = jaccard_join.keep_one(docs, words=words, num=num).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({w[2] for w in want if w[0] is not None and w[2] is not None})
    assert jaccard_join.components(docs.limit(0), words, num).count() == 0


def test_secrets(spark):
    hexes, key = hashlib.sha256(b"1").hexdigest(), "AKIA" + "Q7" * 10
    texts = ["", None, f"é token = \"{hexes[:10]} then {key} password: token: abcdefg", hexes, "x" * 20, "Zk9fQ3xW8vLp2RtY7uHs4Nb6", "get_user_name_from_request", "secret=ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.secrets for r in secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(spark))).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, t in enumerate(texts):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [tuple(s) for s in found[k] if s["kind"] < 3] == sorted(base)
    assert [tuple(s) for s in found[5]] == [(0, 3, 24)] and found[6] == [] and found[4] == []


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", prose(k, 40 * (k % 7))) for k in range(60)] + [(None, None, None), (3, None, "é")], "page_id long, url string, html string")
    index = warc_fixity.archive_index(pages, 25).cache()
    leaves = [(r.archive, r.offset, r.leaf) for r in index.collect()]
    assert len({x[:2] for x in leaves}) == len(leaves) == 62
    bad = {leaves[3][:2]: "changed", leaves[40][:2]: "missing"}
    other = [(a, o, "f" * 64 if bad.get((a, o)) == "changed" else h) for a, o, h in leaves if bad.get((a, o)) != "missing"] + [(0, 10**9, "e" * 64)]
    second = spark.createDataFrame(other, "archive long, offset long, leaf string")
    found = warc_fixity.differing_leaves(index, second, range_bytes=512, fanout=4, levels=3).collect()
    assert {(r.archive, r.offset): r.status for r in found} == bad | {(0, 10**9): "extra"}
    assert warc_fixity.differing_leaves(index, index).count() == 0


def test_sentencepiece_round_trip(docs, rows):
    out = sentencepiece_codec.encode_documents(docs, check="same").collect()
    assert all(r.same for r in out) and len(out) == len(rows) and all((r.ids is None) == (r.text is None) for r in out)
    assert all(r.decoded == r.text for r in sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(docs)).collect())


def test_line_templates(spark):
    common = "please read our terms of service now"
    rows = [(k, f"{prose(k, 12)}\n{common}\nvisit number {k} of this nice page today\n{prose(k + 100, 12)}") for k in range(15)] + [(90, None), (91, ""), (92, common)]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k].dropped_lines == 2 and common not in out[k].text for k in range(15))
    assert out[90].text is None and out[91].text == "" and out[92].dropped_lines == 0


def test_decontamination(spark):
    item = prose(50, 60)
    near = item.replace("w1", "w9", 2)
    docs = spark.createDataFrame([(1, f"{prose(51, 80)} {item} {prose(52, 80)}"), (2, f"{prose(53, 80)} {near}"), (3, prose(54, 300)), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == {(1, 7), (2, 7)}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {3, 4, 5}


def test_classifiers(spark):
    rng = np.random.default_rng(0)
    texts = [prose(k, 40) + (" vile hateful vile" if k % 2 else "") for k in range(80)]
    tox = toxicity.fit(texts[:60], [k % 2 for k in range(60)])
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "the women and the muslim refugee are here")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, tox).collect()}
    assert all((score[k] >= 0.7) == bool(k % 2) for k in range(60, 80)) and score[902] < 0.7
    assert {r.doc_id for r in toxicity.keep_below(docs, tox, 0.7).collect()} == {k for k, s in score.items() if s < 0.7}
    junk = ["".join(rng.choice(list("#$%1290"), 120)) for _ in range(40)]
    q = quality.fit(junk[:30] + texts[:30], [0] * 30 + [1] * 30)
    assert (quality.score_texts(junk[30:], q) < 0.3).all() and (quality.score_texts(texts[30:40], q) >= 0.3).all()
    assert len(quality.score_texts(["", None], q)) == 2


def test_audio_alignment(spark):
    rng = np.random.default_rng(2)
    t = np.arange(400) / audio_fingerprint.RATE
    notes = lambda n: np.concatenate([6000 * np.sin(2 * np.pi * 220 * 2 ** (s / 12) * t) for s in rng.integers(0, 24, n)])
    whole = notes(60)
    shift = 10 * audio_fingerprint.HOP
    part = whole[shift:] + rng.normal(0, 60, len(whole) - shift)
    media = [(0, whole), (1, part), (2, notes(60)), (3, whole), (4, np.zeros(30))]
    rows = [(k, x.astype("<i2").tobytes()) for k, x in media] + [(5, None)]
    out = {r.media_id: r for r in audio_fingerprint.search(spark.createDataFrame(rows, "media_id long, audio binary"), F.col("media_id") == 0).collect()}
    assert (out[0].n_matches, out[0].match_id, out[0].offset) == (1, 1, 10) and out[3].class_id == 0
    assert out[4].n_frames == 0 and out[4].class_id == 4 and out[5].class_id is None and out[2].n_matches is None
