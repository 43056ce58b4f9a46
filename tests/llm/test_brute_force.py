"""Operators against slow plain versions, on odd rows: null, empty, long, tied, repeated, clashing names."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessel import storage
from tessel.llm import audio_fingerprint, jaccard_join, line_templates, quality, secrets, sentencepiece_codec, toxicity, warc_fixity

WORDS = "ka ro ti mun sel da vor pin ga lo hest ur bri no fal we".split()


def phrase(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(WORDS, rng.integers(2, 4))) for _ in range(n))


# --- op2 ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    with open(sentencepiece_codec.default_model_path(), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return model, sp, {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not skip(i)}


def slow_viterbi(text, model, sp, table):
    """Every piece at every place; ties go to the longest last piece, as the operator states."""
    marked = "▁" + text.replace(" ", "▁")
    unknown = min(s for s, _ in table.values()) - 10
    best, back = [0.0], [None]
    for stop in range(1, len(marked) + 1):
        found = [(best[start] + table[marked[start:stop]][0], stop - start, start) for start in range(max(0, stop - 40), stop) if marked[start:stop] in table]
        found = found or [(best[stop - 1] + unknown, 0, stop - 1)]
        score, length, start = max(found)
        best.append(score)
        back.append((start, length > 0))
    ids, at = [], len(marked)
    while at:
        start, known = back[at]
        if known:
            ids.append(table[marked[start:at]][1])
        else:
            ids += [sp.piece_to_id(f"<0x{b:02X}>") for b in reversed(marked[start:at].encode())]
        at = start
    return ids[::-1]


def test_viterbi_finds_the_best_segmentation(spark, pieces):
    texts = [phrase(k, 12) for k in range(6)] + ["a", "  two  blanks ", "line\none\ttab", "Ünïcödé 日本 🙂 x", "aaaaaaaaaaaaaaaaaaaaaaaa", "UPPER lower 12345", "", None, phrase(1, 3000)]
    docs = spark.createDataFrame([(k, t, [1], "x") for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>, same string").repartition(2)
    out = {r.doc_id: r for r in sentencepiece_codec.encode_documents(docs, check="same").collect()}
    for k, t in enumerate(texts):
        assert out[k].ids == (None if t is None else slow_viterbi(t, *pieces) if t else []) and out[k].same
    assert sentencepiece_codec.round_trip(docs.limit(0)).count() == 0


# --- op5, op9 ----------------------------------------------------------------------------


def test_toxicity_scores_from_weights(spark):
    texts = [phrase(k, 30) + (" vilely vile" if k % 2 else "") for k in range(60)]
    model = toxicity.fit(texts, [k % 2 for k in range(60)])
    by_key = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    odd = [None, "", phrase(4, 20000), "vile vile vile", "vile"]

    def slow(text):
        keys = set()
        for word in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            for key, _ in toxicity.word_keys(*toxicity.N.utf8(pa.array([word]))):
                keys |= set(key.tolist())
        return 1 / (1 + math.exp(-model.bias - sum(by_key.get(k, 0.0) for k in keys)))

    rows = list(enumerate(texts[:10] + odd)) + [(0, texts[0])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").repartition(2)
    got = sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score_documents(docs, model).collect())
    assert got == sorted((i, round(slow(t), 6)) for i, t in rows)
    score = dict(got)
    assert score[13] == score[14]  # a repeated word counts once
    assert toxicity.score_documents(docs.limit(0), model).count() == 0 and toxicity.keep_below(docs, model, 2.0).columns == docs.columns


def test_neutral_mentions_score_lower_with_the_constraint():
    rng = np.random.default_rng(5)
    texts, labels = [], []
    for k in range(400):  # the term comes with toxic texts more often than not, but is not what makes them so
        toxic = k % 2
        term = ["muslim"] if rng.random() < (0.5 if toxic else 0.05) else []
        texts.append(" ".join([*rng.choice(WORDS, 14), *term, *(["vile"] if toxic and rng.random() < 0.8 else [])]))
        labels.append(toxic)
    neutral = [f"the muslim people of {phrase(k, 3)} came" for k in range(20)]
    mean = lambda m: float(toxicity._scores(pa.record_batch([pa.array(neutral)], ["text"]), m, toxicity._sieve(m)).mean())
    held, free = toxicity.fit(texts, labels), toxicity.fit(texts, labels, pair_weight=0.0)
    assert mean(held) < mean(free) - 0.02, (mean(held), mean(free))


def test_train_over_tables(spark):
    docs = spark.createDataFrame([(k, phrase(k, 20) + (" vile" if k % 2 else ""), "x") for k in range(80)] + [(None, "vile", "x"), (3, None, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, (k + 1) % 2, k % 2) for k in range(80)] + [(5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    tox = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs.where("doc_id % 3 = 1"), tox).collect()}
    assert all((s >= 0.5) == bool(k % 2) for k, s in score.items())
    good = quality.train(docs, labels, F.col("doc_id") % 5 != 0)
    assert quality.score_documents(docs, good).count() == 82
    for fit, column in ((toxicity, "toxic"), (quality, "quality")):  # one class, no class
        one = fit.train(docs, labels.where(f"{column} = 1"), F.lit(True))
        none = fit.train(docs.limit(0), labels, F.lit(True))
        assert len({r.score for r in fit.score_documents(docs, one).collect()}) == 1 and abs(fit.score_documents(docs, none).first().score - 0.5) < 1e-9


def test_quality_scores_from_weights(spark):
    rng = np.random.default_rng(0)
    junk = ["".join(rng.choice(list("#$%1290 "), 80)) for _ in range(30)]
    model = quality.fit(junk + [phrase(k, 15) for k in range(30)], [0] * 30 + [1] * 30, epochs=3)
    texts = [junk[0], phrase(90, 10), "", None, "é", phrase(91, 9000), junk[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    for k, t in enumerate(texts):  # one text alone, feature by feature
        found = [b for b, _ in quality.features([t], model.bits)]
        ids = np.concatenate(found) if found else np.zeros(0, int)
        z = model.bias + (float(model.weights[ids].astype(float).sum()) / len(ids) if len(ids) else 0.0)
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-5
    assert got[0] == got[6] and quality.score_documents(docs.limit(0), model).count() == 0


# --- op3 ---------------------------------------------------------------------------------


def slow_runs(token, model, offset=0.2, least=12.0):
    size, (low, high) = len(secrets.ALPHABET) + 1, secrets.PAIR_RANGE
    code = [secrets.ALPHABET.index(c) + 1 for c in token]
    total, start, best, end, out = 0.0, 0, 0.0, 0, []
    for i in range(1, len(code) + 1):
        total += min(high, max(low, model[code[i - 1] * size + code[i]])) - offset if i < len(code) else -math.inf
        if total <= 0:
            if best >= least and end - start >= secrets.MIN_TOKEN:
                out.append((start, end))
            total, start, best, end = 0.0, i, 0.0, i
        elif total > best:
            best, end = total, i + 1
    return out


def test_random_runs_and_error_rates(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    held = secrets.labelled_samples(spark, 600, salt=9).withColumn("text", F.when(F.col("label") == 1, F.concat(F.lit("see user_session_token_id/"), F.substring("text", 1, 20))).otherwise(F.col("text")))
    rows = secrets.find_secrets(held.withColumn("base", F.lit(1)), model).collect()
    for r in rows:
        tokens = [(m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", r.text)]
        if not any(s["kind"] < 3 for s in r.secrets):
            assert [(s["start"], s["end"]) for s in r.secrets] == [(at + a, at + b) for at, t in tokens for a, b in slow_runs(t, model)]
    share = lambda own: sum(any(s["kind"] == 3 for s in r.secrets) for r in own) / len(own)
    random = [r for r in rows if r.label == 1]
    assert share([r for r in rows if r.label == 0]) <= 0.01
    assert share(random) >= 0.9 and all(share([r for r in random if r.kind == k]) >= 0.75 for k in secrets.RANDOM_KINDS)


def test_many_spans_clashing_names_and_empty_table(spark):
    model = secrets.train(secrets.labelled_samples(spark, 400))
    text = " ".join(f"token: abcdefg{k}" for k in range(700))
    docs = spark.createDataFrame([(1, text, "a", 5), (1, text, "a", 5), (2, None, "a", 5)], "doc_id long, text string, secrets string, assign_spans int")
    out = secrets.find_secrets(docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert [(s["start"], s["end"]) for s in got[1].secrets] == [m.span() for m in re.finditer(r"token: abcdefg\d+", text)] and got[2].secrets == [] and got[1].assign_spans == 5
    assert {r.text for r in secrets.redact(out).collect()} == {" ".join(["[secret]"] * 700), None}
    assert secrets.find_secrets(docs.limit(0), model).count() == 0


# --- op7 ---------------------------------------------------------------------------------


def test_two_templates_of_one_leaf_and_long_lines(spark):
    names = [phrase(k, 1) for k in range(40)]
    long_line = phrase(500, 90)
    rows = [(k, f"{phrase(k, 9)}\nseen by our {names[k]} reader and friend today again\n{phrase(900 + k, 8)}") for k in range(15)]
    rows += [(20 + k, f"{phrase(100 + k, 9)}\nseen by our market in town for {names[k]} things\n{phrase(800 + k, 8)}") for k in range(15)]
    rows += [(40 + k, f"{long_line.replace(long_line.split()[40], names[k])}\n{phrase(600 + k, 120)}") for k in range(6)]
    rows += [(60 + k, f"seen by our {phrase(700 + k, 6)}\n{phrase(650 + k, 20)}") for k in range(15)]  # prose of the same leaf
    rows += [(90, None), (91, ""), (None, rows[0][1]), (92, "\n\n"), (93, "a\r\n" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, copy_of_text string").repartition(3)
    out = line_templates.drop_recurring_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[k].dropped_lines == 1 and "seen by our" not in got[k].text for k in [*range(15), *range(20, 35), None])
    assert all(got[k].dropped_lines == 1 and got[k].text == phrase(560 + k, 120) for k in range(40, 46))
    assert all(got[k].dropped_lines == 0 and got[k].text == dict(rows)[k] for k in [*range(60, 75), 90, 91, 92])
    assert got[1].copy_of_text == "k" and sorted(out.columns) == sorted([*docs.columns, "dropped_lines", "is_copy"])
    assert line_templates.drop_recurring_lines(docs.limit(0)).count() == 0


def test_copies_stay_whole_and_exact_copies_count_once(spark):
    lines = [phrase(k, 12) for k in range(10)]
    near = [(k, "\n".join([*lines[:k % 10], phrase(300 + k, 12), *lines[k % 10 + 1 :]])) for k in range(20)]
    exact = [(100 + k, phrase(77, 12) + "\n" + phrase(78, 12)) for k in range(30)]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(near + exact, "doc_id long, text string")).collect()}
    assert all(out[k].is_copy and out[k].text == t and out[k].dropped_lines == 0 for k, t in near)
    assert all(out[k].text == t and not out[k].is_copy for k, t in exact)


# --- op1, op4, op10 ----------------------------------------------------------------------


def test_fixity_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc_fixity.archive_index(pages)
    assert warc_fixity.audit(index, index).count() == 0


def test_keep_one_with_clashing_names_and_long_text(spark):
    text = phrase(1, 4000)
    docs = spark.createDataFrame([(1, text, 1, 2), (2, text + " x", 3, 4), (2, text + " x", 3, 4), (3, phrase(2, 10), 5, 6), (None, text, 7, 8)], "doc_id long, text string, least_id int, row_of_id int")
    assert sorted((r.doc_id or 0, r.least_id) for r in jaccard_join.keep_one(docs).collect()) == [(0, 7), (1, 1), (3, 5)]


def test_alignment_against_all_offsets(spark):
    rng = np.random.default_rng(8)
    t = np.arange(400) / audio_fingerprint.RATE
    notes = lambda n: np.concatenate([6000 * np.sin(2 * np.pi * 220 * 2 ** (s / 12) * t) for s in rng.integers(0, 24, n)])
    whole = notes(50)
    media = [(k, notes(40)) for k in range(6)] + [(6, whole), (7, whole[6 * audio_fingerprint.HOP :] + rng.normal(0, 40, len(whole) - 6 * audio_fingerprint.HOP)), (8, whole), (8, whole), (9, np.zeros(9000)), (10, np.zeros(9000)), (11, np.zeros(0))]
    rows = [(k, x.astype("<i2").tobytes(), "m") for k, x in media] + [(12, None, "m")]
    docs = spark.createDataFrame(rows, "media_id long, audio binary, fp string").repartition(2)
    out = audio_fingerprint.search(docs, F.col("media_id") % 2 == 0).collect()
    fps = {k: audio_fingerprint.fingerprint(x.astype("<i2").astype(np.float32)) for k, x in media}
    classes = {k: min(j for j in fps if len(fps[j]) and np.array_equal(fps[j], f)) for k, f in fps.items() if len(f)}
    for r in out:
        assert r.class_id == (classes.get(r.media_id, r.media_id) if r.media_id != 12 else None)
        if r.media_id % 2 or r.media_id not in classes:
            continue
        want = set()
        for other in set(classes.values()) - {classes[r.media_id]}:
            a, b = fps[r.media_id], fps[other]
            by_offset = {}
            for i in range(len(a)):
                for j in np.flatnonzero(b == a[i]).tolist():
                    by_offset[i - j] = by_offset.get(i - j, 0) + 1
            if by_offset:
                votes, offset = max((n, -o) for o, n in by_offset.items())
                overlap, error = audio_fingerprint.bit_errors(a, b, -offset)
                if votes >= 4 and overlap >= 40 and error <= 0.25:
                    want.add((other, -offset, votes, overlap))
        assert r.n_matches == len(want) and (not want or (r.match_id, r.offset, r.votes, r.overlap) in want)
    assert any(r.n_matches for r in out) and audio_fingerprint.search(docs.limit(0), F.lit(True)).count() == 0


def test_no_folder_is_left(spark):
    storage.release(storage.left())
    docs = spark.createDataFrame([(k, phrase(k % 3, 30)) for k in range(9)], "doc_id long, text string")
    jaccard_join.components(docs).collect()
    line_templates.drop_recurring_lines(docs).collect()
    assert len(storage.left()) <= 3  # what the two results read
    storage.release(storage.left())
    assert storage.left() == []
