"""Leaks found against brute force, over edit rates up to the largest share admitted."""

import numpy as np

from tessel.llm import decontaminate

SYLLABLES = "ka ro ti mun sel da vor pin ga lo hest ur bri no fal we".split()


def phrase(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(2, 4))) for _ in range(n))


def plain(text):
    return b" ".join(text.encode().lower().split()).decode()


def typos(rng, text, share, even):
    """``share`` of the characters replaced by one that the text does not have."""
    n, k = len(text), int(share * len(text))
    at = (np.arange(k) + rng.random()) * n / k if even else rng.choice(n, k, replace=False)
    out = list(text)
    for p in at:
        out[int(p)] = "x"
    return "".join(out)


def test_recall_by_edit_rate(spark):
    rng = np.random.default_rng(4)
    items = {k: phrase(rng, n) for k, n in enumerate([12] * 15 + [20] * 15 + [40] * 15)}
    items |= {50 + k: phrase(rng, 14).replace(" ", "") for k in range(3)}
    items |= {60: "Ñandú 日本", 61: "bri ga", 62: "q", 63: "kavor selda munro", 64: None, 65: " "}
    low = {i: plain(t) for i, t in items.items() if t and t.strip()}
    texts, planted = [None, "", "q"], {}
    for i, t in low.items():
        for share in (0.03, 0.08, 0.12, 0.149):
            for even in (False, True):
                if int(share * len(t)):
                    planted[len(texts)] = (i, share, even)
                    texts.append(f"{phrase(rng, 15)}  {typos(rng, t, share, even)}\n{phrase(rng, 15)}")
    texts += [phrase(rng, 60) for _ in range(20)] + [f"{phrase(rng, 9)} {t}" for t in low.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in low.items():
            dist = decontaminate.infix_distance(item, plain(t or ""), int(0.15 * len(item)))
            if dist is not None:
                want[d, i] = dist
    assert set(found) <= set(want) and all(found[k] >= want[k] for k in found)
    for share in (0.03, 0.08, 0.12, 0.149):
        for even in (False, True):
            own = [(d, i) for d, (i, s, e) in planted.items() if (s, e) == (share, even)]
            assert all(k in want for k in own)
            assert sum(k in found for k in own) >= 0.9 * len(own), (share, even)
    # items too short for votes are searched exactly
    assert all(found.get(k) == dist for k, dist in want.items() if k[1] >= 60)
    assert all((d, i) in found for d, i in want if d >= len(texts) - len(low))
