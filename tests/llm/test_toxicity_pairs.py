"""Identity pairs of large labelled samples."""

import numpy as np

from tessel.llm import toxicity


def score(model, text):
    import pyarrow as pa

    return float(toxicity._scores(pa.record_batch([pa.array([text])], ["text"]), model, toxicity._sieve(model))[0])


def test_every_group_is_held_beyond_2000_pairs():
    rng = np.random.default_rng(3)
    filler = [f"f{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(1200):  # the first rows alone give more than 2000 pairs of one group
        toxic = k % 2
        words = list(rng.choice(filler, 12)) + (["vile"] if toxic and rng.random() < 0.7 else [])
        term = "women" if k < 900 else ("deaf" if toxic else "plain")
        texts.append(f"the {term} " + " ".join(words))
        labels.append(toxic)
    model = toxicity.fit(texts, labels)
    gap = abs(score(model, "the deaf people came") - score(model, "the blind people came"))
    assert gap < 0.02, gap


def test_every_term_of_a_sentence_is_swapped():
    pairs = list(toxicity.swap_pairs(["women and deaf men"], [("women", "men"), ("deaf", "blind")], 5))
    assert {p[1] for p in pairs} == {"men and deaf men", "women and blind men", "women and deaf women"}
