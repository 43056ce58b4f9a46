"""Byte BPE, Merkle manifest and filter audit against tiktoken and slow plain versions, on odd rows."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessel.llm import byte_bpe, filter_audit, merkle_manifest

TEXTS = [None, "", " ", "a", "It's  we'll\n\n x\t y ", "Größe 漢字 🎉!? 12345", "  ", "x" * 3000, "ab " * 900, "\x1c \x85\xa0'S 's", "naïve café\r\n"]


# --- op11 --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.read_vocabulary()


@pytest.fixture(scope="module")
def codec(vocabulary):
    return byte_bpe.codec(vocabulary)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)}, special_tokens={})


def some_text(rng, n=40):
    return "".join(rng.choice("abc ABC's'll 12 \n\t\x0b\x1c\x85\xa0 é漢🎉!?-_. ") for _ in range(rng.randint(0, n)))


def test_encodes_as_the_library_does(spark, vocabulary, reference):
    rng = random.Random(1)
    texts = TEXTS + [some_text(rng) for _ in range(400)]
    docs = spark.createDataFrame([(k % 300, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    coded = byte_bpe.encode_documents(docs, vocabulary)
    assert coded.columns == ["doc_id", "text", "ids"]
    for r in byte_bpe.decode_documents(coded, vocabulary).collect():
        assert r.ids == (None if r.text is None else reference.encode_ordinary(r.text))
        assert r.decoded == (None if r.text is None else r.text.encode())
    want = sorted((k % 300, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in enumerate(texts) for ids in [reference.encode_ordinary(t or "")])
    assert sorted(map(tuple, byte_bpe.digests(docs, vocabulary).collect())) == want
    assert byte_bpe.digests(docs.limit(0), vocabulary).count() == 0


def test_every_character_is_split_as_the_library_does(codec, reference):
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{c} {c}b1{c}\n" for c in map(chr, range(start, start + 64)) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_appends_and_edits_give_what_encoding_anew_gives(codec):
    rng = random.Random(2)
    for _ in range(2000):
        text, new = some_text(rng), some_text(rng, 6)
        ids = codec.encode(text)
        start = rng.randint(0, len(text))
        stop = rng.randint(start, len(text))
        assert codec.append(text, ids, new) == codec.encode(text + new)
        assert codec.replace(text, ids, start, stop, new) == codec.encode(text[:start] + new + text[stop:])


def test_prefix_tables(codec, reference):
    """The table of each prefix, grown and edited; an edit looks at prefixes near it only."""
    rng = random.Random(3)
    for _ in range(500):
        data = bytes(rng.choice(b"aaaabcdeeinst r") for _ in range(rng.randint(1, 300)))
        table = byte_bpe.Prefixes(codec, data[: len(data) // 2])
        table.append(data[len(data) // 2 :])
        assert table.ids() == reference._core_bpe.encode_single_piece(data)
        start = rng.randint(0, len(data))
        stop, new = min(len(data), start + rng.randint(0, 4)), bytes(rng.choice(b"abcst") for _ in range(rng.randint(0, 4)))
        table.replace(start, stop, new)
        assert table.last == byte_bpe.Prefixes(codec, data[:start] + new + data[stop:]).last
    table = byte_bpe.Prefixes(codec, b"internationalisation" * 400)
    assert table.replace(4000, 4001, b"x") < 4000
    assert table.last == byte_bpe.Prefixes(codec, table.data).last


def test_appended_documents(spark, vocabulary, reference):
    rows = [(k, t, m) for k, (t, m) in enumerate([(None, None), (None, "new"), ("old", None), ("old", "er one"), ("ends ", " x"), ("", "")])]
    coded = byte_bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, more string"), vocabulary)
    for r in byte_bpe.append_documents(coded, "more", vocabulary).collect():
        old, more = rows[r.doc_id][1:]
        whole = None if old is None and more is None else (old or "") + (more or "")
        assert r.text == whole and r.ids == (None if whole is None else reference.encode_ordinary(whole))


# --- op12 --------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Root of the leaves and, for each, (place, siblings) of every level."""
    level, ways = [(d, [k]) for k, d in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 16):
            run = [d for d, _ in level[at : at + 16]]
            for place, (_, below) in enumerate(level[at : at + 16]):
                for k in below:
                    ways[k].append((place, run[:place] + run[place + 1 :]))
            above.append((digest(*run), sum((below for _, below in level[at : at + 16]), [])))
        level = above
    return level[0][0], ways


def plain_manifest(rows):
    def leaf(r, text):
        return digest(*map(shown, (r.doc_id, r.source, r.lang, r.n_chars, text)))

    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r, leaf(r, r.text)) for r in rows if r.source == s), key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        trees.append((own, *plain_tree([d for _, d in own])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), top in zip(trees, tops, strict=True):
        for (r, d), way in zip(own, ways, strict=True):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = leaf(r, text)
            for place, others in way + top:
                folded = digest(*others[:place], folded, *others[place:])
            out.append((r.doc_id, d, subroot, root, digest(*(x for _, o in way + top for x in o)), folded, folded == root))
    return out


@pytest.mark.parametrize(("n", "sources", "hot"), [(1, 1, 0), (40, 1, 1), (600, 23, 0.5), (300, 300, 0), (17, 2, 1)])
def test_manifest(spark, n, sources, hot):
    rng = random.Random(n)
    pick = rng.choice
    rows = [
        (pick([None, k, k, k // 2]), None if rng.random() < 0.1 else "s0" if rng.random() < hot else f"s{rng.randrange(sources)}é", pick([None, "en"]), pick([None, 3]), pick([None, "", "Ab é", "X" * 5000]), "kept")
        for k in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(3)
    checked = merkle_manifest.audit_documents(docs, merkle_manifest.tampered(F.col("text"), F.col("doc_id")))
    got = checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(docs.collect()), key=repr)


def test_manifest_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle_manifest.audit_documents(docs, F.col("text")).count() == 0


# --- op13 --------------------------------------------------------------------------------


def plain_audit(rows, labels):
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    fails = []
    for doc_id, source, text in rows:
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        mask = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, _, t in rows),
        }
        fails.append((doc_id, source or "", mask))
    out, total = [], {}
    for part in {s for _, s, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[1] == part]
            own = left
            for step, name in enumerate(order, 1):
                here = [f for f in left if f[2][name]]
                left = [f for f in left if not f[2][name]]
                redundant = sum(f[2][name] for f in own) - len(here)
                unique = sum(f[2][name] and sum(f[2].values()) == 1 for f in own)
                out.append((part, order, step, len(left), len(here), redundant, unique, sum(f[0] in good for f in here), sum(f[0] in toxic for f in here)))
                total[part, name] = total.get((part, name), 0) + len(here)
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


def test_filter_audit(spark):
    rng = random.Random(5)
    bank = [None, "", "a", "word " * 60, " ".join(f"w{i}" for i in range(60)), "UPPER lower " + "x" * 20, "50 % & more", " ".join(f"v{i}" for i in range(70)) + " #", "\t\x0b tab\n", "É é"]
    rows = [(rng.choice([None, k, k, k, k // 3]), rng.choice([None, "", "web", "web", "web", "books"]), rng.choice(bank), "extra") for k in range(120)]
    labels = [(rng.choice([None, rng.randrange(120)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mask string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit([r[:3] for r in rows], labels))
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    none = filter_audit.audit(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)
