"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 11).

Every prefix of a piece's bytes has exactly one token that can end its encoding: the token
that fits the last token of the prefix before it. ``Prefixes`` stores that token for each
prefix, so a piece grows by an append without touching what is stored, and after an edit
only prefixes near it are looked at again. Two tokens fit if merging by rank would leave the
border between them alone (see ``Codec.fits``). An Aho-Corasick automaton over the
tokens reports the candidates of each prefix.

A text is first split by the vocabulary's pattern, and each match is encoded on its own; a
match that is a token as a whole is that token. A space with a character other than white
space behind it always starts a match, so texts fall into units there, units are encoded
one by one and remembered, and an append or an edit re-encodes the units it touches.

Null texts have null ids, the empty text none; texts are taken whole, whatever their length.
Equal rows give equal ids. ``encode_documents`` and ``decode_documents`` replace a column of
the name they write and leave every other column as it is.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy
from .sentencepiece_codec import _schema_with, _with
from .textnum import slices

#: The characters that are white space for the pattern's \s (Unicode White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f"(?= [^{WHITE}])")
ODD_SPACE = re.compile(f" (?:[{WHITE}]|$)")
MEMO_ENTRIES = 200_000
MEMO_LENGTH = 64
MEMO_PAIRS = 300_000


class Vocabulary(NamedTuple):
    """Tokens by rank, and the two tokens that each is merged from (-1: a byte or never made)."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    pattern: str


def read_vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file (base64 of the bytes and the rank on each line)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    left, right = [-1] * len(tokens), [-1] * len(tokens)
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            parts = _last_merge(token, ranks)
            if parts is not None:
                left[rank], right[rank] = parts
    return Vocabulary(tokens, left, right, pattern or public_tokenizers.PATTERN)


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes ``token``; None if merging by rank does not end in it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Codec:
    """A vocabulary with its automaton, for one Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.left, self.right, pattern = vocabulary
        self.rank = {t: i for i, t in enumerate(self.tokens) if t}
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0}
        self.length = [len(t) for t in self.tokens]
        self.longest = max(self.length)
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            if len(token) == 1 or self.left[i] >= 0:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern).findall
        self.known: dict[int, bool] = {}
        self.memo = _Memo(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the border between the bytes of ``a`` and ``b`` alone.

        Goes back in time from the finished tokens. Of the two tokens at the border the one
        made last is taken apart; until then its part there stood beside the other token, and
        a merge of these two would have come first if its rank is lower. On equal ranks the
        merge further left comes first.
        """
        known = self.known
        key = a << 32 | b
        stays = known.get(key)
        if stays is None:
            if len(known) >= MEMO_PAIRS:
                known.clear()
            stays = known[key] = self._border_stays(a, b)
        return stays

    def _border_stays(self, a: int, b: int) -> bool:
        merged, left, right = self.merged, self.left, self.right
        bar = len(left)
        while True:
            if merged.get((a, b), bar) < bar:
                return False
            made_a, made_b = (a if left[a] >= 0 else -1), (b if left[b] >= 0 else -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                bar, a = made_a, right[a]  # its merge is the one further left
            else:
                bar, b = made_b + 1, left[b]

    def piece(self, text: str) -> bytes:
        """Packed ids of one match of the pattern."""
        data = text.encode()
        whole = self.rank.get(data)
        ids = [whole] if whole is not None else Prefixes(self, data).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def unit(self, text: str) -> bytes:
        if text.isascii() and (text[1:] if text[0] == " " else text).isalpha():
            return self.piece(text)
        pieces = self.pieces(text)
        return self.piece(text) if len(pieces) == 1 else b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.memo.__getitem__, units_of(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def append(self, text: str, ids: bytes, added: str) -> bytes:
        """Ids of ``text + added``, given those of ``text``; only its last unit is encoded again."""
        return self.replace(text, ids, len(text), len(text), added)

    def replace(self, text: str, ids: bytes, start: int, stop: int, new: str) -> bytes:
        """Ids of the text with [start, stop) replaced, given those of ``text``.

        Encodes from the last unit that starts before the edit to the first that starts
        behind it; ids before and after these are taken over.
        """
        head = max((m.start() for m in UNITS.finditer(text, max(0, text.rfind(" ", 0, max(0, start - 1))), start + 1) if m.start() < start), default=0)
        if head == 0 and start > 1:
            head = max((m.start() for m in UNITS.finditer(text, 0, start + 1) if m.start() < start), default=0)
        behind = UNITS.search(text, stop + 1)
        tail = behind.start() if behind else len(text)
        old = np.frombuffer(ids, "<u4")
        sizes = np.array(self.length, np.int64)[old]
        first = int(np.searchsorted(np.cumsum(sizes), len(text[:head].encode()), "right")) if head else 0
        last = len(old) - (int(np.searchsorted(np.cumsum(sizes[::-1]), len(text[tail:].encode()), "right")) if tail < len(text) else 0)
        middle = self.encode(text[head:start] + new + text[stop:tail])
        return ids[: 4 * first] + middle + ids[4 * last :]


class _Memo(dict):
    """Packed ids of short units and pieces (a piece by itself is a unit of one piece).

    Holds MEMO_ENTRIES; the generation before that serves what is asked for again.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.before: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.before.get(unit)
        if ids is None:
            ids = self.codec.unit(unit)
        if len(unit) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.before = dict(self)
                self.clear()
            self[unit] = ids
        return ids


def units_of(text: str) -> list[str]:
    """The text cut before every space that a character other than white space follows."""
    if ODD_SPACE.search(text):
        return [u for u in UNITS.split(text) if u]
    first, *rest = text.split(" ")
    out = [" " + part for part in rest]
    return [first, *out] if first else out


class Prefixes:
    """The unique valid last token of every prefix of a byte string."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def _fill(self, last: list[int], data: bytes, start: int, stop: int) -> None:
        """Tokens of the prefixes that end in (start, stop], given all before."""
        codec = self.codec
        begin = max(0, start - codec.longest + 1)
        length, known, fits = codec.length, codec.known.get, codec.fits
        for end, token in codec.automaton.iter(data[begin:stop].decode("latin-1")):
            end += begin + 1
            if end <= start or last[end] >= 0:
                continue
            before = end - length[token]
            if before:
                ends = last[before]
                if ends < 0:
                    continue
                stays = known(ends << 32 | token)
                if not (fits(ends, token) if stays is None else stays):
                    continue
            last[end] = token

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what is stored stays as it is."""
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(self.last, self.data, start, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Replace the bytes [start, stop); returns how many prefixes were looked at again.

        Behind the edit, once as many prefixes as the longest token has bytes keep their
        tokens, all further ones do.
        """
        old, shift = self.last, len(new) - (stop - start)
        data = self.data[:start] + new + self.data[stop:]
        last = old[: start + 1] + [-1] * (len(data) - start)
        at, same, step = start, 0, self.codec.longest
        while at < len(data):
            to = min(len(data), max(at, start + len(new)) + step)
            self._fill(last, data, at, to)
            for k in range(at + 1, to + 1):
                # a token kept counts only if its own bytes lie behind the edit
                same = same + 1 if k - shift > stop and last[k] == old[k - shift] else 0
            at = to
            if same >= step:
                last[at + 1 :] = old[at - shift + 1 :]
                break
        self.data, self.last = data, last
        return at - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= self.codec.length[self.last[at]]
        out.reverse()
        return out


_CODECS: dict[int, Codec] = {}


def codec(vocabulary: Vocabulary) -> Codec:
    """One codec a Python worker and vocabulary."""
    key = hash((vocabulary.pattern, *vocabulary.tokens))
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _packed(column: pa.Array) -> list[bytes | None]:
    """Ids of each row as bytes, from a binary or a list column."""
    if pa.types.is_list(column.type):
        return [None if v is None else np.array(v, "<u4").tobytes() for v in column.to_pylist()]
    return column.to_pylist()


def _ids_column(values: list[bytes | None], packed: bool) -> pa.Array:
    if packed:
        return pa.array(values, pa.binary())
    return pa.array([None if v is None else np.frombuffer(v, "<u4").astype(np.int32) for v in values], pa.list_(pa.int32()))


def _ids_type(packed: bool) -> T.DataType:
    return T.BinaryType() if packed else T.ArrayType(T.IntegerType())


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", ids: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with the token ids of the whole text: an array, or ``packed`` into bytes (little-endian, 32 bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())  # as large as the vocabulary's file

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for big in batches:
            for batch in slices(big, text):
                got = [None if value is None else own.encode(value) for value in batch.column(text).to_pylist()]
                yield _with(batch, ids, _ids_column(got, packed))

    return docs.mapInArrow(run, _schema_with(docs.schema, ids, _ids_type(packed)))


def decode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids (an array or packed) stand for; null ids: null."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            got = [None if v is None else own.decode(v) for v in _packed(batch.column(ids))]
            yield _with(batch, data, pa.array(got, pa.binary()))

    return docs.mapInArrow(run, _schema_with(docs.schema, data, T.BinaryType()))


def append_documents(docs: DataFrame, added: str, vocabulary: Vocabulary | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``added`` put behind the text and its ids brought up to date.

    Encodes the last unit of each text and what is added (null: nothing). A null text counts
    as empty then; where both are null, both stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())
    packed = isinstance(docs.schema[ids].dataType, T.BinaryType)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            more = batch.column(added).to_pylist()
            old = batch.column(text).to_pylist()
            got = _packed(batch.column(ids))
            grown = [i if a is None else own.append(t or "", i or b"", a) for t, i, a in zip(old, got, more, strict=True)]
            texts = [t if a is None else (t or "") + a for t, a in zip(old, more, strict=True)]
            yield _with(_with(batch, text, pa.array(texts, pa.string())), ids, _ids_column(grown, packed))

    return docs.mapInArrow(run, _schema_with(_schema_with(docs.schema, text, T.StringType()), ids, _ids_type(packed)))


def digests(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's text, null counting as empty."""
    words = vocabulary or read_vocabulary()
    coded = encode_documents(docs.select("doc_id", "text"), words, packed=True).select("doc_id", "ids")
    none = F.lit(b"")
    ids, data = F.coalesce("ids", none), F.coalesce("decoded", none)
    return decode_documents(coded, words).select(
        "doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(data, 256).alias("decoded_sha256")
    )
