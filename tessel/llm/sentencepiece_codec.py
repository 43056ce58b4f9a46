"""SentencePiece encoding and decoding (operator 2).

An Aho-Corasick automaton over the vocabulary's pieces reports, at each position, every
piece ending there (longest first, along the output links); each report relaxes the best
score at that position, so one pass over the text is the whole Viterbi search. The result
maximises the sum of piece scores; on equal scores the longest last piece wins.

Text form: a word marker (U+2581) is put before the text and stands for each space. A
character that no piece covers costs the lowest piece score minus ten and is written as
the UTF-8 byte pieces, so decoding gives every text back exactly; a U+2581 of the text
itself is written as bytes for the same reason. Null texts stay null; the empty text has
no ids. Vocabulary files are read by the driver and their bytes (below a few MB) go with
the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy
from .textnum import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_ENTRIES = 150_000


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Vocabulary, automaton and the memo of units already segmented."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.unknown = sp.unk_id()
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        alphabet: set[str] = set()
        crosses = False
        for i, piece in enumerate(self.pieces):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or not piece:
                continue
            score = sp.get_score(i)
            lowest = min(lowest, score)
            self.automaton.add_word(piece, (len(piece), score, i))
            alphabet |= set(piece)
            crosses |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        # No piece goes past the end of a word or over a newline unless the vocabulary says
        # so; then the best path of a text is the best paths of these units, one by one.
        end = r"\n" if "\n" not in alphabet else ""
        self.units = None if crosses else re.compile(f"{MARK}*[^{MARK}{end}]+|{MARK}+" + ("|\n" if end else ""))
        self.memo: dict[str, tuple[int, ...]] = {}
        text = [None if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        for i in range(size):
            if sp.is_control(i):
                text[i] = ""
        self.text = text

    def viterbi(self, unit: str) -> list[int]:
        """Ids of the best segmentation of one unit; ``\\0`` marks are handled by encode."""
        n = len(unit)
        best = [0.0] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0
        relaxed = 0
        fallback = self.unknown_score

        for stop, (length, score, piece) in self.automaton.iter(unit):
            stop += 1
            while relaxed < stop:  # positions reached by falling back to one character
                relaxed += 1
                best[relaxed] = best[relaxed - 1] + fallback
                back[relaxed] = (relaxed - 1, -1)
            total = best[stop - length] + score
            if total > best[stop] or (total == best[stop] and back[stop][1] < 0):
                best[stop] = total
                back[stop] = (stop - length, piece)
            done = stop
        for relaxed in range(done + 1, n + 1):
            back[relaxed] = (relaxed - 1, -1)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                for b in reversed(unit[start:at].encode("utf-8", "surrogatepass")):
                    ids.append(self.byte_id.get(b, self.unknown))
            at = start
        ids.reverse()
        return ids

    def _unit(self, unit: str) -> tuple[int, ...]:
        ids = tuple(self.viterbi(unit))
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        if len(unit) <= 64:
            self.memo[unit] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK in text:  # the text's own markers become bytes, between parts without them
            ids: list[int] = []
            for k, part in enumerate(text.split(MARK)):
                if k:
                    ids += [self.byte_id.get(b, self.unknown) for b in MARK.encode()]
                ids += self._plain((MARK if not k else "") + part.replace(" ", MARK))
            return ids
        return self._plain(MARK + text.replace(" ", MARK))

    def _plain(self, marked: str) -> list[int]:
        if self.units is None:
            return self.viterbi(marked)
        memo, ids = self.memo, []
        for unit in self.units.findall(marked):
            ids += memo.get(unit) or self._unit(unit)
        return ids

    def decode(self, ids) -> str:
        text = self.text
        try:  # no byte pieces
            out = "".join([text[i] for i in ids])
        except TypeError:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                piece = text[i]
                if piece is None:
                    run.append(self.byte_of[i])
                else:
                    if run:
                        parts.append(run.decode("utf-8", "replace"))
                        run.clear()
                    parts.append(piece)
            parts.append(run.decode("utf-8", "replace"))
            out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


_CODECS: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _schema_with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind, True)])


def encode_documents(
    docs: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids", check: str | None = None
) -> DataFrame:
    """``docs`` with an array column of piece ids of the whole text (null text: null).

    With ``check``, a boolean column of that name says whether decoding the ids gives the
    text back (null text: true).
    """
    model = _read(model_path or default_model_path())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for big in batches:
            for batch in slices(big, text):
                column = batch.column(text)
                offsets, flat, same = [0], [np.zeros(0, np.int32)], []
                for value in column.to_pylist():
                    got = own.encode(value) if value else []
                    flat.append(np.array(got, np.int32))
                    offsets.append(offsets[-1] + len(got))
                    if check:
                        same.append(not value or own.decode(got) == value)
                arr = pa.ListArray.from_arrays(
                    pa.array(np.array(offsets, np.int32)), pa.array(np.concatenate(flat)),
                    mask=pa.array(column.is_null().to_numpy(zero_copy_only=False)),
                )
                out = _with(batch, ids, arr)
                yield _with(out, check, pa.array(same, pa.bool_())) if check else out

    schema = _schema_with(docs.schema, ids, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(run, _schema_with(schema, check, T.BooleanType()) if check else schema)


def decode_documents(docs: DataFrame, model_path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for (null ids: null)."""
    model = _read(model_path or default_model_path())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            column = batch.column(ids)
            offsets = np.asarray(column.offsets)
            flat = np.asarray(column.values)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            out = [
                own.decode(flat[offsets[i] : offsets[i + 1]].tolist()) if valid[i] else None
                for i in range(batch.num_rows)
            ]
            yield _with(batch, text, pa.array(out, pa.string()))

    return docs.mapInArrow(run, _schema_with(docs.schema, text, T.StringType()))


def _with(batch: pa.RecordBatch, name: str, arr: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [arr], [n for n, _ in kept] + [name])


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, for every row."""
    coded = encode_documents(docs.select("doc_id", "text"), model_path, check="round_trip")
    return coded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "round_trip", "ids"
    )
