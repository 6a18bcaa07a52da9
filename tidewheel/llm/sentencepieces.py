"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a chunk of text once; at each
position it follows output links to every piece that ends there, and each of
them relaxes the best path to that position (Viterbi).

Two kinds of models are served. For a unigram model the path with the highest
sum of scores wins. For a BPE model a piece may follow another only if merging
their joint text by rank gives just these two pieces; a text's BPE encoding is
the one path of which this holds at every step, so the same pass over the same
automaton yields exactly the ids of the merge procedure in linear time.

Chunks (a word with the spaces before it, or a line feed) that a worker meets
again are remembered, in two tables of bounded bytes, the older of which goes
when the newer is full; pieces never span two chunks.
Characters outside the vocabulary become byte pieces. A literal U+2581, which
the format would turn into a space, is also written as bytes, so that decoding
gives back every text exactly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from pathlib import Path
from sys import getsizeof

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Public vocabulary file; the path is a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of each of the two tables of chunks that a worker remembers, as estimated by _new.
REMEMBERED = 20 << 20
#: Pairs of pieces that a worker remembers before it starts anew.
PAIRS = 500_000
#: Bytes of texts that a worker encodes at a time, a longer one alone.
SLICE = 1 << 20
_UNIGRAM, _BPE = 1, 2
_NORMAL, _BYTE = 1, 6
#: Marks of chunks seen once, by hash.
_MARKS = 1 << 20

#: Inside a character class: letters, without superscript and fraction digits.
_LETTER = r"^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209f"
#: Ways to cut a text where no piece may reach over, finest first; the first in which every piece is one chunk is taken.
#: Chunks keep the plain space, as strings of one byte a character take half the memory.
_CHUNKS = (
    rf" *[{_LETTER}]+| *(?:(?![{_LETTER}])[^ \n])+| +|\n",
    r" *[^ \n]+| +|\n",
    r" *[^ ]+| +",
    r"(?s:.+)",
)


class Vocabulary:
    """What a model file says: pieces as (text, score, type), kind of model."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool) -> None:
        self.pieces, self.bpe = pieces, bpe

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(Path(path).read_bytes())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("only models without text normalisation are read")
        if m.trainer_spec.model_type not in (_UNIGRAM, _BPE) or not m.trainer_spec.byte_fallback:
            raise ValueError("only unigram and BPE models with byte fallback are read")
        return cls([(p.piece, p.score, p.type) for p in m.pieces], m.trainer_spec.model_type == _BPE)


class Codec:
    """Encoder and decoder of one vocabulary; made once a worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.bpe = vocabulary.bpe
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        self.values = [p[1] for p in vocabulary.pieces]
        self.text = [p[0] for p in vocabulary.pieces]
        for i, (piece, score, kind) in enumerate(vocabulary.pieces):
            raw = b""
            if kind == _BYTE:
                self.bytes[int(piece[3:5], 16)] = i
                raw = bytes([int(piece[3:5], 16)])
            elif kind == _NORMAL:
                self.ids[piece], self.scores[piece] = i, score
                raw = piece.replace(SPACE, " ").encode()
            self.raw.append(raw)
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.code = "H" if len(self.text) <= 1 << 16 else "i"  # of packed ids
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if not self.bpe or self.merged(piece) == [i]:  # a piece that merging never gives is left out
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.chunk = next(c for c in map(re.compile, _CHUNKS) if all(c.fullmatch(p.replace(SPACE, " ")) for p in self.ids))
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.marks = bytearray(_MARKS)
        self.follows: dict[int, bool] = {}
        self._path = self._merge_path if self.bpe else self._best_path

    def merged(self, text: str) -> list[int]:
        """Ids by the merge procedure itself, for a short text of known
        characters: the best-ranked pair of neighbours is joined, leftmost
        first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two pieces gives the two."""
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        known = self.follows[a << 32 | b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def _merge_path(self, text: str) -> list[int]:
        """BPE: left[k] is the last piece of the encoding of the first k
        characters, -1 if that is no piece; exactly one piece qualifies."""
        left: list[int | None] = [None] * (len(text) + 1)
        left[0] = -1
        known = self.follows.get
        for last, (piece, length) in self.automaton.iter(text):
            if left[last + 1] is not None:
                continue
            before = left[last + 1 - length]
            if before is None or before < 0:
                left[last + 1] = piece
            elif (ok := known(before << 32 | piece)) or ok is None and self._may_follow(before, piece):
                left[last + 1] = piece
        return self._walk(text, left)

    def _best_path(self, text: str) -> list[int]:
        """Unigram: the piece that ends the best-scoring path to each position."""
        left: list[int | None] = [None] * (len(text) + 1)
        best = [float("-inf")] * (len(text) + 1)
        best[0] = 0.0
        done = 0
        for last, (piece, length) in self.automaton.iter(text):
            while done < last:  # positions that no piece reaches end with an unknown character
                done += 1
                if left[done] is None:
                    best[done] = best[done - 1] + self.unknown
            if (score := best[last + 1 - length] + self.values[piece]) > best[last + 1]:
                best[last + 1], left[last + 1] = score, piece
        return self._walk(text, left)

    def _walk(self, text: str, left: list[int | None]) -> list[int]:
        out: list[int] = []
        at = len(text)
        while at:
            piece = left[at]
            if piece is None:
                at -= 1
                out += [self.bytes[c] for c in reversed(text[at].encode("utf-8", "surrogatepass"))]
            else:
                out.append(piece)
                at -= len(self.text[piece])
        return out[::-1]

    def packed(self, text: str) -> bytes:
        """Ids of a text, as the model's own library gives them (but for a
        literal U+2581), as integers of type code; none for an empty text."""
        if not text:
            return b""
        first, *rest = text.split(SPACE)
        out = self._chunks(" " + first)
        for part in rest:
            out.append(array(self.code, [self.bytes[c] for c in SPACE.encode()]).tobytes())
            out += self._chunks(part)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array(self.code, self.packed(text)).tolist()

    def _chunks(self, text: str) -> list[bytes]:
        get, new = self.memory.get, self._new
        return [get(c) or new(c) for c in self.chunk.findall(text)]

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk that was not in the newer table when its text was begun."""
        if known := self.memory.get(chunk):
            return known
        ids = self.older.get(chunk)
        if ids is None:
            ids = array(self.code, self._path(chunk.replace(" ", SPACE))).tobytes()
            at = hash(chunk) & _MARKS - 1
            if not self.marks[at] or len(chunk) > 64:  # most chunks never come again
                self.marks[at] = 1
                return ids
        need = getsizeof(chunk) + getsizeof(ids) + 64  # and about 64 in the table
        if self.held + need > REMEMBERED:
            self.memory, self.older, self.held = {}, self.memory, 0
            self.marks[:] = bytes(_MARKS)
        self.memory[chunk] = ids
        self.held += need
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; control pieces give nothing."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(key: str, vocabulary: Vocabulary) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def encode_texts(docs: DataFrame, model: str = MODEL, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, token_ids, n_tokens, decoded_sha256 (of the text that the ids
    decode to, UTF-8) and round_trip (whether that is the text) of each row.
    A null text counts as empty and has no tokens; long texts are encoded
    whole; rows may repeat, and ids may be null. The driver reads the model
    file and ships the vocabulary (tens of thousands of pieces) in the task;
    executors need no file."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    kind = dict(docs.dtypes)[id_col]
    vocabulary = Vocabulary.load(model)

    def run(b: dict[str, list]) -> dict[str, list]:
        codec = _codec(model, vocabulary)
        packed = [codec.packed(x or "") for x in b["text"]]
        decoded = [codec.decode(array(codec.code, p)) for p in packed]
        ids = np.frombuffer(b"".join(packed), codec.code).astype(np.int32)
        ends = np.cumsum([0] + [len(p) // array(codec.code).itemsize for p in packed], dtype=np.int32)
        return {
            "doc_id": b["doc_id"], "token_ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), "n_tokens": np.diff(ends).tolist(),
            "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded], "round_trip": [d == (x or "") for d, x in zip(decoded, b["text"], strict=True)],
        }

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, token_ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean", ("text", SLICE))


def decode_ids(rows: DataFrame, model: str = MODEL, ids: str = "token_ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of every row: the text that its ids decode to. Null or
    no ids give an empty text; null ids among others give nothing; ids outside
    the vocabulary raise. Rows may repeat, and doc_ids may be null."""
    kind = dict(rows.dtypes)[id_col]
    vocabulary = Vocabulary.load(model)

    def checked(found: Iterable[int | None]) -> list[int]:
        out = [i for i in found if i is not None]
        if out and min(out) < 0:
            raise IndexError("ids are not negative")
        return out

    def run(b: dict[str, list]) -> dict[str, list]:
        codec = _codec(model, vocabulary)
        return {"doc_id": b["doc_id"], "text": [codec.decode(checked(x or ())) for x in b["ids"]]}

    return map_batches(rows.select(F.col(id_col).alias("doc_id"), F.col(ids).alias("ids")), run, f"doc_id {kind}, text string")
