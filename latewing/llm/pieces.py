"""SentencePiece encoding and decoding, by an Aho-Corasick automaton and Viterbi.

The best segmentation is the one with the highest sum of piece scores, ties to the
longer last piece, as in a unigram model. A character that no piece covers becomes
its UTF-8 byte pieces. A literal U+2581 is coded by bytes too, so that
decoding gives back every text exactly. NULL stays NULL, an empty text has no ids.
Rows are coded on their own: repeated rows alike, extra columns are kept, very long texts are coded whole.
No rows give no rows.

Words are coded many at a time. The automaton runs over all words of a batch that were not seen
before, and its output links name every piece at every end; then the best scores of all words grow
together, one position after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from .common import slices, worker_state

_MARK = "▁"
_UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _CONTROL, _OWN, _BYTE = 1, 2, 3, 4, 6  # fixed values of the file format
_MEMO, _MEMO_LENGTH, _TOGETHER = 250_000, 64, 20_000

# Blanks belong to the word after them; no piece has one anywhere else.
_SEGMENT = re.compile(r" *[^ ]+| +")


class PieceLinks:
    """The automaton as arrays, to take many words one character further at a time.

    A state is a beginning of a piece; state 0 is empty. ``ending`` names the longest piece that ends at a
    state, as a state; ``shorter`` the next one that ends there.
    """

    def __init__(self, words: dict[str, int]):
        states = {"": 0}
        for word in words:
            for size in range(1, len(word) + 1):
                states.setdefault(word[:size], len(states))
        self.fail, self.piece = np.zeros((2, len(states)), np.int64)
        self.ending, self.shorter = np.full((2, len(states)), -1, np.int64)
        for name in sorted(states, key=len)[1:]:
            state = states[name]
            behind = self.fail[state] = next(states[name[i:]] for i in range(1, len(name) + 1) if name[i:] in states)
            self.shorter[state] = self.ending[behind]
            self.piece[state] = words.get(name, -1)
            self.ending[state] = state if name in words else self.ending[behind]
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(w) for w in words if len(w) == 1]] = True
        self.bits = (4 * len(states)).bit_length()
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        names = [n for n in states if n]
        keys = np.array([states[n[:-1]] << 21 | ord(n[-1]) for n in names], np.int64)
        for key, slot, name in zip(keys.tolist(), self._slots(keys).tolist(), names):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.next[slot] = key, states[name]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _goto(self, keys: np.ndarray) -> np.ndarray:
        """The state that continues one state by a character; -1 where there is none."""
        slots = self._slots(keys)
        seen = self.keys[slots]
        found = np.where(seen == keys, self.next[slots], -1)
        at = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(at):
            slots[at] = (slots[at] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[at]]
            hit = seen == keys[at]
            found[at[hit]] = self.next[slots[at[hit]]]
            at = at[~hit & (seen >= 0)]
        return found

    def step(self, states: np.ndarray, characters: np.ndarray) -> np.ndarray:
        found = self._goto(states << 21 | characters)
        at = np.flatnonzero(found < 0)
        states = states[at]
        while len(at):
            stuck = states == 0
            found[at[stuck]] = 0
            at, states = at[~stuck], self.fail[states[~stuck]]
            found[at] = self._goto(states << 21 | characters[at])
            going = found[at] < 0
            at, states = at[going], states[going]
        return found


class PieceCoder:
    """Vocabulary of a SentencePiece model file."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single: set[str] = set()
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        self.size, self.gain = [len(p.piece) for p in model.pieces], [0.0] * len(model.pieces)
        scores = [p.score for p in model.pieces if p.type == _NORMAL]
        low, high = min(scores), max(scores)
        for number, piece in enumerate(model.pieces):
            raw = b""
            if piece.type in (_NORMAL, _OWN):
                if any(a != _MARK and b == _MARK for a, b in zip(piece.piece, piece.piece[1:])):
                    raise ValueError(f"piece {piece.piece!r} reaches over a blank")
                size = len(piece.piece)
                score = piece.score if piece.type == _NORMAL else size * high - 0.1
                # Blanks stand for themselves here, so that a literal U+2581 matches nothing.
                word = piece.piece.replace(_MARK, " ")
                self.automaton.add_word(word, number)
                self.gain[number] = score
                if size == 1:
                    self.single.add(word)
                raw = word.encode()
            elif piece.type == _BYTE:
                value = int(piece.piece[1:-1], 16)
                self.byte_ids[value] = number
                raw = bytes([value])
            elif piece.type == _UNKNOWN:
                raw = " ⁇ ".encode()
            self.bytes_of.append(raw)
        self.automaton.make_automaton()
        self.links = PieceLinks(dict(self.automaton.items()))
        # Every piece once as it is and once without a blank before it, for the start of a text.
        self.pieces = pa.array([*self.bytes_of, *(b.removeprefix(b" ") for b in self.bytes_of)], pa.binary())
        self.sizes, self.gains = np.array(self.size, np.int64), np.array(self.gain)
        self.unknown = low - _UNKNOWN_PENALTY
        self.memo: dict[str, bytes] = {}

    def best(self, segment: str) -> list[int]:
        """One pass: at each position the output links name every piece that ends there."""
        size = len(segment)
        score, back = [0.0] * (size + 1), [(-1, 1)] * (size + 1)
        matches = self.automaton.iter(segment)
        end, match = next(matches, (size, None))
        for at in range(size):
            top, choice = None, (-1, 1)
            if segment[at] not in self.single:
                top = score[at] + self.unknown
            longest = 0
            while end == at:
                length = self.size[match]
                value = score[at + 1 - length] + self.gain[match]
                if top is None or value > top or value == top and length > longest:
                    top, choice, longest = value, (match, length), length
                end, match = next(matches, (size, None))
            score[at + 1], back[at + 1] = top, choice
        found: list[int] = []
        at = size
        while at:
            number, length = back[at]
            if number < 0:
                found.extend(self.byte_ids[b] for b in reversed(segment[at - 1].encode()))
            else:
                found.append(number)
            at -= length
        return found[::-1]

    def best_of_many(self, segments: list[str]) -> list[bytes]:
        """``best`` of short segments, as little-endian ids."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-sizes, kind="stable")
        sizes, segments = sizes[order], [segments[i] for i in order.tolist()]
        text = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first, states = np.cumsum(sizes) - sizes, np.zeros(len(segments), np.int64)
        score = np.zeros((int(sizes[0]) + 1, len(segments)))
        choice = np.zeros((int(sizes[0]), len(segments)), np.int32)
        links = self.links
        for place in range(int(sizes[0])):
            live = np.searchsorted(-sizes, -place)  # the longer segments stand first
            states = links.step(states[:live], text[first[:live] + place])
            rows, ends = np.arange(live), links.ending[states]
            alone = ~self.links.single[text[first[:live] + place]]  # no piece: bytes, of a score below all others
            top, held = np.where(alone, score[place, :live] + self.unknown, -np.inf), np.full(live, -1, np.int32)
            rows, ends = rows[ends >= 0], ends[ends >= 0]
            while len(rows):
                number = links.piece[ends]
                value = score[place + 1 - self.sizes[number], rows] + self.gains[number]
                better = value > top[rows]  # longer pieces come first
                top[rows[better]], held[rows[better]] = value[better], number[better]
                ends = links.shorter[ends]
                going = ends >= 0
                rows, ends = rows[going], ends[going]
            score[place + 1, :live], choice[place, :live] = top, held
        found = [b""] * len(segments)
        for i, ids in zip(order.tolist(), self._read_back(segments, sizes, choice)):
            found[i] = ids
        return found

    def _read_back(self, segments: list[str], sizes: np.ndarray, choice: np.ndarray) -> list[bytes]:
        """The chosen pieces of every segment, from its end to its start, all segments step by step."""
        at, live, steps, spelled = sizes - 1, np.arange(len(sizes)), [], set()
        while len(live):
            number = choice[at, live]
            steps.append((live, number))
            spelled.update(live[number < 0].tolist())
            at = at - np.where(number < 0, 1, self.sizes[number])
            at, live = at[at >= 0], live[at >= 0]
        segment = np.concatenate([s for s, _ in steps][::-1])
        number = np.concatenate([n for _, n in steps][::-1])
        number = number[np.argsort(segment, kind="stable")].astype("<i4")
        ends = np.cumsum(np.bincount(segment, minlength=len(sizes))).tolist()
        raw, starts = number.tobytes(), [0, *ends]
        found = [raw[4 * a : 4 * b] for a, b in zip(starts, ends)]
        for i in spelled:
            ids, place = [], 0
            for n in number[starts[i] : ends[i]].tolist():
                if n < 0:
                    ids.extend(self.byte_ids[b] for b in segments[i][place].encode())
                else:
                    ids.append(n)
                place += 1 if n < 0 else self.size[n]
            found[i] = np.array(ids, "<i4").tobytes()
        return found

    def learn(self, segments: Iterable[str]) -> None:
        """Codes new segments into the memo; the caller keeps it small."""
        many = []
        for segment in segments:
            if len(segment) <= _MEMO_LENGTH:
                many.append(segment)
            else:
                self.memo[segment] = np.array(self.best(segment), "<i4").tobytes()
        for start in range(0, len(many), _TOGETHER):
            part = many[start : start + _TOGETHER]
            self.memo.update(zip(part, self.best_of_many(part)))

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Little-endian ids of every text."""
        split = [None if t is None else _SEGMENT.findall(" " + t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(filter(None, split)))
        if len(self.memo) + len(wanted) > _MEMO:
            self.memo.clear()
        self.learn(wanted.difference(self.memo))
        find = self.memo.__getitem__
        return [None if s is None else b"".join(map(find, s)) for s in split]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<i4")

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: pieces gathered into one buffer, which is cut at the lists' ends."""
        counts = ids.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        firsts = (ends - counts)[counts > 0]
        flat[firsts] += len(self.bytes_of)
        pieces = self.pieces.take(pa.array(flat))
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(flat) + 1, 4 * pieces.offset) if len(flat) else np.zeros(1, np.int32)
        cuts = pa.py_buffer(np.concatenate(([0], offsets[ends])).astype(np.int32).tobytes())
        data = pieces.buffers()[2] if len(flat) else pa.py_buffer(b"")
        mask = ids.is_null()
        valid = None if not ids.null_count else pa.py_buffer(np.packbits(~mask.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [valid, cuts, data])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # ids that do not come from a text may spell no character
            return pa.array([None if b is None else b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def _coder(model: str) -> PieceCoder:
    path = public_tokenizers.path(model)
    return worker_state(("pieces", path), lambda: PieceCoder(path))


def _with_column(df: DataFrame, source: str, name: str, kind, convert) -> DataFrame:
    """``df`` with one more last column, made from batches of ``source``; an older one of that name goes."""
    kept = df.drop(name)
    schema = StructType([*kept.schema.fields, StructField(name, kind)])
    names = schema.names
    at = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([*part.columns[:at], convert(part.column(at))], names=names)

    return kept.select(*(kept[f"`{c}`"] for c in kept.columns), F.col(source).alias("__source")).mapInArrow(run, schema)


def encode(df: DataFrame, model: str = "piece_bpe_32k.model", text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of column ``text``; ``model`` names a public model file."""

    def convert(column: pa.Array) -> pa.Array:
        found = _coder(model).encode_all(column.to_pylist())
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(f or b"") // 4 for f in found]))), pa.int32())
        values = pa.Array.from_buffers(pa.int32(), offsets[-1].as_py(), [None, pa.py_buffer(b"".join(filter(None, found)))])
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array([f is None for f in found]))

    return _with_column(df, text, ids, ArrayType(IntegerType()), convert)


def decode(df: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the piece ids in column ``ids``."""

    def convert(column: pa.Array) -> pa.Array:
        return _coder(model).decode_all(column)

    return _with_column(df, ids, text, StringType(), convert)
