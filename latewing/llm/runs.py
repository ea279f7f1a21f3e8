"""Periodic runs of words, by a suffix automaton and link-cut access.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least
``least_length`` words and ``least_repeats`` periods long and that no neighbouring word extends.
Texts are documents' own: a NULL, empty or blank text has no words and no runs. Words are runs of
other characters than blanks, tabs and line ends (U+0020, U+0009 to U+000D), compared as bytes. Rows are read on their own,
repeated rows alike; very long texts are read whole by one task, in time that grows with
n log n. Runs are sorted by start, then period; those of equal length all count. Extra columns
are kept, columns named ``runs`` and ``collapsed`` are replaced. No rows give no rows.

The automaton is built only over stretches that can hold a run. In a run of period q all
three-word windows but those of its first q words have an equal window at most q words
before. So a stretch of m neighbouring windows with an equal earlier one can only hold runs
with q <= (m + 2) / (least_repeats - 1), and windows whose last equal one is further away
end the stretch. This loses no run; most texts have no such stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import slices

_WINDOW = 3
#: Passes that narrow stretches; fewer would only leave more to the automaton.
_NARROWINGS = 20
_RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class SuffixLinks:
    """The suffix automaton of a sequence: length and suffix link of each state, and the state of each prefix."""

    def __init__(self, words: list[int]):
        length, link, prefixes = [0], [-1], []
        moves: list[dict[int, int]] = [{}]
        last = 0
        for size, word in enumerate(words, 1):
            state = len(length)
            length.append(size)
            moves.append({})
            at = last
            while at >= 0 and word not in moves[at]:
                moves[at][word] = state
                at = link[at]
            if at < 0:
                link.append(0)
            else:
                target = moves[at][word]
                if length[target] == length[at] + 1:
                    link.append(target)
                else:
                    copy = state + 1
                    link.append(copy)
                    length.append(length[at] + 1)
                    moves.append(moves[target].copy())
                    link.append(link[target])
                    link[target] = copy
                    while at >= 0 and moves[at].get(word) == target:
                        moves[at][word] = copy
                        at = link[at]
            last = state
            prefixes.append(state)
        self.length, self.link, self.prefixes = length, link, prefixes


class LastEnds:
    """Link-cut access over the tree of suffix links.

    A preferred path holds states whose words last ended at the same place. Each is a splay tree
    by depth; only the tree's root knows that place.
    """

    def __init__(self, links: SuffixLinks):
        self.length, self.up = links.length, links.link.copy()
        count = len(self.length)
        self.left, self.right, self.end = [-1] * count, [-1] * count, [-1] * count

    def _splay(self, x: int) -> None:
        """Makes ``x`` the root of its splay tree, and hands it the place that the old root knew."""
        up, left, right = self.up, self.left, self.right
        top = x
        while (p := up[top]) >= 0 and (left[p] == top or right[p] == top):
            top = p
        if top == x:
            return
        self.end[x] = self.end[top]
        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child >= 0:
            up[child] = p
        up[p], up[x] = x, g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """Every path segment between the state and the root, as (last end, longest length); then they end at ``place``."""
        up, right, end = self.up, self.right, self.end
        found, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            cut = right[x]
            if cut >= 0:
                end[cut] = end[x]
            if end[x] >= 0:
                found.append((end[x], self.length[x]))
            right[x] = below
            below, x = x, up[x]
        end[below] = place
        return found


def find_runs(words: list[int], least_repeats: int = 4, least_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period.

    When a word is appended, a segment whose words ended d places before and now end again is a square of period
    d if it is d words long; longer, it is so many more repeats.
    """
    links = SuffixLinks(words)
    ends, found, reached = LastEnds(links), [], {}
    size = len(words)
    for place, state in enumerate(links.prefixes):
        for before, longest in ends.access(state, place):
            period = place - before
            if (least_repeats - 1) * period > longest or reached.get(period, -1) > place:
                continue
            start, stop = place - longest - period + 1, place + 1
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < size and words[stop] == words[stop - period]:
                stop += 1
            reached[period] = stop
            if stop - start >= least_length:
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _previous(keys: np.ndarray) -> np.ndarray:
    """How far before each key its equal is; 0 where there is none."""
    order = np.argsort(keys, kind="stable")
    ranked, back = keys[order], np.zeros(len(keys), np.int64)
    equal = ranked[1:] == ranked[:-1]
    back[order[1:][equal]] = (order[1:] - order[:-1])[equal]
    return back


def stretches(texts: list[list[bytes]], least_repeats: int, least_length: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of all stretches that can hold runs."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = lambda q: max(least_length, least_repeats * q) - q - _WINDOW + 1
    needed = min(windows(q) for q in range(1, least_length + 1))
    if needed < 1:
        return [(n, 0, int(s)) for n, s in enumerate(sizes) if s]
    firsts, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    if total < _WINDOW:
        return []
    # Equal words have equal hashes; unequal ones may too, which only leaves more stretches.
    own = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, total).view(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    keys = own[:-2] * _MIX[0] + own[1:-1] * _MIX[1] + own[2:] * _MIX[2]
    keys ^= (keys >> np.uint64(29)) + text[:-2].astype(np.uint64) * _MIX[0]
    back = _previous(keys)
    back[text[:-2] != text[2:]] = 0
    at = np.flatnonzero(back)
    at = at[text[at] == text[at - back[at]]]
    for _ in range(_NARROWINGS):
        if not len(at):
            return []
        edges = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1, [True])))
        lengths = np.diff(edges)
        own_length = np.repeat(lengths, lengths)
        kept = (own_length >= needed) & (back[at] <= (own_length + _WINDOW - 1) // (least_repeats - 1))
        if kept.all():
            break
        at = at[kept]
    if not len(at):
        return []
    edges = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1, [True])))
    lengths, begins = np.diff(edges), at[edges[:-1]]
    number = text[begins]
    reach = (lengths + _WINDOW - 1) // (least_repeats - 1)
    start = np.maximum(begins - reach, firsts[number]) - firsts[number]
    stop = begins + lengths + _WINDOW - 1 - firsts[number]
    return list(zip(number.tolist(), start.tolist(), stop.tolist()))


def runs_of(texts: list[list[bytes]], least_repeats: int = 4, least_length: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    found: list[set] = [set() for _ in texts]
    for number, start, stop in stretches(texts, least_repeats, least_length):
        words, names = texts[number], {}
        ids = [names.setdefault(w, len(names)) for w in words[start:stop]]
        for first, length, period in find_runs(ids, least_repeats, least_length):
            first += start
            end = first + length
            # A run that goes on outside this stretch lies whole in another one.
            before = first == start > 0 and words[first - 1] == words[first - 1 + period]
            after = end == stop < len(words) and words[end] == words[end - period]
            if not before and not after:
                found[number].add((first, length, period))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def detect(docs: DataFrame, text: str = "text", least_repeats: int = 4, least_length: int = 6) -> DataFrame:
    """``docs`` with the array ``runs`` (start, length, period) and the text ``collapsed``, words joined by one blank."""
    if least_repeats < 2:
        raise ValueError("a run has two repeats or more")
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    fields = [docs.schema[c] for c in kept]
    schema = StructType([*fields, StructField("runs", ArrayType(_RUN, False)), StructField("collapsed", StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            texts = [(t or b"").split() for t in part.column(len(kept)).to_pylist()]
            found = runs_of(texts, least_repeats, least_length)
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            values = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(3)], _RUN.names)
            )
            collapsed = pa.array([b" ".join(collapse(w, f)) for w, f in zip(texts, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], runs, collapsed], names=schema.names)

    raw = F.col(f"`{text}`").cast("binary").alias("__words_of")
    return docs.select(*(docs[f"`{c}`"] for c in kept), raw).mapInArrow(rows, schema)
