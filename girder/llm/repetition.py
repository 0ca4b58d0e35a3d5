"""Quality rules over repeated passages, found with a suffix array over the words of each text.

The suffixes of a block of texts are sorted together by prefix doubling in numpy. Each text ends
in a sentinel word of its own, so no repeat crosses from one text to another. Only suffixes whose
first ``least`` words occur again in their text can stand in an interval of the wanted depth, so the
sort goes on with those alone. Longest common prefixes of neighbours in suffix order are found in
text order, where each is at most one shorter than the one before, so words are compared a linear
number of times.

Runs of neighbours that share a prefix are intervals, nested like a tree. An interval is a maximal
repeated substring if its suffixes don't all have the same word before them: it can be made longer
on neither side. Each suffix belongs to the deepest maximal interval that holds it; the union of
those spans is what maximal repeats cover.

A worker holds one block: ``BLOCK_WORDS`` words, or one text if that is longer. Measured on a text
of a million words that repeats throughout, it takes some 300 bytes for each word; no array is kept
for a round of doubling, so that doesn't grow with the length of the repeats.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl, per_batch, tune, utf8, with_text

#: Production parameters. WINDOW and MIN_WORDS are those of the base rules, the others the method's.
WINDOW = 8
MIN_WORDS = 20
LEAST_REPEAT = 4
MAX_COVERED = 0.30
MAX_LONGEST = 0.20
BLOCK_WORDS = 400_000
SYMBOLS = b"#*$%&|<>"

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, n_maximal long, spans array<struct<start:long,end:long>>, base_failed boolean, kept boolean"


def _ranked(keys: np.ndarray) -> np.ndarray:
    """For each key the number of smaller keys: equal keys share it, and order is kept."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    if len(keys):
        ordered = keys[order]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        ranks[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return ranks


def sorted_suffixes(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``least`` words another one has too, in order, and the common prefixes
    of each with the next (one fewer; 0 where they share fewer than ``least``).

    ``words``: ids of the words of many texts, each text followed by an id of its own.
    """
    n = len(words)
    none = np.empty(0, np.int64)
    if n == 0:
        return none, none
    rank, span = _ranked(words), 1
    while span < least:
        # Prefixes of ``least`` words exactly, as two that overlap.
        step = min(span, least - span)
        after = np.full(n, -1)
        after[: max(0, n - step)] = rank[step:]
        rank = _ranked(rank * (n + 1) + after + 1)
        span += step
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    if not len(live):
        return none, none
    found, group = live, rank[live]
    # Suffixes in groups of equal ranks; those alone in theirs are sorted already.
    while len(live):
        after = np.where(live + span < n, rank[np.minimum(live + span, n - 1)], -1)
        order = np.lexsort((after, rank[live]))
        at, head, tail = live[order], rank[live][order], after[order]
        new = np.concatenate(([True], head[1:] != head[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        part = new | np.concatenate(([True], tail[1:] != tail[:-1]))
        first = np.maximum.accumulate(np.where(part, np.arange(len(at)), 0))
        rank[at] = head + first - start
        span *= 2
        sizes = np.diff(np.append(np.flatnonzero(part), len(at)))
        live = at[np.repeat(sizes > 1, sizes)]
    # Ranks grow by what is before a suffix in its group, so those of a group stay together.
    by_rank = np.argsort(rank[found], kind="stable")
    order, group = found[by_rank], group[by_rank]
    joined = group[1:] == group[:-1]
    return order, _common(words, order, joined, least)


def _common(words: np.ndarray, order: np.ndarray, joined: np.ndarray, least: int) -> np.ndarray:
    """Words that each suffix in ``order`` shares with the next, where ``joined``; else 0.

    In text order a suffix shares at most one word fewer than the one before it, so the search
    starts there. A text's own last word ends every comparison.
    """
    out = np.zeros(max(0, len(order) - 1), np.int64)
    left = np.flatnonzero(joined)
    in_text = left[np.argsort(order[left], kind="stable")]
    read = memoryview(np.ascontiguousarray(words))
    before, same = -2, 0
    shared = []
    for i, j in zip(order[in_text].tolist(), order[in_text + 1].tolist(), strict=True):
        same = max(least, same - 1) if i == before + 1 else least
        while read[i + same] == read[j + same]:
            same += 1
        shared.append(same)
        before = i
    out[in_text] = shared
    return out


def intervals(common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of suffixes that share a prefix, from the common prefixes of neighbours.

    Returns first place, last place and length of the prefix of each, and the interval around it (-1
    for none); and for each pair of neighbours the interval of just what they share (-1 for none).
    """
    low, high, depth, around, of = (array("q") for _ in range(5))
    open_: list[int] = []
    for k, shared in enumerate(chain(memoryview(common), (0,))):
        start, closed = k, -1
        while open_ and depth[open_[-1]] > shared:
            closed = open_.pop()
            high[closed], start = k, low[closed]
            if open_ and depth[open_[-1]] >= shared:
                around[closed] = open_[-1]
        if shared and not (open_ and depth[open_[-1]] == shared):
            if closed >= 0:
                around[closed] = len(low)
            open_.append(len(low))
            for of_interval, value in ((low, start), (high, -1), (depth, shared), (around, -1)):
                of_interval.append(value)
        of.append(open_[-1] if shared else -1)
    return tuple(np.frombuffer(x, np.int64) if x else np.empty(0, np.int64) for x in (low, high, depth, around, of[:-1]))


class Repeats:
    """Maximal repeated substrings of a block of texts."""

    def __init__(self, words: np.ndarray, least: int):
        self.order, common = sorted_suffixes(words, least)
        self.low, self.high, self.depth, around, of = intervals(common)
        self.maximal, self.reach = np.empty(0, bool), np.zeros(len(self.order), np.int64)
        if not len(self.low):
            return
        # Words before the suffixes: those of an interval differ if some two neighbours' do.
        before = np.where(self.order > 0, words[self.order - 1], -1)
        differ = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
        self.maximal = differ[self.high] > differ[self.low]
        # The nearest maximal interval at or around each: pointers are doubled until none moves.
        # What has nothing maximal around it points at itself in the end, and counts for nothing.
        mine = np.arange(len(around))
        to = np.where(self.maximal | (around < 0), mine, around)
        while (to[to] != to).any():
            to = to[to]
        deepest = np.where(self.maximal[to], self.depth[to], 0)
        pair = np.where(of >= 0, deepest[of], 0)
        self.reach = np.maximum(np.append(pair, 0), np.concatenate(([0], pair)))

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Union of the spans of maximal repeats of ``least`` words or more: starts and ends."""
        long = self.reach >= least
        at, depth = self.order[long], self.reach[long]
        by_place = np.argsort(at, kind="stable")
        return _unions(at[by_place], depth[by_place])


def _unions(at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans [at, at + depth), as starts and ends; ``at`` rises."""
    if not len(at):
        return at, depth
    reach = np.maximum.accumulate(at + depth)
    fresh = np.concatenate(([True], at[1:] > reach[:-1]))
    return at[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1)]


def _block(texts: list[list[bytes]], window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """For each text: words in windows that repeat, words in maximal repeats, longest and number of
    those, and their spans."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids, names = pd.factorize(np.array([w for t in texts for w in t], dtype=object)) if sizes.sum() else (np.empty(0, np.int64), ())
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    words = np.empty(int(ends[-1]), np.int64)
    inner = np.ones(len(words), bool)
    inner[ends - 1] = False
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    # A word counts as another in another text, so that its ranks hold only suffixes of one text.
    words[inner] = owner[inner] * (len(names) + 1) + ids
    words[ends - 1] = np.arange(len(texts)) * (len(names) + 1) + len(names)
    found = Repeats(words, min(least, window))
    longest, number, covered, repeated = (np.zeros(len(texts), np.int64) for _ in range(4))
    good = found.maximal & (found.depth >= least)
    of = owner[found.order[found.low[good]]] if good.any() else np.empty(0, np.int64)
    np.maximum.at(longest, of, found.depth[good])
    np.add.at(number, of, 1)
    begin, end = found.spans(window)
    np.add.at(repeated, owner[begin], end - begin)
    begin, end = found.spans(least)
    np.add.at(covered, owner[begin], end - begin)
    spans: list[list[dict]] = [[] for _ in texts]
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        o = owner[b]
        spans[o].append({"start": b - int(starts[o]), "end": e - int(starts[o])})
    return repeated, covered, longest, number, spans


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None], window: int = WINDOW, min_words: int = MIN_WORDS, least: int = LEAST_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> list[tuple]:
    """One tuple in the order of FIELDS for each UTF-8 text."""
    out: list[tuple] = []
    block: list[tuple[bytes, list[bytes]]] = []
    held = 0

    def flush() -> None:
        if not block:
            return
        found = _block([w for _, w in block], window, least)
        for (text, words), r, c, m, k, s in zip(block, *(x.tolist() for x in found[:4]), found[4], strict=True):
            n = len(words)
            joined = b"".join(words)
            # Code points are the bytes that don't continue another.
            chars = len(joined.decode("utf-8", "replace"))
            symbols = len(joined) - len(joined.translate(None, SYMBOLS))
            base = n < min_words or 100 * r > 30 * n
            out.append((n, chars, symbols, _dup_lines(text), r, c, m, k, s, base, not (base or c > max_covered * n or m > max_longest * n)))
        block.clear()

    for text in texts:
        text = text or b""
        words = text.split()
        if block and held + len(words) > BLOCK_WORDS:
            flush()
            held = 0
        block.append((text, words))
        held += len(words) + 1
    flush()
    return out


def repetition_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, min_words: int = MIN_WORDS, least: int = LEAST_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """The columns ``keep`` of ``docs`` with what its texts repeat, and whether they may stay.

    Words are runs of characters other than ASCII white space. ``n_repeat_words``: words in windows
    of ``window`` words that the text has twice or more. Of the maximal repeated substrings of
    ``least`` words or more: ``n_maximal`` their number, ``longest_repeat`` the words of the longest,
    ``n_covered`` the words in any of their places, ``spans`` those places as words [start, end).

    ``base_failed``: fewer than ``min_words`` words, or over 30 % of them in repeated windows.
    ``kept``: the base holds, maximal repeats cover at most ``max_covered`` of the words, and the
    longest has at most ``max_longest`` of them.

    One row for each row of ``docs``, in no order; only the named columns are read, so others may
    have any names. A null or empty text has no words and isn't kept; an empty table gives no rows;
    repeated rows are measured each for itself; a text of any length is measured as a whole.
    """
    tune(docs.sparkSession)
    source, name = with_text(docs, keep, text)
    names = [x.split()[0] for x in FIELDS.split(", ") if not x.startswith(" ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = measure(utf8(batch, name), window, min_words, least, max_covered, max_longest)
        kinds = [pa.int64()] * 8 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] + [pa.bool_()] * 2
        new = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + new, [*keep, *names])

    return source.mapInArrow(per_batch(run), ddl(source.select(*keep), FIELDS))
