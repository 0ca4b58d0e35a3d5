"""Token counts of greedy word pieces, by a linear longest-match automaton.

The vocabulary is a trie over bytes, of pieces that begin a word and pieces that continue one. When
no edge leaves a node for the next byte, greedy matching cuts pieces off the text matched so far
and goes on with what is left of it. Which pieces those are depends on the node alone, so each node
has a failure link to the node of what is left and the number of pieces cut off on the way. A word
is then counted in one pass over its bytes, without making any piece.

Counts of words are kept between blocks in a table of at most ``KEPT_WORDS`` words.
"""

from __future__ import annotations

from collections import Counter, deque
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import parse_ranks
from .common import ddl, per_batch, tune, utf8, with_text

KEPT_WORDS = 400_000
KEPT_BYTES = 64


def pieces_of(vocabulary: bytes) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word, and pieces that continue one, of a byte-level rank file.

    A token with one leading space begins a word; one without any white space continues one. Single
    bytes also begin a word, so that one in a script without spaces, or any other, can be cut.
    """
    first, later = [], []
    for token in parse_ranks(vocabulary):
        if token[:1] == b" " and len(token[1:].split()) == 1 and token[1:] == token[1:].strip():
            first.append(token[1:])
        elif token.split() == [token]:
            later.append(token)
            if len(token) == 1:
                first.append(token)
    return first, later


class Automaton:
    """Counts pieces of a word by greedy longest match; a word that can't be cut counts as one unknown piece."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        # Node 0 begins a word, node 1 continues one.
        self.edges: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        parent: list[tuple[int, int]] = [(-1, 0), (-1, 0)]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for byte in piece:
                    to = self.edges[at].get(byte)
                    if to is None:
                        to = self.edges[at][byte] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                        parent.append((at, byte))
                    at = to
                if piece:
                    final[at] = True
        #: Where to go on after cutting, or -1, and the number of pieces cut off.
        self.link = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque(self.edges[0].values())
        queue.extend(self.edges[1].values())
        while queue:
            at = queue.popleft()
            queue.extend(self.edges[at].values())
            if final[at]:
                self.link[at], self.popped[at] = 1, 1
                continue
            up, byte = parent[at]
            back, popped = self.link[up], self.popped[up]
            while back >= 0:
                to = self.edges[back].get(byte)
                if to is not None:
                    self.link[at], self.popped[at] = to, popped
                    break
                popped += self.popped[back]
                back = self.link[back]

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; 0 for no bytes."""
        edges, link, popped = self.edges, self.link, self.popped
        at = total = 0
        for byte in word:
            to = edges[at].get(byte)
            while to is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 1
                to = edges[at].get(byte)
            at = to
        if not word:
            return 0
        while at != 1:
            total += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return total


@cache
def _automaton(vocabulary: bytes) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(*pieces_of(vocabulary)), {}


def token_counts(docs: DataFrame, vocabulary: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, with ``n_words`` and ``n_tokens`` of its texts.

    Words are runs of characters other than ASCII white space; each is cut greedily into the
    longest pieces of ``vocabulary`` (a rank file's content), and one that can't be cut to its end
    is one token. A null or empty text has no words and no tokens; a word of any length is counted
    in one pass; repeated rows are counted each for itself; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source, name = with_text(docs, keep, text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, known = _automaton(shared.value)
        words, tokens = [], []
        if len(known) > KEPT_WORDS:
            known.clear()
        for t in utf8(batch, name):
            found = Counter((t or b"").split())
            total = 0
            for w, times in found.items():
                n = known.get(w)
                if n is None:
                    n = automaton.count(w)
                    if len(w) <= KEPT_BYTES:
                        known[w] = n
                total += n * times
            words.append(found.total())
            tokens.append(total)
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*keep, "n_words", "n_tokens"])

    return source.mapInArrow(per_batch(run), ddl(source.select(*keep), "n_words long", "n_tokens long"))
