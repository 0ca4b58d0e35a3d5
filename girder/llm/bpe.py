"""Byte-level BPE by merge replay over the words of a block of texts, with exact decoding.

Texts are cut by the tokenizer's pattern. The distinct new words of a block are laid out in one
array of byte tokens, linked to their neighbours, and indexed: for each rank, the positions whose
pair of tokens would merge into it. Ranks are replayed from the lowest up; a merge touches only the
two pairs beside it, which go into the index in turn. A pair that becomes possible at a lower rank
than the one in hand is replayed before the rest of it, so each word ends as it would alone.

Words and their tokens are kept from block to block in a table of about ``KEPT_WORDS`` words. When
it is full it becomes the older one, from which words that occur again move to the new one. A worker
holds the vocabulary, those two tables and one block.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ddl, per_batch, tune, with_text

#: Most words, and most bytes in a word, that are kept between blocks.
KEPT_WORDS = 300_000
KEPT_BYTES = 64


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Replay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pieces = {rank: token for token, rank in ranks.items()}
        self.bytes = [ranks.get(bytes([i])) for i in range(256)]
        if None in self.bytes:
            raise ValueError("a byte-level vocabulary has a token for every byte")
        #: Rank that a pair of tokens merges into, by left << 32 | right: all ways to cut a token in two.
        self.pairs = {left << 32 | right: rank for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.of_byte = np.array(self.bytes, np.int64)
        self.of_bytes = np.array([[self.pairs.get(a << 32 | b, -1) for b in self.bytes] for a in self.bytes], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word, all merged together."""
        rank_of = self.pairs.get
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        if not n:
            return [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        last = ends[sizes > 0] - 1
        token = self.of_byte[text].tolist()
        # A word's last token has no neighbour, nor has the next word's first.
        nearby = np.arange(1, n + 1)
        nearby[last] = -1
        after = nearby.tolist()
        nearby = np.arange(-1, n - 1)
        nearby[last[:-1] + 1] = -1
        before = nearby.tolist()
        # The rank that each place's token and the next would merge into, and the places of each rank.
        first = np.full(n, -1)
        first[:-1] = self.of_bytes[text[:-1], text[1:]]
        first[last] = -1
        ranks = first.tolist()
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        values = first[order]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
        places = order.tolist()
        index: dict[int, list[int]] = {rank: places[i:j] for rank, i, j in zip(values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)], strict=True)} if len(values) else {}
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            left = rank << 32
            for k, i in enumerate(places):
                if ranks[i] != rank:  # merged away, or another pair by now
                    continue
                j = after[i]
                token[i], token[j], ranks[j] = rank, -1, -1
                end = after[i] = after[j]
                lower = False
                if end >= 0:
                    before[end] = i
                    new = ranks[i] = rank_of(left | token[end], -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(heap, new)
                        lower = new <= rank
                else:
                    ranks[i] = -1
                head = before[i]
                if head >= 0:
                    new = ranks[head] = rank_of(token[head] << 32 | rank, -1)
                    if new >= 0:
                        if new in index:
                            index[new].append(head)
                        else:
                            index[new] = [head]
                            heapq.heappush(heap, new)
                        lower = lower or new <= rank
                if lower:
                    rest = places[k + 1 :]
                    if rest:
                        if rank in index:
                            index[rank].extend(rest)
                        else:
                            index[rank] = rest
                            heapq.heappush(heap, rank)
                    break
        out, at = [], 0
        for end in ends.tolist():
            out.append([t for t in token[at:end] if t >= 0])
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [self.pattern.findall(t) for t in texts]
        fresh: set[str] = set()
        for words in cut:
            fresh.update(words)
        fresh.difference_update(known)
        new = []
        for w in fresh:
            ids = older.get(w)
            if ids is None:
                new.append(w)
            else:
                known[w] = ids
        long = []
        for w, ids in zip(new, self.replay([w.encode() for w in new]), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
            if len(w) > KEPT_BYTES:
                long.append(w)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in long:
            del known[w]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def _replay(data: bytes, pattern: str) -> Replay:
    return Replay(parse_ranks(data), pattern)


def read_file(path: str) -> bytes:
    """A vocabulary file, read by the driver; it has a fixed size (about 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs``, and its texts as tokens and back.

    ``vocabulary``: a rank file's content, sent to the executors once; ``pattern``: the regular
    expression that cuts texts. Columns: ``n_tokens``, ``ids`` (array of ints; left out if ``ids``
    is false), ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (of the bytes that the ids decode to), both in lowercase hex. The decoded
    bytes are the text's own, or the worker stops with an error.

    Special tokens are ordinary text. A null text counts as empty: no tokens, and the digests of no
    bytes. Repeated rows come back as often as they came; an empty table gives no rows; only the
    named columns are read.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source, name = with_text(docs, keep, text)
    new = {"n_tokens": "long"} | ({"ids": "array<int>"} if ids else {}) | {"ids_sha256": "string", "decoded_sha256": "string"}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _replay(shared.value, pattern)
        texts = [t or "" for t in batch.column(name).to_pylist()]
        encoded = bpe.encode(texts)
        digests = []
        for t, i in zip(texts, encoded, strict=True):
            decoded = bpe.decode(i)
            if decoded != t.encode():
                raise ValueError("a text doesn't decode to itself")
            digests.append((hashlib.sha256(i).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        counts = np.array([len(i) // 4 for i in encoded], np.int64)
        columns = [pa.array(counts)]
        if ids:
            flat = np.frombuffer(b"".join(encoded), "<u4").view(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat)))
        columns += [pa.array(list(v), pa.string()) for v in zip(*digests, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + columns, [*keep, *new])

    return source.mapInArrow(per_batch(run), ddl(source.select(*keep), *(f"{n} {k}" for n, k in new.items())))


def vocabulary_of(spark: SparkSession, name: str) -> tuple[bytes, str]:
    """Content of a public rank file, and the pattern that goes with it."""
    import public_tokenizers

    return read_file(public_tokenizers.path(name)), public_tokenizers.PATTERN
