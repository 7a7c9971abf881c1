"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7).

Method: forced-boundary splitting. A merge can only ever join two bytes that stand side by side inside some
vocabulary token, so wherever two neighbouring bytes occur in no token there is a certain cut: the fragments
between cuts are encoded independently and their ids concatenated. Most boundaries between Chinese characters,
for one, are such cuts. Everything that touches every byte works on whole Arrow buffers: the split pattern of the
vocabulary and the cuts are array expressions, equal fragments of a batch are encoded once, and ids are gathered into
the Arrow list directly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 2 << 20  # bytes encoded at a time
KNOWN = 400_000  # fragments remembered by a worker
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# fixed values: the endings that the split pattern keeps with an apostrophe
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

ENCODERS = 2  # vocabularies that a worker keeps ready
_encoders: dict[str, Encoder] = {}  # by digest of the vocabulary, the one used last at the end


def character_classes() -> np.ndarray:
    """Class of every code point under the split pattern: letter, number, white space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    text = "".join(chr(c) if not 0xD800 <= c <= 0xDFFF else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            table[m.start() : m.end()] = kind
    return table


class Encoder:
    """One vocabulary of ranks, from the lines of its file."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.classes = character_classes()
        self.inside = np.zeros(65536, bool)
        for token in self.ranks:
            for pair in zip(token, token[1:], strict=False):
                self.inside[pair[0] * 256 + pair[1]] = True
        self.known: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one fragment: the neighbours of lowest rank merge first, leftmost of equals."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 400:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for fragments of any length."""
        import heapq

        n = len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := self.ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := self.ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def lookup(self, piece: bytes) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            ids = self.known[piece] = self.merge(piece)
        return ids

    def starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte positions where a fragment starts; ``first`` are the starts of the non-empty texts."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at].astype(np.uint32)
        last = len(data) - 1
        b1, b2, b3 = (data[np.minimum(at + i, last)].astype(np.uint32) & 63 for i in (1, 2, 3))
        points = np.where(
            lead < 0x80,
            lead,
            np.where(
                lead < 0xE0,
                (lead & 31) << 6 | b1,
                np.where(lead < 0xF0, (lead & 15) << 12 | b1 << 6 | b2, (lead & 7) << 18 | b1 << 12 | b2 << 6 | b3),
            ),
        )
        del b1, b2, b3, lead
        m = len(at)
        kind = self.classes[points]
        text_start = np.zeros(m + 1, bool)
        text_start[np.searchsorted(at, first)] = True
        text_start[m] = True
        space = kind == SPACE
        prior = np.empty(m, np.uint8)
        prior[0], prior[1:] = 255, kind[:-1]
        prior[text_start[:m]] = 255
        plain = points == 0x20
        after_plain = np.zeros(m, bool)
        after_plain[1:] = plain[:-1]
        after_plain &= prior == SPACE
        ends = text_start[1:].copy()  # the next character is another text
        next_black = np.zeros(m, bool)
        next_black[:-1] = ~space[1:]
        next_black &= ~ends
        begin = np.where(space, (prior != SPACE) | next_black, (kind != prior) & ~after_plain)
        quotes = np.flatnonzero((points == 0x27) & begin)
        if len(quotes):
            wide = np.concatenate([points, np.zeros(3, points.dtype)])
            stop = np.concatenate([text_start, np.ones(3, bool)])
            for ending in ENDINGS:
                q, k = quotes, len(ending)
                fits = np.ones(len(q), bool)
                for i, ch in enumerate(ending, 1):
                    fits &= (wide[q + i] == ord(ch)) & ~stop[q + i]
                hit = q[fits]
                begin[hit + 1] = False
                after = hit + 1 + k
                begin[after[after < m]] = True
        mark = np.zeros(len(data), bool)
        mark[at[begin]] = True
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        mark[1:] |= ~self.inside[pairs]
        return np.flatnonzero(mark)

    def fragments(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Code of every fragment and the distinct fragments; exact, long ones are compared as bytes."""
        stop = np.append(start[1:], len(data))
        size = stop - start
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        key = size.astype(np.uint64)
        for i in range(7):
            byte = padded[start + i].astype(np.uint64)
            if i:
                byte[size <= i] = 0
            key |= byte << np.uint64(8 * (i + 1))
        long = np.flatnonzero(size > 7)
        if len(long):
            names: dict[bytes, int] = {}
            raw = data.tobytes()
            # a key whose lowest byte is 255 is no length of a short fragment
            key[long] = [names.setdefault(raw[a:b], len(names)) * 256 + 255 for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
        code, unique = pd.factorize(key)
        sample = np.empty(len(unique), np.int64)
        sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        return code, [data[start[i] : stop[i]].tobytes() for i in sample]

    def encode(self, data: np.ndarray, offsets: np.ndarray, only_count: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids per text and, unless only counted, all ids one after another."""
        lengths = np.diff(offsets)
        counts = np.zeros(len(lengths), np.int64)
        if len(data) == 0:
            return counts, np.zeros(0, np.int32)
        full = np.flatnonzero(lengths)
        start = self.starts(data, offsets[full])
        code, pieces = self.fragments(data, start)
        lists = [self.lookup(p) for p in pieces]
        n_of = np.fromiter(map(len, lists), np.int64, len(lists))
        n = n_of[code]
        running = np.concatenate([[0], np.cumsum(n)])
        where = np.searchsorted(start, offsets)
        counts = running[where[1:]] - running[where[:-1]]
        if only_count:
            return counts, None
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(n_of.sum()))
        begin = np.concatenate([[0], np.cumsum(n_of)])[code]
        return counts, flat[np.repeat(begin - running[:-1], n) + np.arange(running[-1])]


def _encoder(digest: str, ranks: Callable[[], bytes]) -> Encoder:
    found = _encoders.pop(digest, None)
    _encoders[digest] = found = found or Encoder(ranks())
    for old in list(_encoders)[:-ENCODERS]:
        del _encoders[old]
    return found


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of consecutive texts of about CHUNK bytes; null counts as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver; a vocabulary has a fixed size (here under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _run(df: DataFrame, keep: list[str], text_column: str, vocabulary: str, only_count: bool, name: str) -> DataFrame:
    ranks = read_vocabulary(vocabulary)
    digest, shared = hashlib.sha256(ranks).hexdigest(), df.sparkSession.sparkContext.broadcast(ranks)
    del ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(digest, lambda: shared.value)
        for batch in batches:
            texts, at = batch.column(len(keep)), 0
            for data, offsets in _chunks(texts):
                n = len(offsets) - 1
                counts, ids = encoder.encode(data, offsets, only_count)
                if only_count:
                    out = pa.array(counts, pa.int64())
                else:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                kept = [batch.column(i).slice(at, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, out], [*keep, name])
                at += n

    slim = df.select(*keep, F.col(text_column).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, `{name}` {'bigint' if only_count else 'array<int>'}")


def encode_corpus(df: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id_column``, ids): every row's text as ids, special tokens' strings being ordinary text.

    Null and empty texts give the empty list. Ids may be null or repeat, they are passed through. Text is
    encoded whole, whatever its length; further columns are ignored, so that only two are read.
    """
    return _run(df, [id_column], text_column, vocabulary, False, "ids")


def count_tokens(df: DataFrame, keep: list[str], text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``tokens``, the number of ids of the text; 0 for null and empty texts."""
    return _run(df, keep, text_column, vocabulary, True, "tokens")


def decode_corpus(encoded: DataFrame, id_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id_column``, text) from (``id_column``, ids): the way back, for checking; null ids give null."""
    ranks = read_vocabulary(vocabulary)
    digest, shared = hashlib.sha256(ranks).hexdigest(), encoded.sparkSession.sparkContext.broadcast(ranks)
    del ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in _encoder(digest, lambda: shared.value).ranks.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, text string")
