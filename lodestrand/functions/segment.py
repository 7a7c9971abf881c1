"""Word segmentation by a dictionary (A6, A14): the most probable way to cut a text into dictionary words.

The dictionary is a file of lines ``word count [tag]``, given by its path; none is kept here. A text is cut so that the
product of its words' shares is largest, found from the end in one pass; what is in no word stands alone, but runs of letters
and digits stay whole. For searching, the words within a long word are given as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

_RUN = re.compile(r"[^\W_]", re.U)
_PLAIN = re.compile(r"[0-9A-Za-z]+")


class DictionarySegmenter:
    """A callable from text to words, for ``Analyzer(segmenter=, engine=)``; ``share`` sends its words to the executors once."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(sum(counts.values()), 1))
        words = {w: math.log(max(n, 1)) - total for w, n in counts.items() if w}
        self._table = words, max(map(len, words), default=1), -total
        self._shared = None

    @classmethod
    def read(cls, lines: Iterable[str]) -> DictionarySegmenter:
        """From the lines of a dictionary; a line without a count counts once, one that is empty not at all."""
        counts: dict[str, int] = {}
        for line in lines:
            parts = line.split()
            if parts:
                counts[parts[0]] = counts.get(parts[0], 0) + (int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else 1)
        return cls(counts)

    @classmethod
    def load(cls, path: str) -> DictionarySegmenter:
        """From a file on the driver; a dictionary has a fixed size (a few MB)."""
        with open(path, encoding="utf-8") as f:
            return cls.read(f)

    def share(self, spark: SparkSession) -> DictionarySegmenter:
        """The same with its words in one broadcast variable, so that no task carries them."""
        other = DictionarySegmenter({})
        other._table, other._shared = self._table, spark.sparkContext.broadcast(self._table)
        return other

    def __getstate__(self) -> dict:
        return {"_shared": self._shared, "_table": None if self._shared is not None else self._table}

    @property
    def table(self) -> tuple[dict[str, float], int, float]:
        """(share of every word, longest word, share of an unknown character), as logarithms."""
        if self._table is None:
            self._table = self._shared.value
        return self._table

    def cut(self, text: str) -> list[str]:
        """The most probable words of a text, in order."""
        words, longest, unknown = self.table
        n = len(text)
        best, stop = [0.0] * (n + 1), list(range(1, n + 2))
        for i in range(n - 1, -1, -1):
            best[i] = unknown + best[i + 1]
            for j in range(i + 1, min(i + longest, n) + 1):
                share = words.get(text[i:j])
                if share is not None and (share + best[j] > best[i] or j == i + 1):
                    best[i], stop[i] = share + best[j], j
        out, i = [], 0
        while i < n:
            j = stop[i]
            if j == i + 1 and (run := _PLAIN.match(text, i)):  # letters and digits in no word stay together
                j = run.end()
                while j > i + 1 and any(stop[k] > k + 1 for k in range(i + 1, j)):
                    j -= 1
            out.append(text[i:j])
            i = j
        return out

    def __call__(self, text: str) -> list[str]:
        """Words of a text for searching: every cut word that has a letter or digit, before it the words of two and three characters within it."""
        words, _, _ = self.table
        out = []
        for word in self.cut(text):
            if not _RUN.search(word):
                continue
            for size in (2, 3):
                if len(word) > size:
                    out += [p for i in range(len(word) - size + 1) if (p := word[i : i + size]) in words]
            out.append(word)
        return out
