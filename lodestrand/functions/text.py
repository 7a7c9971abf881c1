"""Text analysis as Column expressions (A1 to A16) and its counterpart for single query strings.

Everything a table goes through stays in the JVM: NFKC is ICU's, called through ``java_method``, traditional
characters go through ``translate`` with ICU's table, the rest are built-in functions. Only query strings,
one at a time, are analysed in Python on the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the character ranges of the analyzer
CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
LATIN_RUN = "[A-Za-z0-9._]+"
BLANKS = "[\\s\\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
EMPTY = "array<string>"
# fixed values: signs that the JVM encodes in a component of an address and browsers do not
PLAIN_SIGNS = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}


def nfkc(c: Column) -> Column:
    """Unicode NFKC; null stays null."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.when(c.isNotNull(), composed)


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def compact_normalized(c: Column) -> Column:
    """Only ASCII letters and digits and CJK characters; accented letters are dropped."""
    return F.regexp_replace(c, f"[^0-9a-z{CJK}]", "")


def cjk_of(c: Column) -> Column:
    """Only the CJK characters."""
    return F.regexp_replace(c, f"[^{CJK}]", "")


def cjk_runs(c: Column) -> Column:
    """Maximal runs of CJK characters."""
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0))


def latin_runs(c: Column) -> Column:
    """Maximal runs of ASCII letters, digits, dots and underscores."""
    return F.regexp_extract_all(c, F.lit(LATIN_RUN), F.lit(0))


def grams(c: Column, n: int, least: int | None = None) -> Column:
    """All ``n``-character substrings, none for strings shorter than ``least`` (default n)."""
    return F.when(
        F.length(c) >= (least or n), F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    ).otherwise(F.array().cast(EMPTY))


def latin_parts(run: Column) -> Column:
    """Parts of one Latin run: itself, its pieces at dots and underscores and at changes of case, its 3-grams."""
    lower = F.lower(run)
    camel = F.regexp_replace(F.regexp_replace(run, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    bare = F.regexp_replace(lower, "[^a-z0-9]", "")
    threes = F.when(F.length(bare) >= 4, F.regexp_extract_all(bare, F.lit("(?=(...))"), F.lit(1))).otherwise(F.array().cast(EMPTY))
    whole = F.when(lower.rlike("[a-z0-9]"), F.array(lower)).otherwise(F.array().cast(EMPTY))
    pieces = F.concat(F.split(lower, "[._]+"), F.split(F.lower(camel), "[ ._]+"))
    return F.array_distinct(F.concat(whole, F.filter(pieces, lambda x: x != ""), threes))


def latin_tokens(*forms: Column) -> Column:
    """Parts of all Latin runs of the forms of a text, distinct; equal runs are cut once."""
    runs = F.array_distinct(F.concat(*[latin_runs(c) for c in forms]))
    return F.array_distinct(F.flatten(F.transform(runs, latin_parts)))


def cjk_tokens(c: Column) -> Column:
    """Single characters and pairs within each CJK run, distinct; pairs overlap, so they are found by looking ahead."""
    single = F.regexp_extract_all(c, F.lit(f"[{CJK}]"), F.lit(0))
    pairs = F.regexp_extract_all(c, F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))
    return F.array_distinct(F.concat(single, pairs))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_computed(c: Column, pattern: str, compute: Callable[[Column], Column]) -> Column:
    """``c`` with every match of ``pattern`` replaced by ``compute(match)``."""
    pieces = F.split(c, pattern, -1)
    found = F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), compute), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(c.rlike(pattern), joined).otherwise(c)


@dataclass
class Analyzer:
    """Options of the analysis.

    ``simplified`` maps traditional to simplified characters (see functions.charmaps), ``phrases`` whole phrases before that,
    the longest first. ``segmenter`` is "none", "whole" (the normalised text as one word, split again at blanks), "words" (runs
    of word characters) or a Python callable from text to words (see functions.segment), run on Arrow batches, which
    ``engine`` has to name, since indexes are kept by what made them.
    """

    compatibility: bool = True
    simplified: dict[int, str] = field(default_factory=dict)
    segmenter: str | Callable[[str], list[str]] = "none"
    engine: str = "builtin"
    phrases: dict[str, str] = field(default_factory=dict)

    def digest(self) -> str:
        """What tokens depend on, as a key: options, tables and the name of the segmenter."""
        if callable(self.segmenter) and self.engine == "builtin":
            raise ValueError("name your segmenter (engine)")
        segmenter = "own" if callable(self.segmenter) else self.segmenter
        parts = [self.compatibility, segmenter, self.engine, sorted(self.simplified.items()), sorted(self.phrases.items())]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]

    def _phrase_pattern(self) -> str:
        return "|".join(re.escape(p) for p in sorted(self.phrases, key=lambda p: (-len(p), p)))

    def fold(self, c: Column) -> Column:
        return nfkc(c) if self.compatibility else c

    def normalize(self, c: Column) -> Column:
        """A1: NFKC, simplified characters, lower case, single blanks."""
        return self.normalize_folded(self.fold(c))

    def normalize_folded(self, folded: Column) -> Column:
        """``normalize`` of what ``fold`` gave."""
        if self.phrases:
            table = F.create_map(*[F.lit(x) for pair in sorted(self.phrases.items()) for x in pair])
            folded = replace_computed(folded, self._phrase_pattern(), lambda m: table[m])
        if self.simplified:
            pairs = sorted(self.simplified.items())
            folded = F.translate(folded, "".join(chr(a) for a, _ in pairs), "".join(b for _, b in pairs))
        return squeeze(F.lower(folded))

    def compact(self, c: Column) -> Column:
        """A2."""
        return compact_normalized(self.normalize(c))

    def words(self, normalized: Column) -> Column:
        """Words of the segmenter."""
        if callable(self.segmenter):
            cut = self.segmenter

            @F.pandas_udf(EMPTY)
            def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for texts in batches:
                    yield texts.map(lambda t: [w for x in cut(t) for w in x.split()] if t else [])

            return segment(normalized)
        if self.segmenter == "whole":
            return F.filter(F.split(normalized, " "), lambda x: x != "")
        if self.segmenter == "words":
            return F.regexp_extract_all(normalized, F.lit(r"(?U)\w+"), F.lit(0))
        return F.array().cast(EMPTY)

    def document_tokens(self, c: Column) -> Column:
        """A5: distinct tokens of a document; null gives none."""
        own = self.words(self.normalize(c)) if callable(self.segmenter) else None  # Python runs outside of ``let``

        def tokens(folded: Column) -> Column:
            def of(normalized: Column) -> Column:
                words = F.array().cast(EMPTY) if own is not None else self.words(normalized)
                return F.concat(words, cjk_tokens(normalized), latin_tokens(normalized, folded))

            return let(self.normalize_folded(folded), of)

        found = let(self.fold(c), tokens)
        found = found if own is None else F.concat(own, found)
        return F.coalesce(F.array_distinct(found), F.array().cast(EMPTY))

    # single strings, on the driver

    def fold_text(self, text: str) -> str:
        return unicodedata.normalize("NFKC", text) if self.compatibility else text

    def normalize_text(self, text: str) -> str:
        text = self.fold_text(text)
        if self.phrases:
            text = re.sub(self._phrase_pattern(), lambda m: self.phrases[m[0]], text)
        return re.sub(BLANKS, " ", text.translate(self.simplified).lower()).strip()

    def compact_text(self, text: str) -> str:
        return re.sub(f"[^0-9a-z{CJK}]", "", self.normalize_text(text))

    def word_list(self, normalized: str) -> list[str]:
        if callable(self.segmenter):
            return [w for w in self.segmenter(normalized) if w.strip()]
        if self.segmenter == "whole":
            return [normalized] if normalized else []
        return re.findall(r"\w+", normalized) if self.segmenter == "words" else []

    def query_tokens(self, text: str) -> list[str]:
        """A lone CJK character is its own token; single-character words are left out otherwise."""
        normalized = self.normalize_text(text)
        if re.fullmatch(f"[{CJK}]", normalized):
            return [normalized]
        tokens: dict[str, None] = {}
        for run in re.findall(f"[{CJK}]+", normalized):
            tokens.update(dict.fromkeys(run))
            tokens.update(dict.fromkeys(run[i : i + 2] for i in range(len(run) - 1)))
        for source in (normalized, self.fold_text(text)):
            for run in re.findall(LATIN_RUN, source):
                tokens.update(dict.fromkeys(latin_parts_text(run)))
        tokens.update(dict.fromkeys(w for w in self.word_list(normalized) if len(w.strip()) >= 2))
        return [part for t in tokens for part in t.split()]


def latin_parts_text(run: str) -> list[str]:
    """``latin_parts`` of one string."""
    lower = run.lower()
    spaced = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", run)).lower()
    bare = re.sub("[^a-z0-9]", "", lower)
    found = [lower] if bare else []
    found += [p for p in re.split("[._]+", lower) + re.split("[ ._]+", spaced) if p]
    if len(bare) >= 4:
        found += [bare[i : i + 3] for i in range(len(bare) - 2)]
    return list(dict.fromkeys(found))


def fuzzy_budget(term: str) -> int:
    """M7: edits allowed when a query term is looked up."""
    cjk = re.sub(f"[^{CJK}]", "", term)
    return int(len(cjk) >= 3) if cjk else int(len(term) >= 4)


def snippet(text: Column, query: str, analyzer: Analyzer, before: int = 36, after: int = 64) -> Column:
    """M8: the surroundings of the first hit: as written, ignoring case, else in the normalised text from its start."""
    flat = squeeze(text)
    lowered = F.lower(flat)
    direct, loose = F.instr(flat, query), F.instr(lowered, query.lower())
    normal = analyzer.normalize(flat)
    shown = F.when((direct > 0) | (loose > 0) | (normal == ""), flat).otherwise(normal)
    found = F.when(direct > 0, direct).when(loose > 0, loose).otherwise(F.instr(normal, query))
    at = F.greatest(found - 1, F.lit(0))
    width = F.when(found > 0, F.lit(len(query))).otherwise(F.lit(0))
    start = F.greatest(at - before, F.lit(0))
    end = F.least(F.length(shown), at + width + after)
    marked = F.concat(
        F.when(start > 0, "…").otherwise(""), F.substring(shown, start + 1, end - start), F.when(end < F.length(shown), "…").otherwise("")
    )
    return F.when(F.coalesce(F.length(flat), F.lit(0)) == 0, "").otherwise(marked)


def wiki_link(title: Column, query: str, namespace: Column) -> Column:
    """Wiki link with the query as label unless it equals the title but for case; files and categories get a colon."""
    colon = F.when(namespace.isin(6, 14), ":").otherwise("")
    label = F.when(F.lower(title) == query.lower(), "").otherwise(F.lit("|" + query))
    return F.concat(F.lit("[["), colon, title, label, F.lit("]]"))


def page_path(title: Column) -> Column:
    """Page name with underscores, percent-encoded as a component of an address."""
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, sign in PLAIN_SIGNS.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return encoded


def byte_size(n: Column) -> Column:
    """B, KiB or MiB."""
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KiB", n / 1024))
        .otherwise(F.format_string("%.1f MiB", n / (1024 * 1024)))
    )
