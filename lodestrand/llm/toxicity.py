"""Abusive, hateful or sexual content (problem 9).

Method: classifier chains. A linear model predicts the first category, the next model gets its probability as a
further input, and so on; in training these inputs are out-of-fold predictions, so that later models see them as
they will be on unseen text. The models score passages (sentences), a document is its worst passage.

Only documents carry labels, not passages. A passage of a rejected document counts as the offence if the
current model finds it the most likely one, which is repeated a few times; passages that the models firmly
contradict are taken for a rater's error and left out.

Features are character n-grams of a form in which disguises vanish: width, look-alikes, accents, traditional
characters, invisible characters, letters apart or repeated, digits in place of letters. All of it is array
work on Arrow buffers. The model is a few thousand n-grams with weights, fitted on the driver from at most
``limit`` labelled documents (the documented bound). An n-gram can only call for scoring a passage if rejected
documents hold it far more often than the whole corpus does: the first pass over every document counts that, and
keeps the passages that may matter, whole, for the second, which scores them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.charmaps import simplified_table
from lodestrand.llm.confusables import look_alike_table
from lodestrand.llm.tokenize import _chunks
from lodestrand.sources.work import materialize

CATEGORIES = ("abusive", "hateful", "sexual")
ORDERS = (2, 3, 4, 6)
LIMIT = 6_000  # labelled documents used for fitting
SAMPLE_BYTES = 64 << 20  # of their texts
ORDINARY = 4_000  # passages of accepted documents without a telling n-gram used for fitting
SUPPORT = 2  # rejected documents that must hold an n-gram, the same for a sample of any size
BITS = 22  # size of the filter in front of the feature list
DROP, BREAK, BLANK = 0, 1, 32
# fixed values: digits and signs that stand for letters inside a word
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def character_table(spark: SparkSession) -> np.ndarray:
    """Plain form of every code point: DROP for invisible ones and accents, BREAK ends a passage, BLANK separates."""
    alike, simple = look_alike_table(spark), simplified_table(spark)
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Mn", "Me", "Cn", "Co"):
            continue
        if ch in "\n。！？!?；;  ":
            table[cp] = BREAK
            continue
        if cp > 127:
            plain = [c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c)[0] != "M"]
            ch = plain[0] if plain else ch
            looks = alike.get(ord(ch), ch)
            if ord(ch) > 127 and looks[:1].isascii() and looks[:1].isalpha():
                ch = looks[0]
            ch = simple.get(ord(ch), ch)
        ch = ch.lower()[0]
        table[cp] = ord(ch) if ch.isalnum() or ch in "@$*" else (ord(".") if ch == "." else BLANK)
    return table


def decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where they start."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead, last = data[at].astype(np.uint32), len(data) - 1
    b1, b2, b3 = (data[np.minimum(at + i, last)].astype(np.uint32) & 63 for i in (1, 2, 3))
    three = np.where(lead < 0xF0, (lead & 15) << 12 | b1 << 6 | b2, (lead & 7) << 18 | b1 << 12 | b2 << 6 | b3)
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | b1, three)), at


def plain_text(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, text number) of all texts in plain form; BREAK stands between passages and texts."""
    if len(data) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    points, at = decode(data)
    text = np.searchsorted(offsets, at, "right") - 1
    form = table[points]
    # a full stop ends a passage before a blank, joins otherwise
    nxt = np.append(form[1:], BREAK)
    form = np.where(form == ord("."), np.where((nxt == BLANK) | (nxt == BREAK), BREAK, DROP), form)
    first = np.append(True, text[1:] != text[:-1])
    keep = (form != DROP) | first
    form, text, first = form[keep], text[keep], first[keep]
    # texts are kept apart by a break in front of each
    where = np.flatnonzero(first)
    form, text = np.insert(form, where, BREAK), np.insert(text, where, text[where])
    form = np.where(form == DROP, BREAK, form)
    han = (form >= 0x3040) & (form < 0xAC00)
    latin = (form >= 97) & (form <= 122)
    left, right = np.append(BREAK, form[:-1]), np.append(form[1:], BREAK)
    l_han, r_han = np.append(False, han[:-1]), np.append(han[1:], False)
    l_lat, r_lat = np.append(False, latin[:-1]), np.append(latin[1:], False)
    for sign, letter in LEET.items():
        form = np.where((form == ord(sign)) & (l_lat | r_lat), ord(letter), form)
    digit = (form >= 48) & (form <= 57)
    form = np.where(digit, 48, form)
    form = np.where((form == ord("@")) | (form == ord("$")), BLANK, form)
    # blanks between Chinese characters and between single letters are disguise; runs of one character are one, but
    # numbers, whose digits all become 0, keep their length (runs are those of the text as written)
    two_left, two_right = np.append([BREAK, BREAK], form[:-2]), np.append(form[2:], [BREAK, BREAK])
    edge = lambda x: (x == BLANK) | (x == BREAK)
    apart = (form == BLANK) & l_lat & r_lat & edge(two_left) & edge(two_right)
    inner = ((form == BLANK) | (form == ord("*"))) & ((l_han & r_han) | ((form == ord("*")) & (l_lat | r_lat)))
    same = (form == left) & (form != BREAK)
    bare = (form == BLANK) & ((left == BREAK) | (right == BREAK))
    keep = ~(apart | inner | same | bare)
    form, text = form[keep], text[keep]
    return np.where(form == ord("*"), BLANK, form), text


def grams(form: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, whether it lies within one passage) of the n-gram at every place, order by order.

    The breaks before and after a passage count as its first and last character.
    """
    form = np.append(form, np.uint32(BREAK))
    breaks = np.cumsum(form == BREAK, dtype=np.int32)
    odd = np.uint64(0x9E3779B97F4A7C15)
    points = form.astype(np.uint64)
    rolled, span = points, 1
    for order in ORDERS:
        n = len(form) - order + 1
        if n <= 0:
            return
        while span < order:
            rolled = rolled[: len(points) - span] * odd + points[span:]
            span += 1
        inner = breaks[order - 2 : order - 2 + n] == breaks[:n]
        yield (rolled + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93), inner


@dataclass
class ChainModel:
    """Sorted n-gram hashes, their weights per category, biases, chain weights and threshold."""

    features: np.ndarray
    telling: np.ndarray  # whether the n-gram by itself makes a passage worth scoring
    weights: np.ndarray  # features x categories
    bias: np.ndarray
    chain: np.ndarray  # categories x categories, lower triangle
    threshold: float

    def passages(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n x categories) of passages given as feature hits."""
        out = np.zeros((n, len(self.bias)))
        for c in range(len(self.bias)):
            z = self.bias[c] + np.bincount(rows, self.weights[cols, c], n)
            for e in range(c):
                z += self.chain[c, e] * out[:, e]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _hits(form: np.ndarray, features: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, feature number) of every n-gram that is a feature."""
    places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shift = np.uint64(64 - BITS)
    for hashed, whole in grams(form):
        may = np.flatnonzero(seen[(hashed >> shift).astype(np.int32)] & whole)
        if len(features):
            at = np.searchsorted(features, hashed[may])
            at[at == len(features)] = 0
            good = features[at] == hashed[may]
            places.append(may[good])
            numbers.append(at[good])
    return np.concatenate(places), np.concatenate(numbers)


def _filter(features: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << BITS, bool)
    seen[features >> np.uint64(64 - BITS)] = True
    return seen


def _fit_linear(rows, cols, n, width, extra, y, weight, rounds=50, l2=2e-3, rate=0.6):
    """Logistic regression by full-batch Adagrad; inputs as (row, column) hits and dense ``extra`` columns."""
    w, b, e = np.zeros(width), 0.0, np.zeros(extra.shape[1])
    gw, gb, ge = np.full(width, 1e-6), 1e-6, np.full(extra.shape[1], 1e-6)
    total = weight.sum()
    share = (weight * y).sum() / max(total, 1e-9)
    b = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    for _ in range(rounds):
        z = b + np.bincount(rows, w[cols], n) + extra @ e
        d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        dw = np.bincount(cols, d[rows], width) + l2 * w / total
        db, de = d.sum(), extra.T @ d + l2 * e / total
        gw += dw * dw
        gb += db * db
        ge += de * de
        w -= rate * dw / np.sqrt(gw)
        b -= rate * db / np.sqrt(gb)
        e -= rate * de / np.sqrt(ge)
    return w, b, e


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labelled:
    """Labelled documents in plain form, with the n-grams of every passage and where raters rejected them."""

    def __init__(self, texts: list[str], labels: list[set[str]], table: np.ndarray):
        self.size = len(texts)
        self.wanted = np.array([[c in s for c in CATEGORIES] for s in labels], bool).reshape(len(labels), len(CATEGORIES))
        self.bad = self.wanted.any(1)
        self.agreed = np.array(["ok" not in s for s in labels], bool)
        forms, docs, base = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        for data, offsets in _chunks(pa.array([t or "" for t in texts], pa.string())):
            f, t = plain_text(data, offsets, table)
            forms.append(f)
            docs.append(t + base)
            base += len(offsets) - 1
        form, doc = np.concatenate(forms), np.concatenate(docs)
        passage = np.cumsum(form == BREAK)
        self.doc_of = np.zeros(int(passage[-1]) + 1 if len(form) else 0, np.int64)
        self.doc_of[passage] = doc
        # one order at a time, n-grams of a single document left out: this bounds the driver's memory
        names, numbers, rows, in_bad, in_ok = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [], []
        passage, doc, base = passage.astype(np.int32), doc.astype(np.int32), 0
        for hashed, whole in grams(form):
            place = np.flatnonzero(whole).astype(np.int32)
            own, number = np.unique(hashed[whole], return_inverse=True)
            del hashed, whole
            once = np.unique(number * np.int64(self.size) + doc[place])
            of, in_doc = once // self.size, once % self.size
            counts = np.bincount(of, self.bad[in_doc], len(own)), np.bincount(of, ~self.bad[in_doc], len(own))
            del once, of, in_doc
            shared = counts[0] + counts[1] >= 2
            renumber = np.where(shared, np.cumsum(shared) - 1 + base, -1).astype(np.int32)
            number = renumber[number]
            used = number >= 0
            names.append(own[shared])
            numbers.append(number[used])
            rows.append(passage[place[used]])
            in_bad.append(counts[0][shared])
            in_ok.append(counts[1][shared])
            base += int(shared.sum())
        order = np.argsort(np.concatenate(names))
        back = np.empty(base, np.int32)
        back[order] = np.arange(base, dtype=np.int32)
        self.names = np.concatenate(names)[order]
        self.number, self.row = back[np.concatenate(numbers)] if base else numbers[0], np.concatenate(rows)
        self.in_bad, self.in_ok = (np.concatenate([np.zeros(0), *x])[order] for x in (in_bad, in_ok))
        self.rate = np.log((self.in_bad + 0.5) / (self.bad.sum() + 1))
        self.lift = self.rate - np.log((self.in_ok + 0.5) / ((~self.bad).sum() + 1))

    def candidates(self) -> np.ndarray:
        """Numbers of the n-grams that at least SUPPORT rejected documents hold, far more often than accepted ones do."""
        return np.flatnonzero((self.in_bad >= SUPPORT) & (self.lift > 2.0))

    def telling(self, counts: np.ndarray | None = None, total: int = 0) -> np.ndarray:
        """Mask of the telling n-grams; ``counts`` are the candidates' document frequencies in ``total`` documents."""
        mask, chosen = np.zeros(len(self.names), bool), self.candidates()
        if counts is not None and len(chosen):
            lift = self.rate[chosen] - np.log((counts + 0.5) / (total + 1))
            # rejected documents hold a telling n-gram up to 1 / (their share of the corpus) times as often
            chosen = chosen[lift > min(np.log(9), 0.75 * np.quantile(lift, 0.95))]
        mask[chosen] = True
        return mask


def fit_chain(labelled: Labelled, telling: np.ndarray, folds: int = 3, rounds: int = 2, seed: int = 5) -> ChainModel:
    """Fit the chain. Without a single rejected document or telling n-gram the model finds nothing."""
    k = len(CATEGORIES)
    bad, doc_of = labelled.bad, labelled.doc_of
    if not telling.any():
        return ChainModel(np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros((0, k)), np.full(k, -6.0), np.zeros((k, k)), 0.5)
    # passages without any telling n-gram cannot be found; of the others all repeated n-grams may weigh. Ordinary
    # passages of accepted documents are added, so that what is common in them speaks against an offence
    row, number = labelled.row, labelled.number
    near = np.zeros(len(doc_of), bool)
    near[row[telling[number]]] = True
    plain = np.flatnonzero(~near & ~bad[doc_of])
    near[np.random.default_rng(seed).permutation(plain)[:ORDINARY]] = True
    used = near[row]
    row, number = row[used], number[used]
    used = np.bincount(number, minlength=len(telling))[number] >= 2
    row, number = row[used], number[used]
    chosen = np.unique(number)
    cols = np.searchsorted(chosen, number)
    kept = np.flatnonzero(near)
    rows = np.searchsorted(kept, row)
    doc_of = doc_of[kept]
    m, width = len(kept), len(chosen)
    fold = np.random.default_rng(seed).integers(0, folds, labelled.size)[doc_of]
    rejected, wanted, halved = bad[doc_of], labelled.wanted[doc_of], ~labelled.agreed[doc_of]
    # first guess: summed lift of the telling n-grams, most telling passage of each rejected document
    score = np.bincount(rows, (np.clip(labelled.lift, 0, 3) * telling)[chosen][cols], m)
    score /= score.max() + 1e-9
    y, weight, probability = np.zeros((m, k)), np.ones(m), np.zeros((m, k))
    for step in range(rounds):
        order = np.lexsort((-score, doc_of))
        top = np.zeros(m, bool)
        top[order[np.append(True, doc_of[order][1:] != doc_of[order][:-1])]] = True
        if step == 0:
            offence, weight = rejected & top, np.where(rejected & ~top, 0.0, 1.0)
        else:
            offence = rejected & ((score > 0.5) | (top & (score > 0.15)))
            weight = np.where(rejected & ~offence & (score > 0.15), 0.0, 1.0)
            weight[~rejected & (score > 0.8)] = 0.0  # a rater's error
        weight = weight * np.where(offence & halved, 0.5, 1.0)
        y = wanted & offence[:, None]
        probability = np.zeros((m, k))
        for c in range(k):  # out-of-fold probabilities, link by link
            for f in range(folds):
                train = fold != f
                sel = train[rows]
                w, b, e = _fit_linear(rows[sel], cols[sel], m, width, probability[:, :c], y[:, c], np.where(train, weight, 0.0))
                z = b + np.bincount(rows, w[cols], m) + probability[:, :c] @ e
                probability[~train, c] = _sigmoid(z[~train])
        score = 1 - np.prod(1 - probability, axis=1)
    weights, bias, chain = np.zeros((width, k)), np.zeros(k), np.zeros((k, k))
    for c in range(k):  # final links: trained on all rows with the out-of-fold inputs
        weights[:, c], bias[c], chain[c, :c] = _fit_linear(rows, cols, m, width, probability[:, :c], y[:, c], weight)
    tells = telling[chosen]
    heavy = tells | (np.abs(weights).max(1) > 1e-3)
    return ChainModel(labelled.names[chosen][heavy], tells[heavy], weights[heavy], bias, chain, 0.5)


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int = LIMIT, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[set[str]]]:
    """At most ``limit`` labelled documents (lowest hashes of doc_id) with the set of labels their raters gave, whole, of
    ``most_bytes`` together: in that order, those that would exceed it are left out."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rated = (
        labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.collect_set("label").alias("labels"))
        .orderBy(*order)
        .limit(limit)
    )
    texts = (
        documents.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(rated), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.first("labels").alias("labels"))
    )
    before = F.sum(F.octet_length("text")).over(Window.orderBy(*order))  # over at most ``limit`` rows
    rows = texts.withColumn("upto", before).where(F.col("upto") <= most_bytes).drop("upto").orderBy("doc_id").toArrow()
    return rows.column("text").to_pylist(), [set(x) for x in rows.column("labels").to_pylist()]


def held_out(texts: list[str], labels: list[set[str]], table: np.ndarray, folds: int = 3, seed: int = 11) -> dict[str, int]:
    """Figures against the raters, who err, of documents that took no part in anything: for every fold n-grams are chosen,
    counted and weighed without it. Without a corpus the sample's own document frequencies decide which n-grams tell."""
    fold = np.random.default_rng(seed).integers(0, folds, len(texts))
    found = np.zeros(len(texts), bool)
    for f in range(folds):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        own = Labelled([texts[i] for i in train], [labels[i] for i in train], table)
        chosen = own.candidates()
        model = fit_chain(own, own.telling((own.in_bad + own.in_ok)[chosen], own.size))
        found[test] = score_texts([texts[i] for i in test], model, table)[:, -1] >= model.threshold
    bad = np.array([bool(s & set(CATEGORIES)) for s in labels], bool)
    return {"documents": len(texts), "rejected": int(bad.sum()), "found": int(found.sum()), "agreeing": int((found & bad).sum())}


def _kept_passages(documents: DataFrame, keep: list[str], candidates: np.ndarray, table: np.ndarray) -> DataFrame:
    """Per document: ``keep``, the numbers of its distinct candidates, and the plain passages that hold any."""
    shared = documents.sparkSession.sparkContext.broadcast((candidates, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, table = shared.value
        seen = _filter(candidates)
        for batch in batches:
            at = 0
            for data, offsets in _chunks(batch.column(len(keep))):
                n = len(offsets) - 1
                form, text = plain_text(data, offsets, table)
                place, number = _hits(form, candidates, seen)
                ends, forms, form_ends = np.zeros(n + 1, np.int32), b"", np.zeros(n + 1, np.int64)
                once = np.zeros(0, np.int64)
                if len(place):
                    once = np.unique(text[place] * len(candidates) + number)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(once // len(candidates), minlength=n))]).astype(np.int32)
                    passage = np.cumsum(form == BREAK)
                    worth = np.zeros(int(passage[-1]) + 1, bool)
                    worth[passage[place]] = True
                    used = worth[passage]
                    forms = form[used].astype("<u4").tobytes()
                    form_ends = np.concatenate([[0], np.cumsum(np.bincount(text[used], minlength=n))]) * 4
                hits = pa.ListArray.from_arrays(pa.array(ends), pa.array((once % max(len(candidates), 1)).astype(np.int32)))
                plain = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(form_ends.astype(np.int32)), pa.py_buffer(forms)])
                kept = [batch.column(i).slice(at, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, hits, plain], names=[*keep, "hits", "plain"])
                at += n

    slim = documents.select(*keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, hits array<int>, plain binary")


def score_forms(form: np.ndarray, text: np.ndarray, n: int, model: ChainModel, seen: np.ndarray) -> np.ndarray:
    """Highest probability per category and overall (texts x (categories + 1)) over the passages of each text."""
    k = len(CATEGORIES)
    out = np.zeros((n, k + 1))
    place, number = _hits(form, model.features, seen)
    if len(place) == 0:
        return out
    passage = np.cumsum(form == BREAK)
    worth = np.zeros(int(passage[-1]) + 1, bool)  # as in fitting, others score 0
    worth[passage[place[model.telling[number]]]] = True
    used = worth[passage[place]]
    place, number = place[used], number[used]
    ids, row = np.unique(passage[place], return_inverse=True)
    p = model.passages(row, number, len(ids))
    owner = np.zeros(len(ids), np.int64)
    owner[row] = text[place]
    for c in range(k):
        np.maximum.at(out[:, c], owner, p[:, c])
    np.maximum.at(out[:, k], owner, 1 - np.prod(1 - p, axis=1))
    return out


def score_texts(texts: list[str | None], model: ChainModel, table: np.ndarray) -> np.ndarray:
    """Scores of a few texts outside Spark."""
    seen, parts = _filter(model.features), [np.zeros((0, len(CATEGORIES) + 1))]
    for data, offsets in _chunks(pa.array(texts, pa.string())):
        parts.append(score_forms(*plain_text(data, offsets, table), len(offsets) - 1, model, seen))
    return np.concatenate(parts)


def _score_kept(kept: DataFrame, keep: list[str], model: ChainModel) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast(model)
    names = [*keep, *CATEGORIES, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = _filter(model.features)
        for batch in batches:
            plain = batch.column(len(keep)).cast(pa.large_binary())
            offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] // 4
            form = np.frombuffer(plain.buffers()[2] or b"", "<u4")[offsets[0] : offsets[-1]]
            text = np.repeat(np.arange(len(plain)), np.diff(offsets))
            p = score_forms(form, text, len(plain), model, seen)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(p[:, c]) for c in range(p.shape[1])]], names=names)

    slim = kept.select(*keep, "plain")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in names[len(keep) :]))


def harm_scores(documents: DataFrame, labels: DataFrame, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id", "source")) -> tuple[DataFrame, ChainModel]:
    """(``keep``, abusive, hateful, sexual, score) of every document, and the model fitted for it.

    Null and empty texts score 0. Without labels, or without a rejected document, everything scores 0. Labels
    of documents that are missing are ignored, several labels of one document are taken together; a repeated
    doc_id is scored row by row. Further columns are ignored.
    """
    table = character_table(documents.sparkSession)
    labelled = Labelled(*labelled_sample(documents, labels, limit), table)
    chosen = labelled.candidates()
    kept = materialize(_kept_passages(documents, list(keep), labelled.names[chosen], table), "passages")
    # as many rows as there are candidates, which the bounded sample bounds
    counted = kept.select(F.explode("hits").alias("n")).groupBy("n").agg(F.count("*").alias("docs")).toArrow()
    counts = np.zeros(len(chosen))
    counts[counted.column("n").to_numpy()] = counted.column("docs").to_numpy()
    model = fit_chain(labelled, labelled.telling(counts, kept.count()))
    return _score_kept(kept, list(keep), model), model


def harmful_documents(documents: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id of the documents with a passage at or above the model's threshold."""
    scores, model = harm_scores(documents, labels, limit)
    return scores.where(F.col("score") >= model.threshold).select("doc_id")


def harmful_rates(documents: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per source (null is a source of its own): documents, those found and the rate, mean score."""
    scores, model = harm_scores(documents, labels, limit)
    return (
        scores.groupBy("source")
        .agg(F.count("*").alias("docs"), F.count_if(F.col("score") >= model.threshold).alias("found"), F.round(F.avg("score"), 6).alias("mean_score"))
        .withColumn("rate", F.round(F.col("found") / F.col("docs"), 6))
    )
