"""Records that share most of their content (problem 4).

Method: parity-sketch join. The 5-character substrings of a body are its tokens. XOR-hashing the tokens
into a sketch makes tokens common to two bodies cancel, so the Hamming distance of two sketches never
exceeds the symmetric difference d of their token sets. For a similarity of at least t, d is at most
D = (1 - t) / (1 + t) * (|A| + |B|): a bound that depends on the size sum alone, hence size bands.

Candidates come from the pigeonhole side. Within a band the tokens are spread over P parts and every part is
XORed to one value; two bodies agree in every part that none of their d differences hits. With ``miss`` 0 there are
more filled parts than differences, so one is certain to agree; but parts then hold two or three tokens and unrelated
bodies meet as well (15 % of pairs of similar size on the test pages). By default P is D / load, several independent
partitions are used, and a pair has to agree in AGREE parts: related bodies agree in some ten of them, unrelated
ones rarely in more than one. The number of values is set so that a pair exactly at the threshold is missed with
probability at most ``miss``; above the threshold that falls fast. Pairs that meet are tested with a 1024-bit sketch,
and what remains is verified exactly on the token sets.

``load`` grows with the logarithm of the number of bodies, at the rate that keeps the number of unrelated bodies a body
meets the same; the values of a body then grow with a power of that number, (1 - t) / (1 + t), which is 0.18 for 0.7.

Exact copies are collapsed to one representative before all this and expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.sources.work import materialize

WORDS = 16  # 64-bit words of the sketch
LOAD, BODIES = 2.0, 40_000  # differences per part at the threshold, for that many bodies
AGREE = 2  # parts in which a pair has to agree
MISS = 1e-4
VALUE_BITS = 48  # of a part's value; an accidental collision costs a test, never a wrong pair
TOKEN_BITS = 55  # of a token's hash; the bits above number the bodies that are worked on together
TOGETHER, CHARACTERS = 1 << (64 - TOKEN_BITS), 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


def compact_body(text: str) -> str:
    """Lower case, without any white space."""
    return "".join(text.lower().split())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(bodies: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, number of their body): the distinct ``width``-character substrings of at most TOGETHER bodies,
    in order of body and hash; a shorter body is one token."""
    bodies = [b if len(b) >= width else b.ljust(width, "\0") for b in bodies]
    points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(bodies), dtype=np.uint64), [len(b) for b in bodies])
    n = max(len(points) - width + 1, 0)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _SEED) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += points[i : n + i] * factors[i]
    inside = owner[:n] == owner[width - 1 : n + width - 1]
    keyed = np.sort((owner[:n] << np.uint64(TOKEN_BITS) | mix(total) >> np.uint64(64 - TOKEN_BITS))[inside])
    keyed = keyed[np.append(True, keyed[1:] != keyed[:-1])[: len(keyed)]]
    return keyed & np.uint64((1 << TOKEN_BITS) - 1), (keyed >> np.uint64(TOKEN_BITS)).astype(np.int64)


def together(bodies: list[str]) -> Iterator[slice]:
    """Runs of bodies to be worked on at once, a long one alone."""
    start = size = 0
    for i, body in enumerate(bodies):
        if i > start and (i - start == TOGETHER or size + len(body) > CHARACTERS):
            yield slice(start, i)
            start, size = i, 0
        size += len(body)
    if start < len(bodies):
        yield slice(start, len(bodies))


def sketches(tokens: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Parity of each body's tokens that fall on each of WORDS * 64 bits, as WORDS integers a body."""
    bits = (mix(tokens) % np.uint64(WORDS * 64)).astype(np.int64)
    parity = np.bincount(owner * (WORDS * 64) + bits, minlength=count * WORDS * 64) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(count, WORDS)


@dataclass(frozen=True)
class Plan:
    """How bodies are cut into parts: similarity, tolerated miss and differences per part."""

    threshold: float
    miss: float = MISS
    load: float = LOAD

    @staticmethod
    def of(threshold: float, miss: float, bodies: int) -> Plan:
        if not 0 < threshold <= 1 or not 0 <= miss < 1 or (miss == 0 and threshold <= 0.5):
            raise ValueError("the threshold is above 0 (above 0.5 if miss is 0) and at most 1, miss is 0 or more")
        return Plan(threshold, miss, max(1.0, LOAD + (1 - threshold) / (1 + threshold) * math.log(max(bodies, 1) / BODIES)))

    @property
    def agree(self) -> int:
        return AGREE if self.miss else 1

    @property
    def ratio(self) -> float:
        """Of the size sums within a band: the size sums of a body's partners then lie in two bands."""
        return min(2.0, max(1.05, 1 / self.threshold))

    def bands(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band that the size sums of a body with its partners fall into."""
        sums = sizes * (1 + self.threshold), sizes * (1 + 1 / self.threshold)
        return tuple(np.floor(np.log(s) / math.log(self.ratio) + e).astype(np.int64) for s, e in zip(sums, (-1e-9, 1e-9), strict=True))

    def differences(self, sums: float) -> int:
        """Most differences of a pair with this size sum."""
        return int((1 - self.threshold) / (1 + self.threshold) * sums + 1e-9)

    def parts(self, band: int) -> tuple[int, int]:
        """(parts of a partition, number of values) of a band; the values of further partitions follow the first."""
        most = self.differences(self.ratio ** (band + 1))
        if not self.miss:
            return most + 1, most + 1
        if most == 0:
            return 1, self.agree
        parts = max(2, math.ceil(most / self.load))
        common = math.floor(self.threshold / (1 + self.threshold) * self.ratio**band)
        hit = (1 - 1 / parts) ** most * (1 - (1 - 1 / parts) ** max(common, 1))
        values = self.agree
        while sum(math.comb(values, k) * hit**k * (1 - hit) ** (values - k) for k in range(self.agree)) > self.miss:
            values += 1
        return parts, values


def signatures(tokens: np.ndarray, owner: np.ndarray, count: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of their body): the value of every non-empty part in all bands where a partner can lie.

    A value is made under its band, partition and part, so equal values stand for equal places.
    """
    sizes = np.bincount(owner, minlength=count)
    low, high = plan.bands(np.maximum(sizes, 1))
    owners, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def cut(members: np.ndarray, parts: int, seed: int, use: int) -> np.ndarray:
        """Values of the first ``use`` parts for each member; returns how many parts each one fills."""
        row = np.full(count, -1)
        row[members] = np.arange(len(members))
        chosen = row[owner] >= 0
        slot, start = row[owner[chosen]], mix(np.array([seed], np.uint64) * _SEED)[0]
        hashed = mix(tokens[chosen] ^ start)
        part = (((hashed >> np.uint64(33)) * np.uint64(parts)) >> np.uint64(31)).astype(np.int64)
        keep = slice(None) if use == parts else np.flatnonzero(part < use)
        xored = np.zeros(len(members) * use, np.uint64)
        np.bitwise_xor.at(xored, slot[keep] * use + part[keep], mix(hashed[keep] + _SEED))
        filled = np.flatnonzero(xored)
        values.append(mix(xored[filled] + mix((filled % use).astype(np.uint64) + start)))
        owners.append(members[filled // use])
        return np.bincount(filled // use, minlength=len(members))

    for band in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        members = np.flatnonzero((low <= band) & (high >= band) & (sizes > 0))
        if not len(members):
            continue
        parts, wanted = plan.parts(band)
        for done in range(0, wanted, parts):
            filled = cut(members, parts, band * 4096 + done + 1, min(parts, wanted - done))
        if not plan.miss:
            # of two bodies one with more filled parts than differences is enough; the others are cut finer as well
            most = np.floor(sizes * (1 - plan.threshold) / plan.threshold + 1e-9)
            finer = 1
            while len(members := members[filled <= most[members]]):
                filled = cut(members, min(parts << finer, 1 << 31), (band << 32) + finer, min(parts << finer, 1 << 31))
                finer += 1
    kept = np.concatenate(values) >> np.uint64(64 - VALUE_BITS)
    return kept.view(np.int64), np.concatenate(owners)


def _bodies(rows: DataFrame, id_column: str, text_column: str, width: int, least: int) -> DataFrame:
    """(id, key, n, words): rows whose compact body has at least ``least`` characters, a 128-bit hash of it as key, the
    number of its tokens and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, b) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if len(b := compact_body(t)) >= least]
            ids, bodies = [i for i, _ in found], [b for _, b in found]
            for part in together(bodies):
                tokens, owner = token_sets(bodies[part], width)
                count = part.stop - part.start
                words = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * WORDS), pa.array(sketches(tokens, owner, count).ravel()))
                keys = pa.array([xxhash.xxh3_128_digest(b.encode("utf-8", "surrogatepass")) for b in bodies[part]], pa.binary())
                sizes = pa.array(np.bincount(owner, minlength=count).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), keys, sizes, words], ["id", "key", "n", "words"])

    # a cheap upper bound of what remains without white space: lower() makes at most two characters of one (U+0130)
    slim = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where(
        F.col("id").isNotNull() & (F.length("text") * 2 >= least)
    )
    return slim.mapInArrow(run, "id long, key binary, n int, words array<long>")


def _values(texts: DataFrame, width: int, plan: Plan) -> DataFrame:
    """(sig, rep, n) of every part of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, bodies = batch.column(0).to_numpy(zero_copy_only=False), [compact_body(t) for t in batch.column(1).to_pylist()]
            for part in together(bodies):
                tokens, owner = token_sets(bodies[part], width)
                count = part.stop - part.start
                sig, body = signatures(tokens, owner, count, plan)
                sizes = np.bincount(owner, minlength=count).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(reps[part][body]), pa.array(sizes[body])], ["sig", "rep", "n"])

    return texts.mapInArrow(run, "sig long, rep long, n int")


def _verified(pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(rep_a, rep_b) of the pairs with text_a and text_b whose token sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([compact_body(t) for t in batch.column(i).to_pylist()] for i in (2, 3))
            good = []
            for part in together([x + y for x, y in zip(a, b, strict=True)]):
                count = part.stop - part.start
                keyed, size = [], np.zeros(count)
                for texts in (a, b):
                    tokens, owner = token_sets(texts[part], width)
                    keyed.append(owner.astype(np.uint64) << np.uint64(TOKEN_BITS) | tokens)
                    size += np.bincount(owner, minlength=count)
                common = np.intersect1d(*keyed, assume_unique=True) >> np.uint64(TOKEN_BITS)
                both = np.bincount(common.astype(np.int64), minlength=count)
                good.append(both >= threshold * (size - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return pairs.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(run, "rep_a long, rep_b long")


def near_duplicates(
    rows: DataFrame, id_column: str, text_column: str, threshold: float = 0.8, width: int = 5, least: int = 1, miss: float = MISS
) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (id, rep), rep the lowest id of equal bodies; links has (rep_a, rep_b), rep_a < rep_b.

    Links are all pairs of different bodies whose token sets share at least ``threshold`` of their union,
    up to a probability of ``miss`` for a pair exactly at the threshold (less above it); with ``miss`` 0 none is missed,
    at a cost that grows with the pairs of similar size. Null texts, null ids
    and bodies of fewer than ``least`` characters (lower case, no white space) are in neither; rows sharing
    an id count once, linked if any of their bodies is; an empty table gives two empty tables. Nothing is capped.
    """
    described = materialize(_bodies(rows, id_column, text_column, width, least), "bodies")
    first = described.groupBy("key").agg(F.min("id").alias("rep"))
    members = materialize(described.select("id", "key").distinct().join(first, "key").select("id", "rep"), "members")
    reps = members.where("id = rep").select("rep").distinct()
    plan = Plan.of(threshold, miss, reps.count())
    texts = (
        rows.select(F.col(id_column).cast("long").alias("rep"), F.col(text_column).alias("text"))
        .where(F.col("text").isNotNull())
        .join(reps, "rep", "left_semi")
    )
    # most values are of one body only: they end here, sorted once
    place = Window.partitionBy("sig").orderBy("rep")
    values = _values(texts, width, plan).withColumn("before", F.lag("rep").over(place)).withColumn("after", F.lead("rep").over(place))
    shared = materialize(values.where(F.col("before").isNotNull() | F.col("after").isNotNull()).select("sig", "rep", "n"), "values")
    total = F.col("n_a") + F.col("n_b")
    similar = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9
    a, b = (shared.select("sig", F.col("rep").alias(f"rep_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    met = a.join(b, "sig").where((F.col("rep_a") < F.col("rep_b")) & similar).groupBy("rep_a", "rep_b").agg(F.count("*").alias("parts"))
    met = met.where(F.col("parts") >= plan.agree).select("rep_a", "rep_b")

    words = [f"w{i}" for i in range(WORDS)]
    sketched = described.join(reps, F.col("id") == F.col("rep"), "left_semi").select(F.col("id").alias("rep"), "n", *[F.col("words")[i].alias(w) for i, w in enumerate(words)])
    sa, sb = (sketched.select(*[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", *words)]) for s in "ab")
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words[1:]), F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    most, size = total * ((1 - threshold) / (1 + threshold)), WORDS * 64
    if miss:  # the distance is at most d; for many differences it also stays, at six sigma, near its expectation
        most = F.least(most, size / 2 * (1 - F.exp(-2 * most / size)) + 3 * math.sqrt(size))
    close = materialize(met.join(sa, "rep_a").join(sb, "rep_b").where(apart <= most + 1e-9).select("rep_a", "rep_b").distinct(), "close")
    ta, tb = (texts.select(F.col("rep").alias(f"rep_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    return members, _verified(close.join(ta, "rep_a").join(tb, "rep_b"), width, threshold).distinct()


def near_duplicate_pairs(rows: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows, equal bodies included."""
    members, links = near_duplicates(rows, id_column, text_column, **options)
    links = materialize(links, "links")
    copies = members.where("id <> rep").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    every = links.unionByName(copies)
    a, b = (members.select(F.col("rep").alias(f"rep_{s}"), F.col("id").alias(f"x_{s}")) for s in "ab")
    return (
        every.join(a, "rep_a")
        .join(b, "rep_b")
        .where((F.col("rep_a") != F.col("rep_b")) | (F.col("x_a") < F.col("x_b")))
        .select(F.least("x_a", "x_b").alias("id_a"), F.greatest("x_a", "x_b").alias("id_b"))
    )


def near_duplicate_classes(rows: DataFrame, id_column: str, text_column: str, **options) -> DataFrame:
    """One row per row with a long enough body: id, class_id (equal bodies) and links of the class to other classes."""
    members, links = near_duplicates(rows, id_column, text_column, **options)
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
