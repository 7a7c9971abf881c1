"""Near duplicates against all pairs."""

import itertools
import random

import numpy as np
import pytest

from lodestrand.llm import neardup


def bodies(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop的了在山火木") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(45, 160))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            edited = [w if rng.random() > 0.04 else rng.choice(words) for w in base]
            if rng.random() < 0.5:
                at = rng.randrange(len(edited))
                edited = edited[at:] + edited[:at]
            out.append(" ".join(edited))
        if rng.random() < 0.2:
            out.append(" ".join(base).upper())
    return out


def truth(rows, threshold, width, least):
    texts = {i: neardup.compact_body(t) for i, t in rows if t is not None and i is not None}
    sets = {i: {t[k : k + width] for k in range(max(1, len(t) - width + 1))} for i, t in texts.items() if len(t) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_pairs_against_all_pairs(spark, threshold):
    rows = list(enumerate(bodies(3, 120))) + [(9000, None), (9001, ""), (9002, "short"), (9003, "z" * 300), (9004, "Z" * 300), (None, "z" * 300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id bigint, content string, n int, key string")
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", threshold=threshold, width=5, least=200).collect()]
    want = truth(rows, threshold, 5, 200)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_classes(spark):
    text = bodies(8, 1)[0]
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, text + " tail"), (4, "other " * 80), (4, "other " * 80)], "id bigint, content string")
    got = {r.id: (r.class_id, r.links) for r in neardup.near_duplicate_classes(df, "id", "content", threshold=0.8, width=5, least=200).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}
    assert neardup.near_duplicate_pairs(df.limit(0), "id", "content").count() == 0


def test_exact_mode_misses_nothing(spark):
    rows = [*enumerate(bodies(5, 90)), (9000, ""), (9001, "abc"), (9002, "abc"), (9003, "zzzzzzzz"), (9004, "zzzzzzzzz")]
    df = spark.createDataFrame(rows, "id bigint, content string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "content", threshold=0.7, width=5, least=1, miss=0).collect()}
    assert got == truth([r for r in rows if r[1]], 0.7, 5, 1) and len(got) > 20
    with pytest.raises(ValueError):
        neardup.Plan.of(0.5, 0, 10)


def arrays(*sets):
    """Token sets as the arrays that the module works on."""
    return np.concatenate([np.unique(s) for s in sets]).astype(np.uint64), np.repeat(np.arange(len(sets)), [len(np.unique(s)) for s in sets]), len(sets)


def values_of(plan, *sets):
    values, owner = neardup.signatures(*arrays(*sets), plan)
    return [values[owner == i].tolist() for i in range(len(sets))]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**55, 500).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 500)], rng.integers(0, 2**55, rng.integers(1, 400)).astype(np.uint64)]))
        one, two = neardup.sketches(*arrays(a, b))
        apart, distance = len(np.setxor1d(a, b)), int(np.bitwise_count(one.view(np.uint64) ^ two.view(np.uint64)).sum())
        assert distance <= apart and (distance - apart) % 2 == 0


@pytest.mark.parametrize("count", [400, 40_000, 4_000_000])
def test_miss_rate_at_the_threshold(count):
    """Pairs whose similarity is just at the threshold agree in as many parts as are asked for, whatever the size of the corpus."""
    rng, plan = np.random.default_rng(2), neardup.Plan.of(0.7, 1e-4, count)
    missed = 0
    for n in (30, 180, 600, 2000):
        for _ in range(60):
            shared = int(np.ceil(0.7 * 2 * n / 1.7))
            pool = rng.integers(0, 2**55, 2 * n)
            one, two = values_of(plan, pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
            missed += len(set(one) & set(two)) < plan.agree
    assert missed <= 1


def test_more_bodies_make_larger_parts_rarer():
    few, many = (neardup.Plan.of(0.7, 1e-4, n) for n in (1_000, 10_000_000))
    assert few.load < many.load and few.parts(20)[0] > many.parts(20)[0] and few.parts(20)[1] < many.parts(20)[1]


def test_exact_values_always_meet():
    rng, plan = np.random.default_rng(3), neardup.Plan.of(0.7, 0, 100)
    for n in (1, 2, 3, 5, 10, 60, 300):
        for _ in range(40):
            shared = int(np.ceil(0.7 * 2 * n / 1.7))
            pool = rng.integers(0, 2**55, 2 * n)
            one, two = values_of(plan, pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
            assert set(one) & set(two)


def test_tokens_together_and_alone():
    texts = ["first body", "a second, longer body", "ab", "", "aaaaaaaa", "𝒳𝒴𝒵 and more"]
    tokens, owner = neardup.token_sets(texts, 5)
    for i, t in enumerate(texts):
        alone, _ = neardup.token_sets([t], 5)
        assert alone.tolist() == tokens[owner == i].tolist() and len(alone) == len({t[k : k + 5] for k in range(max(1, len(t) - 4))})
    plan = neardup.Plan.of(0.7, 1e-4, 100)
    values, of = neardup.signatures(tokens, owner, len(texts), plan)
    for i, t in enumerate(texts):
        own, o = neardup.token_sets([t], 5)
        assert sorted(neardup.signatures(own, o, 1, plan)[0].tolist()) == sorted(values[of == i].tolist())
    assert len(neardup.token_sets(["ab" * 500_000], 5)[0]) == 2 and neardup.token_sets([], 5)[0].size == 0
    for n in (1, 2, 3, 7):
        assert values_of(plan, np.arange(1, n + 1))[0]
    assert [p for p in neardup.together(["x"] * 600 + ["y" * (1 << 21)])] == [slice(0, 512), slice(512, 600), slice(600, 601)]


def test_lower_case_may_be_longer(spark):
    body = "İİİ" + "".join(chr(0x4E00 + i) for i in range(194))
    assert len(body) == 197 and len(neardup.compact_body(body)) == 200
    df = spark.createDataFrame([(1, body), (2, body), (3, body[3:])], "id bigint, body string")
    assert [tuple(r) for r in neardup.near_duplicate_pairs(df, "id", "body", threshold=0.7, width=5, least=200).collect()] == [(1, 2)]
