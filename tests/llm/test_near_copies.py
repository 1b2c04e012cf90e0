"""MinHash and vector near-duplicates, and components, against brute force."""

import itertools
import random

import numpy as np
import pytest

from lexmill.llm import embed_dedup, minhash_dedup
from lexmill.llm._components import components


def joined(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(0, 400)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(5000, k) for k in range(5001, 5300)]
    rows = [*links, (7, 7), (None, 3), (3, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(7)
    real = [x for x in links if x[0] != x[1]]
    for one_task in (0, 200_000):
        got = {r.id: r.component for r in components(df, one_task=one_task).collect()}
        assert got == joined({n for x in real for n in x}, real)
    assert components(df.limit(0)).count() == 0


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_documents_against_brute_force(spark, words, percent):
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([2, 5, 40, 120]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "One", "ONE", "a b c", "word " * 60_000, "word " * 40_000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[i], "s", "h") for i in order] + [(3, texts[3], "s", "h"), (None, texts[0], "s", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sig string, set_hash string")
    sets = [shingles(t, words) for t in texts]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    want = joined(range(len(texts)), links)
    got = minhash_dedup.classes(df, words, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = minhash_dedup.keep_heads(df, words, percent)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))


def test_star_of_many_distinct_copies(spark):
    rng = random.Random(12)
    centre = [f"c{k}" for k in range(302)]
    texts = []
    for n in range(1_200):
        copy = list(centre)
        for k in range(7):
            copy[43 * k + rng.randrange(3, 40)] = f"x{n}-{k}"
        texts.append(" ".join(copy))
    texts.insert(700, " ".join(centre))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = minhash_dedup.classes(df, 3, 85).collect()
    assert len(got) == 1_201 and {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_joins_of_blocks_against_brute_force():
    rng = np.random.RandomState(13)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.sort(np.concatenate([rng.choice(base, 200 - e, False), 1000 * (k + 1) + base[:e]])) for k, e in enumerate(rng.randint(0, 40, 90))]
    rows = [(k, k, minhash_dedup.signature(s)[: minhash_dedup.SKETCH].astype(np.uint8).tobytes(), s) for k, s in enumerate(sets)]
    near = [(a, b) for a, b in itertools.combinations(range(90), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert (minhash_dedup.common(sets[:40], sets[40:]) == [[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]]).all()
    assert joined(range(90), minhash_dedup.joins(rows, None, 80)) == joined(range(90), near)
    across = [(a, b) for a, b in near if a < 40 <= b]
    assert joined(range(90), minhash_dedup.joins(rows[:40], rows[40:], 80)) == joined(range(90), across)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash_dedup.classes(df).count() == 0 and minhash_dedup.keep_heads(df).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.RandomState(9)
    x = rng.standard_normal((150, 16))
    near = np.concatenate([x[k] + 0.08 * rng.standard_normal((m, 16)) for k, m in ((0, 40), (1, 3), (2, 8))])
    chain = np.array([[np.cos(a), np.sin(a)] + [0.0] * 14 for a in np.arange(0, 2.4, 0.4)])
    x = np.concatenate([x, near, chain, x[:5], x[:5] * 3])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    links = [(a, b) for a, b in itertools.combinations(range(len(x)), 2) if cos[a, b] >= 0.9]
    want, degree = joined(range(len(x)), links), np.zeros(len(x), int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    bad = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + k, v, 1) for k, v in enumerate(bad)] + [(2000, [1.0, 0.0], 1), (2001, [2.0, 0.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, head int")
    got = {r.vec_id: r for r in embed_dedup.classes(df).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i), i
    assert all(got[1000 + k].n_links == 0 and got[1000 + k].kept for k in range(len(bad)))
    assert got[2001].component_id == 2000 and got[2001].n_links == 1 and got[None].kept
    assert embed_dedup.classes(df.limit(0)).count() == 0


def test_blocks_count_as_one_group_does(spark):
    rng = np.random.RandomState(10)
    v = np.concatenate([rng.standard_normal(8) + 0.2 * rng.standard_normal((60, 8))])
    rows = [(7, i, 1 + i % 3, bytearray(x.tobytes())) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "component bigint, id bigint, n bigint, v binary")
    count = lambda block: {r.id: r.others for r in embed_dedup.count_links(df, 0.9, block).collect()}
    assert count(8) == count(1000) and any(count(8).values())


def test_repeated_vector_ids_count_for_themselves(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (3, [0.01, 1.0])]
    got = embed_dedup.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


def brute_vectors(x, threshold=0.9):
    """Number of links and smallest number reached, for each vector."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    label, (i, j) = np.arange(len(x)), np.nonzero(near)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            return near.sum(1), label
        label = new


def test_ten_thousand_vectors_against_brute_force(spark):
    rng = np.random.RandomState(21)
    parts = [rng.standard_normal((5_000, 32))]
    for size in (2, 3, 5, 40, 700, 1_500):
        for _ in range(max(1, 300 // size)):
            parts.append(rng.standard_normal(32) + rng.uniform(0.1, 0.3) * rng.standard_normal((size, 32)))
    centre = np.eye(32)[0]
    spokes = np.concatenate([np.full((1_200, 1), 0.905), rng.standard_normal((1_200, 31))], axis=1)
    spokes[:, 1:] *= np.sqrt(1 - 0.905**2) / np.linalg.norm(spokes[:, 1:], axis=1)[:, None]
    parts += [centre[None], spokes]
    x = np.concatenate(parts)
    x = x[rng.permutation(len(x))]
    degree, label = brute_vectors(x)
    got = embed_dedup.classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == len(x) > 8_000
    wrong = sum((r.n_links, r.component_id) != (degree[r.vec_id], label[r.vec_id]) for r in got)
    assert wrong <= 0.01 * len(x), wrong


def test_windows_go_on_through_short_partitions():
    from lexmill.llm._sorted import _reach

    sizes = [(0, 4), (2, 1), (3, 1), (5, 4), (9, 4)]
    got = _reach(sizes, 4)
    assert {b for p, last, b in got if p == 0 and last} == {0, 1, 2} and {b for p, last, b in got if p == 5 and not last} == {2, 1, 0}
    assert {b for p, last, b in got if p == 9 and not last} == {3} and {b for p, last, b in got if p == 2 and last} == {1, 2}


def test_sorted_orders_compare_every_window(spark):
    from lexmill.llm import _sorted

    def compare(keys, sketches, group):
        n, i, j = len(keys), [], []
        for lag in range(1, min(4, n - 1) + 1):
            k = np.nonzero(group[lag:] == group[:-lag])[0]
            i.append(k)
            j.append(k + lag)
        return np.concatenate(i), np.concatenate(j), np.zeros(sum(map(len, i)))

    rows = [(0, bytearray(k.to_bytes(2, "big")), k, bytearray(b"x")) for k in range(30)]
    df = spark.createDataFrame(rows, "tree int, key binary, id bigint, sketch binary")
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.a, r.b) for r in _sorted.neighbour_pairs(df, compare, 4).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    assert got == {(a, b) for a in range(30) for b in range(a + 1, min(30, a + 5))}


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b c d e f g", "x"), (1, "a b c d e f", "y"), (2, "q r s t u v w", "z"), (2, "q r s t u v w", "z"), (None, "n", "n"), (None, "n", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _gone string")
    got = sorted(map(tuple, minhash_dedup.keep_heads(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f", "y"), (2, "q r s t u v w", "z"), (None, "n", "n"), (None, "n", "n")], key=str)
