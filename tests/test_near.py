"""Near-copy groups against brute force, and labels of components."""

import random

from textprov.operators import near

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    t = (text or "").lower().split()
    return {tuple(t[i:i + 5]) for i in range(max(len(t) - 4, 1))} if t else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def got(spark, rows):
    df = spark.createDataFrame(rows, "example_id long, text string").repartition(4)
    return {r.example_id: r.group_id for r in near.near_groups(df).collect()}


def test_groups_equal_brute_force(spark):
    rnd = random.Random(2)
    rows, number = [], 0
    for _ in range(25):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(60, 200))]
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(WORDS)
            rows.append((number, " ".join(copy)))
            number += rnd.randint(1, 3)
    rnd.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "a b c d e"), (8, "a b c d e f"), (9, "a b c d e")]
    assert got(spark, rows) == brute(rows) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 7}
    df = spark.createDataFrame(rows, "example_id long, text string")
    assert near.near_groups(df.limit(0)).collect() == []


def test_a_large_group_costs_comparisons_in_proportion(spark):
    rnd = random.Random(3)
    base = [rnd.choice(WORDS) for _ in range(300)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1:])) for i in range(300)]
    df = spark.createDataFrame(rows, "example_id long, text string")
    links = near.near_links(df).count()
    assert 299 <= links <= 2 * near.BANDS * 300
    assert set(got(spark, rows).values()) == {0}


def test_connected_paths_and_rings(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + (i + 1) % 7, 100 + i) for i in range(7)] + [(500, 499), (499, 500)]
    found = {r.node: r.root for r in near.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(7)}, 499: 499, 500: 499}
