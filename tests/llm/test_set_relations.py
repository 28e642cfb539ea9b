"""Operator 11 against all pairs compared directly."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from echogrid.llm import set_relations

SCHEMA = "doc_id long, text string, lang string, node long, n int, h string, root long"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def direct(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), i if not s else least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def grouped(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 1, 2, "h", 3) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in set_relations.jaccard_groups(docs).collect()), key=repr)


def chains(seed, groups=6, most=45):
    """Texts that go away from their first one by few words at a time, and unlike texts."""
    rng, rows = random.Random(seed), []
    vocab = [f"w{k}" for k in range(3000)]
    for _ in range(groups):
        text = [rng.choice(vocab) for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, most)):
            rows.append(" ".join(text))
            other = list(text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 1)] = [rng.choice(vocab)]
            if rng.random() < 0.5:
                text = other
            else:
                rows.append(" ".join(other))
    rng.shuffle(rows)
    return list(enumerate(rows, 7))


ODD = [(3, None), (2, ""), (9, " \t\n"), (None, "a b c d"), (4, "A B C D"), (5, "a b c d"), (5, "a b c d"), (None, None), (6, "x"), (7, "X"), (8, "x y"), (10, "\x1c x"), (11, "z " * 50_000), (12, "z z z"), (None, "null one"), (None, "null one")]


@pytest.mark.parametrize("rows", [[], ODD, ODD[:1]])
def test_odd_rows(spark, rows):
    assert grouped(spark, rows) == direct(rows)


@pytest.mark.parametrize("bucket,sets", [(24, 4096), (1, 8), (3, 4096)])
def test_like_all_pairs(spark, monkeypatch, bucket, sets):
    monkeypatch.setattr(set_relations, "BUCKET", bucket)
    monkeypatch.setattr(set_relations, "SETS", sets)
    rows = chains(24, 8, 40)
    found = grouped(spark, rows)
    assert found == direct(rows)
    assert len({r[2] for r in found}) < len({t for _, t in rows}) - 10


@pytest.mark.parametrize("rows", [[], ODD, chains(3, 4, 20)])
def test_sql_links_what_all_pairs_link(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(db.execute(set_relations.SQL).fetchall(), key=repr) == direct(rows)


@pytest.mark.parametrize("seed", range(25))
def test_search_links_what_all_pairs_link(monkeypatch, seed):
    """The search alone, with short blocks of its lists, against all pairs; answers are taken from similar sets."""
    monkeypatch.setattr(set_relations, "SKIP", 3)
    sets = sorted({s.tobytes(): s for _, t in chains(seed, 3, 30) if len(s := set_relations.shingles(t.encode()))}.values(), key=len)
    a, b = set_relations.Search(sets).forest()
    assert len(set(b)) == len(b)
    found, expected = list(range(len(sets))), list(range(len(sets)))

    def find(g, k):
        while g[k] != k:
            k = g[k]
        return k

    for x, y in zip(a, b, strict=True):
        common = len(np.intersect1d(sets[x], sets[y]))
        assert 19 * common >= 9 * (len(sets[x]) + len(sets[y]))
        found[find(found, x)] = find(found, y)
    for x, y in combinations(range(len(sets)), 2):
        if 19 * len(np.intersect1d(sets[x], sets[y])) >= 9 * (len(sets[x]) + len(sets[y])):
            expected[find(expected, x)] = find(expected, y)
    name = lambda g: [min(j for j in range(len(sets)) if find(g, j) == find(g, k)) for k in range(len(sets))]
    assert name(found) == name(expected)


def test_answers_of_a_similar_set_bound_and_mend(monkeypatch):
    """Bounds from a similar set's answers hold the true number, and mended ones are exact."""
    rng = np.random.default_rng(5)
    base = np.arange(200)
    sets = sorted((np.unique(np.where(rng.random(200) < 0.06, rng.integers(200, 2000, 200), base)) for _ in range(40)), key=len)
    s = set_relations.Search(sets)
    z = np.arange(2, 40)
    first = s.answers(0, z, None)
    assert (first[0] == first[1]).all()
    low, high = s.answers(1, z, (0, z, *first))
    true = np.array([len(np.intersect1d(sets[1], sets[k])) for k in z])
    assert (low <= true).all() and (true <= high).all()
    same = set_relations.linked(s.n[1], s.n[z], true)
    assert (set_relations.linked(s.n[1], s.n[z], low) == same).all() and (set_relations.linked(s.n[1], s.n[z], high) == same).all()
