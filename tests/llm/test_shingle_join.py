"""The near-duplicate stage of the pipeline against brute-force Jaccard similarities."""

import numpy as np
import pytest

from echogrid.llm import shingle_join, simhash

LEAST = 0.8


def edited(rng, base, n):
    w = list(base)
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"edit{rng.integers(1 << 30)}"
    return w


def rows():
    rng = np.random.default_rng(6)
    out = []
    for length, copies, most in ((400, 6, 10), (300, 30, 5), (60, 40, 3), (7, 3, 1)):
        base = [f"w{k}" for k in rng.integers(0, 5000, length)]
        out += [" ".join(base), " ".join(base).upper()]
        out += [" ".join(edited(rng, base, int(rng.integers(1, most + 1)))) for _ in range(copies)]
    out += [" ".join(f"w{k}" for k in rng.integers(0, 5000, 80)) + " one very common line that many of the texts hold" for _ in range(40)]
    out += ["", None, " \n", "two words"]
    rows = [(k * 7 % 1000, t) for k, t in enumerate(out)]
    # Repeated rows of one id, one id with two texts, and groups of null ids alone.
    return rows + [rows[0], rows[0], (rows[3][0], "another text of that id"), (None, "no id here"), (None, "no id here"), (None, out[0])]


def brute(rows):
    shingle = lambda w: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets = [shingle((t or "").lower().split()) for _, t in rows]
    fps = [int.from_bytes(simhash.fingerprint((t or "").encode(), 5)) for _, t in rows]
    group, far = list(range(len(rows))), 0

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            bits = (fps[a] ^ fps[b]).bit_count()
            close = bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= LEAST
            far += close and bits > 3
            if close or bits <= 3:
                group[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append((i is None, i or 0))
    return sorted(min(v) for v in least.values()), far


@pytest.mark.parametrize("bucket,block", [(24, 1024), (2, 16), (1000, 1024)])
def test_one_row_of_each_group(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(shingle_join, "BUCKET", bucket)
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    expected, far = brute(given)
    assert far > 20
    found = shingle_join.one_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == expected
    assert {(r.doc_id, r.text) for r in found} <= set(given)


def test_no_rows(spark):
    assert shingle_join.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_stage_removes_edited_copies(spark):
    import corpus_pipeline

    given = [(i, t) for i, t in rows() if i is not None]
    found = corpus_pipeline.distinct(spark, spark.createDataFrame(given, "doc_id long, text string"), "")
    assert sorted((False, r.doc_id) for r in found.collect()) == brute(given)[0]
