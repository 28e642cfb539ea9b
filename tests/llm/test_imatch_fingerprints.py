"""Fingerprints of operator 6 against a plain version of the method, both ways of keeping terms, and detection of edited texts."""

import math
import re

import numpy as np
import pytest

from echogrid.llm import common, imatch


def plain_terms(rows, band):
    cut = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for _, t in rows]
    df = {}
    for w in cut:
        for t in w:
            df[t] = df.get(t, 0) + 1
    return [{t for t in w if band[0] * len(rows) <= df[t] <= band[1] * len(rows)} for w in cut], cut


def drawn(spark, terms):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(t,) for t in sorted(terms)], "t string").select("t", *(F.xxhash64("t", F.lit(k)).alias(f"h{k}") for k in range(4)))
    return {r.t: [r[f"h{k}"] for k in range(4)] for r in d.collect()}


@pytest.mark.parametrize("listed", [imatch.LISTED, 0])
def test_fingerprints_are_those_of_the_method(spark, listed):
    rng = np.random.default_rng(3)
    vocab = [f"word{k}" for k in range(300)] + ["größe", "東京", "o_k"]
    rows = [(k, " ".join(rng.choice(vocab, rng.integers(1, 120)))) for k in range(120)] + [(500, None), (501, ""), (502, "Only Rare, rare ONLY"), (503, "only rare"), (3, "again word1"), (None, "word2 word3")]
    band = (0.05, 0.3)
    kept, every = plain_terms(rows, band)
    h = drawn(spark, set().union(*kept))
    found = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), band, listed).collect()
    got = {}
    for r in found:
        got.setdefault((r.doc_id, r.n_chars), r.fingerprint)
    by_set = {}
    for (i, t), k, w in zip(rows, kept, every, strict=True):
        f = got[i, len(t or "")]
        level = int(f[:2])
        assert level == (min(16 - imatch.LEVELS, math.floor(math.log2(len(k)) + 0.8)) if k else 0)
        for up in range(imatch.LEVELS):
            for s in range(imatch.SUBSETS):
                members = frozenset(x for x in k if (h[x][s // 4] >> 16 * (s % 4)) & ((1 << level + up) - 1) == 0)
                part = f[2 + (up * imatch.SUBSETS + s) * imatch.WIDE :][: imatch.WIDE]
                assert (part == imatch.NONE) == (not members)
                assert by_set.setdefault(members, part) == part
        assert (len(f) > 2 + imatch.LEVELS * imatch.SUBSETS * imatch.WIDE) == (not k)
        assert by_set.setdefault((frozenset(k), frozenset(w) if not k else None), f) == f
    parts = [p for m, p in by_set.items() if isinstance(m, frozenset) and m]
    assert len(set(parts)) == len(parts)
    for r in found:
        for other, near in ((r.edited_fingerprint, r.near_edited),):
            assert near == pytest.approx(plain_likeness(r.fingerprint, other))


def plain_likeness(a, b):
    whole = 2 + imatch.LEVELS * imatch.SUBSETS * imatch.WIDE
    if a == b:
        return 1.0
    if len(a) > whole or len(b) > whole:
        return 0.0
    cut = lambda f: {(int(f[:2]) + up, s): f[2 + (up * imatch.SUBSETS + s) * imatch.WIDE :][: imatch.WIDE] for up in range(imatch.LEVELS) for s in range(imatch.SUBSETS)}
    x, y = cut(a), cut(b)
    held = [k for k in x.keys() & y.keys() if (x[k], y[k]) != (imatch.NONE, imatch.NONE)]
    return sum(x[k] == y[k] for k in held) / len(held) if held else 0.0


def test_half_edited_texts_are_found_and_next_ones_are_not(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    r = imatch.fingerprints(d).collect()
    assert np.mean([x.near_edited > 0 for x in r]) >= 0.9
    assert np.mean([x.near_edited > x.near_next for x in r if x.n_chars >= 400]) >= 0.9
    assert np.mean([x.near_next for x in r]) < 0.05


def test_an_empty_lexicon_and_a_long_text(spark):
    rows = [(1, "alpha beta"), (2, "gamma " * 50_000), (3, None)]
    r = {x.doc_id: x for x in imatch.fingerprints(spark.createDataFrame([(*x, 1, "t") for x in rows], "doc_id long, text string, n int, h string"), (2.0, 3.0)).collect()}
    assert set(r) == {1, 2, 3} and r[2].n_chars == 300_000 and all(0 <= x.near_edited <= 1 for x in r.values())
