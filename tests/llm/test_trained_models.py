"""The trained operators (5 and 8) against plain Python versions, on odd rows, and the pipeline against its parts."""

import re

import numpy as np
import pytest
import zstandard

from echogrid.llm import boosted, common, toxicity_gbt, zstd_quality

GOOD = "the careful report describes measured results and their limits in plain sentences"
BAD = "CLICK here free win $$$ buy now now now !!! cheap deal deal"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(200):
        w = (GOOD if k % 3 else BAD).split()
        rows.append((k, " ".join(rng.choice(w, rng.integers(1, 400))), None, 1.0, k % 8))
        labels.append((k, int(k % 3 > 0), int(k % 5 == 0)))
    rows[17] = (17, None, "x", 1.0, 0)
    rows[18] = (18, "", "x", 1.0, 0)
    rows += [rows[20], (None, GOOD, None, 1.0, 0), (21, GOOD, None, 1.0, 0), (500, "word " * 60_000, None, 1.0, 0)]
    labels += [(999, 1, 1), (None, 1, 1), (30, None, None), (31, 1, 1), (31, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, part int").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality_is_the_curve_of_compressed_sizes(corpus):
    docs, labels, rows = corpus
    model = zstd_quality.learn(docs, labels)
    assert model.good and model.bad and model.slope > 0

    def size(raw, text):
        total = 0
        for k in range(0, len(text), zstd_quality.SLICE):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=zstd_quality.LEVEL)
            total += len(zstandard.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(text[k : k + zstd_quality.SLICE]))
        return total

    def score(text):
        t = (text or "").encode()
        d = (size(model.bad, t) - size(model.good, t) - model.bias * len(t)) / (len(t) + zstd_quality.SMOOTH)
        return float(1 / (1 + np.exp(-np.clip(model.prior + model.slope * d, -40, 40))))

    got = sorted(((r.doc_id, r.score, r.predicted) for r in zstd_quality.quality(docs, labels).collect()), key=repr)
    expected = sorted(((i, score(t), int(score(t) >= 0.3)) for i, t, *_ in rows), key=repr)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in expected]
    assert np.allclose([b for _, b, _ in got], [b for _, b, _ in expected])
    empty = [b for a, b, _ in got if a in (17, 18)]
    assert np.allclose(empty, 1 / (1 + np.exp(-model.prior)))
    assert sum(p == (i % 3 > 0) for i, _, p in got if i is not None and i < 200 and i not in (17, 18)) >= 185


def test_dictionaries_hold_slices_from_all_over_a_text(spark):
    text = "".join(f"part{k:06d} " for k in range(200_000))
    rows = spark.createDataFrame([(1, text, 0), (2, "good", 1)], "doc_id long, text string, y int")
    raw = zstd_quality.dictionaries(rows)
    places = np.array([int(x) for x in re.findall(rb"part(\d{6}) ", raw[0])])
    assert 0.9 * zstd_quality.DICTIONARY < len(raw[0]) <= zstd_quality.DICTIONARY
    assert all(((places >= a) & (places < a + 20_000)).any() for a in range(0, 200_000, 20_000))


def test_scores_without_usable_labels(spark, corpus):
    docs, labels, rows = corpus
    for some in (labels.limit(0), labels.where("quality = 1 AND toxic = 0"), labels.where("doc_id = 999")):
        for scored in (zstd_quality.quality(docs, some), toxicity_gbt.toxicity(docs, some)):
            got = scored.select("score").distinct().collect()
            assert len(got) == 1 and 0 <= got[0].score <= 1 and scored.count() == len(rows)
    assert zstd_quality.keep_good(docs.limit(0), labels).count() == 0 == toxicity_gbt.keep_clean(docs.limit(0), labels).count()
    assert toxicity_gbt.keep_clean(docs, labels).columns == docs.columns == zstd_quality.keep_good(docs, labels).columns


def naive_trees(x, y):
    """Boosted trees by trying every threshold of every feature on plain lists."""
    rate = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, boosted.BINS + 1)[1:-1])) for c in x.T]
    raw = [prior] * len(y)

    def grow(rows, depth, g, h):
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best, split = 1e-9, None
        if depth < boosted.DEPTH and len(rows) >= 2 * boosted.LEAST:
            for f, es in enumerate(edges):
                for e in es:
                    left = [i for i in rows if x[i, f] <= e]
                    if boosted.LEAST <= len(left) <= len(rows) - boosted.LEAST:
                        a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = a * a / (b + 1) + (sg - a) ** 2 / (sh - b + 1) - sg * sg / (sh + 1)
                        if gain > best + 1e-12:
                            best, split = gain, (f, e)
        if split is None:
            for i in rows:
                raw[i] += boosted.RATE * sg / (sh + 1)
            return
        f, e = split
        grow([i for i in rows if x[i, f] <= e], depth + 1, g, h)
        grow([i for i in rows if x[i, f] > e], depth + 1, g, h)

    for _ in range(boosted.TREES):
        p = [1 / (1 + np.exp(-r)) for r in raw]
        grow(list(range(len(y))), 0, [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p])
    return np.array(raw)


def test_trees_are_the_naive_ones(monkeypatch):
    monkeypatch.setattr(boosted, "TREES", 6)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=200) * 0.3 > 0.4).astype(float)
    assert np.allclose(boosted.tree_scores(boosted.fit_trees(x, y), x), naive_trees(x, y))


@pytest.mark.parametrize("seed", range(6))
def test_the_calibration_never_falls(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 120))
    score, weight = rng.normal(size=n).round(1), rng.uniform(0.2, 5, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * score))).astype(float)
    x = np.linspace(-4, 4, 400)
    p = boosted.calibrated(boosted.fit_isotonic(score, y, weight), x)
    assert (np.diff(p) >= 0).all() and (p > 0).all() and (p < 1).all()
    # The least-squares rising means, by the formula over all intervals.
    order = np.lexsort((-y, score))
    v, w = y[order], weight[order]
    mean = lambda a, b: (v[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    formula = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    pools = boosted.pooled(zip((v * w).tolist(), w.tolist(), range(n), range(n), strict=True))
    assert np.allclose(np.concatenate([np.full(int(hi - lo) + 1, t / u) for t, u, lo, hi in pools]), formula)


def test_calibration_falls_nowhere_for_a_light_top_pool():
    score, y = np.array([0.0] * 50 + [1.1] * 60 + [2.0]), np.array([0.0] * 50 + [1.0] * 61)
    p = boosted.calibrated(boosted.fit_isotonic(score, y, np.ones(111)), np.array([0.0, 1.1, 2.0]))
    assert p[0] < p[1] <= p[2]


def test_toxicity_is_the_models_scores(corpus):
    docs, labels, rows = corpus
    model = toxicity_gbt.learn(docs, labels)
    got = sorted(((r.doc_id, r.score) for r in toxicity_gbt.toxicity(docs, labels).collect()), key=repr)
    expected = sorted(((i, float(model.score([t or ""])[0])) for i, t, *_ in rows), key=repr)
    assert [a for a, _ in got] == [a for a, _ in expected] and np.allclose([b for _, b in got], [b for _, b in expected])


def test_sample_gives_every_part_rows_of_each_class(corpus):
    docs, labels, _ = corpus
    found = toxicity_gbt.sample(docs, labels, "toxic", 2, 4, 6000).collect()
    assert len({r.doc_id for r in found}) == len(found) and {(r.y, r.part) for r in found} == {(y, k) for y in (0, 1) for k in range(8)}


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_pipeline_is_its_stages_one_by_one(spark):
    import corpus_pipeline
    from tests.llm.test_corpus_operators import brute_fingerprint, low

    sf = "/root/testdata/sf0.001"
    d = common.table(spark, sf, "documents").toPandas()
    labels, bench = common.table(spark, sf, "labels"), common.table(spark, sf, "benchmark").toPandas()
    frame = lambda x: spark.createDataFrame(x)
    toxic = toxicity_gbt.learn(frame(d), labels)
    d = d[toxic.score(list(d.text)) < 0.3]
    good = zstd_quality.learn(frame(d), labels)
    d = d[good.score(good.sizes()([t.encode() for t in d.text])) >= 0.3]
    fp, texts = [brute_fingerprint(t, 5) for t in d.text], list(d.text)
    ids, group = list(d.doc_id), list(range(len(d)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3 or jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)), key=lambda k: ids[k])
                group[y] = x
    d = d[[find(k) == k for k in range(len(ids))]]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {" ".join(split(t)[k : k + 10]) for t in bench.text for k in range(max(1, len(split(t)) - 9))}
    d = d[[not any(f" {w} " in f" {' '.join(split(t))} " for w in windows) for t in d.text]]
    got_ids = sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    assert got_ids == sorted(d.doc_id) and 0 < len(got_ids) < 200
