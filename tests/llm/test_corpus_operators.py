"""Corpus operators on small tables with nulls, empty and long texts, ties and repeated rows, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from echogrid.llm import chat_pairs, common, imatch, license_scan, piece_counts, plane_store, simhash, suffix_decontam, toxicity_gbt, unigram_pieces, zstd_quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double"
LONG = " ".join(f"word{k % 97}{'x' * (k % 5)}" for k in range(20_000))
TEXTS = [
    (5, "The Quick brown fox, jumps over the lazy dog and away it goes."),
    (3, None),
    (1, ""),
    (9, " \t\n"),
    (2, "The Quick brown fox, jumps over the lazy dog and away it goes."),
    (2, "The Quick brown fox, jumps over the lazy dog and away it goes."),
    (7, LONG),
    (8, LONG + " end"),
    (4, "Élan vital Ça va? It's U.S.A. (x), \"y\". 東京 ½ <s> </s> <|endoftext|>"),
    (None, "a row without an id, released under the MIT License."),
    (11, "Licensed under the Apache License, Version 2.0. under the mit license under the MIT license; CC BY-NC 4.0"),
    (12, "This work is licensed under the GNU General Public License, version 3."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 0.5) for i, t in TEXTS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def want(f):
    return sorted(((i, *f(i, t)) for i, t in TEXTS), key=repr)


def test_token_planes(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for bits in (False, True):
        found = plane_store.round_trip(docs, path, bits=bits)
        assert got(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert plane_store.round_trip(empty, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 9000])
@pytest.mark.parametrize("bits", [False, True])
def test_planes_are_inverse(n, bits):
    ids = np.random.default_rng(n).integers(0, 1 << 22, n).astype("<u4")
    width, planes = plane_store.split_planes(ids, bits)
    assert (plane_store.join_planes(planes, width, n) == ids).all()


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    s = [" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    fp = {(i, t): brute_fingerprint(t) for i, t in TEXTS}
    keys = list(fp)
    group = {k: k for k in keys}

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in keys:
        for b in keys:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for k in keys:
        if k[0] is not None:
            least[find(k)] = min(k[0], least.get(find(k), k[0]))
    expected = sorted(((i, f"{fp[i, t]:016x}", least.get(find((i, t)))) for i, t in TEXTS), key=repr)
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket,block", [(24, 8192), (3, 8192), (2, 40)])
def test_simhash_links_keep_all_components(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    fps = set()
    for center in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            x = center
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x - (1 << 64) if x >= 1 << 63 else x)
    fps = sorted(fps)
    a = np.array(fps, np.int64).view(np.uint64)
    group = list(range(len(a)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[k] ^ a) <= 3):
            group[find(k)] = find(int(j))
    least = {}
    for k, x in enumerate(fps):
        least[find(k)] = min(x, least.get(find(k), x))
    expected = {x: least[find(k)] for k, x in enumerate(fps)}
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(5)
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    assert {x: roots.get(x, x) for x in fps} == expected


def test_license_scan(docs, empty):
    def brute(_, text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        at = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in license_scan.BASE}
        every = sorted(k for v in at.values() for k in v)
        return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, v in at.items() if v))

    found = license_scan.flat(license_scan.scan(docs))
    assert got(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want(brute)
    r = {x.doc_id: x for x in found.collect()}
    assert r[12].labels == "gpl-3" and r[12].score > 0.9 and r[12].base_labels == ""
    assert r[11].labels == "apache-2,cc-by-nc,mit" and r[5].score == 0.0
    assert license_scan.scan(empty).count() == 0


def test_imatch(docs, empty, spark):
    unique = docs.dropDuplicates(["doc_id", "text"])
    rows = sorted({(i, t or "") for i, t in TEXTS}, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    expected = {}
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        expected[i] = (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())
    found = imatch.fingerprints(unique, (0.1, 0.5)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == expected
    by = {r.doc_id: r for r in found}
    assert by[5].fingerprint == by[2].fingerprint and by[3].fingerprint == by[1].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert imatch.fingerprints(docs).count() == len(TEXTS)
    assert imatch.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(4, "alone it stands")], "doc_id long, text string")
    assert imatch.fingerprints(one).first().near_next == 1.0


@pytest.mark.parametrize("frequent", [400_000, 4, 0])
def test_piece_counts(docs, empty, frequent):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    expected = want(lambda i, t: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096))
    assert got(piece_counts.token_counts(docs, path, frequent=frequent), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    if not frequent:
        assert piece_counts.token_counts(empty, path).count() == 0


def test_pre_tokens_sum_to_the_library():
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = SentencePieceProcessor(model_file=path), open(path, "rb").read()
    cut, count = piece_counts.cuts(model), piece_counts.piece_counter(model)
    rng = np.random.default_rng(4)
    alphabet = list("aZé9 .,!%-'\"()\n\t_/€東▁  ")
    for _ in range(300):
        t = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        tokens, lines = piece_counts.pre_tokens(t.encode(), cut)
        assert lines + sum(count(tokens)) == len(sp.encode(t)), repr(t)


def test_unigram_is_the_best_segmentation(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    p = unigram_pieces.Pieces(open(path, "rb").read())
    score = {p.bytes[k]: s for k, s in zip(p.trie.ids.tolist(), p.trie.scores.tolist(), strict=True)}

    def best(text):
        chars = [c.encode() for c in "▁" + text.replace(" ", "▁")] if text else []
        top = [0.0] + [-np.inf] * len(chars)
        for j in range(1, len(chars) + 1):
            for i in range(max(0, j - 30), j):
                piece = b"".join(chars[i:j])
                s = score.get(piece, p.trie.unknown if j - i == 1 else None)
                if s is not None:
                    top[j] = max(top[j], top[i] + s)
        return top[-1]

    texts = [t or "" for _, t in TEXTS if t != LONG and t != LONG + " end"] + ["ab  cd", " x ", "日本語 テスト", "\n\n"]
    for t, ids in zip(texts, p.encode([t.encode() for t in texts]), strict=True):
        assert p.decode(ids).decode() == t
        # The path's own score: unknown characters cost once for all their bytes.
        total, at = 0.0, 0
        numbers = np.frombuffer(ids, "<i4").tolist()
        while at < len(numbers):
            k = numbers[at]
            if k in p.trie.byte_ids:
                lead = p.bytes[k][0]
                total += p.trie.unknown
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            else:
                total += score[p.bytes[k]]
                at += 1
        assert total == pytest.approx(best(t))
    found = unigram_pieces.digests(docs, path)
    assert found.count() == len(TEXTS) and found.where("exact").count() == len(TEXTS)
    assert unigram_pieces.digests(empty, path).count() == 0


BENCH = [(1, "jumps over the lazy dog and away it goes"), (2, "short one"), (3, None), (4, ""), (5, "brown fox jumps over the lazy dog and away it goes"), (None, "a row without an id")]


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_decontamination(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(suffix_decontam, "BLOCK_WORDS", most)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = [(i, split(t)[k : k + 10]) for i, t in BENCH if split(t) for k in range(max(1, len(split(t)) - 9))]

    def brute(_, text):
        w, hit, items = split(text), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    items.add(i)
        names = sorted(str(i) for i in items if i is not None)
        return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)

    found = suffix_decontam.digest(suffix_decontam.hits(docs, bench))
    assert got(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want(brute)
    kept = sorted((r.doc_id for r in suffix_decontam.decontaminate(docs, bench).collect()), key=repr)
    assert kept == sorted((i for i, t in TEXTS if not brute(i, t)[1]), key=repr)
    assert suffix_decontam.hits(empty, bench).count() == 0
    assert suffix_decontam.hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_longest_matches(spark, docs):
    bench = spark.createDataFrame(BENCH[:1], "item_id long, text string")
    found = suffix_decontam.matches(docs, bench).collect()
    assert {(r.item_id, r.doc_id, r.word, r.n_words) for r in found} == {("1", 5, 4, 9), ("1", 2, 4, 9)}


def test_chat_pairs(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", None), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "other"), (4, 0, None, "lone"), (6, 1, "user", "b"), (6, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "no id")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, k int")
    r = {x.conv_id: x for x in chat_pairs.flat(chat_pairs.format_pairs(chat_pairs.neighbours(turns))).collect()}
    assert set(r) == {0, 1, 4, 6, 7, None}
    assert r[0].n_prompt_turns == 2 and r[0].prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert r[0].chosen_mask == "9:0,12:0,14:0,8:1" and r[0].rejected_mask == "9:0,13:0"
    assert r[4].chosen_mask == "5:0,12:0" and r[4].rejected == ""
    assert r[6].prompt == "<|user|>\na<|end|>\n" and r[6].rejected == "" and r[7].chosen == "" and r[7].rejected == "<|user|>\nb<|end|>\n"
    assert chat_pairs.neighbours(turns.limit(0)).count() == 0


def test_chat_pairs_of_null_ids_and_long_conversations_like_sql(spark):
    import duckdb

    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", None)]
    rows += [(2, k, ("user", "assistant")[k % 2], f"turn {k} " + "w " * 50) for k in range(3000)] + [(3, k, "user", f"turn {k} " + "w " * 50 if k % 2 == 0 else "other") for k in range(2000)]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = db.execute(chat_pairs.SQL)
    names = [d[0] for d in found.description]
    r = chat_pairs.flat(chat_pairs.format_pairs(chat_pairs.neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert sorted((tuple(x[n] for n in names) for x in r), key=repr) == sorted(found.fetchall(), key=repr) and len(r) == 5


def test_same_conversations_have_no_completions(spark):
    turn = [("user", "q"), ("assistant", "a")]
    pairs = spark.createDataFrame([(1, turn, turn), (2, turn, turn[:1])], "conv_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    r = {x.conv_id: x for x in chat_pairs.format_pairs(pairs).collect()}
    assert r[1].chosen == "" == r[1].rejected and r[1].chosen_mask == [] and r[2].n_prompt_turns == 1 and r[2].rejected_mask == []


def labelled(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    return d, common.table(spark, "/root/testdata/sf0.01", "labels")


def test_toxicity_on_held_out_labels(spark, docs, empty):
    d, labels = labelled(spark)
    r = toxicity_gbt.toxicity(d, labels).where("held_out").join(labels, "doc_id").collect()
    clean = [x for x in r if x.toxic == 0]
    assert sum(x.predicted for x in clean) <= 0.02 * len(clean)
    assert sum(x.predicted for x in r if x.toxic == 1) >= 0.5 * sum(x.toxic for x in r)
    assert toxicity_gbt.toxicity(docs, labels.limit(0)).count() == len(TEXTS)
    assert toxicity_gbt.toxicity(empty, labels).count() == 0
    assert set(docs.columns) == set(toxicity_gbt.keep_clean(docs, labels.limit(0)).columns)


def test_obfuscated_words_are_read():
    f = dict(zip(toxicity_gbt.NAMES, toxicity_gbt.features("You m0r.on, M0R0N!", {"moron": 5.0}, {}), strict=True))
    assert f["hidden"] > 0 and f["near_you"] > 0 and f["strongest"] == pytest.approx(5.0)


def test_quality_on_held_out_labels(spark, docs, empty):
    d, labels = labelled(spark)
    r = zstd_quality.quality(d, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([x.predicted == x.quality for x in r]) >= 0.9
    assert zstd_quality.quality(docs, labels.limit(0)).count() == len(TEXTS)
    assert zstd_quality.quality(empty, labels).count() == 0


def test_long_words_are_segmented_like_short_ones(monkeypatch):
    import time

    p = unigram_pieces.Pieces(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdeé東京の日本語ńĥ=/+0"), 60)).encode() for _ in range(40)]
    short = p.trie.segment([t[:64].decode("utf-8", "ignore").encode() for t in texts])
    monkeypatch.setattr(unigram_pieces, "LONG", 0)
    assert p.trie.segment([t[:64].decode("utf-8", "ignore").encode() for t in texts]) == short
    monkeypatch.undo()
    cjk = "".join(rng.choice(list("東京の日本語を話す人々は多くの本を読む"), 350_000)).encode()
    start = time.process_time()
    (ids,) = p.encode([cjk])
    assert time.process_time() - start < 5 and p.decode(ids) == cjk
