"""Notices with edited words, repeated notices and odd rows, against the SQL of operator 4 and a plain search."""

import re

import duckdb
import numpy as np

from echogrid.llm import license_scan

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(db.execute(license_scan.sql()).fetchall(), key=repr)


def scanned(spark, rows):
    found = license_scan.flat(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
    return sorted((tuple(r[n] for n in NAMES) for r in found), key=repr), found


def plain(text):
    """Labels and score by trying every template at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    labels, score = set(), 0.0
    for k, (t, key, at, label) in enumerate(license_scan.TEMPLATES):
        for i in range(len(w) - len(t) + 1):
            if w[i + at : i + at + len(key)] == key:
                share = sum(a == b for a, b in zip(w[i : i + len(t)], t, strict=True)) / len(t)
                score = max(score, share)
                if share >= (1.0 if k < len(license_scan.BASE) else license_scan.SHARE):
                    labels.add(label)
    return ",".join(sorted(labels)), score


def test_an_edited_word_outside_the_key_phrase(spark):
    rows = [(0, None), (1, "no licence at all")]
    for notice, key, _ in license_scan.NOTICES:
        w, k = notice.split(), key.split()
        first = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        rows += [(len(rows) + 1, " ".join([*w[:i], "edited", *w[i + 1 :]])) for i in range(0, len(w), 1 + len(w) // 12) if not first <= i < first + len(k)]
    got, found = scanned(spark, rows)
    assert got == by_sql(rows)
    assert {r.labels for r in found if r.score > 0.9} >= {"gpl-3"}


def test_notices_with_words_replaced_anywhere(spark):
    rng, rows = np.random.default_rng(7), []
    for k in range(240):
        w = license_scan.NOTICES[k % len(license_scan.NOTICES)][0].split()
        for at in rng.integers(0, len(w), rng.integers(0, 5)):
            w[at] = rng.choice(["the", "license", "software", "other", "version"])
        pad = [["the", "of", "words", "license"][j] for j in rng.integers(0, 4, rng.integers(0, 6))]
        rows.append((k, " ".join([*pad, *w, *pad])))
    got, found = scanned(spark, rows)
    assert got == by_sql(rows)
    assert {r.doc_id: (r.labels, r.score) for r in found} == {i: plain(t) for i, t in rows}


def test_near_notices_of_words_that_no_other_text_has(spark):
    rows = [
        (1, "redistribution and use in source and binary forms with or without modification are allowed provided that the following conditions are met"),
        (2, "this is free and unencumbered software released to the public domain"),
        (3, "it under the terms of the gnu general public license version 2 as published below"),
        (4, "permission is hereby granted free of charge to any person getting a copy of this software and associated documentation files"),
    ]
    got, found = scanned(spark, rows)
    assert got == by_sql(rows)
    assert [r.labels for r in sorted(found)] == ["bsd", "unlicense", "gpl-2", "mit"]


def test_odd_rows(spark):
    rows = [(None, "under the mit license"), (2, None), (2, ""), (3, "MIT"), (4, " ".join(["x under the MIT license"] * 40)), (5, "cc by nc cc by nc"), (5, "cc by nc cc by nc")]
    wide = spark.createDataFrame([(i, t, [1], 5) for i, t in rows], "doc_id long, text string, hits array<int>, n int")
    found = license_scan.flat(license_scan.scan(wide)).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in found), key=repr) == by_sql(rows)


def test_a_long_text(spark):
    found = license_scan.flat(license_scan.scan(spark.createDataFrame([(4, " ".join(["x under the MIT license"] * 20_000))], "doc_id long, text string"))).first()
    assert (found.n_words, found.n_base, found.first_word, found.last_word, found.labels) == (100_000, 20_000, 1, 99_996, "mit")
