"""Operators 12 and 13 against their SQL and against direct versions, odd rows included."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from echogrid.llm import merkle_manifest, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, term string, pos long, tree string, hash string, n int"
ODD = [
    (1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (None, "a b\nc", "en", None, 5), (3, "A\nb", "en", "x", 3), (3, "A\nb", "en", "x", 3), (4, "\n", "en", "x", 1),
    (5, "été Été straße 日本 naïve", "fr", "é", 20), (6, "ab\x00cd 1a2b", "fr", "z", 10), (8, "word " * 30_000, "fr", "z", 150_000), (10, "only\nthese\n", "xx", "lonely", 12), (-7, None, "xx", "", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "t", 1, "u", "h", 2) for r in rows], SCHEMA).coalesce(3)


def in_duckdb(rows, sql):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(names)
    return order, sorted((tuple(dict(zip(names, r, strict=True))[n] for n in order) for r in found.fetchall()), key=repr)


def like_sql(df, rows, sql):
    names, expected = in_duckdb(rows, sql)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == expected
    return expected


def many():
    rows = list(ODD)
    for k in range(260):
        lang, source = ("en", "de")[k % 5 == 0], f"s{k % 7 % 4}"
        text = " ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[j % 26]}{'abcdefghij'[j // 26 % 10]}" * (1 + (j + k) % 3 // 2) for j in range(k % 11, 90 + k % 40, 1 + k % 3))
        rows.append((100 + k, text, lang, source, len(text)))
    return rows


def direct_divergence(rows):
    terms = lambda t: Counter("".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in t or "").split(" "))
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        found.pop("", None)
        count[lang, source].update(found)
        held[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = {t for t, d in held[lang].items() if d >= 30}
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * v) for t in kept}  # noqa: B023, E731
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            items = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}], "term": [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]}
            for part, found in items.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(x[0], lang, part, k, s, x[1]) for k, x in enumerate(found, 1) if part == "pair" or k <= 50]
    return sorted(out, key=repr)


def test_divergence_like_sql_and_directly(spark):
    rows = many()
    found = like_sql(source_divergence.divergence(frame(spark, rows)), rows, source_divergence.SQL)
    assert found == direct_divergence(rows)
    assert any(r[2] == "term" for r in found)


def test_divergence_ties_of_many_terms(spark):
    """More terms of one value than are ranked: those first in UTF-8 order stay."""
    rows = [(k, " ".join(f"t{chr(0xE0 + j % 20)}{chr(97 + j // 20)}" for j in range(120)), "en", "a", 9) for k in range(31)] + [(50, "other", "en", "b", 5)] * 40
    found = like_sql(source_divergence.divergence(frame(spark, rows)), rows, source_divergence.SQL)
    assert sum(r[2] == "term" and r[4] == "a" for r in found) == 50


@pytest.mark.parametrize("rows", [[], ODD[:1], [(1, "x y", "en", "a", 3)] * 3])
def test_divergence_small_tables(spark, rows):
    like_sql(source_divergence.divergence(frame(spark, rows)), rows, source_divergence.SQL)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def direct_manifest(rows):
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*map(spell, (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """The top, and per node the steps of (before, after)."""
        steps, ids = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(ids):
                run = at // 3 * 3
                steps[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
            ids = [at // 3 for at in ids]
            nodes = [sha(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        return nodes[0], steps

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r, leaf(r, r[1])))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = climb([x[1] for x in by[s]])
    root, tops = climb([trees[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (r, own), steps in zip(by[s], trees[s][1], strict=True):
            path = steps + top
            text = r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            h = leaf(r, text)
            for before, after in path:
                h = sha(before, h, after)
            out.append((r[0], h, own, sha(*(x for step in path for x in step)), root, trees[s][0], h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [[], ODD, ODD[:1], [(k, f"line\n{k}", "en", "one", 6) for k in range(28)], [(k, "t\n", "en", f"s{k}", 2) for k in range(11)], many()])
def test_manifest_like_sql_and_directly(spark, rows):
    df = merkle_manifest.manifest(frame(spark, rows))
    found = like_sql(df, rows, merkle_manifest.SQL)
    assert found == direct_manifest(rows)
    assert dict(df.dtypes)["verified"] == "boolean"


def test_proof_of_a_changed_row_fails(spark):
    rows = [(k, f"a\nb {k}", "en", "s", 5) for k in range(20)]
    got = {r.doc_id: r.verified for r in merkle_manifest.manifest(frame(spark, rows)).select("doc_id", "verified").collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 2 == 1 for k in range(20)}


def test_deep_trees_are_spread(spark):
    """A hot source of three thousand leaves: every proof leads to the one root."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("s"), F.col("id") % 40)).otherwise("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    out = merkle_manifest.manifest(docs)
    assert out.where("verified").count() == 4000 and out.select("root").distinct().count() == 1
