"""Audit of how sources differ from their language and from each other (operator 12).

Terms are counted once per slice of texts and summed by (lang, source, term), so what is
shuffled grows with distinct terms, not with words. A language keeps the terms that at least
``LEAST`` of its documents hold; ``V`` is their number. A smoothed share is
``1 + floor(10^9 (count + 5) / (N + 5 V))``, in decimals, so nothing is rounded.

Ranking of terms by cells: the terms of a group that agree in (group count, language count)
are one cell, and the difference is evaluated once a cell. Cells of one value merge, and a
value stays if fewer than ``TOP`` terms stand before it: first within parts of the values,
so that no task meets all values of a group, then among those left. Only the terms of these
cells are expanded, in UTF-8 order within a value.

Pairs of sources: the sum over all kept terms is taken apart. With p0 the share of a count of
zero, a term that one of the sources lacks needs no partner: its difference from the other's
p0 is summed by cell. Only terms that both hold meet, in one join by term.

Rows: null text, lang and source count as ''. Repeated rows count as often as they stand. A
group without terms has counts of zero; with ``V = 0`` the shares are not defined and the
value of a pair is 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, slices
from echogrid.shared import materialize

#: Documents of a language that must hold a term, terms that are ranked, and what is added to a count.
LEAST, TOP, ADDED = 30, 50, 5
SCALE = 1_000_000_000
#: Parts of the values of one group that are ranked before all are.
PARTS = 64
#: Letters A to Z in lower case; other bytes below 128 part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of each slice of documents; a group's row without term shows that it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16 << 20):
            times, held = defaultdict(Counter), defaultdict(Counter)
            for group, text in zip(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True), byte_texts(part), strict=True):
                found = Counter(text.translate(_FOLD).split())
                times[group].update(found)
                held[group].update(found.keys())
            for (lang, source), found in times.items():
                terms = [None, *(t.decode() for t in found)]
                same = lambda x: pa.array([x]).take(pa.array([0] * len(terms)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.string()), pa.array([0, *found.values()], pa.int64()), pa.array([1, *(held[lang, source][t] for t in found)], pa.int64())], ["lang", "source", "term", "n", "docs"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    sums = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def with_share(df: DataFrame, name: str, count: str, total: str) -> DataFrame:
    """``df`` with the smoothed share in parts of ``SCALE``, exactly; null without kept terms (column ``v``)."""
    exact = f"1 + ((cast({count} AS decimal(20,0)) + {ADDED}) * cast({SCALE} AS decimal(10,0))) div (cast({total} AS decimal(20,0)) + {ADDED} * cast(v AS decimal(20,0)))"
    return df.withColumn(name, F.expr(f"CASE WHEN v > 0 THEN {exact} END"))


def ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def top_terms(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a group uses most above its language."""
    cells = terms.groupBy("lang", "source", "g", "l").agg(F.count("*").alias("m")).join(stats, ["lang", "source"])
    cells = with_share(with_share(cells, "p", "g", "n"), "q", "l", "all_n").where("p > q").withColumn("f", F.col("p") - F.col("q"))
    cells = materialize(cells.select("lang", "source", "g", "l", "f", "m"), "divergence-cells")
    values = cells.groupBy("lang", "source", "f").agg(F.sum("m").alias("m"))
    for keys in (["lang", "source", F.pmod(F.xxhash64("f"), F.lit(PARTS))], ["lang", "source"]):
        before = F.sum("m").over(Window.partitionBy(*keys).orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1))
        values = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TOP).drop("before")
    some = cells.join(values.select("lang", "source", "f"), ["lang", "source", "f"]).select("lang", "source", "g", "l", F.col("f").alias("value"))
    return ranked(terms.join(some, ["lang", "source", "g", "l"]).select("lang", "source", F.col("term").alias("item"), "value")).where(F.col("rank") <= TOP)


def pairs(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: how far each two sources of a language are apart."""
    stats = with_share(stats.withColumn("zero", F.lit(0)), "z", "zero", "n")
    own = stats.select("lang", "source", "v", "held", "z")
    side = lambda c: own.select("lang", *(F.col(n).alias(n + c) for n in ("source", "held", "z")))
    both = side("_a").join(own.select("lang", "v", *(F.col(n).alias(n + "_b") for n in ("source", "held", "z"))), "lang").where("source_a <> source_b")

    counts = with_share(terms.groupBy("lang", "source", "g").agg(F.count("*").alias("m")).join(stats.select("lang", "source", "n", "v"), ["lang", "source"]), "p", "g", "n")
    alone = counts.select("lang", F.col("source").alias("source_a"), "p", "m").join(side("_b").drop("held_b"), "lang").where("source_a <> source_b")
    alone = alone.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("z_b"))).alias("alone"))

    p = with_share(terms.join(stats.select("lang", "source", "n", "v", "z"), ["lang", "source"]), "p", "g", "n")
    half = lambda c: p.select("lang", "term", *(F.col(n).alias(n + c) for n in ("source", "p", "z")))
    gain = F.expr("abs(p_a - p_b) - abs(p_a - z_b) - abs(p_b - z_a) + abs(z_a - z_b)")
    met = half("_a").join(half("_b"), ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(gain).alias("met"))
    met = materialize(met, "divergence-met")

    turned = lambda df, v: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), v)
    sums = alone.unionByName(turned(alone, "alone")).withColumnRenamed("alone", "x").unionByName(met.unionByName(turned(met, "met")).withColumnRenamed("met", "x"))
    keys = ["lang", "source_a", "source_b"]
    found = both.join(sums.groupBy(*keys).agg(F.sum("x").alias("x")), keys, "left")
    value = F.coalesce("x", F.lit(0)) + F.coalesce((F.col("v") - F.col("held_a") - F.col("held_b")) * F.abs(F.col("z_a") - F.col("z_b")), F.lit(0))
    return ranked(found.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("value")))


def divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: both parts of the audit."""
    sums = materialize(counted(docs), "divergence-sums")
    every = Window.partitionBy("lang", "term")
    terms = (
        sums.where("term IS NOT NULL")
        .select("lang", "source", "term", F.col("n").alias("g"), F.sum("n").over(every).alias("l"), F.sum("docs").over(every).alias("d"), (F.col("source") == F.min("source").over(every)).cast("long").alias("one"))
        .where(F.col("d") >= LEAST)
        .drop("d")
    )
    terms = materialize(terms, "divergence-terms")
    groups = sums.where("term IS NULL").select("lang", "source")
    of_group = terms.groupBy("lang", "source").agg(F.sum("g").alias("n"), F.count("*").alias("held"), F.sum("one").alias("ones"))
    of_lang = of_group.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("ones").alias("v"))
    none = {c: F.coalesce(c, F.lit(0)) for c in ("n", "held", "all_n", "v")}
    stats = groups.join(of_group.drop("ones"), ["lang", "source"], "left").join(of_lang, "lang", "left").withColumns(none)
    stats = materialize(stats, "divergence-stats")
    out = pairs(terms, stats).withColumn("part", F.lit("pair")).unionByName(top_terms(terms, stats).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


SQL = f"""
WITH docs AS (SELECT coalesce(CAST(lang AS VARCHAR), '') AS lang, coalesce(CAST(source AS VARCHAR), '') AS source, row_number() OVER () AS k,
    translate(coalesce(CAST(text AS VARCHAR), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT lang, source, k, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
l AS (SELECT lang, term, count(*) AS l FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST}),
g AS (SELECT lang, source, term, count(*) AS g FROM words SEMI JOIN l USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(l) AS nl FROM l GROUP BY lang),
totals AS (SELECT lang, source, sum(g) AS n FROM g GROUP BY lang, source),
dense AS (SELECT lang, source, term, coalesce(g, 0) AS g, l,
    1 + CAST({SCALE} AS HUGEINT) * (coalesce(g, 0) + {ADDED}) // (coalesce(n, 0) + {ADDED} * v) AS p,
    1 + CAST({SCALE} AS HUGEINT) * (l + {ADDED}) // (nl + {ADDED} * v) AS q
    FROM groups JOIN l USING (lang) JOIN langs USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN g USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE g > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranks WHERE part = 'pair' OR rank <= {TOP}
"""
