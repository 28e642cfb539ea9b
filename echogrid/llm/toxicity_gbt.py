"""Toxicity: boosted trees over dense features with isotonic calibration (operator 8).

The labelled rows of each class are dealt by the rank of their ids' hashes into eight parts. On
four, words and word beginnings are counted in toxic and clean documents (a distributed count),
which gives a lexicon of log-odds weights; on three the trees learn from the features; on one,
apart from both, the scores are calibrated by a curve that never falls. Features: hits, distinct
hits and weights of the lexicon a word, the strongest weights, hits near a second-person word,
hits of words only readable after undoing obfuscation, rates of capitals, punctuation and
obfuscated words, and the length. They are worked out on the executors over whole texts; only
these numbers, at most ``2 * SAMPLE`` rows, reach the driver.

Bounds: at most ``SAMPLE`` labelled documents of each class are learnt from (chosen by the
hash of their ids). A lexicon entry stands in ``LEAST`` toxic documents and has log-odds of
``ODDS`` at least; of these the ``LEXICON`` entries of the most weight in all toxic documents stay.
All documents are scored.

Rows: null and empty texts have all features zero and get a score like any other. Labels of
unknown documents, null ids and null labels are not used; of an id with contradictory labels the
larger counts, of an id with several texts the least one is learnt from. Repeated rows are scored
row by row, equal texts alike. If a class has no rows for the trees or the calibration (fewer
than two), the score is the share of toxic labels, or 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.boosted import calibrated, fit_isotonic, fit_trees, tree_scores
from echogrid.llm.common import crc_mod, id_text, map_slices
from echogrid.shared import materialize

SAMPLE, LEXICON, LEAST, ODDS, HELD_OUT, MOD, THRESHOLD = 6000, 3000, 3, 2.5, 2, 4, 0.3
#: Words between a hit and a second-person word that is near.
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
EDGES = ".,!?%$&*#|:;\"'()[]{}<>-_~`=+/\\"
_LEET = str.maketrans("013457@$", "oieastas")
_INNER = re.compile(r"(?<=\w)[.\-_*|]+(?=\w)")
_REPEAT = re.compile(r"(.)\1{2,}")
_ODD = re.compile(r"\d|@|\$|(?<=\w)[.\-_*|](?=\w)|(.)\1{2,}")
NAMES = ("hits", "kinds", "weight", "strongest", "second", "near_you", "hidden", "capitals", "punctuation", "odd", "words")


def plain(word: str) -> str:
    """A lower-cased word with look-alike characters, inner marks and stretched letters undone."""
    return _REPEAT.sub(r"\1", _INNER.sub("", word.translate(_LEET)))


def keys(word: str) -> tuple[str, ...]:
    """What a word is looked up by: itself and its beginnings."""
    return (word, f"{word[:4]}*", f"{word[:5]}*") if len(word) >= 6 else (word,)


def features(text: str, lexicon: dict[str, float], known: dict[str, float]) -> list[float]:
    """The dense features of one text; ``known`` remembers words' weights (negative: obfuscated)."""
    raw = text.split()
    if not raw:
        return [0.0] * len(NAMES)
    if len(known) > 300_000:
        known.clear()
    hits, kinds, total, top, near, hidden, odd, last_you, pending = 0, set(), 0.0, [], 0, 0, 0, -99, -99
    for at, token in enumerate(raw):
        w = known.get(token)
        if w is None:
            low = token.lower().strip(EDGES)
            w = max((lexicon.get(k, 0.0) for k in keys(low)), default=0.0) + 0.0
            if not w and _ODD.search(low):
                w = -1e-6 - max((lexicon.get(k, 0.0) for k in keys(plain(low))), default=0.0)
            if low in SECOND_PERSON:
                w = 1e-9
            known[token] = w
        if not w:
            continue
        if w == 1e-9:
            last_you = at
            near += at - pending <= NEAR
            continue
        if w < 0:
            odd += 1
            w = -w - 1e-6
            if w < 1e-3:
                continue
            hidden += 1
        hits += 1
        kinds.add(token.lower())
        total += w
        top.append(w)
        near += at - last_you <= NEAR
        pending = at
    top.sort(reverse=True)
    n, size = len(raw), len(text)
    letters, marks = len(_UPPER.findall(text)), len(_MARKS.findall(text))
    return [hits / n, len(kinds), total / n, top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, near / n, hidden / n, letters / size, marks / size, odd / n, float(np.log1p(n))]


_UPPER, _MARKS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[!?*$%&#@]")


class Model:
    """Lexicon, trees and calibration; what ``score`` needs on the executors."""

    def __init__(self, lexicon: dict[str, float], trees, knots):
        self.lexicon, self.trees, self.knots, self.known = lexicon, trees, knots, {}

    def raw(self, texts: list[str]) -> np.ndarray:
        return tree_scores(self.trees, np.array([features(t, self.lexicon, self.known) for t in texts]).reshape(-1, len(NAMES)))

    def score(self, texts: list[str]) -> np.ndarray:
        return calibrated(self.knots, self.raw(texts)) if self.trees else np.full(len(texts), self.knots)


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int, mod: int, most: int) -> DataFrame:
    """``doc_id, text, y, weight, part``: at most ``most`` labelled learning documents of each class, by the hash of their ids.

    ``weight``: labelled documents that a row of its class stands for; ``part``: 0 to 7, dealt in
    turn within each class, so that each part has rows of each class. The chosen ids, at most
    twice ``most``, are the only rows that are ranked or broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), mod) != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        one = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = one if chosen is None else chosen.unionByName(one)
    totals = usable.groupBy(F.col("y").alias("of")).agg(F.count("*").alias("n"))
    chosen = materialize(chosen, "labelled")
    weights = chosen.groupBy("y").agg(F.count("*").alias("k")).join(totals, F.col("y") == F.col("of")).select("y", (F.col("n") / F.col("k")).alias("weight"))
    own = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1
    parts = own.select("doc_id", "y", (turn % 8).alias("part"))
    return own.join(F.broadcast(parts.join(F.broadcast(weights), "y").drop("y")), "doc_id")


def lexicon_of(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of the words and word beginnings of labelled rows, smoothed by half a document."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(k, y) for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True) for k in terms(t)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["key", "y"])

        return each

    counts = map_slices(rows.select("text", "y"), make, "key string, y int").groupBy("key").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1)))
    kept = counts.where(F.col("t") >= LEAST).withColumn("w", odds).where(F.col("w") > ODDS)
    return {r.key: r.w for r in kept.orderBy(F.desc(F.col("w") * F.col("t")), "key").limit(LEXICON).collect()}


def terms(text: str) -> set[str]:
    """What a text counts for in the lexicon: its plain words and their beginnings."""
    found = {x.lower().strip(EDGES) for x in text.split()}
    found = {plain(w) if _ODD.search(w) else w for w in found} - {""}
    return {k for w in found for k in keys(w)}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    rows = materialize(sample(docs, labels, "toxic", HELD_OUT, MOD, SAMPLE), "toxic-sample")
    sizes = {(r.y, r.part): r["count"] for r in rows.groupBy("y", "part").count().collect()}
    if not all((y, part) in sizes for y in (0, 1) for part in (0, 1)):
        n = sum(sizes.values())
        return Model({}, None, sum(v for (y, _), v in sizes.items() if y == 1) / n if n else 0.0)
    toxic, clean = (sum(v for (of, part), v in sizes.items() if of == y and part >= 4) for y in (1, 0))
    lexicon = lexicon_of(rows.where("part >= 4"), toxic, clean)
    shared = spark.sparkContext.broadcast(lexicon)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        own, known = shared.value, {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = pa.array([features(t, own, known) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("part"), batch.column("weight"), x], list("abcde"))

        return each

    found = sorted(map_slices(rows.where("part < 4").select("doc_id", "text", "y", "part", "weight"), make, "doc_id long, y int, part int, weight double, x array<double>").collect())
    x, y, part, weight = np.array([r.x for r in found]), np.array([r.y for r in found], float), np.array([r.part for r in found]), np.array([r.weight for r in found])
    trees = fit_trees(x[part > 0], y[part > 0])
    return Model(lexicon, trees, fit_isotonic(tree_scores(trees, x[part == 0]), y[part == 0], weight[part == 0]))


def scorer(model: Model, spark) -> Callable:
    """A column function: score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for part in parts:
            yield pd.Series(own.score([t or "" for t in part]))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``."""
    score = scorer(learn(docs, labels), docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), MOD) == HELD_OUT, F.lit(False))
    scored = id_text(docs).select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored as toxic; all columns stay, in no new order."""
    score = scorer(learn(docs, labels), docs.sparkSession)
    return docs.where(score(F.col("text").cast("string")) < THRESHOLD)
