"""I-Match fingerprints with randomised lexicons (operator 6).

The lexicon is the terms whose document frequency lies within ``BAND`` of all documents (so an
inverse-document-frequency band). If a document has d different terms on average, at most
d / BAND[0] terms can be that frequent, however many documents there are. A text's kept terms are
sorted, and for each of ``SUBSETS`` random subsets of the lexicon the kept terms in it are hashed.
A subset is thinned to the text: of m kept terms it holds about one (a rate of 2 to minus the
level, about log2 m), and at the next levels a half and a quarter, so that texts of up to four times
the terms have a level in common. Likeness is the share of equal hashes among the subsets of the
common levels that hold a term of either text; without a common level it is 0. Thinned so, a
subset keeps its hash with a chance of about 0.15 when half of a text's terms are others.
DataFrame functions only.

A lexicon of ``LISTED`` terms at most is a literal set within the scan (its count and bytes are
checked); a larger one is joined to the texts' terms by a shuffle, with the same result.

Rows: a null text is an empty one. A text without kept terms is fingerprinted by all its
terms, and is like another such text if these are equal. Repeated ids stay as rows; as
"next document" an id stands for its row of the smallest text hash. A null id sorts before all
others. A long text is one row; only half of its length travels. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.common import id_text
from echogrid.llm.license_scan import words
from echogrid.shared import materialize

BAND = (0.004, 0.04)
#: Subsets, and levels of thinning that a fingerprint holds; a hash is 48 bits in 8 characters.
SUBSETS, LEVELS, WIDE = 16, 3, 8
#: Stands for a subset without a term.
NONE = "-" * WIDE
#: A lexicon up to so many terms, of so many bytes in all, is a literal.
LISTED, LISTED_BYTES = 100_000, 4 << 20
#: Stands for a null id in joins; sorts before all others.
NO_ID = -(1 << 63)


def lexicon(terms: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """``term``: the terms within the band; ``terms`` has ``t``, each document's distinct terms."""
    counts = materialize(terms.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "terms")
    # No word is empty: that term stands for the documents.
    n = counts.where("term = ''").agg(F.max("df")).first()[0] or 0
    return counts.where((F.col("term") != "") & (F.col("df") >= band[0] * n) & (F.col("df") <= band[1] * n)).select("term")


def kept_terms(df: DataFrame, texts: dict[str, str], terms: DataFrame, listed: int = LISTED) -> DataFrame:
    """``df`` without the text columns; for each ``c``: ``c``, its terms of the lexicon, and ``c_every``, all its terms."""
    rest = [c for c in df.columns if c not in texts]
    every = df.select(*rest, *(F.array_distinct(words(F.col(c))).alias(f"{c}_every") for c in texts))
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
    if size.n <= listed and size.b <= LISTED_BYTES:
        # Terms are letters, digits and non-ASCII characters, so they need no escapes; one text is parsed faster than so many literals.
        names = ", ".join(f"'{r.term}'" for r in terms.toLocalIterator())
        within = lambda c: F.expr(f"filter({c}_every, t -> t IN ({names}))") if names else F.array().cast("array<string>")
        return every.select("*", *(within(c).alias(c) for c in texts))
    keyed = materialize(every.withColumn("_row", F.monotonically_increasing_id()), "imatch-rows")
    out = keyed
    for c in texts:
        found = keyed.select("_row", F.explode(f"{c}_every").alias("term")).join(terms, "term").groupBy("_row").agg(F.collect_list("term").alias(c))
        out = out.join(found, "_row", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out.drop("_row")


def with_fingerprints(df: DataFrame, texts: dict[str, str], terms: DataFrame, listed: int = LISTED) -> DataFrame:
    """``df`` without the text columns, each replaced by its fingerprint under the given name.

    Two digits of the level, the subsets' hashes at that level and the next two, and, for a text
    without kept terms, a hash of all its terms. Steps that are used often are columns of their
    own, so each is worked out once.
    """
    rest = [c for c in df.columns if c not in texts]
    kept = kept_terms(df, texts, terms, listed)
    # Each long deals four subsets 16 bits each: a term is in a subset's level if that many bits are 0.
    drawn = lambda c: F.transform(F.array_sort(c), lambda t: F.struct(t.alias("t"), *(F.xxhash64(t, F.lit(k)).alias(f"h{k}") for k in range(SUBSETS // 4))))
    level = lambda c: F.when(F.size(c) > 0, F.least(F.round(F.log2(F.size(c)) + 0.3), F.lit(16 - LEVELS))).otherwise(0).cast("int")
    alone = lambda c: F.when(F.size(c) == 0, F.md5(F.array_join(F.array_sort(f"{c}_every"), " ").cast("binary"))).otherwise("")
    sized = kept.select(*rest, *(x for c in texts for x in (drawn(c).alias(c), level(c).alias(f"{c}_level"), alone(c).alias(f"{c}_all"))))

    def thinned(terms: str, c: str, k: int, up: int) -> Column:
        mask = F.call_function("shiftleft", F.lit(1), F.col(f"{c}_level") + up).cast("long") - 1
        return F.filter(terms, lambda x: F.shiftright(x[f"h{k // 4}"], 16 * (k % 4)).bitwiseAND(mask) == 0)

    def hashed(members: Column) -> Column:
        return F.when(F.size(members) == 0, NONE).otherwise(F.base64(F.unhex(F.substring(F.lpad(F.hex(F.xxhash64(members)), 16, "0"), 5, 12))))

    # The levels are nested: the next ones are sought among the few terms of the first.
    first = sized.select("*", *(thinned(c, c, k, 0).alias(f"{c}_{k}") for c in texts for k in range(SUBSETS)))
    part = lambda c, k, up: F.col(f"{c}_{k}") if up == 0 else thinned(f"{c}_{k}", c, k, up)
    every = lambda c: F.concat(F.lpad(F.col(f"{c}_level").cast("string"), 2, "0"), *(hashed(part(c, k, up)) for up in range(LEVELS) for k in range(SUBSETS)), F.col(f"{c}_all"))
    return first.select(*rest, *(every(c).alias(name) for c, name in texts.items()))


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes over subsets of the common levels that hold a term of either text; without kept terms in both, equality."""
    one, most = SUBSETS * WIDE, 2 + LEVELS * SUBSETS * WIDE
    x, y = (F.substring(c, 1, 2).cast("int") for c in (a, b))
    skip = lambda p, q: F.greatest(q - p, F.lit(0)) * one
    part = lambda c, off, k: F.substr(c, 3 + off + k * WIDE, F.lit(WIDE))
    places = F.sequence(F.lit(0), (LEVELS - F.abs(x - y)) * SUBSETS - 1)
    pairs = F.transform(places, lambda k: F.struct(part(a, skip(x, y), k).alias("x"), part(b, skip(y, x), k).alias("y")))
    held = F.filter(pairs, lambda p: (p["x"] != NONE) | (p["y"] != NONE))
    same = F.size(F.filter(held, lambda p: p["x"] == p["y"])) / F.greatest(F.size(held), F.lit(1))
    bare = (F.length(a) > most) | (F.length(b) > most)
    return F.when(bare | (a == b), (a == b).cast("double")).when(F.abs(x - y) >= LEVELS, 0.0).otherwise(same)


def successors(ids: DataFrame) -> DataFrame:
    """``id, next``: for distinct ids the next one down, for the last the first.

    Ids are dealt by ranges; each range looks back by itself, and only the ranges' ends - one
    row for each partition - meet in one task.
    """
    spark = ids.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(ids.select("id").distinct().repartitionByRange(n, "id").withColumn("range", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("range").agg(F.max("id").alias("last"))
    every = Window.orderBy("range")
    ends = ends.select("range", F.coalesce(F.lag("last").over(every), F.max("last").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    own = F.lag("id").over(Window.partitionBy("range").orderBy("id"))
    return dealt.withColumn("own", own).join(ends, "range").select("id", F.coalesce("own", "before").alias("next"))


def edited(docs: DataFrame) -> DataFrame:
    """``id, doc_id, n, h, text, next, edited``: each document and its text whose end is the next one's beginning.

    Only as much of the next text as is needed travels: at most half as long as the receiver.
    """
    # Both joins need the same two columns, so the texts are shuffled once; all else is worked out behind the joins.
    base = id_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    needs = materialize(base.groupBy("id").agg(F.max(F.length("text")).alias("most")), "lengths")
    pairs = successors(needs).join(needs, "id").select(F.col("id").alias("receiver"), F.col("next").alias("id"), F.floor(F.col("most") / 2).cast("int").alias("need"))
    starts = base.join(pairs, "id").select("receiver", F.struct(F.xxhash64("text").alias("h"), F.expr("left(text, need)").alias("start")).alias("s"), F.col("id").alias("next"))
    starts = starts.groupBy("receiver", "next").agg(F.min("s").alias("s")).select(F.col("receiver").alias("id"), "next", F.col("s.start").alias("start"))
    both = base.join(starts, "id").withColumns({"doc_id": F.nullif("id", F.lit(NO_ID)), "n": F.length("text"), "h": F.xxhash64("text")})
    half = F.floor(F.col("n") / 2).cast("int")
    return both.withColumn("edited", F.concat(F.expr("left(text, n - cast(floor(n / 2) as int))"), F.substring(F.col("start"), F.lit(1), half)))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND, listed: int = LISTED) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    terms = lexicon(id_text(docs).select(F.array_distinct(words(F.col("text"))).alias("t")), band)
    both = edited(docs).select("id", "doc_id", F.col("n").cast("long").alias("n_chars"), "h", "next", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited")
    both = materialize(with_fingerprints(both, {"text": "fingerprint", "edited": "edited_fingerprint"}, terms, listed), "imatch")
    nexts = both.groupBy("id").agg(F.min(F.struct("h", "fingerprint")).alias("s")).select(F.col("id").alias("next"), F.col("s.fingerprint").alias("next_fingerprint"))
    return both.join(nexts, "next").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
