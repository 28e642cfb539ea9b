"""Token counts by distinct pre-token (operator 7).

Pre-tokens are cut where no piece of the library can reach: before a run of spaces, beside a
line feed, and before those ASCII marks that follow no ASCII letter or digit in
any piece of the model. A text's count is the sum over its pre-tokens.

First all distinct pre-tokens of all texts are counted with their frequencies, and the library
counts each one's pieces once. Then each document's pre-token frequencies are joined to them:
the most frequent ones, ``FREQUENT`` and ``FREQUENT_BYTES`` at most, are summed in the scan, the
others join by a shuffle. No ids are made.

Rows: a null text is an empty one, of no tokens. Rows of the same id and text are summed as
one and given back as often as they stand; null ids are an id of their own. A long text is one row
with its own rare pre-tokens. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, id_text, map_slices
from echogrid.shared import materialize

#: Bound on what is broadcast: so many pre-tokens and bytes at most. One longer than ``SHORT`` is not: it stands at most once per so many bytes of text.
FREQUENT, FREQUENT_BYTES, SHORT = 400_000, 16 << 20, 4096
SPACE = "\u2581"


def cuts(model: bytes) -> re.Pattern[bytes]:
    """The pattern of pre-tokens: a word is cut before a mark that follows no word character in any piece."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)
    pieces = [library.id_to_piece(k) for k in range(library.get_piece_size()) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k))]
    beside = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
    if any(b == SPACE != a for a, b in beside):
        raise ValueError("pieces of this model reach across spaces")
    word = lambda c: c.isascii() and c.isalnum()
    marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} - {b for a, b in beside if word(a)}
    own = re.escape("".join(sorted(marks))).encode()
    first = rb" *[^ \n%b]+(?<=[0-9A-Za-z])(?=[%b])|" % (own, own) if own else b""
    return re.compile(first + rb" *[^ \n]+| +(?=\n|\Z)")


def pre_tokens(text: bytes, cut: re.Pattern[bytes]) -> tuple[list[bytes], int]:
    """The pre-tokens with their leading spaces, and how many line feeds, each a token of its own.

    The library puts one space before a text; nothing else starts with an added one. It reads
    the marker character itself as a space.
    """
    return cut.findall(b" " + text.replace(SPACE.encode(), b" ")) if text else [], text.count(b"\n")


def piece_counter(model: bytes) -> Callable[[list[bytes]], list[int]]:
    """Numbers of pieces of pre-tokens: what the library gives for them within a text."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)

    def count(tokens: list[bytes]) -> list[int]:
        # Behind a line feed the library adds nothing: its own space and the line feed are two pieces.
        return [len(x) - 2 for x in library.encode([b"\n".decode() + t.decode("utf-8", "replace") for t in tokens], num_threads=1)] if tokens else []

    return count


def vocabulary(docs: DataFrame, model: bytes) -> DataFrame:
    """``token binary, n, pieces``: all distinct pre-tokens, their occurrences and pieces."""
    cut = cuts(model)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter[bytes] = Counter()
            for t in byte_texts(batch):
                seen.update(pre_tokens(t, cut)[0])
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

        return each

    distinct = map_slices(docs, make, "token binary, n long", 32 << 20).groupBy("token").agg(F.sum("n").alias("n"))

    def counted() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = piece_counter(model)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(count(batch.column("token").to_pylist()), pa.int32())], ["token", "n", "pieces"])

        return each

    def run(batches):
        each = counted()
        for batch in batches:
            yield each(batch)

    return distinct.mapInArrow(run, "token binary, n long, pieces int")


def most_frequent(vocab: DataFrame, most: int, most_bytes: int = FREQUENT_BYTES) -> int:
    """The least count such that at most ``most`` tokens of ``most_bytes`` bytes have it or more, from sums over quarters of powers of two."""
    steps = vocab.where(F.length("token") <= SHORT).groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count("*").alias("k"), F.sum(F.length("token")).alias("b"))
    least, held, size = 1 << 62, 0, 0
    for r in sorted(steps.collect(), reverse=True):
        held, size = held + r.k, size + r.b
        if held > most or size > most_bytes:
            break
        least = -(-(2 ** (r.step / 4)) // 1)
    return int(least)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row per row of ``docs``."""
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    cut = cuts(model)
    base = id_text(docs)
    vocab = materialize(vocabulary(base.select("text"), model), "pieces")
    often = (F.col("n") >= most_frequent(vocab, frequent)) & (F.length("token") <= SHORT)
    known = spark.sparkContext.broadcast({bytes(r.token): r.pieces for r in vocab.where(often).select("token", "pieces").toLocalIterator()})

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        get = known.value.get

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, token, times, doc, size, own = [], [], [], [], [], []
            for k, i, t in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), byte_texts(batch), strict=True):
                tokens, n = pre_tokens(t, cut)
                rare: dict[bytes, int] = {}
                for x in tokens:
                    p = get(x)
                    if p is None:
                        rare[x] = rare.get(x, 0) + 1
                    else:
                        n += p
                # The document's own row joins nothing: no pre-token holds a line feed.
                key += [k] * (len(rare) + 1)
                token.append(b"\n" + k.to_bytes(8, "big", signed=True))
                token += rare
                times.append(1)
                times += rare.values()
                none = [None] * len(rare)
                doc += [i] * (len(rare) + 1)
                size += [len(t), *none]
                own += [n, *none]
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(token, pa.binary()), pa.array(times, pa.int32()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(own, pa.int64())], list("abcdef"))

        return each

    rows = map_slices(base.withColumn("key", F.xxhash64("doc_id", "text")), make, "key long, token binary, times int, doc_id long, n_bytes long, own long")
    joined = rows.join(vocab.where(~often).select("token", "pieces"), "token", "left")
    count = F.coalesce("own", F.col("times") * F.col("pieces")).cast("long")
    summed = joined.groupBy("doc_id", "key").agg(F.max("n_bytes").alias("n_bytes"), F.sum(count).alias("n"), F.count("own").alias("rows"))
    each = summed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    n = (F.col("n") / F.col("rows")).cast("long")
    return each.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
