"""Token-id files of compressed bit or byte planes with a chunk index (operator 2).

Documents are dealt to shards by ranges of ascending id; each shard is a run of chunks, and a
chunk holds whole documents. A chunk's ids are cut into blocks of ``BLOCK`` ids; in each block
the ids are transposed into planes (bits or bytes, least significant first), plane by plane
over the chunk, and every plane is one zstandard frame. A row of the written table is a chunk:

``shard, chunk, inside, n_ids, doc_ids, lengths, width, planes`` - ``planes`` the frames and the
rest the chunk's index, so a reader opens any chunk on its own and reads only the index columns
to find a document. ``inside``: ids of the shard before the chunk; with the shards' totals, one row
a shard, it gives the ids of all documents before, and no plane is shuffled to find it.

Rows: a null text is an empty one, of only the end id. Null ids sort first. Repeated ids keep
their rows, in the order of their texts. A document longer than a chunk is a chunk of its own.
Other columns are not read. An empty table gives an empty file.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, id_text, slices
from echogrid.shared import new_path

BLOCK = 4096
#: Ids after which a chunk is closed; a longer document is a chunk of its own.
CHUNK = 1 << 18
#: Bytes of text of a shard, about; a shard is sorted by one task.
SHARD_BYTES = 128 << 20
#: Words whose ids a task remembers; then it starts anew.
REMEMBERED = 250_000
LEVEL = 1
SCHEMA = "shard int, chunk int, inside long, n_ids long, doc_ids array<long>, lengths array<long>, width int, planes array<binary>"
#: White space at which a text may be cut without changing any id: no token of the library spans it.
CUT = bytes.maketrans(b"\t\n\r", b"   ")
#: Latin letters that no normalisation changes but for their case, then ASCII marks other than the apostrophe.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def split_planes(ids: np.ndarray, bits: bool = False) -> tuple[int, list[bytes]]:
    """Width in bytes and the planes, each over the blocks in order; the last block is filled with zeros."""
    width = 1 + (int(ids.max(initial=0)).bit_length() - 1) // 8 if len(ids) else 1
    n = -(-len(ids) // BLOCK) * BLOCK
    full = np.zeros(n, "<u4")
    full[: len(ids)] = ids
    blocks = full.view(np.uint8).reshape(-1, BLOCK, 4)[:, :, :width]
    if not bits:
        return width, [np.ascontiguousarray(blocks[:, :, k]).tobytes() for k in range(width)]
    each = np.unpackbits(np.ascontiguousarray(blocks), axis=2, bitorder="little")
    return width, [np.packbits(each[:, :, k], axis=1, bitorder="little").tobytes() for k in range(8 * width)]


def join_planes(planes: list[bytes], width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of planes as ``split_planes`` gives them."""
    if len(planes) == width:
        full = np.zeros((len(planes[0]), 4), np.uint8)
        for k, p in enumerate(planes):
            full[:, k] = np.frombuffer(p, np.uint8)
        return full.reshape(-1).view("<u4")[:n]
    each = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little") for p in planes], axis=1)
    full = np.zeros((len(each), 4), np.uint8)
    full[:, :width] = np.packbits(each, axis=1, bitorder="little")
    return full.reshape(-1).view("<u4")[:n]


def byte_alphabet() -> dict[int, str]:
    """Latin-1 character codes to the characters that stand for their UTF-8 bytes in byte-level vocabularies."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    shown = {c: chr(c) for c in plain} | {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in plain)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


def word_encoder(tokenizer_path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Texts to their ids as little-endian 32-bit bytes; each distinct word is encoded once and remembered.

    The library never joins what white space parts, and drops the white space itself, so a
    text's ids are its words' ids one after the other. It also cuts a word of letters from
    the marks behind it; such words go in lower case to the library's model, without the
    normaliser and the pre-tokeniser, which would leave them as they are. All other words,
    and words with an apostrophe, go through the whole library.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = Tokenizer.from_str(f.read())
    model, alphabet = tokenizer.model, byte_alphabet()
    known: dict[bytes, bytes] = {}
    parts: dict[str, bytes] = {}
    whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    if whole("One, two\tthree\n\nfour's  <s> x1 \u6771 end") != [k for w in ("One,", "two", "three", "four's", "<s>", "x1", "\u6771", "end") for k in whole(w)]:
        raise ValueError("tokens of this vocabulary reach across white space")

    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def learn(word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = SIMPLE.fullmatch(text) if simple else None
        if m is None:
            return packed(tokenizer.encode(text, add_special_tokens=False).ids)
        letters, marks = m[1].lower(), m[2]
        out = parts.get(letters)
        if out is None:
            out = parts[letters] = packed([t.id for t in model.tokenize(letters.translate(alphabet))])
        if marks:
            if marks not in parts:
                parts[marks] = packed(tokenizer.encode(marks, add_special_tokens=False).ids)
            out += parts[marks]
        return out

    # The short cut holds if the library agrees on words of all its letters and marks.
    letters = [chr(c) for c in range(256) if SIMPLE.fullmatch(chr(c))]
    marks = [chr(c) for c in range(33, 127) if SIMPLE.fullmatch("a" + chr(c))]
    probes = letters + [f"{a}{b}e" for a, b in zip(letters, letters[7:], strict=False)] + [f"Ward{m}" for m in marks] + [f"\u00e9t{m}{n}" for m, n in zip(marks, marks[3:], strict=False)]
    simple = True
    simple = all(learn(w.encode()) == packed(whole(w)) for w in probes)

    def encode(texts: list[bytes]) -> list[bytes]:
        words = [t.translate(CUT).split(b" ") for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
            parts.clear()
        for w in set().union(*words).difference(known):
            known[w] = learn(w)
        return [b"".join(map(known.__getitem__, x)) for x in words]

    return encode


def shards_for(texts: DataFrame) -> int:
    """Shards by the bytes of all texts, so that a shard's size does not grow with the table."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, bits: bool = False, shards: int | None = None) -> None:
    """Encode and write all documents, ascending by id."""
    n = shards or shards_for(id_text(docs))
    dealt = id_text(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("shard", F.spark_partition_id())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, pack = word_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=LEVEL)
        held: list[tuple[int | None, bytes]] = []
        size = number = shard = inside = 0

        def closed() -> pa.RecordBatch:
            width, planes = split_planes(np.frombuffer(b"".join(x for _, x in held), "<u4"), bits)
            row = {"shard": shard, "chunk": number, "inside": inside, "n_ids": size, "doc_ids": [i for i, _ in held], "lengths": [len(x) // 4 for _, x in held], "width": width, "planes": [pack.compress(p) for p in planes]}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for part in slices(batches, 4 << 20):
            shard = part.column("shard")[0].as_py()
            for i, x in zip(part.column("doc_id").to_pylist(), encode(byte_texts(part)), strict=True):
                held.append((i, x + end))
                size += len(x) // 4 + 1
                if size >= CHUNK:
                    yield closed()
                    held, size, number, inside = [], 0, number + 1, inside + size
        if held:
            yield closed()

    dealt.mapInArrow(chunks, SCHEMA).write.parquet(path)


ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("inside", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()), ("planes", pa.list_(pa.binary()))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written chunks with ``before``: ids in all chunks before, from the index columns.

    Only the shards' totals, one row a shard, meet in one task and are broadcast; the chunks stay
    where they are read.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return stored.join(F.broadcast(bases), "shard").withColumn("before", F.col("base") + F.col("inside")).drop("base")


def documents(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian 32-bit) of every document of ``read``."""
    return stored.mapInArrow(_decode(lambda ids: pa.array([x.tobytes() for x in ids], pa.binary())), "doc_id long, start long, n_tokens long, ids binary")


def digests(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of ``read``."""
    return stored.mapInArrow(_decode(lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64())), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _decode(made: Callable[[list[np.ndarray]], pa.Array]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = join_planes([unpack.decompress(p) for p in row["planes"]], row["width"], row["n_ids"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [np.ascontiguousarray(x) for x in np.split(ids, ends[:-1])]
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends - lengths), pa.array(lengths), made(parts)]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "c", "d"])

    return run


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 1, bits: bool = False) -> DataFrame:
    """Write ``docs`` to the shared folder and return the digests of what is read back."""
    spark = docs.sparkSession
    path = new_path(spark, "planes")
    write(docs, path, tokenizer_path, end_id, bits)
    return digests(read(spark, path))
