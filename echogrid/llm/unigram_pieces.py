"""Unigram segmentation by a double-array trie, and its decoding (operator 9).

The pieces are those of a sentencepiece model file; their log scores are the file's, or, as
the file at hand numbers its pieces by rank, ``-log(rank + 2)`` with ``zipf`` (the default). A
text is normalised as the library does: spaces become the marker, one marker goes before the
text. Viterbi finds the segmentation of the highest sum of scores; a character that no piece
holds costs the lowest score less 10 and becomes one piece per UTF-8 byte.

No piece holds a marker behind another character, so a best segmentation never crosses a
marker that follows another character, and words are segmented on their own: the distinct
words of a slice run through one vectorised Viterbi, all words at a time, over the trie's base
and check arrays. A word over ``LONG`` bytes (a run of Chinese or Japanese, an encoded file) has
no others of its length beside it and is walked byte by byte over the same arrays, in time and
memory proportional to its bytes.

Rows: null and empty texts give no pieces. Repeated ids and rows keep their rows. Equal scores
go to the piece that starts first. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import byte_texts, id_text, map_slices

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Words a task remembers; then it starts anew.
REMEMBERED = 400_000
#: Longest word that runs with the others of its length; a longer one is walked alone. Only shorter ones are remembered.
LONG = 64
_WORDS = re.compile(rb"(?:\xe2\x96\x81)+(?:(?!\xe2\x96\x81)[\x00-\xff])*|(?:(?!\xe2\x96\x81)[\x00-\xff])+")


class Trie:
    """Pieces as a double array over UTF-8 bytes: child of s by byte c is base[s] + c if check there is s."""

    def __init__(self, pieces: list[bytes], scores: list[float], ids: list[int], byte_ids: list[int], lowest: float):
        kids: list[dict[int, int]] = [{}]
        end: list[int] = [-1]
        for k, p in enumerate(pieces):
            s = 0
            for c in p:
                if c not in kids[s]:
                    kids[s][c] = len(kids)
                    kids.append({})
                    end.append(-1)
                s = kids[s][c]
            end[s] = k
        # Nodes of many children find room first; those of one child fill what is left, slot by slot.
        size = 2 * len(kids) + 70_000
        used, bases, free, low = np.zeros(size + 8192, bool), [0] * len(kids), 257, 1
        used[0], near = True, np.arange(128)[:, None]
        for node in sorted(range(len(kids)), key=lambda k: -len(kids[k])):
            marks = np.fromiter(kids[node], np.int64)
            if not len(marks):
                break
            while used[free]:
                free += 1
            if len(marks) == 1:
                b = free - int(marks[0])
            else:
                b = low
                while len(fits := np.flatnonzero(~used[b + near + marks].any(axis=1))) == 0:
                    b += len(near)
                b = low = b + int(fits[0])
            bases[node] = b
            used[b + marks] = True
        self.base, self.check, self.value = (np.full(size + 8192, x, np.int32) for x in (0, -1, -1))
        at, todo = {0: 0}, [0]
        while todo:
            node = todo.pop()
            slot = at[node]
            self.value[slot], self.base[slot] = end[node], bases[node]
            for c, child in kids[node].items():
                at[child] = bases[node] + c
                self.check[bases[node] + c] = slot
                todo.append(child)
        self.scores, self.ids = np.array(scores, np.float64), np.array(ids, np.int32)
        self.byte_ids, self.unknown = np.array(byte_ids, np.int32), lowest - UNKNOWN_PENALTY
        self._lists: tuple[list, ...] | None = None

    def segment(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            if n:
                if n > LONG:
                    out[k] = self._walk(w)
                else:
                    by_size.setdefault(n, []).append(k)
        for own in by_size.values():
            for at in range(0, len(own), 65_536):
                some = own[at : at + 65_536]
                for k, ids in zip(some, self._viterbi([words[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    def _walk(self, word: bytes) -> bytes:
        """The same for one long word, byte by byte."""
        if self._lists is None:
            self._lists = self.base.tolist(), self.check.tolist(), self.value.tolist(), self.scores.tolist()
        base, check, value, scores = self._lists
        n, low = len(word), -math.inf
        best, came, piece = array("d", [low]) * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == low or word[i] & 0xC0 == 0x80:
                continue
            width = i + 1
            while width < n and width < i + 4 and word[width] & 0xC0 == 0x80:
                width += 1
            single, state, j = False, 0, i
            while j < n:
                b = base[state]
                to = b + word[j]
                if b <= 0 or check[to] != state:
                    break
                state, j = to, j + 1
                v = value[to]
                if v >= 0:
                    single |= j == width
                    score = here + scores[v]
                    if score > best[j]:
                        best[j], came[j], piece[j] = score, i, v
            if not single:
                score = here + self.unknown
                if score > best[width]:
                    best[width], came[width], piece[width] = score, i, -1
        ids, at = array("i"), n
        while at:
            i, v = came[at], piece[at]
            if v >= 0:
                ids.append(self.ids[v])
            else:
                ids.extend(self.byte_ids[c] for c in reversed(word[i:at]))
            at = i
        ids.reverse()
        return np.array(ids, "<i4").tobytes()

    def _viterbi(self, words: list[bytes]) -> list[bytes]:
        """Words of one length: best score up to each byte, piece by piece, for all words at a time."""
        n, width = len(words), len(words[0])
        text = np.frombuffer(b"".join(words), np.uint8).reshape(n, width).astype(np.int32)
        head = (text & 0xC0) != 0x80
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        came, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero(head[:, i] & (best[i] > -np.inf))
            if not len(rows):
                continue
            size = np.ones(len(rows), np.int32)
            for j in range(i + 1, min(i + 4, width)):
                size += (~head[rows, j]) & (size == j - i)
            single = np.zeros(len(rows), bool)
            live, state, mine = rows, np.zeros(len(rows), np.int32), np.arange(len(rows))
            for j in range(i, width):
                to = self.base[state] + text[live, j]
                ok = (self.check[to] == state) & (self.base[state] > 0)
                if not ok.any():
                    break
                live, state, mine = live[ok], to[ok], mine[ok]
                val = self.value[state]
                hit = val >= 0
                if hit.any():
                    r, v = live[hit], val[hit]
                    single[mine[hit]] |= size[mine[hit]] == j + 1 - i
                    score = best[i, r] + self.scores[v]
                    better = score > best[j + 1, r]
                    r, v = r[better], v[better]
                    best[j + 1, r], came[j + 1, r], piece[j + 1, r] = score[better], i, v
            for length in np.unique(size[~single]):
                r = rows[(~single) & (size == length)]
                score = best[i, r] + self.unknown
                better = score > best[i + length, r]
                r = r[better]
                best[i + length, r], came[i + length, r], piece[i + length, r] = score[better], i, -1
        # Walk back for all words at once; ids stand at the byte where their piece starts.
        marks = np.full((n, width), -1, np.int32)
        at, every = np.full(n, width, np.int32), np.arange(n)
        while len(every):
            frm, k = came[at, every], piece[at, every]
            known = k >= 0
            marks[every[known], frm[known]] = self.ids[k[known]]
            for off in range(4):
                bad = (~known) & (frm + off < at)
                marks[every[bad], frm[bad] + off] = self.byte_ids[text[every[bad], frm[bad] + off]]
            at = frm
            left = at > 0
            at, every = at[left], every[left]
        counts = (marks >= 0).sum(axis=1)
        flat = marks[marks >= 0].astype("<i4").tobytes()
        ends = np.cumsum(counts) * 4
        return [flat[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


class Pieces:
    """The pieces of a model file, ready to encode and decode."""

    def __init__(self, model: bytes, zipf: bool = True):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        byte_ids = [sp.piece_to_id(f"<0x{c:02X}>") for c in range(256)]
        score = (lambda k, r: -float(np.log(r + 2))) if zipf else (lambda k, r: sp.get_score(k))
        scores = [score(k, r) for r, k in enumerate(plain)]
        self.trie = Trie([sp.id_to_piece(k).encode() for k in plain], scores, plain, byte_ids, min(scores))
        self.bytes = [b""] * n
        for k in plain:
            self.bytes[k] = sp.id_to_piece(k).encode()
        for c, k in enumerate(byte_ids):
            self.bytes[k] = bytes([c])
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit bytes."""
        cut = [_words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list(set().union(*cut).difference(self.known))
        new = dict(zip(fresh, self.trie.segment(fresh), strict=True))
        self.known.update(p for p in new.items() if len(p[0]) <= LONG)
        return [b"".join([self.known.get(w) or new[w] for w in x]) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids: bytes joined, markers to spaces, the first one dropped."""
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist())).replace(MARK, b" ")
        return text[1:] if text[:1] == b" " else text


def _words(text: bytes) -> list[bytes]:
    if not text:
        return []
    if MARK in text:
        return _WORDS.findall(MARK + text.replace(b" ", MARK))
    first, *rest = text.split(b" ")
    if b"" not in rest and first:
        return [MARK + w for w in (first, *rest)] if rest or first else []
    return _WORDS.findall(MARK + text.replace(b" ", MARK))


def encode(docs: DataFrame, model_path: str, zipf: bool = True) -> DataFrame:
    """``doc_id, ids binary, text string``: the ids and the text that they decode to."""
    return _mapped(docs, model_path, zipf, "doc_id long, ids binary, text string", lambda p, i, texts, ids: [i, pa.array(ids, pa.binary()), pa.array([p.decode(x).decode("utf-8", "replace") for x in ids], pa.string())])


def digests(docs: DataFrame, model_path: str, zipf: bool = True) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, exact`` of every document.

    ``exact``: the decoded text equals the text (a text's own marker characters come back as spaces).
    """

    def made(p: Pieces, i: pa.Array, texts: list[bytes], ids: list[bytes]) -> list[pa.Array]:
        import hashlib

        back = [p.decode(x) for x in ids]
        is_byte = np.array([len(b) == 1 for b in p.bytes]) & np.isin(np.arange(len(p.bytes)), p.trie.byte_ids)
        return [
            i,
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([int(is_byte[np.frombuffer(x, "<i4")].sum()) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            pa.array([x == t for x, t in zip(back, texts, strict=True)], pa.bool_()),
        ]

    return _mapped(docs, model_path, zipf, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean", made)


def _mapped(docs: DataFrame, model_path: str, zipf: bool, schema: str, made: Callable) -> DataFrame:
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Pieces(f.read(), zipf))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        p = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = byte_texts(batch)
            out = made(p, batch.column("doc_id"), texts, p.encode(texts))
            return pa.RecordBatch.from_arrays(out, [str(k) for k in range(len(out))])

        return each

    return map_slices(id_text(docs), make, schema)
