"""SentencePiece encoding and decoding in batched numpy.

A text falls into segments wherever two neighbouring characters stand together in
no piece.  Distinct segments of equal length advance together: hashes of all their
substrings probe the sorted keys of the pieces, vectorised maxima over the last piece
fill a Viterbi table and store backpointers.  The best path has the highest sum of
scores; for BPE files, whose scores only rank merges, the fewest pieces and then the highest
sum.  Unknown characters become byte pieces where the model has them.

The ids that the library gives for a BPE file follow the order of merges, which is no best
path.  For such files they are to be had as well, from the same tables: vectorised
maxima choose each segment's next merge.
"""

from __future__ import annotations

import heapq
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .tokens import slices
from .words import _BASE, _INVERSE, _power, mix

SPACE = "▁"
#: Segments whose ids a worker keeps. Results don't depend on it.
KEEP = 800_000
_LONG = 96
_CUT = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields; 32- and 64-bit values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Pieces:
    """A vocabulary: pieces with scores, how to segment, and how to normalise."""

    def __init__(self, pieces: list[str], scores: list[float], *, bpe: bool, unknown: int = 0, other: dict[int, int | None] | None = None, prefix: bool = True, normalize=None):
        """other: ids that no text matches, with the byte they stand for or None."""
        other = other or {}
        self.bpe, self.unknown, self.prefix, self.normalize = bpe, unknown, prefix, normalize
        self.byte = np.full(256, -1, np.int64)
        for k, b in other.items():
            if b is not None:
                self.byte[b] = k
        self.fallback = bool((self.byte >= 0).all())
        self.raw = [bytes([other[k]]) if k in other and other[k] is not None else b"" if k in other else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        own = [k for k in range(len(pieces)) if k not in other and pieces[k]]
        self.longest = max((len(pieces[k]) for k in own), default=1)
        key = np.array([self._key(pieces[k]) for k in own], np.uint64)
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array(own, np.int64)[order]
        self.scores = np.array([scores[k] for k in own], np.float64)[order]
        # a BPE file's scores are ranks of merges, not weights: the best path has the fewest pieces, then the best ranks
        self.weights = self.scores / 1e12 - 1 if bpe else self.scores
        self.worst = float(self.weights.min(initial=0)) - 10  # of an unknown character
        near = {(ord(a) << 21) | ord(b) for k in own for a, b in zip(pieces[k], pieces[k][1:], strict=False)}
        self.near = np.array(sorted(near), np.uint64)
        self.known = {pieces[k]: (scores[k], k) for k in own}
        self.kept: dict[bool, dict[int, bytes]] = {True: {}, False: {}}

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & ((1 << 64) - 1)
        return int(mix(np.array([(h + len(piece)) & ((1 << 64) - 1)], np.uint64))[0])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        spec = {2: b"", 3: b""} | {f: v for f, v in _fields(sp.serialized_model_proto()) if f in (2, 3)}
        norm = dict(_fields(spec[3]))
        plain = not norm.get(2) and norm.get(4, 1) == 0
        other: dict[int, int | None] = {k: None for k in range(n) if sp.is_unknown(k) or sp.is_control(k) or sp.is_unused(k)}
        other |= {k: int(sp.id_to_piece(k)[3:5], 16) for k in range(n) if sp.is_byte(k)}
        return cls([sp.id_to_piece(k) for k in range(n)], [sp.get_score(k) for k in range(n)], bpe=dict(_fields(spec[2])).get(3, 1) == 2, unknown=sp.unk_id(), other=other, prefix=bool(norm.get(3, 1)), normalize=None if plain else sp.normalize)

    def _table(self, cp: np.ndarray, path: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(weight on a path, or score of a merge, and id) of every substring of equal-length segments, [length - 1, segment, start]; -inf where no piece is."""
        n, size = cp.shape
        most, scores = min(self.longest, size), self.weights if path else self.scores
        score, ident = np.full((most, n, size), -np.inf), np.full((most, n, size), -1, np.int64)
        h = np.zeros((n, size), np.uint64)
        for m in range(1, most + 1):
            h = h[:, : size - m + 1] * np.uint64(_BASE) + cp[:, m - 1 :].astype(np.uint64) + np.uint64(1)
            key = mix(h + np.uint64(m))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            score[m - 1, :, : size - m + 1] = np.where(ok, scores[at], -np.inf)
            ident[m - 1, :, : size - m + 1] = np.where(ok, self.ids[at], -1)
        return score, ident

    def _merged(self, score: np.ndarray) -> np.ndarray:
        """BPE: the length of the symbol that starts at each place, 0 inside a symbol."""
        most, n, size = score.shape
        width = np.ones((n, size), np.int64)
        rows = np.arange(n)
        place = np.arange(size)
        while len(rows):
            w = width[rows]
            nxt = place + w
            wide = np.where(nxt < size, np.take_along_axis(np.pad(w, ((0, 0), (0, 1))), np.minimum(nxt, size), 1), 0)
            total = w + wide
            ok = (w > 0) & (wide > 0) & (total <= most)
            gain = np.where(ok, score[np.where(ok, total, 1) - 1, rows[:, None], place], -np.inf)
            best = gain.argmax(1)
            hit = gain[np.arange(len(rows)), best] > -np.inf
            rows, best, wide = rows[hit], best[hit], wide[hit]
            add = wide[np.arange(len(rows)), best]
            width[rows, best + width[rows, best]] = 0
            width[rows, best] += add
        return width

    def _best_path(self, score: np.ndarray) -> np.ndarray:
        """Viterbi over all segments at once; the length of the piece that starts at each place of the best path, else 0."""
        most, n, size = score.shape
        best, back = np.full((n, size + 1), -np.inf), np.ones((n, size + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, size + 1):
            m = np.arange(1, min(most, end) + 1)
            last = np.stack([score[k - 1, :, end - k] for k in m], 1)
            last[:, 0] = np.where(last[:, 0] == -np.inf, self.worst, last[:, 0])
            total = best[:, end - m] + last
            back[:, end] = total.argmax(1) + 1
            best[:, end] = total.max(1)
        width, end, rows = np.zeros((n, size), np.int64), np.full(n, size), np.arange(n)
        while len(rows):
            m = back[rows, end[rows]]
            end[rows] -= m
            width[rows, end[rows]] = m
            rows = rows[end[rows] > 0]
        return width

    def _long(self, text: str) -> list[int]:
        """BPE of one very long segment with a queue of merges."""
        width, prev, nxt = [1] * len(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < len(text) and (hit := self.known.get(text[i : j + width[j]])):
                heapq.heappush(queue, (-hit[0], i, width[i], width[j]))

        for i in range(len(text) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = nxt[i]
            if width[i] != a or j >= len(text) or width[j] != b:
                continue
            width[i], width[j], nxt[i] = a + b, 0, nxt[j]
            if nxt[i] < len(text):
                prev[nxt[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out: list[int] = []
        for i, w in enumerate(width):
            if w:
                hit = self.known.get(text[i : i + w])
                out += [hit[1]] if hit else self._unknown(text[i : i + w])
        return out

    def _unknown(self, text: str) -> list[int]:
        return [int(self.byte[b]) for b in text.encode()] if self.fallback else [self.unknown]

    def segment_ids(self, segments: list[str], path: bool) -> list[list[int]]:
        """Ids of segments, by the best path or by merges; those of equal length advance together."""
        out: list[list[int]] = [[] for _ in segments]
        by: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by.setdefault(len(s), []).append(k)
        for size, all_k in by.items():
            if size > _LONG and not path:
                for k in all_k:
                    out[k] = self._long(segments[k])
                continue
            step = max(1, 400_000 // (size * min(size, self.longest)))
            for lo in range(0, len(all_k), step):
                some = all_k[lo : lo + step]
                cp = np.frombuffer("".join(segments[k] for k in some).encode("utf-32-le"), "<u4").reshape(len(some), size)
                score, ident = self._table(cp, path)
                width = self._best_path(score) if path else self._merged(score)
                row, start = np.nonzero(width)
                found = ident[width[row, start] - 1, row, start]
                for r, s, i in zip(row.tolist(), start.tolist(), found.tolist(), strict=True):
                    if i >= 0:
                        out[some[r]].append(i)
                    else:
                        out[some[r]] += self._unknown(segments[some[r]][s : s + 1])
        if not self.fallback:  # neighbouring unknown characters are one unknown piece
            out = [[i for k, i in enumerate(x) if i != self.unknown or k == 0 or x[k - 1] != i] for x in out]
        return out

    def encode(self, texts: list[str], path: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets that bound each text's), by the best path, or by a BPE file's merges."""
        path = path or not self.bpe
        if self.normalize:
            texts = [self.normalize(t) for t in texts]
        else:
            texts = [(SPACE if self.prefix else "") + t.replace(" ", SPACE) if t else "" for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        text = "".join(texts)
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        if not len(cp):
            return np.empty(0, np.int64), np.zeros(len(off), np.int64)
        start = np.ones(len(cp), bool)
        pair = (cp[:-1] << np.uint64(21)) | cp[1:]
        if len(self.near):
            start[1:] = self.near[np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)] != pair
        start[off[:-1][size > 0]] = True
        s = np.flatnonzero(start)
        e = np.r_[s[1:], len(cp)]
        total = np.cumsum((cp + np.uint64(1)) * _power(_BASE, len(cp)))
        before = np.where(s > 0, total[s - 1], np.uint64(0))
        h = mix((total[e - 1] - before) * _power(_INVERSE, len(cp))[s] + (e - s).astype(np.uint64))
        uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.kept[path]) > KEEP:
            self.kept[path] = {}
        kept = self.kept[path]
        new = [k for k, x in enumerate(keys) if x not in kept]
        found = self.segment_ids([text[s[at[k]] : e[at[k]]] for k in new], path)
        kept.update((keys[k], np.array(x, "<i4").tobytes()) for k, x in zip(new, found, strict=True))
        got = [kept[x] for x in keys]
        flat = np.frombuffer(b"".join(got), "<i4")
        n = np.array([len(x) // 4 for x in got], np.int64)
        first = np.cumsum(n) - n
        count = n[back]
        ends = np.cumsum(count)
        out = flat[np.repeat(first[back] - (ends - count), count) + np.arange(int(ends[-1]))]
        bound = np.concatenate([[0], ends])[np.searchsorted(s, off, "left")]
        return out.astype(np.int64), bound

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts whose ids lie between neighbouring offsets; broken byte runs become U+FFFD."""
        out = []
        for a, b in zip(off, off[1:], strict=False):
            t = b"".join([self.raw[k] for k in ids[a:b].tolist()]).decode("utf-8", "replace")
            out.append(t[1:] if self.prefix and t[:1] == " " else t)
        return out


def pieces(path: str) -> Pieces:
    """This worker's vocabulary for a file; the segments it keeps outlive a task."""
    kept = sys.modules.setdefault("_kept_pieces", types.ModuleType("_kept_pieces")).__dict__
    if path not in kept:
        kept[path] = Pieces.load(path)
    return kept[path]


def _parts(p: Pieces, text: str) -> list[str]:
    """A very long text in parts that end before a space, where that can't change ids (only the first part gets the prefix)."""
    if len(text) <= 2 * _CUT:
        return [text]
    out, lo = [], 0
    while len(text) - lo > 2 * _CUT:
        hi = text.find(" ", lo + _CUT)
        while hi > 0 and (text[hi - 1] == " " or (ord(text[hi - 1]) << 21 | ord(SPACE)) in p.near):
            hi = text.find(" ", hi + 1)
        if hi < 0:
            break
        out.append(text[lo:hi])
        lo = hi + 1  # the space is the next part's prefix
    return [*out, text[lo:]]


def _split(p: Pieces, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(parts of all texts, where each text's begin and end among them)."""
    own = [_parts(p, t) if p.prefix and not p.normalize else [t] for t in texts]
    return [x for parts in own for x in parts], np.concatenate([[0], np.cumsum([len(x) for x in own])])


def encode_pieces(docs: DataFrame, model: str, *, merges: bool = False) -> DataFrame:
    """Rows (doc_id, ids) for each row of docs: ids of its whole text by the best path, or with merges those that the library gives for a BPE file; null texts count as empty and have none."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 20):
                own, at = _split(p, texts[lo:hi])
                ids, off = p.encode(own, not merges)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(off[at], pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); null ids give an empty text."""
    small_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            lists = b.column(1)
            off = np.concatenate([[0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in lists], np.int64))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.decode(lists.flatten().to_numpy(), off), pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, n_pieces, ids_crc32, same, n_merged, merged_crc32, merged_same): the whole text encoded by the best path, decoded again, and whether the same text came back; then the same by merges.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.  The columns of merges hold the library's
    ids for a BPE file; for other files they repeat the best path.  The sign U+2581 comes back as a space.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 20):
                own, at = _split(p, texts[lo:hi])
                out = []
                for path in (True, False):
                    ids, off = p.encode(own, path)
                    off, data = off[at], ids.astype("<u4")
                    back = p.decode(ids, off)
                    out += [pa.array(np.diff(off)), pa.array([zlib.crc32(data[a:e].tobytes()) for a, e in zip(off, off[1:], strict=False)], pa.int64()), pa.array([a == t for a, t in zip(back, texts[lo:hi], strict=True)])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *out], ["doc_id", "n_pieces", "ids_crc32", "same", "n_merged", "merged_crc32", "merged_same"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_pieces bigint, ids_crc32 bigint, same boolean, n_merged bigint, merged_crc32 bigint, merged_same boolean")
