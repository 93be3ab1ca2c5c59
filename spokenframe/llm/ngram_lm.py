"""An interpolated modified Kneser-Ney model of order 3, counted in Spark.

Words are 64-bit hashes.  Every task counts its own words (then its triples of
words) and hands sorted, compressed runs of (key, count) to buckets; the buckets
merge them and store sorted arrays in the shared folder:

    words-*      hash and count of each training word; its place is the word's id
    contexts-*   ids of the contexts' first words, under their second words
    starts-*     where each context's thirds start
    follow-*     its occurrences, and how many of its thirds occur once and twice
    thirds-*     ids of the words that follow each context, in order
    counts-*     how often each triple occurs
    pairs-*      ids of the second words, under their first words
    times-*      different words before each pair; after a text's beginning, its occurrences
    stats-*      for each id: words that precede it; the sum of `times` after it and
                 how many of its followers have 1, 2 and more of them

`heads-*` has the ids of those upper words and where each one's rows start.
Small numbers are bytes, capped at 255; `over-*` has the larger ones.  Words lie
in buckets by hash, triples and pairs by the id of their context's last word.  A
word that holds more than its share of all tokens is spread: triples by their
first word (after a text's beginning, by their third), pairs by their second.
Workers map the files they meet into memory and score texts batch by batch with
binary searches over sorted queries.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, parts, small_batches, written
from .token_files import _store
from .words import flat, mix, word_hashes

#: The end of a text; no word has this hash but by chance (one in 2**64).
END = int(mix(np.array([0x5EED], np.uint64))[0])
#: The beginning of a text, as a hash: the greatest, as its id is the greatest.
BEGIN = np.uint64((1 << 64) - 1)
#: Keys that a task gathers before it merges equal ones.
GATHER = 1 << 22
#: Tokens whose triples are counted at once, so that places among their words fit 21 bits.
CHUNK = (1 << 21) - 3
#: Training tokens for one bucket of triples.
CELL = 1 << 22
OPEN_FILES = 192

WORD = np.dtype([("hash", "<u8"), ("count", "<u8")])
STAT = np.dtype([("before", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("total", "<u8")])


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run, compressed: differences of the keys with their bytes laid out by place, then small counts."""
    step = np.diff(keys, prepend=np.uint64(0))
    small = next(t for t in ("u1", "u2", "u4", "u8") if not len(counts) or counts.max() <= np.iinfo(t).max)
    data = _by_place(step) + counts.astype(small).tobytes()
    return len(keys).to_bytes(8, "little") + small.encode() + pa.compress(data, "zstd", asbytes=True)


def _by_place(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()



def _pack3(keys: np.ndarray, thirds: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of triples: a run of their contexts behind the thirds' bytes."""
    data = pa.compress(_by_place(thirds), "zstd", asbytes=True)
    return len(data).to_bytes(8, "little") + data + _pack(keys, counts)


def _unpack3(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(run[:8], "little")
    keys, counts = _unpack(run[8 + size :])
    data = pa.decompress(run[8 : 8 + size], 4 * len(keys), "zstd", asbytes=True)
    return keys, np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1), counts


def _merge3(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = [_unpack3(r) for r in runs]
    keys, thirds, counts = (np.concatenate([g[k] for g in got]) for k in range(3))
    del got
    order = np.lexsort((thirds, keys))
    keys, thirds, counts = keys[order], thirds[order], counts[order]
    at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (thirds[1:] != thirds[:-1])])
    return keys[at], thirds[at], np.add.reduceat(counts, at)


def _unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, small = int.from_bytes(run[:8], "little"), run[8:10].decode()
    data = pa.decompress(run[10:], n * (8 + int(small[1])), "zstd", asbytes=True)
    step = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(step, dtype=np.uint64), np.frombuffer(data, small, n, 8 * n).astype(np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _merge(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = [_unpack(r) for r in runs]
    return _summed(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))


class _Gather:
    """Counts keys, merging when many have come."""

    def __init__(self):
        self.new: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.size += len(keys)
        if self.size > GATHER:
            self.merge()

    def merge(self) -> None:
        if self.new:
            k, c = np.unique(np.concatenate(self.new), return_counts=True)
            self.keys, self.counts = _summed(np.concatenate([self.keys, k]), np.concatenate([self.counts, c.astype(np.uint64)]))
            self.new, self.size = [], 0


def _bucket(x: np.ndarray, whole: int, n: int) -> np.ndarray:
    """The bucket of each x in 0 .. whole, in order."""
    if whole == 1 << 64:
        return (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    return np.minimum(x.astype(np.int64) * n // max(1, whole), n - 1)


def _put_small(folder: str, name: str, over: str, counts: np.ndarray) -> None:
    """counts (n, or n x columns) as bytes, and the rows that a byte doesn't hold in a table of their own."""
    _put(folder, name, np.minimum(counts, 255).astype("u1"))
    wide = counts if counts.ndim > 1 else counts[:, None]
    rows = np.flatnonzero((wide >= 255).any(1))
    _put(folder, over, np.column_stack([rows, wide[rows]]).astype("<u8"))


def _put_under(folder: str, name: str, keys: np.ndarray) -> None:
    """Sorted keys as the lower half of each, and for each upper half that occurs the place of its first."""
    upper = keys >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, upper[1:] != upper[:-1]])
    _put(folder, f"heads-{name}", np.stack([np.append(upper[at], 0), np.append(at, len(keys))]).astype("<u4"))
    _put(folder, name, (keys & np.uint64(0xFFFFFFFF)).astype("<u4"))


def _find(values: np.ndarray, at: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of each wanted value in values[at:end], which ascend; -1 where it isn't there."""
    at, last = at.copy(), end.copy()
    left = np.flatnonzero(at < end)
    while len(left):
        mid = (at[left] + last[left]) // 2
        less = values[mid] < want[left]
        at[left[less]], last[left[~less]] = mid[less] + 1, mid[~less]
        left = left[at[left] < last[left]]
    here = np.flatnonzero(at < end)
    here = here[values[at[here]] == want[here]]
    out = np.full(len(at), -1, np.int64)
    out[here] = at[here]
    return out


def _put(folder: str, name: str, data: np.ndarray) -> None:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(np.ascontiguousarray(data).tobytes())


class _Maps:
    """Files of one folder as arrays, memory-mapped where the store is a mounted folder; the latest used stay open."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.path = _store(folder)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def __call__(self, name: str, dtype: np.dtype | str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        full = f"{self.path}/{name}"
        if not self.store.get_file_info(full).size:
            data = np.empty(0, dtype)
        elif self.local:
            data = np.memmap(full, dtype, "r")
        else:
            with self.store.open_input_file(full) as f:
                data = np.frombuffer(f.read_buffer(), dtype)
        self.open[name] = data
        if len(self.open) > OPEN_FILES:
            self.open.popitem(last=False)
        return data


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that hold for all of them."""

    folder: str
    buckets: int
    tokens: int = 0
    words: list[str] = field(default_factory=list)  # file of each bucket
    base: list[int] = field(default_factory=list)  # id of each bucket's first word
    size: int = 0  # words known; also the id of a text's beginning
    cells: int = 1  # buckets of triples, pairs and stats
    triples: list[str] = field(default_factory=list)
    pairs: list[str] = field(default_factory=list)
    spread: list[str] = field(default_factory=list)  # pairs whose first word is spread
    stats: list[str] = field(default_factory=list)
    d1: tuple[float, float, float] = (0.0, 0.0, 0.0)
    d2: tuple[float, float, float] = (0.0, 0.0, 0.0)
    d3: tuple[float, float, float] = (0.0, 0.0, 0.0)
    total: int = 0  # pairs of different words
    many: tuple[int, int, int] = (0, 0, 0)  # words with one, two, more words before them

    @property
    def hot(self) -> float:
        """A word with more occurrences than this is spread by its neighbours."""
        return max(1.0, self.tokens / (8 * self.cells))


class Lookup:
    """Searches in a model's files, for sorted queries."""

    def __init__(self, model: Model):
        self.m, self.maps = model, _Maps(model.folder)
        self.edges = np.array([(b << 64) // model.buckets for b in range(1, model.buckets)], object)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each hash; -1 and 0 where it is not known. hashes are sorted."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        b = _bucket(hashes, 1 << 64, self.m.buckets)
        for lo, hi in _stretches(b):
            name = self.m.words[b[lo]]
            if not name:
                continue
            t = self.maps(name, WORD)
            k = np.minimum(np.searchsorted(t["hash"], hashes[lo:hi]), len(t) - 1)
            row = t[k]
            ok = row["hash"] == hashes[lo:hi]
            ids[lo:hi][ok] = k[ok] + self.m.base[b[lo]]
            counts[lo:hi][ok] = row["count"][ok]
        return ids, counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """STAT of each id; ids are sorted and known, or model.size for a text's beginning."""
        out = np.zeros(len(ids), STAT)
        b = _bucket(ids, self.m.size + 1, self.m.cells)
        for lo, hi in _stretches(b):
            name = self.m.stats[b[lo]]
            if name:
                out[lo:hi] = self.maps(name, STAT)[ids[lo:hi] - _first(int(b[lo]), self.m.size + 1, self.m.cells)]
        return out

    def small(self, name: str, over: str, k: np.ndarray, columns: int = 1) -> np.ndarray:
        """Rows k of an array of small numbers."""
        out = self.maps(name, "u1").reshape(-1, columns)[k].astype(np.int64)
        big = np.flatnonzero((out == 255).any(1))
        if len(big):
            more = self.maps(over, "<u8").reshape(-1, columns + 1)
            out[big] = more[np.searchsorted(more[:, 0], k[big].astype(np.uint64)), 1:]
        return out

    def under(self, name: str, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The place of each pair of ids in an array of lower ids under upper ones, or -1."""
        ids, starts = self.maps(f"heads-{name}", "<u4").reshape(2, -1)
        k = np.minimum(np.searchsorted(ids[:-1], upper.astype(np.uint32)), len(ids) - 2)
        at, end = starts[k].astype(np.int64), starts[k + 1].astype(np.int64)
        return _find(self.maps(name, "<u4"), at, np.where(ids[k] == upper, end, at), lower)

    def times(self, first: np.ndarray, second: np.ndarray, often: np.ndarray) -> np.ndarray:
        """How many words precede each pair; often: which first words are spread."""
        out = np.zeros(len(first), np.int64)
        b = _bucket(np.where(often, second, first), self.m.size + 1, self.m.cells) + often * self.m.cells
        key = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.lexsort((key, b))
        b = b[order]
        names = self.m.pairs + self.m.spread
        for lo, hi in _stretches(b):
            name = names[b[lo]]
            if name:
                to = order[lo:hi]
                k = self.under(f"pairs-{name}", first[to], second[to])
                to, k = to[k >= 0], k[k >= 0]
                out[to] = self.small(f"times-{name}", f"over-times-{name}", k)[:, 0]
        return out

    def triples(self, first: np.ndarray, second: np.ndarray, third: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how often each triple occurs, what follows its context); often: which second words are spread.

        What follows: occurrences, and thirds that occur once, twice and more often.
        """
        out, follow = np.zeros(len(first), np.int64), np.zeros((len(first), 4), np.int64)
        b = _bucket(np.where(often, first, second), self.m.size + 1, self.m.cells)
        key = (second.astype(np.uint64) << np.uint64(32)) | first.astype(np.uint64)
        order = np.lexsort((key, b))
        b = b[order]
        for lo, hi in _stretches(b):
            name = self.m.triples[b[lo]]
            if not name:
                continue
            to = order[lo:hi]
            k = self.under(f"contexts-{name}", second[to], first[to])
            to, k = to[k >= 0], k[k >= 0]
            starts = self.maps(f"starts-{name}", "<u4")
            at, end = starts[k].astype(np.int64), starts[k + 1].astype(np.int64)
            f = self.small(f"follow-{name}", f"over-follow-{name}", k, 3)
            follow[to] = np.column_stack([f, end - at - f[:, 1] - f[:, 2]])
            k = _find(self.maps(f"thirds-{name}", "<u4"), at, end, third[to])
            out[to[k >= 0]] = self.small(f"counts-{name}", f"over-counts-{name}", k[k >= 0])[:, 0]
        return out, follow


def _stretches(b: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal neighbours."""
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.empty(0, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _first(bucket: int, whole: int, n: int) -> int:
    """The least id of a bucket of _bucket(ids, whole, n)."""
    return -(-bucket * whole // n)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many keys occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k - 0.05) if x > 0 else 0.5 for k, x in enumerate(d, 1))


def _rows(docs: DataFrame, learn: Column | None) -> DataFrame:
    docs = docs if learn is None else docs.filter(learn)
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, offsets of each text's tokens): its words, then one END."""
    h, w = word_hashes(*flat(texts))
    return np.insert(h, w[1:], np.uint64(END)), w + np.arange(len(w))


def _emit(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A run for each bucket; keys ascend inside a bucket."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[at[1:], len(keys)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([_pack(keys[a:b], counts[a:b]) for a, b in zip(at, end, strict=True)], pa.binary())], ["bucket", "run"])


def _emit3(keys: np.ndarray, thirds: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    keys, thirds, counts, bucket = keys[order], thirds[order], counts[order], bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[at[1:], len(keys)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([_pack3(keys[a:b], thirds[a:b], counts[a:b]) for a, b in zip(at, end, strict=True)], pa.binary())], ["bucket", "run"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, which of them start a text) of batches, joined to about half a CHUNK at least."""
    parts, size = [], 0
    for b in batches:
        h, w = _tokens(b.column(0))
        starts = np.zeros(len(h), bool)
        starts[w[:-1]] = True
        parts.append((h, starts))
        size += len(h)
        if size > CHUNK // 2:
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            parts, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _counted(h: np.ndarray, starts: np.ndarray, skip: int, look: Lookup) -> pa.RecordBatch:
    """Runs of the triples that end at the tokens after the first `skip`."""
    m = look.m
    known, c = np.unique(np.append(h, BEGIN), return_inverse=True)
    begin, c = len(known) - 1, c[:-1].astype(np.uint64)
    b, a = np.empty_like(c), np.empty_like(c)
    b[0] = a[0] = begin
    b[1:] = c[:-1]
    b[starts] = begin
    a[1:] = b[:-1]
    a[starts] = begin
    bits = np.uint64(21)
    key, counts = np.unique((((b << bits) | a) << bits | c)[skip:], return_counts=True)
    mask = np.uint64((1 << 21) - 1)
    b, a, c = ((key >> (bits + bits)).astype(np.int64), ((key >> bits) & mask).astype(np.int64), (key & mask).astype(np.int64))
    ids, often = look.ids(known[:-1])
    ids, often = np.append(ids, m.size), np.append(often > m.hot, True)
    cell = _bucket(np.where(often[b], np.where(b == begin, ids[c], ids[a]), ids[b]), m.size + 1, m.cells)
    keys = (ids[b].astype(np.uint64) << np.uint64(32)) | ids[a].astype(np.uint64)
    return _emit3(keys, ids[c].astype("<u4"), counts.astype(np.uint64), cell)


def train(docs: DataFrame, learn: Column | None = None, *, buckets: int | None = None) -> Model:
    """Count docs (where learn holds) and store the model in the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    m = Model(new_path(spark, "lm"), buckets or max(16, parts(spark)))
    n, folder, low = m.buckets, m.folder, np.uint64(0xFFFFFFFF)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Gather()
        for b in batches:
            got.add(_tokens(b.column(0))[0])
        got.merge()
        if len(got.keys):
            yield _emit(got.keys, got.counts, _bucket(got.keys, 1 << 64, n))

    def merge_words(t: pa.Table) -> pa.Table:
        keys, counts = _merge(t.column("run").to_pylist())
        name = f"words-{uuid.uuid4().hex}"
        out = np.empty(len(keys), WORD)
        out["hash"], out["count"] = keys, counts
        _put(folder, name, out)
        return pa.table({"bucket": [t.column("bucket")[0].as_py()], "name": [name], "size": [len(keys)], "tokens": [int(counts.sum())]})

    rows = _rows(docs, learn)
    runs = rows.mapInArrow(count_words, "bucket bigint, run binary")
    made = written(runs.groupBy("bucket").applyInArrow(merge_words, "bucket bigint, name string, size bigint, tokens bigint"), "lm-words")
    m.words, m.base = [""] * n, [0] * n
    for r in made.orderBy("bucket").collect():  # a row for each bucket
        m.words[r["bucket"]], m.base[r["bucket"]] = r["name"], m.size
        m.size += r["size"]
        m.tokens += r["tokens"]
    if not m.size:
        return m
    if m.size >= (1 << 32) - 1:
        raise ValueError("more than 2**32 different words: their ids don't fit the pairs' keys")

    m.cells = cells = max(n, -(-m.tokens // CELL))

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(m)
        for h, starts in _gathered(batches):
            for at in range(0, len(h), CHUNK):
                lo = max(0, at - 2)
                yield _counted(h[lo : at + CHUNK], starts[lo : at + CHUNK], at - lo, look)

    def row(bucket: int, kind: str, run: bytes = b"", name: str = "", of: Iterable[int] = ()) -> dict:
        return {"bucket": bucket, "kind": kind, "run": run, "name": name, "of": list(of)}

    def dealt(kind: str, keys: np.ndarray, counts: np.ndarray, by: np.ndarray) -> list[dict]:
        """A run of keys for each bucket that holds some of the ids `by`."""
        if not len(keys):
            return []
        return [row(r["bucket"], kind, r["run"]) for r in _emit(keys, counts.astype(np.uint64), _bucket(by, m.size + 1, cells)).to_pylist()]

    def store_pairs(bucket: int, kind: str, keys: np.ndarray, counts: np.ndarray) -> list[dict]:
        """Store pairs; their part of the words' statistics."""
        if not len(keys):
            return []
        name = uuid.uuid4().hex
        _put_under(folder, f"pairs-{name}", keys)
        _put_small(folder, f"times-{name}", f"over-times-{name}", counts)
        first, second = keys >> np.uint64(32), keys & low
        at = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        ids = first[at]
        sums = [np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2, counts > 2)]
        out = [row(bucket, kind, name=name, of=[int((counts == k).sum()) for k in (1, 2, 3, 4)])]
        for k, of, c in [("total", ids, sums[0]), ("n1", ids, sums[1]), ("n2", ids, sums[2]), ("n3", ids, sums[3]), ("before", *np.unique(second, return_counts=True))]:
            some = np.flatnonzero(c)
            out += dealt(k, of[some], c[some], of[some])
        return out

    def merge_triples(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        keys, thirds, counts = _merge3(t.column("run").to_pylist())
        middle = keys >> np.uint64(32)
        edge = np.flatnonzero(np.r_[True, middle[1:] != middle[:-1]])
        often = np.repeat(_often(Lookup(m), middle[edge].astype(np.int64)), np.diff(np.r_[edge, len(keys)]))
        begins = middle == m.size
        pairs = (middle << np.uint64(32)) | thirds
        # after a text's beginning pairs count by occurrence, as no word can precede it
        out = dealt("spread", pairs[begins], counts[begins], thirds[begins])
        k, c = np.unique(pairs[often & ~begins], return_counts=True)
        out += dealt("spread", k, c, k & low)
        k, c = np.unique(pairs[~often], return_counts=True)
        out += store_pairs(bucket, "pairs", k, c.astype(np.uint64))
        keys, thirds, counts = keys[~begins], thirds[~begins], counts[~begins]
        if len(keys):
            name = uuid.uuid4().hex
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            _put_under(folder, f"contexts-{name}", keys[at])
            _put(folder, f"starts-{name}", np.append(at, len(keys)).astype("<u4"))
            _put_small(folder, f"follow-{name}", f"over-follow-{name}", np.column_stack([np.add.reduceat(x.astype(np.uint64), at) for x in (counts, counts == 1, counts == 2)]))
            _put(folder, f"thirds-{name}", thirds.astype("<u4"))
            _put_small(folder, f"counts-{name}", f"over-counts-{name}", counts)
            out.append(row(bucket, "triples", name=name, of=[int((counts == k).sum()) for k in (1, 2, 3, 4)]))
        return pa.Table.from_pylist(out, rows_type)

    def merge_spread(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(store_pairs(t.column("bucket")[0].as_py(), "spread pairs", *_merge(t.column("run").to_pylist())), rows_type)

    rows_type = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("run", pa.binary()), ("name", pa.string()), ("of", pa.list_(pa.int64()))])
    schema = "bucket bigint, kind string, run binary, name string, of array<bigint>"
    runs = rows.mapInArrow(count_triples, "bucket bigint, run binary")
    made = written(runs.groupBy("bucket").applyInArrow(merge_triples, schema), "lm-triples")
    spread = written(made.filter("kind = 'spread'").select("bucket", "run").groupBy("bucket").applyInArrow(merge_spread, schema), "lm-pairs")
    made = made.filter("kind <> 'spread'").union(spread)
    names = {"triples": [""] * cells, "pairs": [""] * cells, "spread pairs": [""] * cells}
    of = {kind: np.zeros(4, np.int64) for kind in names}
    for r in made.filter(F.col("kind").isin(*names)).select("bucket", "kind", "name", "of").collect():  # three rows for each bucket
        names[r["kind"]][r["bucket"]] = r["name"]
        of[r["kind"]] += r["of"]
    m.triples, m.pairs, m.spread = names.values()
    m.d2, m.d3 = discounts((of["pairs"] + of["spread pairs"]).tolist()), discounts(of["triples"].tolist())

    def merge_stats(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        lo, hi = _first(bucket, m.size + 1, cells), _first(bucket + 1, m.size + 1, cells)
        out = np.zeros(hi - lo, STAT)
        kinds = np.array(t.column("kind").to_pylist())
        data = t.column("run").to_pylist()
        for kind in STAT.names:
            runs = [data[k] for k in np.flatnonzero(kinds == kind)]
            if runs:
                keys, counts = _merge(runs)
                out[kind][keys.astype(np.int64) - lo] = counts
        name = f"stats-{uuid.uuid4().hex}"
        _put(folder, name, out)
        b = out["before"]
        return pa.table({"bucket": [bucket], "name": [name], "total": [int(b.sum(dtype=np.int64))], "of": pa.array([[int((b == k).sum()) for k in (1, 2, 3, 4)] + [int((b > 2).sum())]], pa.list_(pa.int64()))})

    made = written(made.filter(F.col("kind").isin(*STAT.names)).select("bucket", "kind", "run").groupBy("bucket").applyInArrow(merge_stats, "bucket bigint, name string, total bigint, of array<bigint>"), "lm-stats")
    m.stats, of = [""] * cells, np.zeros(5, np.int64)
    for r in made.collect():  # a row for each bucket
        m.stats[r["bucket"]] = r["name"]
        m.total += r["total"]
        of += r["of"]
    m.d1, m.many = discounts(of[:4].tolist()), (int(of[0]), int(of[1]), int(of[4]))
    return m


def _often(look: Lookup, first: np.ndarray) -> np.ndarray:
    """Which ids are spread by their neighbours; the beginning of a text always is."""
    counts = np.zeros(len(first), np.int64)
    b = np.searchsorted(look.m.base, first, "right") - 1
    for k in np.unique(b):
        mine = (b == k) & (first < look.m.size)
        # empty buckets share their base with the next; the last of them holds the word
        if mine.any() and look.m.words[k]:
            counts[mine] = look.maps(look.m.words[k], WORD)["count"][first[mine] - look.m.base[k]]
    return (counts > look.m.hot) | (first == look.m.size)


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def token_scores(look: Lookup, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of every token; w bounds the texts."""
    m = look.m
    words, back = np.unique(h, return_inverse=True)
    ids, counts = look.ids(words)
    stat = np.zeros(len(words), STAT)
    stat[ids >= 0] = look.stats(np.sort(ids[ids >= 0]))  # ids ascend with hashes
    rest = sum(d * k for d, k in zip(m.d1, m.many, strict=True)) / max(1, m.total)
    if not m.total:
        rest = 1.0
    p1 = np.maximum(stat["before"] - _discount(stat["before"], m.d1), 0) / max(1, m.total) + rest / (m.size + 1)

    def leave(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight of the lower order, occurrences) after each first word."""
        mass = m.d2[0] * s["n1"] + m.d2[1] * s["n2"] + m.d2[2] * s["n3"]
        return np.where(s["total"] > 0, mass / np.maximum(1, s["total"]), 1.0), s["total"].astype(np.float64)

    gamma, total = leave(stat)
    begin = look.stats(np.array([m.size])) if m.size else np.zeros(1, STAT)
    gamma0, total0 = leave(begin)
    second = ids[back]
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[w[:-1]] = m.size
    g, t = np.empty(len(h)), np.empty(len(h))
    g[1:], t[1:] = gamma[back][:-1], total[back][:-1]
    g[w[:-1]], t[w[:-1]] = gamma0[0], total0[0]
    hot = counts[back] > m.hot
    often = np.empty(len(h), bool)
    often[1:] = hot[:-1]
    often[w[:-1]] = True
    c2 = np.zeros(len(h), np.int64)
    known = np.flatnonzero((first >= 0) & (second >= 0)) if m.size else np.empty(0, np.int64)
    if len(known):
        key, k, again = np.unique((first[known].astype(np.uint64) << np.uint64(32)) | second[known].astype(np.uint64), return_index=True, return_inverse=True)
        k = known[k]
        c2[known] = look.times(first[k], second[k], often[k])[again]
    p = np.maximum(c2 - _discount(c2, m.d2), 0) / np.maximum(1, t) + g * p1[back]
    before = np.full_like(first, -1)  # -1 where a text begins, too: its first word has no further context
    before[1:] = first[:-1]
    before[w[:-1]] = -1
    known = np.flatnonzero((before >= 0) & (first >= 0)) if m.size else np.empty(0, np.int64)
    if len(known):
        # unknown thirds have the id -1, which no file holds
        c3, follow = look.triples(before[known], first[known], second[known], often[known])
        seen = follow[:, 0] > 0
        c3, follow, at = c3[seen], follow[seen], known[seen]
        p[at] = (np.maximum(c3 - _discount(c3, m.d3), 0) + follow[:, 1:] @ np.array(m.d3) * p[at]) / follow[:, 0]
    return np.log10(p), counts[back]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are words (A-Z as a-z) and one end.  Null texts count as empty and hold
    their end only.  base_score: log10 of the add-0.1 unigram probability.  Null
    ids and repeated rows give a row each; further columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for b in batches:
            if not len(b):
                continue
            h, w = _tokens(b.column("text"))
            log, counts = token_scores(look, h, w)
            base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.size + 1)))
            at = w[:-1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(w)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(np.full(len(at), model.tokens, np.int64)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(log, at))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
