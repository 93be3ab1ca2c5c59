"""Spelling variant grouping by reduced-alphabet generation.

Words are counted once over all texts.  For the search, letters are hashed to a few
symbols, so that a word becomes a reduced word.  One edit of a word makes at most one
edit of its reduced word.  Each word generates the full neighbourhood of its reduced
word: itself, every deletion, replacement and insertion of a symbol, as 64-bit
hashes that follow from prefix sums in constant time each.  These meet the hashes of the
reduced vocabulary in a join, and pairs are verified on the words themselves.

Words of m letters are reduced with the fewest symbols that give about as many reduced words as
there are words of that length, so a generated word meets few others however
large the vocabulary is; a neighbourhood of another length uses the symbols of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import dealt
from .shared import slices_of, small_batches, written
from .words import flat, mix

#: Letters are A-Z, a-z and U+00C0 to U+00FF; in UTF-8 all of the latter, and only these, begin with C3.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), _LEAD]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32)
#: crc32 states as the table steps see them: x -> table[(x ^ byte) & 255] ^ (x >> 8)
_CRC = (_CRC ^ np.uint32(0xFFFFFFFF)) ^ np.uint32(0x00FFFFFF)
_CRC = _CRC[np.arange(256) ^ 0xFF]
#: Distinct words that a counting task gathers before it hands them on.
_GATHER = 400_000
#: Words longer than this take the symbols and the way of long words.
LONG = 64
#: Longest neighbourhoods that one batch holds, in rows.
_ROWS = 200_000


def words_of(batch: pa.RecordBatch, every: int, least: int) -> tuple[pa.Array, pa.Array]:
    """(words, counts) of a batch (doc_id as text, text): runs of letters in lower case, with the letters deleted that the hash names."""
    buf, off = flat(batch.column(1))
    letter = _LETTER[buf]
    letter[1:] |= buf[:-1] == _LEAD
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    buf = _LOWER[buf]
    before = [zlib.crc32(f"{d}:".encode()) for d in batch.column(0).fill_null("").to_pylist()]
    doc = np.searchsorted(off, start, "right") - 1
    crc = _crcs(buf, start, end, np.array(before, np.uint32)[doc])
    hit = crc % np.uint32(every) == 0
    letters = np.concatenate([[0], np.cumsum(buf != _LEAD)])
    size = letters[end] - letters[start]
    keep = ~hit & (size >= least)
    odd = []
    for a, b, c, n in zip(start[hit].tolist(), end[hit].tolist(), crc[hit].tolist(), size[hit].tolist(), strict=True):
        if n > least:
            w = buf[a:b].tobytes().decode()
            odd.append(w[: c % n] + w[c % n + 1 :])
    start, end = start[keep], end[keep]
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    plain = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(buf[inside]))
    found = pc.value_counts(pa.concat_arrays([plain, pa.array(odd, pa.large_string())]))
    return found.field(0), found.field(1)


def _crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of buf[start:end] continued from each state; words of equal length advance together."""
    size = end - start
    out = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    s, c, n = start[order], out[order], size[order]
    many = int(np.searchsorted(-n, -LONG, "left"))  # longer ones by the library
    for k in range(many):
        c[k] = zlib.crc32(buf[s[k] : s[k] + n[k]].tobytes(), int(state[order[k]])) ^ 0xFFFFFFFF
    live = c[many:]
    at, sizes = s[many:], n[many:]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -j, "left"))
        x = live[:m]
        live[:m] = _CRC[(x ^ buf[at[:m] + j]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out[order] = c
    return out ^ np.uint32(0xFFFFFFFF)


def vocabulary(docs: DataFrame, *, every: int, least: int, often: int) -> DataFrame:
    """Rows (word, n): words of at least `least` letters that occur `often` times or more, counted in each task first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]) if len(held) > 1 else held[0]

        for b in batches:
            for part in slices_of(b, 1, 1 << 22):
                words, n = words_of(part, every, least)
                held.append(pa.table({"word": words, "n": n}))
                size += len(words)
                if size > 2 * _GATHER:
                    held = [merged()]
                    size = len(held[0])
                    if size > _GATHER:
                        yield from held[0].combine_chunks().to_batches(50_000)
                        held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches(50_000)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    words = rows.mapInArrow(run, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def symbols_for(words: DataFrame) -> np.ndarray:
    """The number of symbols for each length up to LONG (longer words take the last): about one reduced word for each word."""
    size = F.least(F.length("word"), F.lit(LONG + 1))
    out = np.full(LONG + 2, 2, np.int64)
    for r in words.groupBy(size.alias("m")).count().collect():  # at most LONG + 1 rows
        if r["m"] <= LONG:
            out[r["m"]] = max(2, int(np.ceil(r["count"] ** (1 / max(1, r["m"])) - 1e-9)))
    return out


def _alphabet(symbols: int) -> np.ndarray:
    """The symbol (from 1) of every letter, dealt out by a hash."""
    return (1 + (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(11)) % np.uint64(symbols)).astype(np.uint64)


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, _STEP, np.uint64), out=out[1:])
    return out


def _keys(h: np.ndarray, m: int) -> np.ndarray:
    """Join keys of reduced words of m symbols from their polynomial hashes."""
    return mix(h + np.uint64(m * 0xD6E8FEB86659FD93 & (1 << 64) - 1)).view(np.int64)


def reduced(letters: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The key of each word's reduced word; letters is a matrix, one row for each word of a length."""
    m = letters.shape[1]
    return _keys((_alphabet(symbols[min(m, LONG + 1)])[letters] * _powers(m)).sum(1, dtype=np.uint64), m)


def neighbours(letters: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) for the full one-edit neighbourhood of each word's reduced word, each reduced word once."""
    count, m = letters.shape
    power = _powers(m + 1)
    who, keys = [], []

    def put(index: np.ndarray, h: np.ndarray, size: int) -> None:
        who.append(index)
        keys.append(_keys(h, size))

    def sums(size: int) -> tuple[np.ndarray, np.ndarray, int]:
        k = int(symbols[min(size, LONG + 1)])
        s = _alphabet(k)[letters]
        total = np.zeros((count, m + 1), np.uint64)
        np.cumsum(s * power[:m], axis=1, dtype=np.uint64, out=total[:, 1:])
        return s, total, k

    rows = np.arange(count)
    s, total, k = sums(m)
    put(rows, total[:, m], m)
    for x in range(1, k + 1):  # replacements
        h = total[:, m, None] + (np.uint64(x) - s) * power[:m]
        i, j = np.nonzero(s != x)
        put(i, h[i, j], m)
    if m > 1:  # deletions: of neighbouring equal symbols the first
        s, total, _ = sums(m - 1)
        h = total[:, :m] + (total[:, m, None] - total[:, 1:]) * np.uint64(_BACK)
        first = np.ones(s.shape, bool)
        first[:, 1:] = s[:, 1:] != s[:, :-1]
        i, j = np.nonzero(first)
        put(i, h[i, j], m - 1)
    s, total, k = sums(m + 1)
    rest = total + (total[:, m, None] - total) * np.uint64(_STEP)
    for x in range(1, k + 1):  # insertions: not behind the same symbol
        h = rest + np.uint64(x) * power
        new = np.ones((count, m + 1), bool)
        new[:, 1:] = s != x
        i, j = np.nonzero(new)
        put(i, h[i, j], m + 1)
    return np.concatenate(who), np.concatenate(keys)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, letters) for the words of each length; every letter is one code below 256."""
    texts = words.to_pylist()
    size = np.array([len(w) for w in texts], np.int64)
    for m in np.unique(size).tolist():
        own = np.flatnonzero(size == m)
        yield own, np.frombuffer("".join([texts[k] for k in own]).encode("latin-1"), np.uint8).reshape(len(own), m)


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, other, n): all ordered pairs of words that differ by one inserted, deleted or replaced letter; n is the other's.

    words (word, n) holds each word once.
    """
    symbols = symbols_for(words)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(len(b), np.int64)
            for own, letters in _by_length(b.column(0)):
                out[own] = reduced(letters, symbols)
            yield pa.RecordBatch.from_arrays([pa.array(out), b.column(0), b.column(1)], ["key", "other", "n"])

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, second column) for the neighbourhood of each word in the first column."""
        for b in batches:
            for own, letters in _by_length(b.column(0)):
                m = letters.shape[1]
                step = max(1, _ROWS // (int(symbols.max() if m < LONG else 2) * (2 * m + 1)))
                for lo in range(0, len(own), step):
                    who, keys = neighbours(letters[lo : lo + step], symbols)
                    at = own[lo : lo + step][who]
                    for k in range(0, len(at), _ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + _ROWS]), b.column(1).take(pa.array(at[k : k + _ROWS]))], ["key", "name"])

    kept = words.select("word", "n")
    have = kept.mapInArrow(key, "key bigint, other string, n bigint")
    near = F.levenshtein("word", "other", 1) == 1
    short = kept.filter(F.length("word") <= LONG).select("word", F.col("word").alias("name")).mapInArrow(generate, "key bigint, name string").withColumnRenamed("name", "word")
    pairs = short.join(have.hint("merge"), "key").filter(near).select("word", "other", "n")
    # of long words only names are generated, not copies of the word
    names = kept.filter(F.length("word") > LONG).select("word", F.sha2("word", 256).alias("name"))
    if names.isEmpty():
        return pairs
    met = names.mapInArrow(generate, "key bigint, name string").join(have.hint("merge"), "key").filter(F.length("other") >= LONG)
    return pairs.union(met.join(names.hint("merge"), "name").filter(near).select("word", "other", "n"))


def spelling_variants(docs: DataFrame, *, every: int = 97, least: int = 5, often: int = 3, ratio: int = 2) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word.

    Words are runs of [A-Za-z\\u00C0-\\u00FF] with A-Z in lower case; where `every` divides the crc32 of
    `<doc_id>:<run>` (a null id is empty), the run's letter at that crc32 modulo its length is
    deleted.  Words have at least `least` letters and occur `often` times or more in all texts, repeated
    rows included.  form is the near word of largest n, ties the first in code point order, if that
    n is at least `ratio` times the word's; root follows forms to the last.  Null texts count
    as empty, texts of any length are read whole, other columns aren't read.  Without words the
    result is empty.
    """
    words = written(vocabulary(docs, every=every, least=least, often=often), "words")
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("other").alias("form"))).alias("best")
    found = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.join(found.hint("merge"), "word", "left")
    takes: Column = -F.col("best.neg") >= ratio * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.neg")).alias("form_n")), "forms")
    # every round a word's root becomes that of its root; n grows along forms, so there are no cycles
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        nxt = dealt(roots.withColumnRenamed("word", "_word"), roots.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"]).select(F.col("_word").alias("word"), F.col("next"))
        nxt = written(nxt, "roots")
        if nxt.isEmpty():
            break
        roots = written(roots.join(nxt.hint("merge"), "word", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
