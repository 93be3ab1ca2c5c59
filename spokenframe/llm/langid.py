"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  One binary classifier for each bit, over
hashed byte n-grams of the whole text, predicts that bit; loss-weighted decoding
takes the language whose codeword costs least.  Two near-equal costs flag the
text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import sample_by_class
from .shared import id_crc, small_batches
from .words import flat

BUCKETS = 4096
#: About as many training rows for each language, and most in all: with more languages there are fewer of each.
SAMPLE_PER_LANG = 500
SAMPLE_ROWS = 16_000
AMBIGUOUS = 0.6


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1: exhaustive up to 7 classes, else the best of many random codes."""
    if n <= 2:
        return np.array([[1], [-1]])[:n]
    if n <= 7:
        masks = range(1, 1 << (n - 1))
        return np.array([[1 if k == 0 or not m >> (k - 1) & 1 else -1 for m in masks] for k in range(n)])
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        gap = (bits - code @ code.T)[~np.eye(n, dtype=bool)].min()
        if gap > least:
            best, least = code, gap
    return best


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    out[65:91] += 32
    for lo, hi in ((0, 65), (91, 97), (123, 128)):  # digits, signs and white space are one symbol
        out[lo:hi] = 32
    return out


_FOLD = _fold()


def grams(texts: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed counts of 2-, 3- and 4-grams of bytes for each text, square-rooted and of length 1."""
    buf, off = flat(texts)
    code = _FOLD[buf]
    out = np.zeros((len(off) - 1, buckets), np.float32)
    for k in range(len(off) - 1):
        c = code[off[k] : off[k + 1]]
        h, count = c, np.zeros(buckets, np.int64)
        for n in (2, 3, 4):
            if len(c) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            count += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(33 - int(buckets).bit_length()), minlength=buckets)
        out[k] = count
    np.sqrt(out, out)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


@dataclass
class Codes:
    """Languages, their codewords, and the weights of each bit's classifier."""

    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the cheapest codeword, its share of the likelihood) of each row."""
        f = x @ self.weight + self.bias
        cost = np.stack([np.logaddexp(0, -f * c).sum(1) for c in self.code], 1) / max(1, self.code.shape[1]) * 4
        p = np.exp(cost.min(1, keepdims=True) - cost)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def fit_codes(x: np.ndarray, y: list[str], steps: int = 150) -> Codes:
    """Logistic regressions for the bits, by accelerated gradient descent."""
    langs = sorted(set(y))
    code = codewords(len(langs))
    at = np.searchsorted(langs, y)
    target = code[at].astype(np.float32)
    row = (1 / np.bincount(at).astype(np.float32))[at][:, None] / len(langs)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -target * row / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw = 0.9 * vw - 4.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 1.0 * g.sum(0)
        w, b = w + vw, b + vb
    return Codes(langs, code, w, b)


def train(docs: DataFrame, *, per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE_ROWS) -> Codes | None:
    """Classifiers from rows with text and lang whose crc32(doc_id) mod 4 is not 2.

    Every language is learned, from about per_lang rows of each, at most about `most` in all; ids of any type will do.
    """
    small_batches(docs.sparkSession)
    known = docs.filter("text is not null and lang is not null").filter(id_crc(F.col("doc_id")) % 4 != 2)
    rows = sample_by_class(known.select("doc_id", "text", "lang"), "lang", ["doc_id", "text"], per_lang, most).select("text", F.col("lang").cast("string").alias("lang"), "_draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                x = grams(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("_draw"), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["lang", "_draw", "x"])

    # repeated rows are drawn together; of those that are too many the last by hash go, whatever their ids and languages
    seen = rows.mapInArrow(run, "lang string, _draw double, x binary").orderBy("_draw", "lang", "x").limit(2 * most).toPandas()
    if not len(seen):
        return None
    x = np.stack([np.frombuffer(v, "<f2") for v in seen["x"]]).astype(np.float32)
    return fit_codes(x, seen["lang"].tolist())


def identify(docs: DataFrame, *, per_lang: int = SAMPLE_PER_LANG, most: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, lang_pred, score, ambiguous) for each row of docs, from its text alone.

    lang_pred is a learned language, or `und` (score 0) where text is null or holds no
    letter, or where nothing could be learned.  ambiguous marks scores under AMBIGUOUS.
    Repeated rows and null ids give a row each; further columns are not read.
    """
    model = train(docs, per_lang=per_lang, most=most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                b = batch.slice(lo, 512)
                letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                if model is None:
                    lang, score = np.full(len(b), "und", object), np.zeros(len(b))
                else:
                    at, score = model.decode(grams(b.column("text")))
                    lang = np.where(letters, np.array(model.langs, object)[at], "und")
                    score = np.where(letters, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
