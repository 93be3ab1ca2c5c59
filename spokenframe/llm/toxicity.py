"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words (a fixed list, and words and
word beginnings learned from labelled rows), how close they stand to
second-person words, shares of capitals and punctuation, and rates of words that
hide letters behind digits or signs.  They are counted on the bytes of a batch at
once.  A bounded, documented sample of labelled rows trains the trees; a part of
it that the trees don't see fits the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import sample_by_class
from .shared import id_crc, release, slices_of, small_batches, written
from .words import flat, hash_word, mix, per_doc, word_hashes

#: Insults; a caller may pass other words.
LEXICON = (
    "idiot idiots moron morons stupid dumb loser losers pathetic scum trash garbage worthless disgusting clown clowns "
    "fool imbecile jerk creep filthy vermin ugly hate shut hell damn crap bastard bitch whore slut asshole fuck fucking shit kill die "
    "dummkopf trottel idioten abschaum arschloch connard connasse salaud imbécile ordure estúpido imbécil basura asqueroso mierda pendejo"
).split()
SECOND_PERSON = "you your yours yourself u ur ye du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti vosotros".split()
#: Labelled rows drawn for each label, about.
SAMPLE_PER_LABEL = 6000
NEAR_WORDS = 5

#: Letters and digits; signs that stand for letters.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _letters() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for b in range(256):
        if 97 <= b < 123 or b >= 128:
            out[b] = b + 1
        elif 65 <= b < 91:
            out[b] = b + 33
    return out


_PLAIN = _letters()
_HIDDEN = _letters()
for _c, _d in _LEET.items():
    _HIDDEN[ord(_c)] = ord(_d) + 1

#: Bytes of a word's beginning that the learned lexicon looks at.
PREFIX = 5

FEATURES = ("words", "learned", "learned_any", "stems", "stems_any",  "lexicon", "lexicon_any", "near_you", "you", "hidden", "hidden_words", "capitals", "bangs", "questions", "signs", "digits", "non_ascii", "distinct_hits")


@dataclass
class Lexicon:
    """Sorted hashes: of the fixed words, second-person words, learned words and learned beginnings."""

    fixed: np.ndarray
    person: np.ndarray
    words: np.ndarray
    stems: np.ndarray


def features(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    lexicon, person = lex.fixed, lex.person
    buf, off = flat(texts)
    size = np.maximum(1, np.diff(off))
    h, w = word_hashes(buf, off, _PLAIN)
    n = np.diff(w)
    words = np.maximum(1, n)
    hit, you = _isin(h, lexicon), _isin(h, person)
    hits = per_doc(hit, w)
    learned, stems = per_doc(_isin(h, lex.words), w), per_doc(_isin(word_hashes(buf, off, _PLAIN, PREFIX)[0], lex.stems), w)
    hit |= _isin(h, lex.words)
    # distance in words from each hit to the nearest second-person word of its text
    doc = np.repeat(np.arange(len(n)), n)
    at_you, at_hit = np.flatnonzero(you), np.flatnonzero(hit)
    near = np.zeros(len(h), np.int64)
    if len(at_you) and len(at_hit):
        k = np.searchsorted(at_you, at_hit)
        for side in (np.minimum(k, len(at_you) - 1), np.maximum(k - 1, 0)):
            p = at_you[side]
            near[at_hit] |= (np.abs(p - at_hit) <= NEAR_WORDS) & (doc[p] == doc[at_hit])
    h2, w2 = word_hashes(buf, off, _HIDDEN)
    hidden = np.maximum(0, per_doc(_isin(h2, lexicon), w2) - hits)
    letter = _PLAIN[buf] != 0
    cloak = np.zeros(len(buf), bool)
    if len(buf) > 2:  # a digit or sign between two letters
        cloak[1:-1] = ~letter[1:-1] & (_HIDDEN[buf[1:-1]] != 0) & letter[:-2] & letter[2:]
    share = lambda mask: per_doc(mask, off) / size
    sign = (buf > 32) & (buf < 127) & ~letter & ~((buf >= 48) & (buf < 58)) & (buf != 44) & (buf != 46)
    distinct = np.zeros(len(n))
    if len(at_hit):
        pairs = np.unique(np.stack([doc[at_hit].astype(np.uint64), h[at_hit]], 1), axis=0)
        distinct += np.bincount(pairs[:, 0].astype(np.int64), minlength=len(n))
    return np.stack(
        [np.log1p(n), learned / words, np.minimum(learned, 20), stems / words, np.minimum(stems, 20), hits / words, np.minimum(hits, 20), per_doc(near, w), per_doc(you, w) / words, hidden, per_doc(cloak, off) / words, share((buf >= 65) & (buf < 91)), share(buf == 33), share(buf == 63), share(sign), share((buf >= 48) & (buf < 58)), share(buf >= 128), distinct],
        axis=1,
    ).astype(np.float32)


def _isin(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def lexicon_hashes(words: list[str] | tuple[str, ...]) -> np.ndarray:
    return np.array(sorted({hash_word(w, _PLAIN) for w in words}), np.uint64)


@dataclass
class Trees:
    """Boosted trees of a fixed depth: feature and cut of each inner node, value of each leaf; then the calibration's steps."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    xs: np.ndarray
    ys: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.xs, self.ys), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a non-decreasing (weighted) fit of y over x, as knots to interpolate between."""
    order = np.argsort(x, kind="stable")
    weight = np.ones(len(x)) if weight is None else weight
    blocks: list[list[float]] = []  # [sum, weight, least x, most x]
    for v, t, w in zip(x[order], y[order], weight[order], strict=True):
        if blocks and blocks[-1][3] == v:
            blocks[-1][0] += t * w
            blocks[-1][1] += w
        else:
            blocks.append([t * w, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    xs = np.array([v for b in blocks for v in b[2:]])
    ys = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return xs, ys


def train_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, hold: np.ndarray | None = None, stands_for: np.ndarray | None = None) -> Trees:
    """Second-order boosting of the log loss on binned features; rows in hold fit the calibration only, each as much as the labelled rows it stands for."""
    hold = np.zeros(len(y), bool) if hold is None else hold
    if len(y) == 0 or y[~hold].min(initial=1) == y[~hold].max(initial=0):
        p = float(np.average(y, weights=stands_for)) if len(y) else 0.0
        return Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0, np.array([0.0, 1.0]), np.array([p, p]))
    fit, target = x[~hold], y[~hold].astype(float)
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) for c in fit.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, fit.T, strict=True)], 1)
    weight = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean()))
    margin = np.zeros(len(target))
    trees, inner = [], 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(target), int)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                mine = node == k
                if mine.sum() < 20:
                    continue
                best = 1e-6
                total_g, total_h = g[mine].sum(), h[mine].sum()
                for f in range(x.shape[1]):
                    b = binned[mine, f]
                    gl = np.cumsum(np.bincount(b, g[mine], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[mine], len(cuts[f]) + 1))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    j = int(np.argmax(gain))
                    if gain[j] > best:
                        best, feature[k], cut[k] = gain[j], f, cuts[f][j]
            node = 2 * node + 1 + (fit[np.arange(len(fit)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        trees.append((feature, cut, value))
    out = Trees(np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees]), np.stack([t[2] for t in trees]), 0.0, np.zeros(0), np.zeros(0))
    part = hold if hold.any() else ~hold
    out.xs, out.ys = isotonic(out.raw(x[part]), y[part].astype(float), None if stands_for is None else stands_for[part])
    return out


def learn_lexicon(rows: DataFrame, lexicon: tuple[str, ...], *, most: int = 4000) -> Lexicon:
    """Words and beginnings that stand in toxic rows far oftener than in others.

    Support counts differing texts, told apart by a hash of all their words, so that
    copies of one text don't make its words look toxic.  At most `most` entries of
    each sort are kept, the best supported first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (x for y in batches for x in slices_of(y, "text")):
            buf, off = flat(b.column("text"))
            toxic = b.column("toxic").to_numpy(zero_copy_only=False) > 0
            for stem in (0, PREFIX):
                h, w = word_hashes(buf, off, _PLAIN, stem)
                sets = [np.unique(h[w[k] : w[k + 1]]) for k in range(len(b))]
                n = [len(x) for x in sets]
                sig = [mix(x).sum(dtype=np.uint64) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(np.array(sig, np.uint64).view(np.int64), n)), pa.array(np.repeat(toxic, n)), pa.array(np.full(sum(n), stem > 0))],
                    ["h", "sig", "toxic", "stem"],
                )

    def count(toxic: bool):
        return F.sum((F.col("toxic") == toxic).cast("int"))

    total = rows.agg(F.sum((F.col("toxic") > 0).cast("int")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, n = total["p"] or 0, total["n"] or 0
    found = written(
        rows.mapInArrow(run, "h bigint, sig bigint, toxic boolean, stem boolean")
        .distinct().groupBy("h", "stem").agg(count(True).alias("a"), count(False).alias("b"))
        .filter((F.col("a") >= max(4, 0.004 * p)) & (F.col("a") / max(1, p) >= 12 * (F.col("b") + 0.5) / max(1, n - p)))
        , "lexicon",
    )
    sort = lambda stem: np.sort(found.filter(F.col("stem") == stem).orderBy(F.desc("a"), "h").limit(most).toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    return Lexicon(lexicon_hashes(lexicon), lexicon_hashes(SECOND_PERSON), sort(False), sort(True))


def train(docs: DataFrame, labels: DataFrame, *, lexicon: tuple[str, ...] = tuple(LEXICON), per_label: int = SAMPLE_PER_LABEL) -> tuple[Trees, Lexicon]:
    """Trees from labelled rows whose crc32(doc_id) mod 5 is not 0.

    About per_label rows of each label are drawn; their ids are broadcast, their
    features (not their texts) come to the driver.  Half of them teach the lexicon, the
    others the trees; a quarter of the latter fits the calibration.  An id with several
    labels counts as toxic if any says so; null labels are left out.
    """
    small_batches(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").filter(id_crc(F.col("doc_id")) % 5 != 0).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = written(known, "labels")
    drawn = written(sample_by_class(known, "toxic", ["doc_id"], per_label, 2 * per_label), "drawn")
    # ids of at most about 2 * per_label rows
    rows = written(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))),
        "labelled",
    )
    lex = learn_lexicon(rows.filter("half = 0").select("text", "toxic"), lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in slices_of(y, "text")):
            x = features(b.column("text"), lex)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), pa.array(list(x), pa.list_(pa.float32()))], ["id", "toxic", "x"])

    mine = rows.filter("half = 1").select(F.xxhash64("doc_id").alias("id"), "toxic", "text")
    seen = mine.mapInArrow(run, "id bigint, toxic int, x array<float>").dropDuplicates(["id"]).orderBy("id").limit(4 * per_label).toPandas()
    x = np.array(seen["x"].tolist(), np.float32).reshape(len(seen), len(FEATURES))
    y = seen["toxic"].to_numpy().astype(int)
    # the sample has as many rows of either label; the calibration counts each for the labelled rows it stands for
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands_for = np.array([total.get(v, 0) / max(1, int((y == v).sum())) for v in (0, 1)])[y]
    hold = np.arange(len(y)) % 4 == 0
    return train_trees(x, y, hold=hold, stands_for=stands_for), lex


def toxicity(docs: DataFrame, labels: DataFrame, *, lexicon: tuple[str, ...] = tuple(LEXICON), per_label: int = SAMPLE_PER_LABEL, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the columns score (0 to 1) and predicted (1 if score >= 0.5), under the given names; they replace columns of those names.

    Null texts count as empty; empty texts are scored like others.  Without
    usable labels every score is the share of toxic labels, or 0.
    """
    model, lex = train(docs, labels, lexicon=lexicon, per_label=per_label)
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (x for y in batches for x in slices_of(y, at)):
            text = b.column(at).fill_null("")
            s = model.score(features(text, lex))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*b.schema.names, *names])

    fields = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, fields)
