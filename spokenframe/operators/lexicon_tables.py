"""Lexicons as tables: thousands of entries are looked for in one pass over each text.

A lexicon is a table (lexicon, name, pattern, weight[, literal]).  Literal entries are words or phrases; all of
them make one automaton, built once a task, that reports every occurrence in a single scan.  The others are regular
expressions, which are tried one by one only where their common alternation finds anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that one automaton holds; larger tables are looked for in several passes.
ENTRIES = 100_000


class Matcher:
    """Entries (pattern, literal) made ready: counts(text) gives {entry: how often it occurs}."""

    def __init__(self, entries: list[tuple[str, bool]]):
        import ahocorasick

        self.automaton, self.size = ahocorasick.Automaton(), [len(p) for p, _ in entries]
        by: dict[str, list[int]] = {}
        for k, (pattern, literal) in enumerate(entries):
            if literal and pattern:
                by.setdefault(pattern.lower(), []).append(k)
        for word, ks in by.items():
            self.automaton.add_word(word, (len(word), ks))
        self.ready = bool(by)
        if self.ready:
            self.automaton.make_automaton()
        self.patterns = [(k, re.compile(p, re.I)) for k, (p, literal) in enumerate(entries) if not literal]
        self.any = re.compile("|".join(f"(?:{p.pattern})" for _, p in self.patterns), re.I) if self.patterns else None

    def counts(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        if self.ready:
            low, ends = text.lower(), {}
            word = lambda c: c.isalnum() or c == "_"
            for last, (n, ks) in self.automaton.iter(low):
                start, end = last + 1 - n, last + 1
                inside = (start and word(low[start - 1]) and word(low[start])) or (end < len(low) and word(low[end]) and word(low[last]))
                if not inside and start >= ends.get(ks[0], 0):  # occurrences of one entry don't overlap
                    ends[ks[0]] = end
                    for k in ks:
                        out[k] = out.get(k, 0) + 1
        if self.any is not None and self.any.search(text):
            for k, p in self.patterns:
                n = sum(1 for _ in p.finditer(text))
                if n:
                    out[k] = n
        return out


def lexicon_hits(rows: DataFrame, lexicon: DataFrame, keys: list[str], column: str = "text", *, entries: int = ENTRIES) -> DataFrame:
    """(keys, lexicon, name, weight, hits): every entry that occurs in a row's text, and how often without overlap.

    Case doesn't matter.  A literal begins and ends at the edge of a word where it begins and ends with a letter,
    digit or underscore.  Null texts hold nothing; entries that are null or blank are left out.  rows are read once
    for each `entries` entries of the table.
    """
    table = lexicon if "literal" in lexicon.columns else lexicon.withColumn("literal", F.lit(False))
    table = table.filter(F.trim("pattern") != "").select("lexicon", "name", "pattern", F.col("weight").cast("double").alias("weight"), F.coalesce("literal", F.lit(False)).alias("literal"))
    passes = max(1, -(-table.count() // entries))
    part = F.pmod(F.xxhash64("lexicon", "name", "pattern"), F.lit(passes))
    kinds = [rows.schema[k] for k in keys]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], "lexicon string, name string, weight double, hits bigint"])
    asked, out = rows.select(*keys, F.coalesce(column, F.lit("")).alias("_text")), None
    for k in range(passes):
        some = [tuple(r) for r in table.filter(part == k).collect()]  # about `entries` entries

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(p, literal) for _, _, p, _, literal in some])
            for b in batches:
                take, found = [], []
                for i, text in enumerate(b.column(len(keys)).to_pylist()):
                    for entry, n in matcher.counts(text).items():
                        take.append(i)
                        found.append((*some[entry][:2], some[entry][3], n))
                cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
                named = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[b.column(j).take(pa.array(take, pa.int64())) for j in range(len(keys))], *named], [*keys, "lexicon", "name", "weight", "hits"])

        met = asked.mapInArrow(run, schema)
        out = met if out is None else out.union(met)
    return out.groupBy(*keys, "lexicon", "name", "weight").agg(F.sum("hits").alias("hits"))


def best_entries(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lexicon, weight, name): of each text and lexicon the entry of most weight, ties to the smaller name."""
    best = F.min(F.struct((-F.col("weight")).alias("neg"), "name")).alias("b")
    return hits.groupBy(*keys, "lexicon").agg(best).select(*keys, "lexicon", (-F.col("b.neg")).alias("weight"), "b.name")


def weighted_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lexicon, score): hits times weight, summed over a lexicon's entries."""
    return hits.groupBy(*keys, "lexicon").agg(F.sum(F.col("hits") * F.col("weight")).alias("score"))
