"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, for each part, `tokens-*.bin` (the ids of all its documents
behind each other, unsigned 16-bit if the vocabulary allows, else 32-bit, little
endian), `offsets-*.bin` (unsigned 64-bit: where each document starts in the
part, and the end) and `ids-*.bin` (signed 64-bit doc_id of each document; a null id
is -2**63).  Parts follow each other in ascending doc_id order.  The table of
parts has each part's base, the number of ids in all parts before it, by a
prefix sum.

Every attempt of a task writes files of its own name; the table of parts, which
Spark commits, names the files that count.  A lost executor or a second attempt
leaves nothing but an unnamed file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, parts, small_batches, written
from .tokens import encoder, slices

NO_ID = -(1 << 63)


def _store(uri: str):
    """(file system, path) of a folder's URI; local folders and stores that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, *, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode every text, append end_id, write the files; the table of parts (part, base, n_docs, n_tokens, folder, name, width).

    Documents are ordered by doc_id (null ids first), ties by text; null texts
    count as empty and hold end_id only.  Only doc_id and text are read.  An empty table
    gives no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    n = partitions or parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}"
        end, lengths, ids, total = np.array([end_id], "<u4").tobytes(), [], [], 0
        with store.open_output_stream(f"{path}/tokens-{name}.bin") as out:
            for b in batches:
                ids.append(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                texts = b.column(1).to_pylist()
                for lo, hi in slices(texts):
                    got = [x + end for x in enc.ids(texts[lo:hi])]
                    lengths.append(np.array([len(x) // 4 for x in got], np.uint64))
                    out.write(np.frombuffer(b"".join(got), "<u4").astype(f"<u{width}").tobytes())
        if not lengths:
            store.delete_file(f"{path}/tokens-{name}.bin")
            return
        offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate(lengths), dtype=np.uint64)])
        total = int(offsets[-1])
        for kind, data in (("offsets", offsets.astype("<u8")), ("ids", np.concatenate(ids).astype("<i8"))):
            with store.open_output_stream(f"{path}/{kind}-{name}.bin") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": len(offsets) - 1, "n_tokens": total, "folder": folder, "name": name, "width": width}])

    made = written(rows.mapInArrow(run, "part bigint, n_docs bigint, n_tokens bigint, folder string, name string, width bigint"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def mapped(folder: str, name: str, kind: str, dtype: str) -> np.ndarray:
    """One file as an array: memory-mapped where the store is a mounted folder, else read."""
    from pyarrow import fs

    store, path = _store(folder)
    full = f"{path}/{kind}-{name}.bin"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(full, dtype, "r") if store.get_file_info(full).size else np.empty(0, dtype)
    with store.open_input_file(full) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(files: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) read back from the files; start counts the ids of all documents before."""
    spark = files.sparkSession
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                offsets = mapped(r["folder"], r["name"], "offsets", "<u8").astype(np.int64)
                tokens = mapped(r["folder"], r["name"], "tokens", f"<u{r['width']}")
                ids = mapped(r["folder"], r["name"], "ids", "<i8")
                for lo in range(0, len(ids), 4096):
                    hi = min(lo + 4096, len(ids))
                    crc = [zlib.crc32(tokens[offsets[k] : offsets[k + 1]].astype("<u4").tobytes()) for k in range(lo, hi)]
                    out = [
                        pa.array(np.asarray(ids[lo:hi]), pa.int64(), mask=np.asarray(ids[lo:hi]) == NO_ID),
                        pa.array(offsets[lo:hi] + r["base"]),
                        pa.array(offsets[lo + 1 : hi + 1] - offsets[lo:hi]),
                        pa.array(crc, pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([tokens[offsets[k] : offsets[k + 1]].astype(np.int64) for k in range(lo, hi)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return files.repartition(parts(spark), "part").mapInArrow(run, schema)
