"""Token-ID output: flat unsigned integer files with 64-bit document offsets, written by partition and memory-mapped again.

Rows are range-partitioned by doc_id and a hash of the text, so that partition k holds smaller ids than partition k+1 and one doc_id with
very many rows is spread; the samples that set the ranges hold two integers a row, never a text. Each task streams its ids into one flat
file and writes an index beside it. The first position of a partition is the prefix sum of the token counts before it (one row a partition).

Defined cases: a null text counts as empty (only the end id); rows without doc_id come first; repeated doc_ids are kept, in the order of the
hash of their texts, and rows that repeat both id and text are in one file, however many they are (one task writes them as they stream by); an empty table gives no files and no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import default_path, encoder
from .storage import make_dir, materialize, memory_map, new_path, open_write
from .textscan import by_bytes, text_buffer

_MANIFEST = "part long, tokens_path string, index_path string, n_docs long, n_tokens long, width int"


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", width: int = 2) -> DataFrame:
    """Write the files and return their manifest, with ``base``, the position of each file's first id among all.

    ``width``: bytes of an id (2 or 4). A task that runs again writes files of another name; the manifest names the ones that count.
    """
    spark = docs.sparkSession
    tokenizer, folder = tokenizer or default_path(), folder or new_path(spark, "tokens")
    make_dir(folder)
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        tokens, index = f"{folder}/{part:06d}-{name}.bin", f"{folder}/{part:06d}-{name}.idx"
        out, offsets, ids, missing, total = None, [], [], [], 0
        for batch in by_bytes(batches, "text"):
            out = out or open_write(tokens)
            found, bounds = encoder(tokenizer).encode(*text_buffer(batch.column(1)))
            if found.size and int(found.max()) >= 256**width:
                raise ValueError("an id does not fit the width of the file")
            full = np.insert(found, bounds[1:], end_id).astype(kind)
            offsets.append(total + bounds[:-1] + np.arange(bounds.size - 1))
            missing.append(np.asarray(batch.column(0).is_null()))
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            out.write(full.tobytes())
            total += full.size
        if out is None:
            return
        out.close()
        n = sum(map(len, ids))
        with open_write(index) as f:
            for x in (np.array([n], "<u8"), np.append(np.concatenate(offsets), total).astype("<u8"), np.concatenate(ids).astype("<i8"), np.concatenate(missing).astype("u1")):
                f.write(x.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "tokens_path": tokens, "index_path": index, "n_docs": n, "n_tokens": total, "width": width}], schema=pa.schema([("part", pa.int64()), ("tokens_path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("tie"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = materialize(rows.mapInArrow(write, _MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document, from the memory-mapped files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in (row for batch in batches for row in batch.to_pylist()):
            head = memory_map(file["index_path"])
            n = int(np.frombuffer(head, "<u8", 1)[0])
            offsets = np.frombuffer(head, "<u8", n + 1, 8).astype(np.int64)
            ids = np.frombuffer(head, "<i8", n, 8 * (n + 2))
            missing = np.frombuffer(head, "u1", n, 8 * (2 * n + 2)).astype(bool)
            tokens = np.frombuffer(memory_map(file["tokens_path"]), "<u2" if file["width"] == 2 else "<u4")
            for k in range(0, n, 20_000):
                part = offsets[k : k + 20_001]
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
                m = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + m], pa.int64(), mask=missing[k : k + m]), pa.array(part[:-1] + file["base"]), pa.array(np.diff(part)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("index_path", "tokens_path", "base", "width")
    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, **options) -> DataFrame:
    return read_token_files(write_token_files(docs, **options))
