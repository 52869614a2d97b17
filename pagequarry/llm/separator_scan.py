"""Token counts of documents from flat token files that have no index.

A flat file is nothing but unsigned 16-bit ids, each document followed by an
end-of-document id.  Files are cut into blocks of equal size, read by byte
range; numpy finds a block's separators at once.  A document that crosses
borders is put together by a prefix scan over the blocks of its file: the last
separator before a block, and the number of separators before it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .common import new_folder, stage_table

ID_BYTES = 2


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def tasks_for(files: DataFrame) -> int:
    """Tasks to read files with: one for each, but the session's number of partitions at least."""
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.count())


def write_flat(docs: DataFrame, path: str, pattern: str, eod: int) -> DataFrame:
    """Write the texts' ids to flat files in the shared folder, one file a partition.

    Returns ``file, doc_no, doc_id``: which document is the how manieth of which
    file, which the files themselves don't say.  ``eod`` must be no id of a text.
    A task that is run again writes a file of its own; only files that the
    returned table names count.
    """
    folder = new_folder(docs.sparkSession, "flat")
    end = np.array([eod], dtype=f"<u{ID_BYTES}").tobytes()

    def run(batches):
        own = bpe.encoder(path, pattern, ID_BYTES)
        target, inside = open_folder(folder)
        target.create_dir(inside, recursive=True)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
        no = 0
        out = None
        try:
            for batch in batches:
                if out is None:
                    out = target.open_output_stream(f"{inside}/{name}")
                for text in batch.column(1):
                    out.write(own.encode(text.as_py()) + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(no, no + n)), batch.column(0).cast(pa.int64())], names=["file", "doc_no", "doc_id"])
                no += n
        finally:
            if out is not None:
                out.close()

    return stage_table(docs.select("doc_id", "text").mapInArrow(run, "file string, doc_no long, doc_id long"), "flat-docs")


def blocks_of(files: DataFrame, block: int) -> DataFrame:
    """``file, block, first, size``: the blocks, in ids, of the files in column ``file``."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                source, inside = open_folder(name)
                size = source.get_file_info(inside).size // ID_BYTES
                first = np.arange(0, size, block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(first), pa.string()), pa.array(np.arange(len(first))), pa.array(first), pa.array(np.minimum(block, size - first))],
                    names=["file", "block", "first", "size"],
                )

    return files.select("file").mapInArrow(run, "file string, block long, first long, size long")


def scan(files: DataFrame, eod: int, block: int = 1 << 20) -> DataFrame:
    """``file, doc_no, start, n_tokens`` of every document in the files (``file``, one row each).

    ``start`` counts the file's ids before the document; ``n_tokens`` leaves out
    the separator.  A file's last document may lack its separator: it counts if
    it has ids.  An empty file has no documents; two separators in a row hold
    an empty one.
    """

    def run(batches):
        for batch in batches:
            for name, no, first, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                source, inside = open_folder(name)
                with source.open_input_file(inside) as f:
                    f.seek(first * ID_BYTES)
                    ids = np.frombuffer(f.read(size * ID_BYTES), dtype=f"<u{ID_BYTES}")
                ends = (np.flatnonzero(ids == eod) + first).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([no]), pa.array([first + size]), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "stop", "ends"]
                )

    blocks = blocks_of(files, block)
    spread = blocks.repartition(tasks_for(files), "file", "block")
    found = spread.mapInArrow(run, "file string, block long, stop long, ends array<long>")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    scanned = found.withColumns(
        {
            "base": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
            "carry": F.coalesce(F.max(last_end).over(before), F.lit(-1)),
            "is_last": F.lead("block").over(order).isNull(),
        }
    )
    # The open end of a file counts as one more separator if ids stand before it.
    open_end = F.col("is_last") & (F.coalesce(last_end, F.col("carry")) < F.col("stop") - 1)
    scanned = scanned.withColumn("ends", F.when(open_end, F.array_append("ends", F.col("stop"))).otherwise(F.col("ends")))
    each = scanned.select("file", "base", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    return each.select("file", (F.col("base") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, pattern: str, eod: int, block: int = 1 << 20) -> DataFrame:
    """``doc_id, start, n_tokens`` of every row of ``docs``: written flat, then counted by a scan.

    Null and empty texts count 0; repeated doc_ids keep a row each.
    """
    docs_in = write_flat(docs, path, pattern, eod)
    counts = scan(docs_in.select("file").distinct(), eod, block)
    # Both sides have a row a document: they are merged by a short key, and neither is ever broadcast.
    key = F.xxhash64("file").alias("_file")
    sides = docs_in.select(key, "doc_no", "doc_id").hint("merge"), counts.select(key, "doc_no", "start", "n_tokens")
    return sides[0].join(sides[1], ["_file", "doc_no"]).select("doc_id", "start", "n_tokens")
