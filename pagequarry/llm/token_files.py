"""Token files coded by a static range asymmetric numeral system.

Texts are encoded to ids, in ascending doc_id order, and written to shards.
One frequency table, counted over all ids, serves every shard.

A shard holds blocks of :data:`BLOCK` ids at most.  A block is coded by
``lanes`` interleaved coders that share one stream of 32-bit words, so numpy
codes a whole row of lanes at a time.  Blocks need nothing from each other; in
a block, checkpoints (all lanes' states and the place in the stream) let a
reader start every :data:`CHECKPOINT` ids.  A block's checksum covers its ids,
another the coded bytes.

Layout of a shard, all little-endian::

    magic
    block*      header (n_ids, lanes, n_checkpoints, n_words, ids_crc, data_crc: u32),
                n_checkpoints * (word: u64, states: lanes * u64), words: n_words * u32
    documents   doc_id: i64 * n, is_null: u8 * n, n_tokens: u64 * n
    blocks      (offset: u64, first id: u64) * n_blocks
    footer      documents' offset, n, blocks' offset, n_blocks, n_ids: u64 each, magic
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stage, new_folder, stage_table
from .separator_scan import open_folder, tasks_for

MAGIC = b"PQRANS01"
BLOCK, CHECKPOINT = 1 << 18, 1 << 17
_BITS, _LOW, _WORD = np.uint64(20), np.uint64(1 << 31), np.uint64(32)
_MASK, _WORD_MASK = np.uint64((1 << 20) - 1), np.uint64((1 << 32) - 1)
_HEAD, _FOOT = struct.Struct("<6I"), struct.Struct("<5Q8s")


# --- ids of texts -----------------------------------------------------------


#: Characters whose class is the same in every version of Unicode: letters, digits, and signs but the apostrophe.
_LETTER, _DIGIT, _SIGN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9", "!-&(-/:-@\\[-`{-~"


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: a byte's own if it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(rest)}


#: What a tokenizer file must say for its texts to be cut here; texts of any other go through the library whole.
_ASSUMED = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class ChunkEncoder:
    """Whole texts through a ``tokenizers`` file.

    A byte-level pre-tokenizer cuts a text to pieces, and the library's model
    encodes each distinct piece once as long as it stays in the cache.  Texts of
    letters, digits, signs and blanks of ASCII and Latin-1 are cut to pieces here,
    since every version of Unicode agrees on these.  Others are cut to chunks at the
    last space before anything that isn't white space, where a piece always starts;
    chunks that hold anything else go through the library whole.
    """

    def __init__(self, path: str, cached: int = 400_000, dtype: str = "<u2"):
        import json
        import os

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        cut, model = settings.get("pre_tokenizer") or {}, settings["model"]
        self.known = settings.get("normalizer") is None and not settings.get("truncation") and model["type"] == "BPE" and not model.get("dropout")
        self.known = self.known and all(cut.get(k) == v for k, v in _ASSUMED.items())
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.cut, self.odd = regex.compile(r"(?= [^\s\x1c-\x1f])", regex.V1), regex.compile(r" (?:[\s\x1c-\x1f]|\Z)")
        run = f"[{_LETTER}]+|[{_DIGIT}]+|[{_SIGN}]+"
        self.plain = regex.compile(rf"(?:{run})(?:\n?(?:{run}))*")
        self.pieces_of = regex.compile(rf"{run}|\n").findall
        self.strange = re.compile(rf"[^\t\n\r -~{_LETTER}]").search
        self.pieces_in = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+").findall
        self.border = re.compile(r" (?=\S)").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached, self.dtype, self.code = cached, dtype, {"<u2": "H", "<u4": "I"}[dtype]
        self.words: dict[str, bytes] = {}  # chunks without the space that they start with
        self.heads: dict[str, bytes] = {}  # chunks that start a text
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.cached:
                self.pieces.clear()
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
            found = self.pieces[piece] = array(self.code, ids).tobytes()
        return found

    def _learn(self, known: dict[str, bytes], chunks: list[str], lead: str) -> None:
        new = {c for c in chunks if c not in known}
        if len(known) + len(new) > self.cached:
            known.clear()
            new = set(chunks)
        whole = []
        for c in new:
            if self.plain.fullmatch(c) and not any(s in c for s in self.special):
                first, *rest = self.pieces_of(c)
                known[c] = self._piece(lead + first) + b"".join(map(self._piece, rest)) if rest else self._piece(lead + first)
            else:
                whole.append(c)
        for c, found in zip(whole, self.tokenizer.encode_batch_fast([lead + c for c in whole], add_special_tokens=False) if whole else ()):
            known[c] = np.array(found.ids, dtype=self.dtype).tobytes()

    def _ids(self, known: dict[str, bytes], chunks: list[str], lead: str) -> bytes:
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            self._learn(known, chunks, lead)
            return b"".join(map(known.__getitem__, chunks))

    def _plain_slices(self, text: str, size: int = 200_000):
        """Slices of a text between whose ends no piece lies."""
        at = 0
        while at < len(text):
            found = self.border(text, at + size) if at + size < len(text) else None
            stop = found.start() if found else len(text)
            yield text[at:stop]
            at = stop

    def _from_pieces(self, text: str) -> bytes:
        out = []
        for part in self._plain_slices(text):
            found = self.pieces_in(part)
            try:
                out.append(b"".join(map(self.pieces.__getitem__, found)))
            except KeyError:
                out.append(b"".join(map(self._piece, found)))
        return b"".join(out)

    def encode(self, text: str | None, slice_of: int = 50_000) -> bytes:
        if not text:
            return b""
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if not self.strange(text) and not any(s in text for s in self.special):
            return self._from_pieces(text)
        if self.odd.search(text):
            parts = [p for p in self.cut.split(text) if p]
            head = "" if parts[0][0] == " " and self.cut.match(parts[0]) else parts.pop(0)
            parts = [p[1:] for p in parts]
        else:
            head, *parts = text.split(" ")
        out = [self._ids(self.heads, [head], "")] if head else []
        for k in range(0, len(parts), slice_of):
            out.append(self._ids(self.words, parts[k : k + slice_of], " "))
        return b"".join(out)


@lru_cache(maxsize=1)
def _chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


# --- the coder --------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**20; every id that occurs has one at least."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> "Table":
        counts = np.asarray(counts, dtype=np.int64)
        space, total = 1 << 20, int(counts.sum())
        if total == 0:
            counts, total = np.ones(1, dtype=np.int64), 1
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * space / total).astype(np.int64)), 0)
        order = np.argsort(-freq, kind="stable")
        k = 0
        while (rest := space - int(freq.sum())) != 0:  # what rounding left goes to, or comes from, the frequent ids
            s = order[k % len(order)]
            k += 1
            step = rest if rest > 0 else max(rest, -(int(freq[s]) - 1) // 2)
            freq[s] += step
        ends = np.cumsum(freq)
        return Table(freq.astype(np.uint64), (ends - freq).astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def encode_block(ids: np.ndarray, table: Table, checkpoint: int = CHECKPOINT) -> bytes:
    n = len(ids)
    lanes = int(min(512, max(1, n // 64)))
    steps = -(-n // lanes)
    every = max(1, checkpoint // lanes)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << np.uint64(43)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * steps
    states = {}
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        now, f = x[: b - a], freq[a:b]
        full = now >= limit[a:b]
        if full.any():
            words[t] = (now[full] & _WORD_MASK).astype("<u4")
            now = np.where(full, now >> _WORD, now)
        q = now // f
        x[: b - a] = (q << _BITS) + (now - q * f) + start[a:b]
        if t % every == 0:
            states[t] = x.copy()
    before = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    points = b"".join(struct.pack("<Q", int(before[t])) + states[t].astype("<u8").tobytes() for t in sorted(states))
    stream = np.concatenate(words).astype("<u4").tobytes() if steps else b""
    data = points + stream
    return _HEAD.pack(n, lanes, len(states), len(stream) // 4, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(data)) + data


class BadBlock(ValueError):
    """A block's bytes don't fit its checksums."""


def decode_block(block: bytes, table: Table, first: int = 0, stop: int | None = None, checkpoint: int = CHECKPOINT) -> np.ndarray:
    """Ids ``first`` to ``stop`` of a block, decoded from the last checkpoint before ``first``."""
    n, lanes, n_points, n_words, ids_crc, data_crc = _HEAD.unpack_from(block)
    size = n_points * 8 * (lanes + 1) + 4 * n_words
    data = block[_HEAD.size : _HEAD.size + size]
    if len(data) != size or zlib.crc32(data) != data_crc:
        raise BadBlock("coded bytes differ from their checksum")
    stop = n if stop is None else min(stop, n)
    if first >= stop:
        return np.empty(0, dtype=np.uint32)
    every = max(1, checkpoint // lanes)
    point = first // lanes // every
    at = point * 8 * (lanes + 1)
    place = struct.unpack_from("<Q", data, at)[0]
    x = np.frombuffer(data, dtype="<u8", count=lanes, offset=at + 8).astype(np.uint64)
    words = np.frombuffer(data, dtype="<u4", count=n_words, offset=n_points * 8 * (lanes + 1)).astype(np.uint64)
    t0, t1 = point * every, -(-stop // lanes)
    out = np.empty((t1 - t0) * lanes, dtype=np.uint32)
    for t in range(t0, t1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        now = x[: b - a]
        slot = now & _MASK
        s = table.symbol[slot]
        out[a - t0 * lanes : b - t0 * lanes] = s
        now = table.freq[s] * (now >> _BITS) + slot - table.start[s]
        low = np.flatnonzero(now < _LOW)
        if len(low):
            now[low] = (now[low] << _WORD) | words[place : place + len(low)]
            place += len(low)
        x[: b - a] = now
    found = out[first - t0 * lanes : stop - t0 * lanes]
    if first == 0 and stop == n and zlib.crc32(found.astype("<u4").tobytes()) != ids_crc:
        raise BadBlock("ids differ from their checksum")
    return found


# --- shards -----------------------------------------------------------------


class ShardWriter:
    """Streams documents to one shard; holds one block of ids at a time."""

    def __init__(self, out, table: Table):
        self.out, self.table, self.place = out, table, 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[tuple[int, int]] = []
        self.open: list[np.ndarray] = []
        self.n_open = self.n_ids = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.empty(0, dtype=np.uint16)
        k = 0
        while len(ids) - k >= least and k < len(ids):
            part = ids[k : k + BLOCK]
            self.blocks.append((self.place, self.n_ids))
            self._write(encode_block(part, self.table))
            self.n_ids += len(part)
            k += len(part)
        self.open, self.n_open = [ids[k:]], len(ids) - k

    def close(self) -> None:
        self._flush(1)
        at = self.place
        self._write(np.array([d if d is not None else 0 for d in self.docs], dtype="<i8").tobytes())
        self._write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
        self._write(np.array(self.lengths, dtype="<u8").tobytes())
        blocks_at = self.place
        self._write(np.array(self.blocks, dtype="<u8").tobytes())
        self._write(_FOOT.pack(at, len(self.docs), blocks_at, len(self.blocks), self.n_ids, MAGIC))
        self.out.close()


class ShardReader:
    """Reads a shard by its footer; a block or a document at a time."""

    def __init__(self, uri: str, table: Table):
        source, inside = open_folder(uri)
        self.file, self.table = source.open_input_file(inside), table
        size = self.file.size()
        self.file.seek(size - _FOOT.size)
        at, n, blocks_at, n_blocks, self.n_ids, magic = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"no token shard: {uri}")
        self.file.seek(at)
        self.doc_ids = np.frombuffer(self.file.read(8 * n), dtype="<i8")
        self.nulls = np.frombuffer(self.file.read(n), dtype=np.uint8)
        self.lengths = np.frombuffer(self.file.read(8 * n), dtype="<u8").astype(np.int64)
        self.file.seek(blocks_at)
        places = np.frombuffer(self.file.read(16 * n_blocks), dtype="<u8").reshape(-1, 2).astype(np.int64)
        self.offsets = np.concatenate((places[:, 0], [at]))
        self.firsts = np.concatenate((places[:, 1], [self.n_ids]))

    def _block(self, k: int) -> bytes:
        self.file.seek(int(self.offsets[k]))
        return self.file.read(int(self.offsets[k + 1] - self.offsets[k]))

    def range(self, first: int, stop: int) -> np.ndarray:
        """Any range of the shard's ids."""
        found = [np.empty(0, dtype=np.uint32)]
        k = int(np.searchsorted(self.firsts, first, side="right")) - 1
        while first < stop and k < len(self.firsts) - 1:
            base = int(self.firsts[k])
            found.append(decode_block(self._block(k), self.table, first - base, min(stop, int(self.firsts[k + 1])) - base))
            first, k = int(self.firsts[k + 1]), k + 1
        return np.concatenate(found)

    def documents(self):
        """(doc_id or None, start in the shard, n_tokens, crc32 of the ids) in order, over one block at a time."""
        block = np.empty(0, dtype=np.uint32)
        k = at = start = 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            crc, left = 0, n
            while left:
                if at == len(block):
                    block, at, k = decode_block(self._block(k), self.table), 0, k + 1
                part = block[at : at + left]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                at += len(part)
                left -= len(part)
            yield (None if null else doc_id), start, n, crc
            start += n


@dataclass(frozen=True)
class TokenFiles:
    """``shards`` (``file, range_no, first_row, first_doc, n_docs, n_ids``) and the frequency counts that they were coded with.

    ``range_no`` and ``first_row`` (the first document's place in its range) give the shards' order.
    """

    shards: DataFrame
    counts: tuple[tuple[int, int], ...]
    vocabulary: int

    def table(self) -> Table:
        counts = np.zeros(self.vocabulary, dtype=np.int64)
        for i, n in self.counts:
            counts[i] = n
        return Table.of(counts)


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> TokenFiles:
    """Encode, sort and write the texts of ``docs`` (``doc_id, text``).

    Texts, not ids, are dealt by range of doc_id (one shuffle); each range is
    sorted and encoded once into an interim table of 16-bit ids, the ids are
    counted (as many rows as the vocabulary has come to the driver), and each
    range becomes a shard, or several where its interim file is read in parts.
    A read task may get any files in any order, so each row carries its range
    and its place there.  Null texts are empty; rows with the same doc_id
    are documents of their own, next to each other; null doc_ids come first.
    Without a ``folder`` the shards are interim files, which go when the program ends.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], dtype="<u2").tobytes()

    def to_ids(batches):
        own, range_no, row = _chunk_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = pa.array([own.encode(t.as_py()) + end for t in batch.column(1)], pa.binary())
            n = batch.num_rows
            place = pa.array(np.arange(row, row + n, dtype=np.int64))
            row += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, range_no, dtype=np.int32)), place, batch.column(0), ids], names=["range_no", "row", "doc_id", "ids"])

    ids = stage_table(ordered.mapInArrow(to_ids, "range_no int, row long, doc_id long, ids binary"), "token-ids")

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype="<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["id", "n"])

    counted = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    counts = tuple((r["id"], r["n"]) for r in counted)
    table = TokenFiles(docs, counts, (counts[-1][0] + 1) if counts else 1).table()
    folder = folder.rstrip("/") if folder else new_folder(spark, "tokens")

    def to_shards(batches):
        target, inside = open_folder(folder)
        target.create_dir(inside, recursive=True)
        writer, following = None, None
        made = []

        def done():
            writer.close()
            made.append((name, *first, len(writer.docs), writer.n_ids))

        for batch in batches:
            for range_no, row, doc_id, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if writer is not None and (range_no, row) != following:  # another range's file, or another part of one, begins
                    done()
                    writer = None
                if writer is None:
                    name = f"{folder}/shard-{range_no:06d}-{row:012d}-{uuid.uuid4().hex}.rans"
                    writer, first = ShardWriter(target.open_output_stream(f"{inside}/{name.rsplit('/', 1)[1]}"), table), (range_no, row, doc_id)
                writer.add(doc_id, np.frombuffer(x.as_buffer(), dtype="<u2"))
                following = (range_no, row + 1)
        if writer is not None:
            done()
        types = {"file": pa.string(), "range_no": pa.int32(), "first_row": pa.int64(), "first_doc": pa.int64(), "n_docs": pa.int64(), "n_ids": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 6, types.values())], names=list(types))

    shards = stage_table(ids.mapInArrow(to_shards, "file string, range_no int, first_row long, first_doc long, n_docs long, n_ids long"), "token-shards")
    drop_stage(ids)
    return TokenFiles(shards, counts, len(table.freq))


def read_documents(files: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the shards.

    ``start`` counts the ids of all documents before it: a running sum over the
    shards (a row each), then within a shard.  Each shard is one task's stream.
    """
    table = files.table()
    order = W.orderBy("range_no", "first_row").rowsBetween(W.unboundedPreceding, -1)
    placed = files.shards.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("file", "base")

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(ShardReader(name, table).documents())
                for k in range(0, len(rows), 8192):
                    ids, starts, ns, crcs = zip(*rows[k : k + 8192])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(np.array(starts, dtype=np.int64) + base), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    # A number is given, as adaptive execution would merge rows as small as these to one task.
    return placed.repartition(tasks_for(files.shards), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
