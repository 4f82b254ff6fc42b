"""Token ids in files of patched frame-of-reference blocks.

A shard file holds the ids of its documents one after the other, in blocks of ``BLOCK``. A block subtracts its minimum and packs
what is left at the bit width that ``PERCENTILE`` of its ids need; ids that need more are outliers, whose places and whole values
follow as an exception list. An index holds each block's start in the file, so any run of ids is read without the blocks before it:

    magic | blocks: <IBH minimum, width, outliers> packed bits, places <u2, values <u4 | starts <i8 of the blocks and of their end
    | documents: ids <i8, null flags u1, numbers of ids <i8 | <qqq ids, blocks, documents | magic

Documents are range-partitioned by id and sorted inside a partition; each task streams its texts through the tokenizer into one
shard under a name of its own and returns a row of the manifest. A task that runs twice leaves a file that no manifest names, so
lost executors and speculation do no harm. Ids that precede a shard are added up over the manifest, one row per shard.

The tokenizer encodes every piece of its own pre-tokenization by itself, so a worker cuts texts into such pieces and asks the library for
every different piece once; the ids are those of the whole text.

Defined results: a null text is empty and holds the end id alone; null document ids come first; equal ids are ordered by a hash of
their texts; equal rows stay rows of their own; texts of any length are written whole; an empty table gives an empty manifest;
extra columns are not stored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaygrid.llm.common import whole
from assaygrid.plans.bind import Catalog, table
from assaygrid.runtime import materialize, scratch_path

catalog = Catalog()
MAGIC = b"PFORIDS1"
BLOCK = 1024  # ids of a block, a multiple of 8
PERCENTILE = 90  # per cent of a block's ids that its width must hold
CHUNK = 256  # blocks packed or read at once
MEMO = 500_000  # pieces remembered by a worker; then the memory starts afresh
# The tokenizer's own pieces on plain text, where its letters are these and its numbers ASCII digits.
PLAIN = r"[ -~\nÀ-ÖØ-öø-ÿ]*"
WORDS = r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ÿ0-9]+"
END = 2
HEAD, HEAD_SIZE = "<IBH", 7
TAIL, TAIL_SIZE = "<qqq", 24
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"


# --- blocks ------------------------------------------------------------------------------------------------


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of ``values``, a uint32 matrix of one block per row."""
    low = values.min(1)
    rest = values - low[:, None]
    at = max(0, -(-values.shape[1] * percentile // 100) - 1)
    widths = bit_length(np.partition(rest, at, axis=1)[:, at])
    outlier = bit_length(rest.max(1)) > widths
    out: list[bytes] = [b""] * len(values)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8), axis=1, bitorder="little").reshape(len(rows), -1, 32)
        packed = np.packbits(bits[:, :, :width].reshape(len(rows), -1), axis=1, bitorder="little")
        for row, body in zip(rows.tolist(), packed):
            places = np.flatnonzero(rest[row] >> np.uint32(width)) if outlier[row] else np.zeros(0, np.int64)
            out[row] = struct.pack(HEAD, int(low[row]), width, len(places)) + body.tobytes() + places.astype("<u2").tobytes() + rest[row][places].astype("<u4").tobytes()
    return out


def unpack(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in ``raw``, one block per row."""
    heads = [struct.unpack_from(HEAD, raw, s) for s in starts.tolist()]
    widths = np.array([w for _, w, _ in heads], np.int64)
    out = np.empty((len(heads), BLOCK), np.uint32)
    flat = np.frombuffer(raw, np.uint8)
    for width in np.unique(widths).tolist():
        rows, size = np.flatnonzero(widths == width), BLOCK * width // 8
        body = flat[(starts[rows] + HEAD_SIZE)[:, None] + np.arange(size)]
        bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
        bits[:, :, :width] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
        out[rows] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for row, (_, width, n) in enumerate(heads):
        if n:
            at = int(starts[row]) + HEAD_SIZE + BLOCK * width // 8
            out[row, np.frombuffer(raw, "<u2", n, at)] = np.frombuffer(raw, "<u4", n, at + 2 * n)
    return out + np.array([low for low, _, _ in heads], np.uint32)[:, None]


# --- files -------------------------------------------------------------------------------------------------


class Writer:
    """Writes one shard to an open binary stream; holds at most ``CHUNK`` blocks and one text's ids."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.waiting, self.held = sink, 0, [], 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids.astype(np.uint32))
        self.held += len(ids)
        if self.held >= CHUNK * BLOCK:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        full = len(ids) // BLOCK * BLOCK
        for at in range(0, full, CHUNK * BLOCK):
            self._blocks(ids[at : min(at + CHUNK * BLOCK, full)].reshape(-1, BLOCK))
        rest = ids[full:]
        if last and len(rest):
            self._blocks(np.pad(rest, (0, BLOCK - len(rest)), constant_values=rest.min())[None])
            rest = rest[:0]
        self.waiting, self.held = [rest], len(rest)

    def _blocks(self, values: np.ndarray) -> None:
        for block in pack(values):
            self.starts.append(self.at)
            self._put(block)

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        self._flush(last=True)
        n_ids = sum(n for *_, n in self.docs)
        self._put(np.array([*self.starts, self.at], "<i8").tobytes())
        for place, kind in ((0, "<i8"), (1, "u1"), (2, "<i8")):
            self._put(np.array([d[place] for d in self.docs], kind).tobytes())
        self._put(struct.pack(TAIL, n_ids, len(self.starts), len(self.docs)) + MAGIC)
        return len(self.docs), n_ids


class Reader:
    """Reads a shard from an open file that can seek."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        end = size - TAIL_SIZE - len(MAGIC)
        tail = self._read(end, TAIL_SIZE + len(MAGIC))
        if tail[TAIL_SIZE :] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_ids, n_blocks, n_docs = struct.unpack(TAIL, tail[: TAIL_SIZE])
        at = end - 17 * n_docs - 8 * (n_blocks + 1)
        raw = self._read(at, end - at)
        self.starts = np.frombuffer(raw, "<i8", n_blocks + 1)
        at = 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        self.no_id = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the shard; only the blocks that hold them are read."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        begin = int(self.starts[first])
        raw = self._read(begin, int(self.starts[last + 1]) - begin)
        return unpack(raw, self.starts[first : last + 1] - begin).reshape(-1)[start - first * BLOCK : stop - first * BLOCK]

    def runs(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document's place, ids) in order; a long document comes in several runs, an empty one in one without ids."""
        bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        at = doc = 0
        while doc < len(self.sizes):
            ids = self.ids(at, at + CHUNK * BLOCK)
            end = at + len(ids)
            while doc < len(self.sizes):
                a, b = max(at, int(bounds[doc])), min(end, int(bounds[doc + 1]))
                yield doc, ids[a - at : b - at]
                if bounds[doc + 1] > end:
                    break
                doc += 1
            at = end


# --- tokens ------------------------------------------------------------------------------------------------


class Pieces:
    """The library's ids of whole texts, each different piece asked for once; broadcast as its definition.

    ``words`` finds the pieces of a plain text in lower case: those of the tokenizer itself, for texts of printable ASCII, spaces,
    line ends and Latin letters, which normalisation only lowers. Other texts are cut at spaces and line ends, and of their parts
    the plain ones are cut further; what is not plain, and what holds a special token's string, goes to the library as it is.
    """

    def __init__(self, definition: str, words: str = WORDS) -> None:
        self.definition, self.words = definition, words

    def __getstate__(self) -> dict:
        return {"definition": self.definition, "words": self.words}

    def ready(self) -> Pieces:
        if not hasattr(self, "tokenizer"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer, self.memo = Tokenizer.from_str(self.definition), {}
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.plain, self.find = re.compile(PLAIN).fullmatch, re.compile(self.words).findall
        return self

    def cut(self, text: str) -> list[str]:
        if self.plain(text) and not any(s in text for s in self.special):
            return self.find(text.lower())
        parts = text.replace("\n", " ").split(" ")
        return [text] if len(parts) == 1 else list(chain.from_iterable(map(self.cut, parts)))

    def ids(self, text: str) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        pieces = self.cut(text)
        found = list(map(memo.get, pieces))
        if None in found:
            new = list({p for p, ids in zip(pieces, found) if ids is None})
            memo.update((p, array("I", e.ids).tobytes()) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)))
            found = list(map(memo.get, pieces))
            for p in new:
                if len(p) > 64:
                    del memo[p]
        return np.frombuffer(b"".join(found), np.uint32)


def opened(path: str):
    """File system and path inside it, of any store that Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def write(docs: DataFrame, definition: str, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The manifest (shard, path, n_docs, n_ids, start: the ids of all shards before it) of the files written."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces(definition))
    folder = scratch_path(spark)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        pieces = shared.value.ready()
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        with files.open_output_stream(f"{root}/{name}") as sink:
            writer = Writer(sink)
            for batch in chain([first], batches):
                for i, t in zip(batch.column(0), batch.column(1)):
                    writer.add(i.as_py(), np.append(pieces.ids(t.as_py()), np.uint32(end)))
            n_docs, n_ids = writer.close()
        row = [TaskContext.get().partitionId()], [f"{folder}/{name}"], [n_docs], [n_ids]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_ids"])

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(F.col(text)).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    laid = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = materialize(laid.mapInArrow(store, MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the write
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, inside = opened(path)
                with files.open_input_file(inside) as file:
                    reader = Reader(file, file.size())
                    sums = [0] * len(reader.sizes)
                    for doc, ids in reader.runs():
                        sums[doc] = zlib.crc32(ids.astype("<u4").tobytes(), sums[doc])
                    starts = np.cumsum(reader.sizes) - reader.sizes + base
                    columns = [pa.array(reader.doc_ids, mask=reader.no_id), pa.array(starts, pa.int64()), pa.array(reader.sizes), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.repartitionByRange(max(1, manifest.count()), "shard").select("path", "start")
    return shards.mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@catalog.add("op12_token_files")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    return read(write(table(spark, sf, "documents").select("doc_id", "text"), definition))
