"""Token ids in fixed-width bit-packed files.

A file holds the ids of consecutive documents in ascending doc_id order:

    header    magic, bits an id, ids a block, documents, ids          (little endian)
    table     doc_id int64 and null flag of each document, ids before each document uint64
    blocks    byte offset of each block uint64
    payload   blocks of ids, each id in the least bits the vocabulary needs, lowest bit first

A block starts at a byte, so any id is found by one seek and unpacked by numpy without a loop.

Defined results: a null or empty text holds its end id only; null doc_ids come first; rows that
repeat a doc_id are documents of their own, in the order of their texts' hashes; texts of any length go
whole to one file; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, groups
from .common import held, new_path, release, written

MAGIC = b"VKTOK1\0\0"
HEADER = struct.Struct("<8sIIQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits each, lowest bit first; whole machine words are the same layout without a shift."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) != 0, bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    cells = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (cells.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int) -> Iterator[bytes]:
    n = len(doc_ids)
    starts = np.zeros(n + 1, "<u8")
    np.cumsum(lengths, out=starts[1:])
    full = (block * bits + 7) // 8
    n_blocks = -(-len(ids) // block)
    yield HEADER.pack(MAGIC, bits, block, n, len(ids))
    yield np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    yield np.array([d is None for d in doc_ids], np.uint8).tobytes()
    yield starts.tobytes()
    yield (np.arange(n_blocks + 1, dtype="<u8") * full).tobytes()
    for at in range(0, len(ids), block):
        yield pack(ids[at : at + block], bits)


class TokenFile:
    """Random access to one file, opened by any reader with seek() and read()."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack(source.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        doc_ids, null = np.frombuffer(source.read(8 * n), "<i8"), np.frombuffer(source.read(n), np.uint8)
        self.doc_ids = [None if m else int(d) for d, m in zip(doc_ids, null)]
        self.starts = np.frombuffer(source.read(8 * (n + 1)), "<u8").astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = HEADER.size + 9 * n + 8 * (n + 1) + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop, reading their blocks only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(self.payload + int(self.offsets[first]))
        upto = min(self.n_ids, (last + 1) * self.block)
        out, each = [], (self.block * self.bits + 7) // 8
        data = self.source.read(int(self.offsets[last] - self.offsets[first]) + ((upto - last * self.block) * self.bits + 7) // 8)
        if self.block * self.bits % 8 == 0:
            out.append(unpack(data, upto - first * self.block, self.bits))
        else:
            for b in range(first, last + 1):
                out.append(unpack(data[(b - first) * each : (b - first + 1) * each], min(self.block, self.n_ids - b * self.block), self.bits))
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class LibraryEncoder(ChunkEncoder):
    """The tokenizers library over whole texts, asked once for each distinct chunk.

    The library itself encodes a text's pieces apart from each other; chunks end where the pieces of the
    byte-level pattern always end, so their ids end to end are the ids of the text.  Texts that can't be
    cut so go to the library whole, and so do all texts where the file names another pre-tokenizer or
    normaliser.  The table of chunks is bounded in bytes.
    """

    def __init__(self, path: str, room: int = 256 << 20):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # such strings in a text are ordinary text
        self.bits = bits_for(self.library.get_vocab_size())
        self.kind = "<u2" if self.bits <= 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer")
        if self.cuts:
            self.spaced = np.zeros(self.library.get_vocab_size(), bool)
            self.spaced[[i for t, i in self.library.get_vocab().items() if t.startswith("\u0120")]] = True
            super().__init__(self.whole(["\n"])[0], room)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, chunks: list[str]) -> list[bytes]:
        """Joined with a space before each, chunks are cut in the same places again, and only the first id
        of each begins with the space."""
        out: dict[str, bytes] = {}
        begins, rest = [c for c in chunks if c[0] == "\n"], []
        out.update(zip(begins, self.whole(begins)))
        ask = [c for c in chunks if c[0] != "\n"]
        parts = [ask[k : k + 500] for k in range(0, len(ask), 500)]
        for e, part in zip(self.library.encode_batch_fast([" " + " ".join(x) for x in parts], add_special_tokens=False), parts):
            ids = np.array(e.ids, self.kind)
            starts = np.flatnonzero(self.spaced[ids]).tolist()
            if len(starts) != len(part):
                rest += part
                continue
            data, width = ids.tobytes(), ids.itemsize
            for p, a, b in zip(part, starts, [*starts[1:], len(ids)]):
                out[p] = data[a * width : b * width]
        out.update(zip(rest, self.whole([" " + p for p in rest])))
        return [out[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        return super().encode(texts) if self.cuts else self.whole(texts)


def encoder_of(path: str) -> LibraryEncoder:
    """The encoder of this Python worker, so that its table lasts from task to task."""
    return held(("tokens", path), lambda: LibraryEncoder(path))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, docs_per_file: int = 4000, bytes_per_file: int = 32_000_000, block: int = 4096) -> DataFrame:
    """Writes the files of docs (doc_id, text); gives one row per file, itself a written table:
    path, first_doc, first_key, n_docs, n_tokens.  A task writes a file whenever it holds as many bytes of
    ids, so that very long texts don't add up.  Files of lost or repeated attempts aren't listed."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one doc_id stand in the order of their texts' hashes, so that they can be dealt to several tasks
    rows = rows.withColumn("key", F.xxhash64("text"))
    n_files = max(1, -(-docs.count() // docs_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        release(("tokens", tokenizer_path))
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], encoder.kind).tobytes()
        width = len(end)
        store, at = fs.FileSystem.from_uri(folder)

        def write(ids: list[int | None], key: int, lengths: list[int], data: list[bytes]) -> pa.RecordBatch:
            store.create_dir(at, recursive=True)
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{at}/{name}.part") as out:
                for piece in file_bytes(ids, lengths, np.frombuffer(b"".join(data), encoder.kind), encoder.bits, block):
                    out.write(piece)
            store.move(f"{at}/{name}.part", f"{at}/{name}.tok")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.tok"], "first_doc": pa.array([ids[0]], pa.int64()), "first_key": pa.array([key], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([sum(lengths)], pa.int64())})

        ids, key, lengths, data, size = [], 0, [], [], 0
        for batch in batches:
            for lo, texts in groups(batch.column(1)):
                if not ids:
                    key = batch.column(2)[lo].as_py()
                ids += batch.column(0).slice(lo, len(texts)).to_pylist()
                for x in encoder.encode(texts):
                    data.append(x + end)
                    lengths.append(len(data[-1]) // width)
                    size += len(data[-1])
                if size >= bytes_per_file:
                    yield write(ids, key, lengths, data)
                    ids, lengths, data, size = [], [], [], 0
        if ids:
            yield write(ids, key, lengths, data)

    ranged = rows.repartitionByRange(n_files, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    return written(ranged.mapInArrow(run, "path string, first_doc long, first_key long, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: start counts the ids of
    all documents before it, ids_crc32 is the crc32 of its ids as little-endian uint32."""
    # one row per file, so this single ordered pass stays small
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_key").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, min(10_000, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    f = TokenFile(source)
                    sums = []
                    for lo in range(0, len(f.doc_ids), 512):
                        hi = min(len(f.doc_ids), lo + 512)
                        ids = f.ids(int(f.starts[lo]), int(f.starts[hi])).astype("<u4")
                        data, first = memoryview(ids).cast("B"), int(f.starts[lo])
                        sums += [zlib.crc32(data[4 * (int(f.starts[k]) - first) : 4 * (int(f.starts[k + 1]) - first)]) for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1] + base, pa.int64()), pa.array(np.diff(f.starts), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
