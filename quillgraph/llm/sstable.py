"""Token shards as sorted string tables.

A shard file holds documents in ascending key order::

    "QSST0001" | blocks | index | Bloom filter | footer

A block is zstd-compressed entries ``varint shared, varint rest, varint size, key rest, ids``: each key gives only what
differs from the key before it; the first key of a block is whole. The sparse index has one line per block (first key,
offset, length, documents, ids), the Bloom filter holds all keys, and the fixed-size footer says where both stand and
how many documents and ids the file has. ``Table.get`` asks the filter, binary-searches the index and reads one block.

A key is one byte for null (0) or not (1) and the identifier as big-endian with its sign bit turned, so that bytes sort
as identifiers, nulls first. Repeated identifiers stay as separate entries, ordered by text. Null and empty text has
the end id alone. Ids are two bytes where the vocabulary allows, else four.
"""

from __future__ import annotations

import bisect
import os
import struct
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_uri, open_store, shared_dir, table
from quillgraph.llm.text import slices

MAGIC = b"QSST0001"
#: Bytes of entries in a block before compression, at least.
BLOCK_BYTES = 1 << 17
FOOTER = struct.Struct("<QQQQQQI8s")
END_ID = 2
#: Pieces whose ids a worker remembers, at most about this many.
CACHE_PIECES = 1_000_000


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    """Writes one shard to a binary stream; keys must not descend."""

    def __init__(self, out, width: int = 2):
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.entries, self.size, self.first, self.last = [], 0, b"", b""
        self.block_docs = self.block_ids = self.docs = self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.entries += [entry, ids]
        self.size += len(entry) + len(ids)
        self.last = key
        self.keys.append(key)
        self.block_docs += 1
        self.block_ids += len(ids) // self.width
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.entries))
            self.index.append((self.first, self.at, len(data), self.block_docs, self.block_ids))
            self._put(data)
            self.docs, self.ids = self.docs + self.block_docs, self.ids + self.block_ids
            self.entries, self.size, self.block_docs, self.block_ids = [], 0, 0, 0

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QQQQ", *rest) for k, *rest in self.index))
        bloom_at, bits = self.at, max(64, 10 * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        places = np.array([p for k in self.keys for p in _probes(k, bits)], np.int64)
        np.bitwise_or.at(bloom, places >> 3, (1 << (places & 7)).astype(np.uint8))
        self._put(bloom.tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.docs, self.ids, self.width, MAGIC))


class Table:
    """Reads a shard from a seekable binary file of ``size`` bytes."""

    def __init__(self, file, size: int):
        self.file = file
        index_at, index_size, bloom_at, self.bits, self.docs, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        data, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QQQQ", data, at + n)))
            at += n + 32
        self.firsts = [x[0] for x in self.index]
        self.bloom = self._read(bloom_at, -(-self.bits // 8))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int):
        data = zstandard.ZstdDecompressor().decompress(self._read(self.index[i][1], self.index[i][2]))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each entry with this identifier."""
        key, out = key_of(doc_id), []
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return out
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            out += [ids for k, ids in self._block(i) if k == key]
            i += 1
        return out


class _Known(dict):
    """Pieces with their ids; those asked for the first time are learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, piece: bytes) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class Encoder:
    """Ids of whole texts, from a vocabulary whose pieces never cross white space, by remembering pieces.

    Text is cut at ASCII white space, where the vocabulary's own pattern cuts too. Where text is in normal form C, before
    and after lower-casing A-Z, pieces are lower-cased first, as the vocabulary itself does. An unknown piece of letters,
    or of letters and one mark at its end, goes straight to the library's model; others go through its whole encoder.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known = _Known(self._learn)
        self.model = self.tokenizer.model
        self.code = "H" if self.width == 2 else "I"
        self.marks = {x: self._ids(x) for x in ".,"}
        #: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of_letters(self, body: str) -> bytes:
        return array(self.code, [x.id for x in self.model.tokenize(body)]).tobytes()

    def pieces(self, text: str) -> list[bytes]:
        data = text.encode()
        low = data.lower()
        if "<|" in text or not (text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low.decode())):
            return data.split()
        return low.split()

    def _learn(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII alone
            return self._of_letters(piece.decode().lower())
        text = piece.decode()
        mark = self.marks.get(text[-1])
        if mark and piece[:-1].isalpha():
            return self.known[piece[:-1]] + mark
        if "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
            return self._ids(text)
        if mark and text[:-1].isalpha():
            return self.known[piece[:-1]] + mark
        if not text.isalpha():
            return self._ids(text)
        low = text.lower()
        return self._of_letters(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        find = self.known.__getitem__
        return [b"".join(map(find, self.pieces(x or ""))) for x in texts]


_encoders: dict[str, Encoder] = {}


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> list[tuple[int, str, int, int]]:
    """Writes ``docs`` (doc_id, text) under ``folder`` in ascending order over shards: number, file, documents and ids of each.

    A shard is written under a name of its own attempt and then renamed, so a task that runs again leaves one whole file.
    Ranges are of identifiers and beginnings of texts, so that many rows of one identifier, or of none, fill several shards.
    """
    folder = arrow_uri(docs.sparkSession, folder)

    def write(batches):
        encoder = _encoders.setdefault(tokenizer, None) or Encoder(tokenizer)
        _encoders[tokenizer] = encoder
        end = end_id.to_bytes(encoder.width, "little")
        fs, root = open_store(folder)
        shard = TaskContext.get().partitionId()
        at, own = f"{root}/shard-{shard:06d}.sst", f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
        out = writer = None
        for batch in slices(batches):
            if writer is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(own)
                writer = Writer(out, encoder.width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                writer.add(key_of(doc_id), ids + end)
        if writer is not None:
            writer.close()
            out.close()
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                fs.delete_file(at)
            fs.move(own, at)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"shard-{shard:06d}.sst"], "docs": [writer.docs], "ids": [writer.ids]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return sorted(map(tuple, rows.mapInArrow(write, "shard long, path string, docs long, ids long").collect()))


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; one task per file."""
    folder = arrow_uri(spark, folder)
    starts = np.cumsum([0, *(x[3] for x in shards)]).tolist()

    def read(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fs, root = open_store(folder)
                at = f"{root}/{shards[i][1]}"
                with fs.open_input_file(at) as file:
                    start, rows = starts[i], []
                    for key, ids in Table(file, fs.get_file_info(at).size):
                        rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _table(rows)
                            rows = []
                    yield _table(rows)

    def _table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = len(shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shards = write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, folder, shards)


QUERIES = {"op5_token_shards": op5_token_shards}
SQL: dict[str, str] = {}
