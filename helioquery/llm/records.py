"""Token ids in length-delimited binary record files with a separate offset index.

Documents are dealt by ranges of their ids; each partition tokenizes its range in id order and writes one record file
and one index file, named after the partition, under a name of its own first and then renamed, so a repeated task
replaces whole files. A record is: payload length (u64), masked CRC-32 of these 8 bytes (u32), payload, masked CRC-32 of
the payload (u32); all little-endian. The payload is: flags (u8; 1: the id is null), bytes per token (u8; 2 where the
vocabulary fits, else 4), document id (i64), token ids. The index is: magic, number of records (u64), their offsets
(u64 each), masked CRC-32 of the offsets. Masking rotates a CRC by 15 bits and adds a constant, so that checksums of
data that hold checksums stay strong.

Tokenizing cuts a text before spaces that a non-space follows, around lone line ends, and between a word and a lone
comma or full stop. A byte-level pre-tokenizer always has a bound there, so pieces are encoded apart, each distinct one
once per worker as far as its bounded memory goes, with the same ids as the whole text. Texts that may hold an added
token are encoded whole.

Null texts count as empty and give the end id alone; null ids come first; rows with equal ids are ordered by a hash of
the text; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, partitions, ship, slices, written

MAGIC = b"HQINDEX1"
_MASK_DELTA = 0xA282EAD8
_HEAD = struct.Struct("<BBq")
_SPACE = re.compile(r" (?=\S)")
_RUN = re.compile(r"\s\s")
#: A stop that doesn't follow a letter or digit.
_BARE_STOP = re.compile(r"[,.]\s(?<![^\W_]..)", re.S)
_CACHE = 400_000
_SUB_BATCH = 1 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _HEAD.pack(doc_id is None, width, doc_id or 0) + ids.astype("<u2" if width == 2 else "<u4").tobytes()


def read_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, width, doc_id = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=_HEAD.size)


def _checked(data: bytes, crc: int, what: str) -> bytes:
    if masked_crc(data) != crc:
        raise ValueError(f"bad checksum of {what}")
    return data


def read_records(data) -> Iterator[bytes]:
    """Payloads of an open record file, in order, one in memory at a time."""
    while head := data.read(12):
        if len(head) < 12:
            raise ValueError("truncated record")
        (n,) = struct.unpack("<Q", _checked(head[:8], struct.unpack("<I", head[8:])[0], "a length"))
        body = data.read(n + 4)
        if len(body) < n + 4:
            raise ValueError("truncated record")
        yield _checked(body[:n], struct.unpack("<I", body[n:])[0], "a record")


def read_index(data: bytes) -> np.ndarray:
    if data[:8] != MAGIC:
        raise ValueError("not an index")
    (n,) = struct.unpack_from("<Q", data, 8)
    body = _checked(data[16 : 16 + 8 * n], struct.unpack_from("<I", data, 16 + 8 * n)[0], "an index")
    return np.frombuffer(body, "<u8")


def read_record(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One document by its number in the file, by way of the index."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{name}.idx") as f:
        offset = int(read_index(f.read())[number])
    with store.open_input_file(name) as f:
        f.seek(offset)
        return read_payload(next(read_records(f)))


class _Places(dict):
    """Number of each piece; pieces not seen yet get the next number and are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Encoder:
    """Whole texts to ids, with a bounded memory of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(size, bool)  # tokens that begin with a space, as byte-level vocabularies write it
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token[:1] == "\u0120"
        self.line_end = self.tokenizer.token_to_id("\u010a")
        self.place = _Places()
        self.starts, self.lengths, self.flat, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self) -> None:
        """Encode the pieces listed as new. Pieces that begin with their only space, and pieces without white space, are
        joined to be encoded together; spaces and line ends show in the ids where each one ends."""
        pieces, first = self.place.new, len(self.place) - len(self.place.new)
        lead, bare, odd = [], [], []
        for i, p in enumerate(pieces, first):
            rest = p[1:] if p[:1] == " " else p
            if not rest or not rest.isprintable() or " " in rest:  # white space but the plain space is not printable
                odd.append((i, p))
            elif rest is p:
                bare.append((i, p))
            else:
                lead.append((i, p))
        for i, p in odd:
            self._keep([i], self._ids(p), np.zeros(1, int))
        for k in range(0, len(lead), 1000):
            run = lead[k : k + 1000]
            ids = self._ids("".join([p for _, p in run]))
            self._keep([i for i, _ in run], ids, np.flatnonzero(self.spaced[ids]))
        for k in range(0, len(bare), 1000):
            run = bare[k : k + 1000]
            ids = self._ids("\n".join([p for _, p in run]))
            ends = np.flatnonzero(ids == self.line_end)
            self._keep([i for i, _ in run], np.delete(ids, ends), np.concatenate(([0], ends - np.arange(len(ends)))))
        self.place.new = []

    def _keep(self, numbers: list[int], ids: np.ndarray, starts: np.ndarray) -> None:
        if len(starts) != len(numbers):
            raise ValueError("this tokenizer does not part texts at spaces and line ends")
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while max(numbers) >= len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + starts
        self.lengths[numbers] = np.diff(np.append(starts, len(ids)))
        self.used += len(ids)

    def _forget(self, size: int, used: int) -> None:
        """Drop the pieces numbered from ``size`` on."""
        while len(self.place) > size:
            self.place.popitem()
        self.used = used

    def pieces(self, text: str) -> list[str]:
        if "\0" in text or any(a in text for a in self.added):
            return [text]
        if _RUN.search(text) or _BARE_STOP.search(text):
            return _SPACE.sub("\0 ", text).split("\0")
        for stop in (", ", ". ", ",\n", ".\n"):
            text = text.replace(stop, f"\0{stop}")
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        size, used = len(self.place), self.used
        cut = [self.pieces(t) for t in texts]
        counts = [len(c) for c in cut]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, sum(counts))
        self._add()
        starts, lengths = self.starts[at], self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
        if len(self.place) > _CACHE:  # the first pieces seen hold the common ones
            self._forget(size, used)
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _sub_batches(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= _SUB_BATCH or i == len(texts) - 1:
            yield ids[start : i + 1], [x or "" for x in texts[start : i + 1]]
            start, held = i + 1, 0


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                  folder: str | None = None) -> DataFrame:
    """Write the files; one row per file: shard, path, n_docs, n_tokens."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "records")
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def write(batches):
        encoder, task = _encoder(tokenizer_path), TaskContext.get()
        store, top = fs.FileSystem.from_uri(folder)
        name = f"{top}/part-{task.partitionId():06d}.rec"
        own = f"{name}.{task.taskAttemptId()}"
        offsets, at, tokens = [], 0, 0
        with store.open_output_stream(own) as out:
            for batch in slices(batches):
                for ids, texts in _sub_batches(batch["id"].to_pylist(), batch["text"].to_pylist()):
                    for doc_id, coded in zip(ids, encoder.encode(texts), strict=True):
                        record = frame(payload_of(doc_id, np.append(coded, np.uint32(end_id)), encoder.width))
                        offsets.append(at)
                        out.write(record)
                        at += len(record)
                        tokens += len(coded) + 1
        if not offsets:
            store.delete_file(own)
            return
        body = np.array(offsets, "<u8").tobytes()
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(MAGIC + struct.pack("<Q", len(offsets)) + body + struct.pack("<I", masked_crc(body)))
        store.move(f"{own}.idx", f"{name}.idx")
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{folder}/{name.rpartition('/')[2]}"],
                                          "n_docs": pa.array([len(offsets)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return written(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "record-files")


def read_back(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids in all documents before it), n_tokens, ids_crc32, from the files."""
    spark = files.sparkSession
    before, listed = 0, []
    for f in files.orderBy("shard").collect():  # as many rows as partitions
        listed.append((f["path"], before, f["n_docs"]))
        before += f["n_tokens"]
    table = spark.createDataFrame(listed, "path string, start long, n_docs long").repartition(max(1, len(listed)), "path")

    def read(batches):
        for batch in batches:
            for path, start, n_docs in zip(*(batch[c].to_pylist() for c in ("path", "start", "n_docs")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                out: list[list] = [[], [], [], []]
                with store.open_input_stream(f"{name}.idx") as f:
                    offsets = read_index(f.read())
                if len(offsets) != n_docs:
                    raise ValueError(f"{path}: {len(offsets)} records in the index, {n_docs} written")
                with store.open_input_stream(name, buffer_size=1 << 20) as f:
                    at, found = 0, 0
                    for payload in read_records(f):
                        if offsets[found] != at:
                            raise ValueError(f"{path}: the index is wrong at record {found}")
                        doc_id, ids = read_payload(payload)
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start, at, found = start + len(ids), at + len(payload) + 16, found + 1
                        if len(out[0]) >= 10_000:
                            yield _rows(out)
                            out = [[], [], [], []]
                yield _rows(out)

    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op6_token_records(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_back(write_records(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")))


ORACLE: dict[str, str] = {}
