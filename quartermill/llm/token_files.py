"""Token-id output in fixed-width bit-packed files.

Every id is stored in the least number of bits that holds the vocabulary. A
file image is

    magic "QMTF", version, bits, n_docs, n_blocks, n_ids      (32 bytes)
    doc_id, null mark and first id of each document            (random access by document)
    byte offset of each block of 4096 ids                      (random access by id)
    the packed blocks, each a whole number of bytes, low bits first

so any run of ids is found by one look at the offsets and unpacked by numpy in
one go. Images are rows of a Parquet table in the shared folder: Spark's
commit protocol makes them whole when tasks are retried, and any store that
Spark reaches can hold them. ``export`` writes them as plain files.

Order. Documents are range-partitioned by doc_id and sorted (nulls first; rows
that repeat a doc_id by text), so (part, seq) orders the images and the ids of
all documents form one line. Texts are shuffled once, ids never.

Encoding. Tokens never span ASCII white space in this tokenizer (its splits
are runs of letters, single digits and runs of other characters, and white
space is dropped), so words are cut by its pattern, and words and splits are
encoded once, splits by the library's model, and kept in bounded tables of each Python worker; ``encode_whole`` is the plain
call it is tested against.

Edge cases. Null and empty texts have the end id only. Repeated rows are
documents of their own. An empty table writes no image and gives no row. Other
columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, Memo, id_or_null, ids, raw, shared_dir, table

END = 1
BLOCK = 4096
#: Ids after which an image is closed; a longer document has one of its own size.
FILE_IDS = 2_000_000
#: Words, and splits of words, that a worker keeps in each of two generations; about 180 bytes each.
WORDS, SPLITS = 600_000, 400_000
HEAD = struct.Struct("<4sHHQQQ")
MAGIC, VERSION = b"QMTF", 1


# --- the format -----------------------------------------------------------


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(values: np.ndarray, bits: int) -> bytes:
    """Ids, low bits first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return values.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4")[:, 0]


def write_image(doc_ids: np.ndarray, lengths: np.ndarray, values: np.ndarray, bits: int) -> bytes:
    blocks = [pack(values[k : k + BLOCK], bits) for k in range(0, len(values), BLOCK)]
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    missing = doc_ids == NO_ID
    index = [np.where(missing, 0, doc_ids).astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), starts.tobytes()]
    base = HEAD.size + sum(map(len, index)) + 8 * (len(blocks) + 1)
    offsets = base + np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, VERSION, bits, len(doc_ids), len(blocks), len(values)), *index, offsets.tobytes(), *blocks])


class Image:
    """Reads a file image; nothing is unpacked before it is asked for."""

    def __init__(self, data: bytes):
        magic, version, self.bits, n, blocks, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = HEAD.size
        self.data = memoryview(data)
        values = np.frombuffer(data, "<i8", n, at)
        missing = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.doc_ids = np.where(missing, NO_ID, values)
        at += 9 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 8 * (n + 1)).astype(np.int64)

    def __getitem__(self, span: slice) -> np.ndarray:
        """The ids of a span, from the blocks that hold it."""
        a, z, _ = span.indices(self.n_ids)
        if a >= z:
            return np.zeros(0, "<u4")
        first, last = a // BLOCK, (z - 1) // BLOCK
        whole = BLOCK * self.bits % 8 == 0  # then blocks lie side by side and unpack as one
        if whole:
            n = min(self.n_ids, (last + 1) * BLOCK) - first * BLOCK
            got = unpack(self.data[self.offsets[first] : self.offsets[last + 1]], n, self.bits)
            return got[a - first * BLOCK : z - first * BLOCK]
        parts = [unpack(self.data[self.offsets[k] : self.offsets[k + 1]], min(BLOCK, self.n_ids - k * BLOCK), self.bits) for k in range(first, last + 1)]
        return np.concatenate(parts)[a - first * BLOCK : z - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self[int(self.starts[k]) : int(self.starts[k + 1])]


# --- encoding -------------------------------------------------------------


class Encoder:
    """A tokenizer file, with tables of encoded words and of the splits that words are made of.

    Words are looked up alone only if the file's own steps allow it: white
    space is dropped, and its pattern cuts words into splits that are encoded
    each by itself. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = width(self.tokenizer.get_vocab_size())
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        rules = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers") or []]
        last = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.wordwise = rules == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and last.items() <= steps[1].items()
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"]) if self.wordwise else None
        self.merge = self.tokenizer.model.tokenize
        #: The characters that byte-level vocabularies write for bytes: printable ones of Latin-1 for themselves, the others from U+0100 on.
        other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.renamed = {b: chr(256 + k) for k, b in enumerate(other)}
        self.words, self.splits = Memo(WORDS), Memo(SPLITS)

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_split(self, split: str) -> bytes:
        """The model's ids of one split in its final case and composition; the steps before the model only rename its bytes."""
        if not (split.isascii() and split.isprintable()):
            split = split.encode().decode("latin-1").translate(self.renamed)
        ids = [x.id for x in self.merge(split)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. Words of Latin letters, which case and composition rules leave alone, are put together from their splits."""
        out, cut = {}, {}
        plain = {word: word.lower().decode() for word in new if word.isalpha()}  # ASCII letters only: one split
        for word in new:
            if word in plain:
                continue
            text = word.decode("utf-8", "replace")
            if (text.isascii() or max(text) < "\u0180") and "<|" not in text:
                cut[word] = self.pattern.findall(text.lower())
            else:
                out[word] = np.array(self.encode_whole(text), "<u4").tobytes()
        got, unknown = self.splits.find_all(set(plain.values()).union(*cut.values()))
        learnt = dict(zip(unknown, map(self._encode_split, unknown), strict=True))
        self.splits.put_all(learnt)
        got |= learnt
        out |= zip(plain, map(got.__getitem__, plain.values()), strict=True)
        for word, parts in cut.items():
            out[word] = b"".join(map(got.__getitem__, parts))
        return out

    def encode(self, text: bytes) -> bytes:
        """A text's ids and the end id, as little-endian 32-bit integers."""
        if not self.wordwise:
            return np.array([*self.encode_whole(text.decode("utf-8", "replace")), END], "<u4").tobytes()
        split = text.split()
        got = list(map(self.words.young.get, split))
        if None in got:
            gaps = [k for k, x in enumerate(got) if x is None]
            made, new = self.words.find_all({split[k] for k in gaps})
            if new:
                learnt = self._encode_words(new)
                made |= learnt
                self.words.put_all({w: x for w, x in learnt.items() if len(w) < 64} if max(map(len, new)) >= 64 else learnt)
            for k in gaps:
                got[k] = made[split[k]]
        got.append(b"\x01\x00\x00\x00")
        return b"".join(got)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tables of images -----------------------------------------------------


def images(docs: DataFrame, path: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """(part, seq, n_ids, data): file images of all documents, in ascending order of doc_id."""
    path = path or tokenizer_path()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        held, texts, size = [], [], 0

        def image() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(texts), "<u4")
            data = write_image(np.array(held, np.int64), np.array([len(t) // 4 for t in texts]), values, made.bits)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(values)], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "data"])

        for b in batches:
            for doc, text in zip(ids(b.column(0)).tolist(), raw(b.column(1)), strict=True):
                held.append(doc)
                texts.append(made.encode(text))
                size += len(texts[-1]) // 4
                if size >= file_ids:
                    yield image()
                    held, texts, size, seq = [], [], 0, seq + 1
        if held:
            yield image()

    # rows of one doc_id, null say, go by a hash of their text, so that they spread as well
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return ordered.mapInArrow(build, "part int, seq int, n_ids bigint, data binary")


def write_images(docs: DataFrame, to: str, path: str | None = None) -> None:
    images(docs, path).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(to)


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, unpacked from the images at ``at``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                got = Image(data)
                values, n = got[:], len(got.doc_ids)
                crc = [zlib.crc32(values[a:z]) for a, z in zip(got.starts[:-1].tolist(), got.starts[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), id_or_null(got.doc_ids), pa.array(got.starts[:-1]), pa.array(np.diff(got.starts)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema("part int, seq int, n_ids bigint, data binary").parquet(at)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each writing task, so one window can order them
    parts = parts.select(F.col("part").alias("p"), before(Window.orderBy("part")).alias("first"))
    within = files.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("within"))
    bases = within.join(parts, within["part"] == parts["p"]).select("p", F.col("seq").alias("s"), (F.col("first") + F.col("within")).alias("base"))
    rows = files.select("part", "seq", "data").mapInArrow(read, "part int, seq int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    joined = rows.join(bases, (rows["part"] == bases["p"]) & (rows["seq"] == bases["s"]))
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def export(spark: SparkSession, at: str, folder: str) -> list[str]:
    """Writes each image to a file of its own in a folder that the driver reaches; one image at a time."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in spark.read.parquet(at).orderBy("part", "seq").select("part", "seq", "data").toLocalIterator():
        out.append(f"{folder}/tokens-{row['part']:05d}-{row['seq']:05d}.qmtf")
        with open(out[-1], "wb") as f:
            f.write(row["data"])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token files of all documents and reads from them doc_id, start, n_tokens, ids_crc32."""
    to = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4()}"
    write_images(table(spark, sf_dir, "documents"), to)
    return read_documents(spark, to)
