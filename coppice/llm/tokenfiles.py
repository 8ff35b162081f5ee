"""Token ids in files of Huffman-coded blocks.

Writing takes two passes.  The first deals documents out by ranges of doc_id,
encodes each text and stores the ids with their place in the shard.  The counts
of all ids then give one code: canonical, lengths limited by package-merge.  The
second pass writes blocks of ids: independent of each other, each with its
documents' ids and lengths and the bit offset of every ``STRIDE``-th id, so all
stretches between offsets are decoded side by side through one table.

A dataset is a folder of Parquet containers, which Spark commits file by file and
writes again when an executor is lost: ``codebook`` (one row: the code lengths),
``tokens`` (the first pass; deleted unless kept) and ``blocks`` (shard, start,
payload).  A payload, all little-endian: magic ``CHB1``, then u32 documents, u32
ids, u32 offsets, u32 stride, u64 bits; i64 doc ids, u8 flags (1: no doc id),
u32 lengths, u32 offsets, then u32 words of bits, highest bit first.

Defined results: null counts as the empty text (the end id alone); rows with a
null doc_id come first; rows that share a doc_id are side by side, in the order of a
hash of their texts; ids are whole numbers, and an id of text that is none is an error; very long texts are encoded whole; further columns are ignored,
whatever their names; an empty table gives no blocks.  A block holds whole documents: it ends with the
document that brings it to ``BLOCK_IDS``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.storage import discard, mapped, new_path
from coppice.llm.textscan import texts

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
STRIDE = 256
BLOCK_IDS = 1 << 18
LONGEST_CODE = 18
#: Words, and chunks, whose ids a worker remembers.
REMEMBERED = 3 << 18
_MAGIC = b"CHB1"
_HEAD = struct.Struct("<4sIIIIQ")


# ---- tokenizer -----------------------------------------------------------------


#: Letters, then signs that hold no letter or digit.
_PLAIN = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_characters() -> list[str]:
    """The characters by which byte-level models write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (c for c in range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Ids, as little-endian u32, of chunks met so far; a new one is asked of the library."""

    def __init__(self, ask, limit: int):
        super().__init__()
        self.ask, self.limit = ask, limit

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[chunk] = self.ask(chunk)
        return ids


class Encoder:
    """Ids of texts from the tokenizers library, whose answers for chunks between spaces are remembered.

    The library drops white space before it looks for tokens, so the ids of a text
    are those of its chunks one after the other.  A chunk of letters and signs is
    cut by the library between the two and lower-cased, so a word is asked for once,
    however it is written and whatever follows it.  Where lower-casing or
    normalisation could do more (letters beyond U+0250, marks, digits), the whole
    chunk goes through the library.
    """

    def __init__(self, file: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.model, self.characters = self.library.model, dict(enumerate(_byte_characters()))
        self.words, self.signs, self.known = _Known(self._word, remembered), _Known(self._whole, 1 << 16), _Known(self._chunk, remembered)

    def _whole(self, chunk: bytes) -> bytes:
        return np.array(self.library.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        ids = [t.id for t in self.model.tokenize(text if word.isascii() else text.translate(self.characters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        parts = _PLAIN(chunk)
        if not parts:
            return self._whole(chunk)
        word, signs = parts.groups()
        if word.isascii():
            word = word.lower()
        else:
            text = word.decode()
            if not text.isalpha() or max(text) >= "\u0250" or "\u0130" in text:
                return self._whole(chunk)
            word = text.lower().encode()
        return self.words[word] + self.signs[signs] if signs else self.words[word]

    def __call__(self, rows: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        get = self.known.__getitem__
        return [b"".join(map(get, x.split())) for x in rows]


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


# ---- code ----------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths (u8; 0: unused) of an optimal prefix code of at most ``longest`` bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols don't fit in {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # Each level's list: leaves and packages of the level below, by weight; a mark tells leaves.
    levels = []
    packages = np.zeros(0)
    for _ in range(longest):
        both = np.concatenate((weight, packages))
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        merged = both[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of given lengths: shorter first, then by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        size = self.lengths[order]
        self.width = int(size.max()) if len(size) else 1
        spans = 1 << (self.width - size)
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begins >> (self.width - size)).astype(np.uint64)
        #: Next ``width`` bits -> symbol << 8 | length.
        self.table = np.zeros(1 << self.width, np.int64)
        filled = np.repeat((order << 8) | size, spans)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
        """32-bit words, the bit offset of every ``stride``-th id, and the number of bits."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        bits = int(ends[-1]) if len(ids) else 0
        begin = ends - size
        at = begin >> 5
        value = self.codes[ids] << (64 - (begin & 31) - size).astype(np.uint64)
        words = np.zeros((bits >> 5) + 3, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return words.astype("<u4"), begin[::stride].astype("<u4"), bits

    def decode(self, words: np.ndarray, offsets: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        """n ids; every stretch between offsets moves on by one id in each step."""
        out = np.zeros((len(offsets), stride), np.uint32)
        words = words.astype(np.uint64)
        at = offsets.astype(np.int64)
        shift, mask = 64 - self.width, np.uint64((1 << self.width) - 1)
        for k in range(min(stride, n)):
            lanes = len(offsets) - (k > (n - 1) % stride)
            at = at[:lanes]
            word = at >> 5
            wide = (words[word] << np.uint64(32)) | words[word + 1]
            hit = self.table[((wide >> (shift - (at & 31)).astype(np.uint64)) & mask).astype(np.int64)]
            out[:lanes, k] = hit >> 8
            at = at + (hit & 255)
        return out.ravel()[:n]


# ---- blocks --------------------------------------------------------------------


def pack(code: Code, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A payload."""
    words, offsets, bits = code.encode(ids)
    if bits >= 1 << 32:
        raise ValueError("a document of over 4 Gbit doesn't fit in a block")
    flags = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(offsets), STRIDE, bits)
    return b"".join((head, names.tobytes(), flags.tobytes(), np.array(lengths, "<u4").tobytes(), offsets.tobytes(), words.tobytes()))


def unpack(code: Code, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, flags, lengths and ids of a payload."""
    magic, docs, n, checks, stride, _ = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    out = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", checks)):
        out.append(np.frombuffer(payload, kind, count, at))
        at += out[-1].nbytes
    words = np.frombuffer(payload, "<u4", (len(payload) - at) // 4, at)
    return out[0], out[1], out[2], code.decode(words, out[3], n, stride)


def _narrow(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _tokenized(docs: DataFrame, file: str, end_id: int, dtype: str, id_col: str, text_col: str) -> DataFrame:
    """(shard, at, doc_id, n, ids) in ascending doc_id order within and between shards."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = own.select("*", F.xxhash64("text").alias("text_hash"))  # rows of one doc_id, or of none, go by their text
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, at = encoder(file), TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                raw = [x + end for x in encode(texts(part.column(1)))]
                n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                begins = at + np.cumsum(n) - n
                at += int(n.sum())
                small = [np.frombuffer(x, "<u4").astype(dtype).tobytes() for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), shard, np.int32)), pa.array(begins), part.column(0), pa.array(n), pa.array(small, pa.binary())], names=["shard", "at", "doc_id", "n", "ids"])

    return mapped(dealt, scan, "shard int, at long, doc_id long, n long, ids binary")


def _id_counts(tokens: DataFrame, vocab: int, dtype: str) -> np.ndarray:
    """How often each id occurs; each task sends one count per id it met."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(vocab, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                sums += np.bincount(np.frombuffer(b"".join(b.column(0).slice(i, 1000).to_pylist()), dtype), minlength=vocab)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(sums[met])], names=["id", "n"])

    counted = mapped(tokens.select("ids"), scan, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(vocab, np.int64)
    rows = counted.toPandas()  # at most one row for each id of the vocabulary
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def _blocks(tokens: DataFrame, starts: dict[int, int], lengths: bytes, dtype: str) -> DataFrame:
    sent = tokens.sparkSession.sparkContext.broadcast((starts, lengths))  # a number for each shard, a byte for each id

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths = sent.value
        code = Code(np.frombuffer(lengths, np.uint8))
        held: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        rows = first = where = 0

        def block() -> pa.RecordBatch:
            payload = pack(code, names, sizes, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([first]), pa.array([payload], pa.binary())], names=["shard", "start", "payload"])

        for b in batches:
            for shard, at, doc_id, raw in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                start = starts[shard] + at
                if held and (rows >= BLOCK_IDS or shard != where or start != first + rows):
                    yield block()
                    held, names, sizes, rows = [], [], [], 0
                if not held:
                    first, where = start, shard
                held.append(np.frombuffer(raw, dtype))
                names.append(doc_id)
                sizes.append(len(held[-1]))
                rows += len(held[-1])
        if held:
            yield block()

    return mapped(tokens, scan, "shard int, start long, payload binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_tokens: bool = False) -> None:
    """Write the ids of all documents, ``end_id`` after each, in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocab = max(Tokenizer.from_file(tokenizer_file).get_vocab(with_added_tokens=True).values()) + 1
    dtype = _narrow(vocab)
    _tokenized(docs, tokenizer_file, end_id, dtype, id_col, text_col).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.schema("shard int, at long, doc_id long, n long, ids binary").parquet(f"{path}/tokens")
    lengths = code_lengths(_id_counts(tokens, vocab, dtype), max(LONGEST_CODE, int(vocab).bit_length())).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    totals = {r.shard: r.n for r in tokens.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    starts, total = {}, 0
    for shard in sorted(totals):
        starts[shard] = total
        total += totals[shard]
    _blocks(tokens, starts, lengths, dtype).write.option("compression", "none").parquet(f"{path}/blocks")
    if not keep_tokens:
        discard(spark, [f"{path}/tokens"])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the blocks."""
    book = spark.read.schema("lengths binary").parquet(f"{path}/codebook").first()
    blocks = spark.read.schema("shard int, start long, payload binary").parquet(f"{path}/blocks")
    if book is None:
        raise ValueError(f"no codebook in {path}")
    sent = spark.sparkContext.broadcast(bytes(book.lengths))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(sent.value, np.uint8))
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names, flags, lengths, ids = unpack(code, payload)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                cut = [raw[4 * a : 4 * e] for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                none = (flags & 1) != 0
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64), mask=none), pa.array(start + begins), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(cut if with_ids else [None] * len(cut), pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    found = mapped(blocks.select("start", "payload"), scan, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found if with_ids else found.drop("ids")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the files."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path)
