"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are split into pre-tokens. A task gathers documents into chunks and lists, for each distinct word of a chunk,
the positions at which it stands. The lists are shuffled by word, so every task encodes each of its distinct words once,
however often it occurs; then they are shuffled back by chunk and the ids are put in place by position. A very frequent
word is one entry for each chunk, so it makes no task large. To keep the shuffle small the entries of a chunk that go to
the same task travel packed in one row. Decoding joins ids to the token-byte table, which has one row for each rank of
the vocabulary and is broadcast as arrays (its size is that of the vocabulary file, whatever the data).

Defined cases: a null text is an empty one; an empty text has no ids; rows that repeat, also with a null id, give one
result each; other columns of the input are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import ctypes
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARACTERS = 12_000_000  # of text that a task holds at a time; one longer text is a chunk of its own
SLICE = 1 << 18  # values that are packed at a time
DECODED_BYTES = 4 << 20  # of ids that are decoded at a time, or one text
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SIMPLE = re.compile(f"[\\t\\n\\r -~{LETTERS}]*\\Z")  # over these characters the standard library's classes are exact

PACKED = "bucket int, chunk long, lengths binary, words binary, counts binary, firsts binary, gaps binary, ids array<long>, sizes binary"
PLACED = "chunk long, lengths binary, tokens binary, counts binary, firsts binary, gaps binary, ids array<long>, sizes binary"


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, lines))}


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The token-byte table: one row (id, bytes) for each rank."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    return spark.createDataFrame([(rank, bytearray(word)) for word, rank in ranks.items()], "id int, bytes binary")


def splitter(pattern: str):
    """A function from a text to its pre-tokens, by the fast standard library where that gives the same matches."""
    whole, fast = regex.compile(pattern), pattern
    for name, characters in (("L", LETTERS), ("N", "0-9")):
        fast = fast.replace(rf"\p{{{name}}}+", f"[{characters}]+").replace(rf"\p{{{name}}}", characters)
    if r"\p" in fast:
        return whole.findall
    quick = re.compile(fast)
    return lambda text: (quick if SIMPLE.match(text) else whole).findall(text)


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, lowest first, the high bit set on all bytes but the last; also the size of each value."""
    parts = [_varints(values[at : at + SLICE]) for at in range(0, max(len(values), 1), SLICE)]
    return b"".join(data for data, _ in parts), np.concatenate([sizes for _, sizes in parts])


def _varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    sizes = np.ones(len(values), np.int8)
    for bits in (7, 14, 21, 28):
        sizes += values >= (1 << bits)
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        there = sizes > k
        more = (sizes[there] > k + 1).astype(np.uint8) << 7
        out[starts[there] + k] = ((values[there] >> (7 * k)) & 127).astype(np.uint8) | more
    return out.tobytes(), sizes


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(5):
        there = starts + k <= ends
        values[there] |= (raw[starts[there] + k].astype(np.int64) & 127) << (7 * k)
    return values


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def packed_positions(encoded: list[bytes], sequence: np.ndarray, buckets: int, pack):
    """The words of a chunk ordered by bucket, the sequence in these numbers, and for each bucket that has words
    (bucket, first word, end word, counts, firsts, gaps): how often and where its words stand, packed.
    """
    bucket = np.fromiter((zlib.crc32(word) % buckets for word in encoded), np.int64, len(encoded))
    by_bucket = np.argsort(bucket, kind="stable")
    place = np.empty(len(encoded), np.int32)
    place[by_bucket] = np.arange(len(encoded))
    encoded = [encoded[k] for k in by_bucket]
    sequence = place[sequence]
    positions = np.argsort(sequence, kind="stable").astype(np.int32)  # a chunk has far fewer than 2^31 positions
    counts = np.bincount(sequence, minlength=len(encoded))
    starts = np.cumsum(counts) - counts
    firsts = positions[starts]  # within a bucket in rising order, as words are numbered by their first position
    later = np.ones(len(positions), bool)
    later[starts] = False
    gap_bytes, gap_sizes = varints(np.diff(positions, prepend=0)[later])
    gap_ends = np.concatenate(([0], np.cumsum(gap_sizes, dtype=np.int64)))
    bounds, out = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1)), []
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        lo, hi = starts[a] - a, (starts[b] if b < len(starts) else len(positions)) - b
        first = varints(np.diff(firsts[a:b], prepend=0))[0]
        out.append((k, a, b, pack(varints(counts[a:b])[0]), pack(first), pack(gap_bytes[gap_ends[lo] : gap_ends[hi]])))
    return encoded, sequence, out


def word_numbers(counts: list[bytes], firsts: list[bytes], gaps: list[bytes]) -> np.ndarray:
    """The word at each position, words numbered through the buckets in the order given."""
    unpack = zstandard.ZstdDecompressor().decompress
    read = lambda packed: np.concatenate([np.zeros(0, np.int64), *(from_varints(unpack(x)) for x in packed)])
    n = read(counts)
    heads = np.cumsum(n) - n
    first = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(from_varints(unpack(x))) for x in firsts)])
    steps = np.empty(int(n.sum()), np.int32)
    later = np.ones(len(steps), bool)
    later[heads] = False
    steps[heads], steps[later] = first, read(gaps)
    run = np.cumsum(steps, dtype=np.int64)
    positions = run - np.repeat(run[heads] - first, n)
    out = np.empty(len(positions), np.int32)
    out[positions] = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return out


def explode_chunks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of each chunk with their positions, packed by the bucket of the word, and one row with its documents."""
    split, pack = splitter(pattern), zstandard.ZstdCompressor(level=3).compress
    schema = pa.schema(
        [("bucket", pa.int32()), ("chunk", pa.int64())]
        + [(name, pa.binary()) for name in ("lengths", "words", "counts", "firsts", "gaps")]
        + [("ids", pa.list_(pa.int64())), ("sizes", pa.binary())]
    )
    number, part = 0, TaskContext.get().partitionId()

    def rows(ids, sequences, words) -> pa.RecordBatch:
        """The rows of a chunk; takes sequences and words empty."""
        chunk = (part << 32) | number
        out = [(chunk % buckets, chunk, None, None, None, None, None, ids, np.array([len(s) for s in sequences], np.int64).tobytes())]
        sequence, encoded = np.concatenate(sequences), [word.encode() for word in words]
        sequences.clear()
        words.clear()
        encoded, sequence, packed = packed_positions(encoded, sequence, buckets, pack)
        del sequence
        for k, a, b, counts, firsts, gaps in packed:
            lengths = np.fromiter(map(len, encoded[a:b]), np.int64, b - a)
            out.append((k, chunk, pack(varints(lengths)[0]), pack(b"".join(encoded[a:b])), counts, firsts, gaps, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def fresh():
        words = defaultdict()
        words.default_factory = words.__len__
        return [], [], words, 0

    ids, sequences, words, held = fresh()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            found = split(text)
            ids.append(key)
            sequences.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            held += len(text)
            if held >= CHUNK_CHARACTERS:
                yield rows(ids, sequences, words)
                number += 1
                ids, sequences, words, held = fresh()
    if ids:
        yield rows(ids, sequences, words)
    del ids, sequences, words
    give_back()


def encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The ids of each packed word; a task encodes each of its distinct words once."""
    whole = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})
    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    known: dict[bytes, bytes] = {}

    def encoded(word: bytes) -> bytes:
        ids = known.get(word)
        if ids is None:
            ids = known[word] = np.array(whole.encode_ordinary(word.decode()), "<u4").tobytes()
        return ids

    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        lengths, tokens = [], []
        for packed, packed_words in zip(columns["lengths"].to_pylist(), columns["words"].to_pylist()):
            if packed is None:
                lengths.append(None)
                tokens.append(None)
                continue
            data, ends = unpack(packed_words), np.cumsum(from_varints(unpack(packed))).tolist()
            ids = [encoded(data[a:b]) for a, b in zip([0, *ends], ends)]
            lengths.append(pack(varints(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)[0]))
            tokens.append(pack(b"".join(ids)))
        yield pa.RecordBatch.from_arrays(
            [columns["chunk"], pa.array(lengths, pa.binary()), pa.array(tokens, pa.binary())]
            + [columns[name] for name in ("counts", "firsts", "gaps", "ids", "sizes")],
            names=["chunk", "lengths", "tokens", "counts", "firsts", "gaps", "ids", "sizes"],
        )
    known.clear()
    del whole
    give_back()


def assemble(rows: pa.Table) -> pa.Table:
    """The ids of every document of one chunk, put together by position."""
    unpack = zstandard.ZstdDecompressor().decompress
    is_head = rows["sizes"].is_valid()
    head, body = rows.filter(is_head).slice(0, 1).to_pylist()[0], rows.filter(pc.invert(is_head))
    packed = lambda name: (x.as_py() for x in body[name])
    lengths = np.concatenate([np.zeros(0, np.int64), *(from_varints(unpack(x)) for x in packed("lengths"))])
    tokens = np.frombuffer(b"".join(unpack(x) for x in packed("tokens")), "<u4")
    word_at = word_numbers(*(list(packed(name)) for name in ("counts", "firsts", "gaps")))
    starts, sizes = np.cumsum(lengths) - lengths, np.frombuffer(head["sizes"], np.int64)
    ids = []
    for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
        at = word_at[end - size : end]
        ids.append(tokens[gathered(starts[at], lengths[at])].tobytes())
    return pa.table({"doc_id": pa.array(head["ids"], pa.int64()), "ids": pa.array(ids, pa.binary())})


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers. The key must be an integer."""
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = narrow.mapInArrow(lambda batches: explode_chunks(batches, pattern, buckets), PACKED)
    placed = packed.repartition(buckets, "bucket").mapInArrow(lambda batches: encode_words(batches, path), PLACED)
    return placed.groupBy("chunk").applyInArrow(assemble, "doc_id long, ids binary")


def slices_of(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """(start, end) of consecutive slices of a binary column, each of `most` bytes at most or of one value."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    out, start, held = [], 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, held + most, "right")))
        out.append((start, end))
        start, held = end, int(ends[end - 1])
    return out


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with the bytes that its ids stand for, by a join of ids to the token-byte table."""
    spark = encoded.sparkSession
    table = token_table(spark, path).orderBy("id").collect()  # as large as the vocabulary file
    starts = np.zeros(table[-1]["id"] + 1, np.int64)
    lengths = np.zeros_like(starts)
    for row, end in zip(table, np.cumsum([len(row["bytes"]) for row in table])):
        starts[row["id"]], lengths[row["id"]] = end - len(row["bytes"]), len(row["bytes"])
    shared = spark.sparkContext.broadcast((starts, lengths, b"".join(row["bytes"] for row in table)))

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lengths, data = shared.value
        data = np.frombuffer(data, np.uint8)
        for batch in batches:
            for a, b in slices_of(batch.column("ids"), DECODED_BYTES):
                out, part = [], batch.slice(a, b - a)
                for ids in part.column("ids"):
                    ids = np.frombuffer(ids.as_buffer(), "<u4")
                    out.append(data[gathered(starts[ids], lengths[ids])].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])
        give_back()

    schema = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(join_bytes, f"{schema}, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    made = decode(encode(docs, path=path), path)
    return made.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) / 4 AS LONG)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
