"""Encoding against the tiktoken library, decoding by the round trip."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from grovemark.llm import byte_pairs
from tests.llm import fixtures


def expected(rows):
    ranks = byte_pairs.read_ranks(public_tokenizers.path(byte_pairs.VOCABULARY))
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for row in rows:
        text = row["text"] or ""
        ids = whole.encode_ordinary(text)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        out[row["doc_id"], len(ids), digest, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("characters", [12_000_000, 2_000])
def test_same_as_the_library(spark, monkeypatch, characters):
    monkeypatch.setattr(byte_pairs, "CHUNK_CHARACTERS", characters)
    docs = fixtures.mixed(spark, [(9100, "don't 'S  can't\r\n\r\n  we'll 12 ab1 x  "), (9101, "<|endoftext|>")])
    assert Counter(map(tuple, byte_pairs.digests(docs).collect())) == expected(docs.collect())


def test_other_columns_and_no_rows(spark):
    docs = fixtures.odd(spark)
    assert Counter(map(tuple, byte_pairs.digests(docs).collect())) == expected(docs.collect())
    assert byte_pairs.digests(fixtures.empty(spark)).count() == 0


def test_varints():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31])
    assert byte_pairs.from_varints(byte_pairs.varints(values)[0]).tolist() == values.tolist()


def test_varints_take_a_bounded_amount_of_memory_beside_their_result():
    values = np.random.default_rng(0).integers(0, 2**31, 2_000_000) >> np.arange(2_000_000) % 31
    tracemalloc.start()
    data, sizes = byte_pairs.varints(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.sum() == len(data) and (byte_pairs.from_varints(data) == values).all()
    assert peak < 3 * (len(data) + len(values)) + 40 * byte_pairs.SLICE
    assert byte_pairs.varints(values[:0])[0] == b""


def test_a_chunk_is_packed_without_its_dictionary_of_words(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    texts = [" ".join(f"w{i}" for i in range(at, at + 1_000)) for at in range(0, 200_000, 1_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(200), pa.int64()), "text": texts})
    held, real = [], byte_pairs.packed_positions

    def packed_positions(*given):
        held.append(tracemalloc.get_traced_memory()[0])
        return real(*given)

    monkeypatch.setattr(byte_pairs, "TaskContext", Task)
    monkeypatch.setattr(byte_pairs, "packed_positions", packed_positions)
    tracemalloc.start()
    rows = [made.num_rows for made in byte_pairs.explode_chunks(iter([batch]), public_tokenizers.PATTERN, 8)]
    tracemalloc.stop()
    assert rows == [9] and held[0] < 20_000_000


def test_texts_are_decoded_in_slices_of_bounded_size():
    column = pa.array([b"x" * n for n in (3, 4, 0, 9, 30, 1, 1, 1)])
    assert byte_pairs.slices_of(column.slice(1), 10) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert byte_pairs.slices_of(column, 10) == [(0, 3), (3, 4), (4, 5), (5, 8)]
    assert byte_pairs.slices_of(column[:0], 10) == []
