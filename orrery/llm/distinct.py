"""Corpus-wide distinct units: each is answered once, and the answers go back to the texts.

Rows form blocks as they are read. A block lists its distinct units by bucket (the hash
of the unit), so a unit meets all its copies in one group, is answered there once, and
every block gets the answers of its own units in the order of its list. Texts travel as
codes of the block's units. Lists, codes and answers are compressed, and all per-unit
work is vectorised.

A block's key is a hash of its place, ids and texts, and it is cut twice: once for its list and
once for its codes. Input that a shuffle could give out in another order is therefore
written first (``stable``); should a block still come out otherwise, its answers are
missing and the task fails instead of giving wrong results.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import blobs, chunks, cut, text_bytes
from .hashing import TABLE, Hashes, U, mix

PACKED = "key long, block long, blob binary"
BLOCK_BYTES = 4 << 20

#: Units (binary, none empty) of all texts in order, and units per text.
Cutter = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def sealed(value) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, 5))


def opened(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def planes(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers below 2 ** 32 byte by byte, the empty high bytes left out; compresses well."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width]).tobytes()


def whole(p: tuple[int, bytes]) -> np.ndarray:
    width, data = p
    n = len(data) // width
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u4").reshape(-1).astype(np.int64)


def ranges_array(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The stretches of ``data`` between neighbouring ``edges`` as a binary array, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def strings(units: pa.Array) -> tuple[tuple[int, bytes], bytes]:
    data, at = text_bytes(units)
    return planes(np.diff(at)), data.tobytes()


def units_array(s: tuple[tuple[int, bytes], bytes]) -> pa.Array:
    edges = np.concatenate([[0], np.cumsum(whole(s[0]))])
    return ranges_array(np.frombuffer(s[1], np.uint8), edges)


def hashes_of(units: pa.Array) -> np.ndarray:
    data, at = text_bytes(units)
    size = np.diff(at)
    return mix(Hashes(TABLE[data]).of(at[:-1], at[1:]) + size.astype(U))


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` itself where reading it again gives the same rows in the same order, else its table."""
    return cut(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(key, rows) of a task's rows in order, about ``most`` bytes of text each or one longer text."""
    held, size, part, nth = [], 0, TaskContext.get().partitionId(), itertools.count()

    def block():
        rows = pa.concat_batches(held)
        h = xxhash.xxh3_64(f"{part}.{next(nth)}")
        h.update(rows.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).tobytes())
        data, at = text_bytes(rows.column("text"))
        h.update(np.ascontiguousarray(data))
        h.update(at.tobytes())
        return int(np.uint64(h.intdigest()).view(np.int64)), rows

    for b in chunks(batches, most=most):
        data, _ = text_bytes(b.column("text"))
        if held and size + len(data) > most:
            yield block()
            held, size = [], 0
        held.append(b)
        size += len(data)
    if held:
        yield block()


def packed_rows(key: list, block: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(block, pa.int64()), blobs(blob)], ["key", "block", "blob"])


def listed(rows: DataFrame, cutter: Cutter, n: int, most: int = BLOCK_BYTES) -> DataFrame:
    """(key: bucket, block, blob: the block's distinct units of the bucket) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks_of(batches, most):
            units = cutter(own.column("text"))[0].unique()
            if not len(units):
                continue
            bucket = (hashes_of(units) % U(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            units, size = units.take(pa.array(order)), np.bincount(bucket, minlength=n)
            there, ends = np.flatnonzero(size), np.cumsum(size)
            yield packed_rows(there.tolist(), [block] * len(there), [sealed(strings(units.slice(int(ends[b] - size[b]), int(size[b])))) for b in there.tolist()])

    return rows.mapInArrow(run, PACKED)


def held(rows: DataFrame, cutter: Cutter, n: int, ordered: bool, most: int = BLOCK_BYTES) -> DataFrame:
    """(key: block, block, blob): ids, text sizes, and the texts as codes of their block's units.

    ``ordered`` keeps the order of units; else a text is its distinct units and their frequencies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks_of(batches, most):
            texts = own.column("text")
            units, per = cutter(texts)
            coded = units.dictionary_encode()
            bucket = (hashes_of(coded.dictionary) % U(n)).astype(np.int64)
            codes, often = coded.indices.to_numpy().astype(np.int64), np.empty(0, np.int64)
            if not ordered:
                m = max(1, len(bucket))
                both, often = np.unique(np.repeat(np.arange(len(per)), per) * m + codes, return_counts=True)
                codes, per = both % m, np.bincount(both // m, minlength=len(per))
            sizes = np.diff(text_bytes(texts)[1])
            yield packed_rows([block], [block], [sealed((own.column("doc_id").to_pylist(), planes(sizes), planes(bucket), planes(codes), planes(per), planes(often)))])

    return rows.mapInArrow(run, PACKED)


class Block:
    """A block of texts as codes, with the answers to its units by code."""

    def __init__(self, blob: bytes, replies: dict[int, bytes]):
        self.ids, *parts = opened(blob)
        self.sizes, self.bucket, self.codes, self.per, self.often = (whole(p) for p in parts)
        self.replies = replies

    def answers(self) -> Iterator[tuple[np.ndarray, object]]:
        """(codes, what was answered for them) by bucket."""
        order = np.argsort(self.bucket, kind="stable")
        size = np.bincount(self.bucket) if len(self.bucket) else np.empty(0, np.int64)
        at = 0
        for b in np.flatnonzero(size).tolist():
            if b not in self.replies:
                raise RuntimeError("a block was read with other rows than before: write the input to a table first")
            yield order[at : at + size[b]], opened(self.replies[b])
            at += size[b]


def assembled(of: DataFrame, replies: DataFrame, finish: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    """``finish`` of every block, joined to its replies (key: block, block: bucket)."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        known = dict(zip(answers.column("block").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        return pa.concat_tables([finish(Block(b, known)) for b in blocks.column("blob").to_pylist()]) if blocks.num_rows else finish(Block(sealed(([], *[planes(np.empty(0, np.int64))] * 5)), {}))

    return of.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(run, schema)


def distinct_units(t: pa.Table) -> tuple[list[pa.Array], pa.Array]:
    """The lists of a bucket, and the distinct units of all of them."""
    lists = [units_array(opened(b)) for b in t.column("blob").to_pylist()]
    return lists, pa.chunked_array(lists, pa.binary()).unique()


def places(units: pa.Array, known: pa.Array) -> np.ndarray:
    return pc.index_in(units, value_set=known).to_numpy(zero_copy_only=False)
