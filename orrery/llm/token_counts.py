"""Token counts without ids: every distinct pre-token of the corpus is counted once.

Texts are cut at ASCII white space, which the tokenizer drops, and between an ASCII
letter and a stop, where its pre-tokens always end; no piece or special string spans
such a cut. The distinct pre-tokens of all texts meet by hash, each is counted once, and
the counts are joined to every document's pre-token frequencies and summed (see
distinct.py). Ids are never held beyond the batch of pre-tokens being counted.

Edge cases: null text counts as empty (0 tokens); repeated doc_ids are counted
row by row; a text without white space is one pre-token and held whole; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import doc_columns, shuffle_partitions, text_bytes
from .distinct import Block, assembled, distinct_units, held, listed, packed_rows, places, planes, ranges_array, sealed, stable, whole
from .words import load_tokenizer

#: Kinds of bytes: white space 1, letters 2, stops 3, all others 0.
KIND = np.zeros(256, np.uint8)
KIND[list(b"\t\n\x0b\x0c\r ")] = 1
KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
KIND[list(b".,;:!?")] = 3
#: True where a byte of the first kind and one of the second belong to different pre-tokens.
APART = np.zeros((4, 4), bool)
APART[1, :] = APART[:, 1] = True
APART[2, 3] = APART[3, 2] = True
APART[1, 1] = False


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts in order, and how many each text has."""
    data, at = text_bytes(texts)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    kind = KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = APART[kind[:-1], kind[1:]]
    edge[at[:-1][at[:-1] < len(data)]] = True
    full = kind != 1
    start = np.flatnonzero(edge & full)
    kept = np.concatenate([[0], np.cumsum(full)])
    per = np.diff(np.searchsorted(start, at))
    return ranges_array(data[full], np.concatenate([kept[start], kept[-1:]])), per


_TOKENIZERS: dict = {}


def counts_of(units: list[bytes], path: str) -> np.ndarray:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = load_tokenizer(path)
    out = np.zeros(len(units), np.int64)
    for i in range(0, len(units), 4096):
        part = [u.decode() for u in units[i : i + 4096]]
        out[i : i + len(part)] = [len(e) for e in _TOKENIZERS[path].encode_batch_fast(part, add_special_tokens=False)]
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    rows, n = stable(doc_columns(docs)), shuffle_partitions(docs.sparkSession)

    def count(t: pa.Table) -> pa.Table:
        lists, known = distinct_units(t)
        counts = counts_of(known.to_pylist(), tokenizer_path)
        replies = [sealed(planes(counts[places(u, known)])) for u in lists]
        return pa.Table.from_batches([packed_rows(t.column("block").to_pylist(), t.column("key").to_pylist(), replies)])

    def add(b: Block) -> pa.Table:
        counts = np.zeros(len(b.bucket), np.int64)
        for codes, reply in b.answers():
            counts[codes] = whole(reply)
        upto = np.concatenate([[0], np.cumsum(counts[b.codes] * b.often)])
        ends = np.cumsum(b.per)
        total = upto[ends] - upto[ends - b.per]
        return pa.table([pa.array(b.ids, pa.int64()), pa.array(b.sizes), pa.array(total), pa.array(total > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    replies = listed(rows, pre_tokens, n).groupBy("key").applyInArrow(count, "key long, block long, blob binary")
    return assembled(held(rows, pre_tokens, n, ordered=False), replies, add, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
