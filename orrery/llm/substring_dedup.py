"""Exact substring dedup over words by prefix-partitioned suffix trees.

Candidate contexts are dealt by anchors (see repeats.py). Within whole groups of them
suffixes, one for every window, are split by prefixes of variable length: by the first
word, and where too many share it by one word more, until a set fits in memory or its
suffixes agree in a whole window. The sorted suffixes of a set and their adjacent common
prefixes are a suffix tree's leaves and inner nodes; the nodes at least a window deep are
the maximal repeats, and of a node's leaves all but the earliest are removed.

Edge cases: null or empty text has no words and nothing to remove; a text repeated
within itself keeps its first copy; ties are decided by (doc_id, start); an empty
table gives an empty result; other columns pass through, but those named n_symbols,
n_removed, n_spans or kept give way to the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Spec, without_repeats
from .suffix_dedup import common_at_least, direct_sort

WINDOW_WORDS = 20
GRAM_WORDS = 8
#: Suffixes of one set.
MOST_LEAVES = 1 << 14


def prefix_sets(line: np.ndarray, places: np.ndarray, depth: int, most: int = MOST_LEAVES) -> Iterator[tuple[int, np.ndarray]]:
    """(prefix length, suffixes): sets by the shortest prefix that leaves ``most`` suffixes at most, or by ``depth`` words.

    Sets of the same prefix length come together, in the order of their prefixes.
    """
    top, of, k = int(line.max()) + 1 if len(line) else 1, np.zeros(len(places), np.int64), 0
    while len(places) and k < depth:
        _, of, size = np.unique(of * top + line[places + k], return_inverse=True, return_counts=True)
        k += 1
        small = size[of] <= most if k < depth else np.ones(len(of), bool)
        if small.any():
            yield k, places[small][np.argsort(of[small], kind="stable")]
        places, of = places[~small], of[~small]


def deep_nodes(line: np.ndarray, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in sorted order, and the number of the inner node ``depth`` words down that each lies under.

    Neighbours that share ``depth`` words lie under one node; a node of one leaf is that leaf.
    """
    order = direct_sort(leaves, line, depth)
    shared = common_at_least(line, order[:-1], order[1:], depth)
    return order, np.cumsum(np.concatenate([[True], ~shared])) - 1


def earlier_windows(contexts: list[bytes], span: np.ndarray, copies: np.ndarray, doc: np.ndarray, s: np.ndarray, spec: Spec) -> np.ndarray:
    """For every window of every context, whether an equal one stands earlier."""
    words = pc.split_pattern(pa.array(contexts, pa.binary()).cast(pa.string()), " ")
    per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(per + 1) - per - 1
    line = np.zeros(int((per + 1).sum()), np.int64)
    line[np.repeat(begin - np.cumsum(per) + per, per) + np.arange(per.sum())] = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    at = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    place = np.repeat(begin, span) + at
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((np.repeat(s, span) + at, np.repeat(doc, span)))] = np.arange(len(place))
    window = np.full(len(line), -1)
    window[place] = np.arange(len(place))
    out = np.zeros(len(place), bool)
    for _, leaves in prefix_sets(line, place, spec.length):
        order, node = deep_nodes(line, leaves, spec.length)
        own = window[order]
        first = np.full(node[-1] + 1, len(place))
        np.minimum.at(first, node, rank[own])
        out[own] = rank[own] > first[node]
    return out


def dedup_words(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """All columns of ``docs``, n_symbols (words), n_removed, n_spans and kept (words joined by one space)."""
    return without_repeats(docs, Spec(words=True, length=window, gram=gram, keep_first=True), earlier_windows)


def clean(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with repeats cut out of the text; a text that loses nothing stays byte for byte.

    Columns other than doc_id and text travel as one, so their names are free.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    out = dedup_words(docs.select("doc_id", "text", rest.alias("rest")), window)
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    cols = [text.alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*cols)
