"""Order-preserving packing by dynamic programming.

Documents keep their order. The tokens of a stretch of documents form a line, and
cuts are chosen on it so that every window holds at most ``size`` tokens and the
sum of padding and truncation penalties is least: a cut at a document's end is
free, one at a sentence's end costs little (of several ends within ``grain`` tokens the
last one counts), any other costs more. The best cost
up to a place is the least over a sliding range of earlier places of
cost + place, kept by a monotone queue, so a stretch takes linear time.

Each task packs its own documents in one pass, holding one stretch at a time; the
last window of a stretch goes on into the next one. At a task's end the rest is
cut at powers of two, which need no padding. No shuffle.

Edge cases: null or empty text is a document of its end token alone; a text
without sentence ends gets places every ``step`` tokens; repeated doc_ids are
packed as separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import blobs, chunks, doc_columns
from .words import byte_bpe_cut, memo, ragged


@dataclass(frozen=True)
class PackRules:
    size: int = 2048
    end_id: int = 1
    sentence_penalty: int = 4
    hard_penalty: int = 24
    step: int = 32
    grain: int = 16


def best_cuts(places: list[int], penalty: list[int], size: int) -> list[int]:
    """Indices of the cuts of least total cost from places[0] to places[-1].

    ``places`` rise by at most ``size``. cost(j) = penalty[j] + size - places[j] + min(cost(i) + places[i])
    over i with places[j] - places[i] <= size; the minimum comes from a monotone queue.
    """
    n = len(places)
    back = [0] * n
    queue_at, queue_key, head = [0], [places[0]], 0
    for j in range(1, n):
        here = places[j]
        low = here - size
        while places[queue_at[head]] < low:
            head += 1
        back[j] = queue_at[head]
        key = queue_key[head] + penalty[j] + size  # cost(j) + places[j]
        while len(queue_key) > head and queue_key[-1] >= key:
            queue_key.pop()
            queue_at.pop()
        queue_key.append(key)
        queue_at.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def tail_lengths(rest: int, size: int, penalty: int) -> list[int]:
    """Lengths that cut the last ``rest`` tokens of a task: powers of two need no padding."""
    out = []
    while rest:
        power = 1 << (rest.bit_length() - 1)
        take = rest if size - rest <= penalty else power
        out.append(take)
        rest -= take
    return out


class Line:
    """The tokens not packed yet: documents' pieces in order, with the places where cuts may lie."""

    def __init__(self):
        self.ids = np.empty(0, np.int32)
        self.doc, self.total, self.origin, self.begin = ([] for _ in range(4))  # origin: tokens of the document before; begin: place on the line
        self.places, self.penalty = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, docs: list[int], texts: pa.Array, tokenizer_path: str, rules: PackRules) -> None:
        m = memo(tokenizer_path)
        units, per_doc = byte_bpe_cut(texts)
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        m.learn(distinct)
        count, first, ends, pool = m.tables()
        rows = m.rows(distinct)[coded.indices.to_numpy()]
        lens = count[rows]
        # one more token, the end, after each document's units
        last = np.cumsum(per_doc)
        upto = np.concatenate([[0], np.cumsum(lens)])
        n_tokens = upto[last] - upto[last - per_doc] + 1
        doc_end = np.cumsum(n_tokens)
        body = pool[ragged(first[rows], lens)]
        ids = np.insert(body, upto[last], rules.end_id) if len(docs) else body
        shift = np.repeat(np.arange(len(docs)), per_doc)
        stop = (upto[1:] + shift)[ends[rows]]  # place after a sentence's last token
        stop = stop[np.concatenate([stop[1:] // rules.grain != stop[:-1] // rules.grain, [True]])] if len(stop) else stop
        base = len(self.ids)
        places, penalty = np.concatenate([doc_end, stop]), np.concatenate([np.zeros(len(doc_end), np.int64), np.full(len(stop), rules.sentence_penalty)])
        order = np.argsort(places, kind="stable")  # at one place a document's end stands first
        places, penalty = places[order], penalty[order]
        fresh = np.concatenate([[True], places[1:] != places[:-1]]) & (places > 0)
        places, penalty = places[fresh], penalty[fresh]
        gaps = np.diff(np.concatenate([[0], places]))
        extra = np.maximum(0, (gaps - 1) // rules.step) * (gaps > 2 * rules.step)
        more = (places - gaps).repeat(extra) + rules.step * (ragged(np.zeros(len(extra), np.int64), extra) + 1)
        places, penalty = np.concatenate([places, more]), np.concatenate([penalty, np.full(len(more), rules.hard_penalty)])
        order = np.argsort(places, kind="stable")
        self.places, self.penalty = np.concatenate([self.places, places[order] + base]), np.concatenate([self.penalty, penalty[order]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.doc += docs
        self.total += n_tokens.tolist()
        self.origin += [0] * len(docs)
        self.begin += (base + doc_end - n_tokens).tolist()

    def pieces(self, cuts: list[int], number: int) -> tuple[list[tuple], int]:
        """The pieces before the last cut, as rows; they leave the line."""
        stop = cuts[-1]
        n = len(self.doc)
        begin, cut = np.array(self.begin, np.int64), np.array([0, *cuts], np.int64)
        edges = np.unique(np.concatenate([begin[begin < stop], cut]))
        lo, hi = edges[:-1], edges[1:]
        d = np.searchsorted(begin, lo, "right") - 1
        w = np.searchsorted(cut, lo, "right") - 1
        raw = self.ids.astype("<u4").tobytes()
        out = [
            (self.doc[k], self.origin[k] + a - self.begin[k], z - a, raw[4 * a : 4 * z], self.total[k], number + s, a - c)
            for k, a, z, s, c in zip(d.tolist(), lo.tolist(), hi.tolist(), w.tolist(), cut[w].tolist(), strict=True)
        ]
        k = int(np.searchsorted(begin, stop, "right")) - 1
        whole = stop >= len(self.ids)
        keep = n if whole else k
        if not whole:
            self.origin[k] += stop - self.begin[k]
            self.begin[k] = stop
        self.doc, self.total, self.origin = self.doc[keep:], self.total[keep:], self.origin[keep:]
        self.begin = [b - stop for b in self.begin[keep:]]
        later = self.places > stop
        self.ids, self.places, self.penalty = self.ids[stop:], self.places[later] - stop, self.penalty[later]
        return out, len(cuts)


def pack(docs: DataFrame, tokenizer_path: str, rules: PackRules | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    rules = rules or PackRules()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.RecordBatch.from_arrays([blobs(list(c)) if k == pa.binary() else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, number = Line(), TaskContext.get().partitionId() << 32
        for b in chunks(batches, most=4 << 20):
            line.add(b.column("doc_id").to_pylist(), b.column("text"), tokenizer_path, rules)
            places = [0, *line.places.tolist()]
            cuts = [places[j] for j in best_cuts(places, [0, *line.penalty.tolist()], rules.size)]
            if len(cuts) > 1:
                rows, n = line.pieces(cuts[:-1], number)
                number += n
                yield batch(rows)
        if len(line.ids):
            rows, _ = line.pieces(np.cumsum(tail_lengths(len(line.ids), rules.size, rules.hard_penalty)).tolist(), number)
            yield batch(rows)

    return doc_columns(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
