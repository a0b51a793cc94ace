"""Repeated windows across documents, found in pieces that fit in memory.

A window is ``length`` consecutive symbols (words or bytes) of one document. Its
anchor is the ``gram`` symbols inside it with the least hash, so equal windows have
equal anchors at equal places. Consecutive windows with one anchor form a run; its
context is the text under its windows. Hashes only deal: whether windows are equal is
decided by the operator's own suffix structure, from the contexts themselves.

1. Documents form blocks as they are read. A block lists the hashes of its anchors by
   bucket, and learns which of them occur elsewhere.
2. Contexts around such anchors, each once a block with its number of copies, meet by
   anchor. Copies that are equal byte by byte are laid together there, too, with their
   numbers, and the operator's resolver sorts what is left and says which windows repeat.
3. An anchor with more than ``group_limit`` contexts, a frequent phrase say, is not one
   group: its windows are counted one by one as the anchors were, and those that occur
   again meet by window, in groups of at most ``group_limit`` and the earliest copy.
4. The answers return to the blocks.

Blocks travel compressed with all their columns; all numeric work is vectorised, and
arrays follow a block, a bucket's contexts or a million symbols of a long text. Nothing
is capped: every repeated window is found. Rows that share a doc_id are told apart by
their place in the input; a null doc_id counts as the least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .arrow import blobs, bounded, cut, shuffle_partitions
from .distinct import blocks_of, opened, planes, sealed, stable, whole
from .hashing import BASE, TABLE, Hashes, U, long_word_line, mix, word_line

#: Symbols of one line; longer texts are read in overlapping lines of so many.
LINE = 1 << 20
#: Low bits of an anchor's key that hold its place in a line.
PLACE_BITS = U(22)


@dataclass(frozen=True)
class Spec:
    """What repeats: symbols, window and anchor lengths, and which copy stays."""

    words: bool  # symbols are words, else bytes
    length: int
    gram: int
    keep_first: bool  # the first occurrence stays, else every one goes
    group_limit: int = 4096
    block_bytes: int = 2 << 20
    batch_bytes: int = 2 << 20


def symbol_line(texts: list[bytes], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in one line, and symbols per text."""
    if spec.words:
        return word_line(texts)[:2]
    return TABLE[np.frombuffer(b"".join(texts), np.uint8)], np.fromiter(map(len, texts), np.int64, len(texts))


def lines(texts: list[bytes], spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, symbols per piece, row and first symbol of each piece); pieces of a long text overlap by a window."""
    held: list[int] = []
    size = 0

    def flush():
        symbols, per = symbol_line([texts[i] for i in held], spec)
        return symbols, per, np.array(held), np.zeros(len(held), np.int64)

    for row, t in enumerate(texts):
        if len(t) <= LINE:
            held.append(row)
            size += len(t)
            if size >= LINE:
                yield flush()
                held, size = [], 0
            continue
        symbols = long_word_line(t)[0] if spec.words else np.frombuffer(t, np.uint8)
        for p in range(0, max(1, len(symbols) - spec.length + 1), LINE):
            own = symbols[p : p + LINE + spec.length - 1]
            yield own if spec.words else TABLE[own], np.array([len(own)]), np.array([row]), np.array([p])
    if held:
        yield flush()


RUN = ("h", "c", "row", "s", "span")


def runs_of(texts: list[bytes], spec: Spec) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: anchor and context hash, row, first window and number of windows."""
    length, gram = spec.length, spec.gram
    parts: list[tuple] = [(np.empty(0, U), np.empty(0, U), *[np.empty(0, np.int64)] * 3)]
    for symbols, per, rows, bases in lines(texts, spec):
        n = len(symbols)
        if n < length:
            continue
        hashes = Hashes(symbols)
        at = np.arange(n - gram + 1)
        grams = hashes.of(at, at + gram)
        low = (mix(grams) >> PLACE_BITS << PLACE_BITS) | at.astype(U)
        width, have = length - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        anchor = (low & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)  # of the window at each place
        ends = np.cumsum(per)
        owner = np.repeat(np.arange(len(per)), per)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= ends[owner]
        apart = anchor[1:] != anchor[:-1]
        first, last = valid.copy(), valid.copy()
        first[1:] &= ~valid[:-1] | apart
        last[:-1] &= ~valid[1:] | apart
        s0, s1 = np.flatnonzero(first), np.flatnonzero(last)
        o, span = owner[s0], s1 - s0 + 1
        parts.append((grams[anchor[s0]], hashes.of(s0, s1 + length) + span.astype(U) * BASE, rows[o], s0 - (ends - per)[o] + bases[o], span))
    return dict(zip(RUN, map(np.concatenate, zip(*parts, strict=True)), strict=True))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ U(0x5851F42D4C957F2D)) % U(n)).astype(np.int64)


def column_texts(batch) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]


def ids(batch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def contexts_of(text: bytes, s: np.ndarray, stop: np.ndarray, spec: Spec) -> list[bytes]:
    """The symbols s .. stop - 1 of a text, words joined by one space."""
    if not spec.words:
        return [text[a:z] for a, z in zip(s.tolist(), stop.tolist(), strict=True)]
    if len(text) <= LINE:
        words = text.split()
        return [b" ".join(words[a:z]) for a, z in zip(s.tolist(), stop.tolist(), strict=True)]
    _, begin, end = long_word_line(text)
    return [b" ".join(text[a:z].split()) for a, z in zip(begin[s].tolist(), end[stop - 1].tolist(), strict=True)]


class Rows:
    """Collects (key, kind, block, blob) and gives them out as one table or batch."""

    def __init__(self):
        self.cols: list[list] = [[], [], [], []]

    def add(self, key: int, kind: int, block: int, value) -> None:
        for c, v in zip(self.cols, (key, kind, block, sealed(value)), strict=True):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int8(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(self.cols, kinds, strict=False)), blobs(self.cols[3])], ["key", "kind", "block", "blob"])

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


PACKED = "key long, kind byte, block long, blob binary"
LISTED, COLD, HOT, OWN, OWN_HOT, HOT_CONTEXTS = range(6)
UNIQUE, SHARED, CROWDED = range(3)


def groups(*by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``by``, first of each group in that order, and the group of every item."""
    order = np.lexsort(by[::-1])
    new = np.ones(len(order), bool)
    for k, b in enumerate(by):
        own = b[order]
        new[1:] = (own[1:] != own[:-1]) if not k else new[1:] | (own[1:] != own[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, order[new], group


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, items in their order)."""
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket) if len(bucket) else np.empty(0, np.int64)
    ends = np.cumsum(size)
    for b in np.flatnonzero(size).tolist():
        yield b, order[ends[b] - size[b] : ends[b]]


def anchors(runs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, the group of every run, contexts of each anchor, and whether one of them repeats."""
    h, group = np.unique(runs["h"], return_inverse=True)
    order, first, _ = groups(group, runs["c"])
    contexts = np.bincount(group[first], minlength=len(h))
    return h, group, contexts, np.bincount(group, minlength=len(h)) > contexts


def without_null(docs: DataFrame) -> DataFrame:
    return bounded(docs).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def packed_batch(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked_batch(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


#: (distinct contexts of whole groups; windows, copies, document and first place of each) -> a flag for every window:
#: it repeats, or, where the first copy stays, an earlier window equals it.
Resolver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, Spec], np.ndarray]


def met(lists: pa.Table, keys: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of a bucket, the group of every entry by its first ``keys`` columns, contexts of each group, and whether one repeats in a block."""
    held = [opened(b) for b in lists.column("blob").to_pylist()]
    group = groups(*(np.concatenate([np.frombuffer(x[i], "<u8") for x in held]) for i in range(keys)))[2]
    n, again = np.concatenate([whole(x[keys]) for x in held]), np.concatenate([whole(x[keys + 1]) for x in held])
    return held, group, np.bincount(group, n).astype(np.int64), np.bincount(group, again) > 0


def without_repeats(docs: DataFrame, spec: Spec, resolve: Resolver) -> DataFrame:
    """All columns of ``docs``, then n_symbols, n_removed, n_spans and kept (binary)."""
    docs = docs.drop("n_symbols", "n_removed", "n_spans", "kept")
    rows, n = stable(without_null(docs)), 4 * shuffle_partitions(docs.sparkSession)  # buckets, several a partition, so that partitions are even
    names, length = rows.columns, spec.length

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks_of(batches, spec.block_bytes):
            h, _, contexts, again = anchors(runs_of(column_texts(own), spec))
            out = Rows()
            for b, at in by_bucket(bucket_of(h, n)):
                out.add(b, LISTED, block, (h[at].tobytes(), planes(contexts[at]), planes(again[at])))
            yield out.batch()

    def list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks_of(batches, spec.block_bytes):
            out = Rows()
            out.add(block, LISTED, block, packed_batch(own))
            yield out.batch()

    def count_anchors(t: pa.Table) -> pa.Table:
        held, group, total, some = met(t, 1)
        state = np.where(total > spec.group_limit, CROWDED, np.where((total > 1) | some, SHARED, UNIQUE))[group]
        out, at = Rows(), 0
        for x, block, bucket in zip(held, t.column("block").to_pylist(), t.column("key").to_pylist(), strict=True):
            size = len(x[0]) // 8
            out.add(block, LISTED, bucket, planes(state[at : at + size]))
            at += size
        return out.table()

    def ask(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = Rows()
        known = dict(zip(replies.column("block").to_pylist(), replies.column("blob").to_pylist(), strict=True))
        for block, blob in zip(blocks.column("block").to_pylist(), blocks.column("blob").to_pylist(), strict=True):
            own = unpacked_batch(opened(blob))
            texts, docs_ = column_texts(own), ids(own)
            runs = runs_of(texts, spec)
            h, group, _, _ = anchors(runs)
            state = np.zeros(len(h), np.int64)
            for b, at in by_bucket(bucket_of(h, n)):
                if b not in known:
                    raise RuntimeError("a block was read with other rows than before: write the input to a table first")
                state[at] = whole(opened(known[b]))
            state = state[group]
            live = np.flatnonzero(state)
            live = live[np.lexsort((runs["row"][live], runs["s"][live], docs_[runs["row"][live]]))]  # earliest copies first
            # the contexts, equal ones once
            text_of: list = [None] * len(live)
            for row, at in by_bucket(runs["row"][live]):
                s = runs["s"][live[at]]
                for i, c in zip(at.tolist(), contexts_of(texts[row], s, s + runs["span"][live[at]] + length - 1, spec), strict=True):
                    text_of[i] = c
            number: dict[tuple[int, bytes], int] = {}
            of = np.fromiter((number.setdefault(k, len(number)) for k in zip(runs["h"][live].tolist(), text_of, strict=True)), np.int64, len(live))
            size = np.bincount(of, minlength=len(number))
            first = np.full(len(number), len(live))
            np.minimum.at(first, of, np.arange(len(live)))
            lead = live[first]
            items = {"h": runs["h"][lead], "doc": docs_[runs["row"][lead]], "s": runs["s"][lead], "span": runs["span"][lead], "copies": size}
            contexts = [text_of[i] for i in first.tolist()]
            hot = state[lead] == CROWDED
            cold = np.flatnonzero(~hot)
            order: list[np.ndarray] = [np.empty(0, np.int64)]
            for b, at in by_bucket(bucket_of(items["h"][cold], n)):
                order.append(cold[at])
                ship(out, b, COLD, block, items, cold[at], contexts)
            crowd = np.flatnonzero(hot)
            place = np.empty(len(lead), np.int64)
            place[np.concatenate([*order, crowd])] = np.arange(len(lead))
            out.add(block, OWN, block, (place[of], runs["row"][live], runs["s"][live], runs["span"][live], first[of] == np.arange(len(live)), items["span"][np.argsort(place)], len(crowd)))
            if len(crowd):
                out.add(block, HOT_CONTEXTS, block, ({k: v[crowd] for k, v in items.items()}, [contexts[i] for i in crowd.tolist()]))
        return out.table()

    def ship(out: Rows, key: int, kind: int, block: int, items: dict, at: np.ndarray, contexts: list[bytes]) -> None:
        texts = [contexts[i] for i in at.tolist()]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out.add(key, kind, block, ([items["h"][at].tobytes(), items["doc"][at].tobytes(), items["s"][at].tobytes()], planes(items["span"][at]), planes(items["copies"][at]), planes(sizes), b"".join(texts)))

    # windows of crowded anchors, one by one

    def windows_of(items: dict, contexts: list[bytes]) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of some contexts: distinct ones (w, v, doc, s, copies), the distinct one of each, whether it is its earliest, its context and place."""
        span = items["span"]
        of, i = np.repeat(np.arange(len(span)), span), np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        upto, hashed = np.cumsum([0, *map(len, contexts)]), ([], [])
        for _, part in by_bucket(upto[:-1] // LINE):  # about a line's bytes at a time
            symbols, per = symbol_line([contexts[k] for k in part.tolist()], spec)
            at = np.repeat(np.cumsum(per) - per - np.cumsum(span[part]) + span[part], span[part]) + np.arange(span[part].sum())
            for k in (0, 1):
                hashed[k].append(Hashes(symbols, k).of(at, at + length))
        w, v = map(np.concatenate, hashed)
        doc, s = items["doc"][of], items["s"][of] + i
        order, first, group = groups(w, v)
        order = np.lexsort((s, doc, group))
        earliest = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])] if len(order) else order
        copies = np.bincount(group, items["copies"][of], minlength=len(earliest)).astype(np.int64)
        is_first = np.zeros(len(of), bool)
        is_first[earliest] = True
        return {"w": w[earliest], "v": v[earliest], "doc": doc[earliest], "s": s[earliest], "copies": copies}, group, is_first, of[earliest], i[earliest]

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob").to_pylist(), strict=True):
                x, *_ = windows_of(*opened(blob))
                out = Rows()
                for k, at in by_bucket(bucket_of(x["w"], n)):
                    out.add(k, LISTED, block, (x["w"][at].tobytes(), x["v"][at].tobytes(), planes(np.ones(len(at), np.int64)), planes(x["copies"][at] > 1), x["doc"][at].tobytes(), x["s"][at].tobytes()))
                yield out.batch()

    def count_windows(t: pa.Table) -> pa.Table:
        held, group, total, some = met(t, 2)
        block = np.repeat(np.array(t.column("block").to_pylist(), np.int64), [len(x[0]) // 8 for x in held])
        doc, s = (np.concatenate([np.frombuffer(x[i], "<i8") for x in held]) for i in (4, 5))
        order = np.lexsort((block, s, doc, group))
        leads = np.zeros(len(group), bool)
        leads[order[np.concatenate([[True], group[order][1:] != group[order][:-1]])]] = True
        parts = np.where((total > 1) | some, -(-total // spec.group_limit), 0)[group]
        out, at = Rows(), 0
        for x, b, bucket in zip(held, t.column("block").to_pylist(), t.column("key").to_pylist(), strict=True):
            size = len(x[0]) // 8
            out.add(b, LISTED, bucket, (planes(parts[at : at + size]), planes(leads[at : at + size])))
            at += size
        return out.table()

    def ask_windows(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = Rows()
        known = dict(zip(replies.column("block").to_pylist(), replies.column("blob").to_pylist(), strict=True))
        for block, blob in zip(blocks.column("block").to_pylist(), blocks.column("blob").to_pylist(), strict=True):
            items, contexts = opened(blob)
            x, group, is_first, of, i = windows_of(items, contexts)
            parts, leads = np.zeros(len(of), np.int64), np.zeros(len(of), bool)
            for b, at in by_bucket(bucket_of(x["w"], n)):
                p, first = opened(known[b])
                parts[at], leads[at] = whole(p), whole(first) > 0
            # a window goes to one part of its group; the earliest of all goes to every part
            sent = np.repeat(np.arange(len(of)), np.where(leads, parts, np.minimum(parts, 1)))
            nth = np.arange(len(sent)) - np.searchsorted(sent, sent)
            part = np.where(leads[sent], nth, int(np.int64(block) & np.int64(0x7FFFFFFFFFFFFFFF)) % np.maximum(parts[sent], 1))
            cols = {"h": mix(x["w"][sent] + part.astype(U) * BASE), "doc": x["doc"][sent], "s": x["s"][sent], "span": np.ones(len(sent), np.int64), "copies": x["copies"][sent]}
            texts: list = [None] * len(sent)
            for c, at in by_bucket(of[sent]):
                starts = i[sent[at]]
                for k, t in zip(at.tolist(), contexts_of(contexts[c], starts, starts + length, spec), strict=True):
                    texts[k] = t
            order: list[np.ndarray] = [np.empty(0, np.int64)]
            for b, at in by_bucket(bucket_of(cols["h"], n)):
                order.append(at)
                ship(out, b, HOT, block, cols, at, texts)
            out.add(block, OWN_HOT, block, (group, is_first, len(of), sent[np.concatenate(order)]))
        return out.table()

    def decide(t: pa.Table) -> pa.Table:
        held = [opened(b) for b in t.column("blob").to_pylist()]
        h, doc, s = (np.concatenate([np.frombuffer(x[0][i], k) for x in held]) for i, k in enumerate(("<u8", "<i8", "<i8")))
        span, copies = (np.concatenate([whole(x[i]) for x in held]) for i in (1, 2))
        per = [len(x[0][0]) // 8 for x in held]
        block = np.repeat(np.array(t.column("block").to_pylist(), np.int64), per)
        texts: list[bytes] = []
        for x in held:
            ends = np.cumsum(whole(x[3])).tolist()
            texts += [x[4][a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        order = np.lexsort((block, s, doc, h))  # by anchor, the earliest copy first
        number: dict[bytes, int] = {}  # equal contexts have one anchor; parts of a crowded window may meet here, too
        of = np.empty(len(h), np.int64)
        of[order] = np.fromiter((number.setdefault(texts[i], len(number)) for i in order.tolist()), np.int64, len(h))
        first = np.full(len(number), len(h))
        np.minimum.at(first, of[order], np.arange(len(h)))
        lead = order[first]
        weight = np.bincount(of, copies, minlength=len(number)).astype(np.int64)
        contexts = [texts[i] for i in lead.tolist()]
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        begins = np.concatenate([[True], h[lead][1:] != h[lead][:-1]])
        part = (np.cumsum(sizes) - sizes)[np.flatnonzero(begins)] // spec.batch_bytes  # whole groups, about batch_bytes at a time
        cuts = np.flatnonzero(begins)[np.concatenate([[True], part[1:] != part[:-1]])].tolist()
        flags = []
        for a, z in zip(cuts, [*cuts[1:], len(lead)], strict=True):
            own = lead[a:z]
            flags.append(resolve(contexts[a:z], span[own], weight[a:z], doc[own], s[own], spec))
        flag = np.concatenate(flags)
        begin = np.cumsum(span[lead]) - span[lead]
        is_lead = (block == block[lead[of]]) & (doc == doc[lead[of]]) & (s == s[lead[of]])
        out, at = Rows(), 0
        for size, b, bucket, kind in zip(per, *(t.column(k).to_pylist() for k in ("block", "key", "kind")), strict=True):
            own = np.arange(at, at + size)
            where = np.repeat(begin[of[own]] - np.cumsum(span[own]) + span[own], span[own]) + np.arange(span[own].sum())
            bits = flag[where]
            if spec.keep_first:  # a later copy of a whole context goes
                bits |= np.repeat(~is_lead[own], span[own])
            out.add(b, kind, bucket, (size, np.packbits(bits).tobytes()))
            at += size
        return out.table()

    def finish(t: pa.Table, marks: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], dict[int, bytes]] = {}
        for key, kind, of, blob in zip(*(marks.column(k).to_pylist() for k in ("key", "kind", "block", "blob")), strict=True):
            found.setdefault((key, kind), {})[of] = blob
        tables = []
        for block, blob in zip(t.column("block").to_pylist(), t.column("blob").to_pylist(), strict=True):
            own = unpacked_batch(opened(blob))
            place, row, s, span, first, spans, n_hot = opened(found[block, OWN][block])
            cold = len(spans) - n_hot
            flag = taken(found.get((block, COLD), {}), spans[:cold])
            if n_hot:
                group, is_first, n_windows, sent = opened(found[block, OWN_HOT][block])
                hot = np.zeros(n_windows, bool)
                np.logical_or.at(hot, sent, taken(found.get((block, HOT), {}), np.ones(len(sent), np.int64)))
                again = hot[group]
                if spec.keep_first:
                    shown = np.zeros(n_windows, bool)
                    shown[sent] = True
                    again = again | (~is_first & shown[group])
                flag = np.concatenate([flag, again])
            begin = np.cumsum(spans) - spans
            where = np.repeat(begin[place] - np.cumsum(span) + span, span) + np.arange(span.sum())
            gone = flag[where]
            if spec.keep_first:  # a later copy within the block goes
                gone = gone | np.repeat(~first, span)
            at = np.repeat(s - np.cumsum(span) + span, span) + np.arange(span.sum())
            tables.append(cleaned(own, np.repeat(row, span)[gone], at[gone]))
        return pa.concat_tables(tables)

    def taken(replies: dict[int, bytes], spans: np.ndarray) -> np.ndarray:
        """One flag a window, from the packed answers of the buckets in which the contexts lie, in order."""
        if not len(spans):
            return np.empty(0, bool)
        upto = np.concatenate([[0], np.cumsum(spans)])
        out, at = [], 0
        for b in sorted(replies):
            size, bits = opened(replies[b])
            stop = at + size
            out.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(upto[stop] - upto[at])).astype(bool))
            at = stop
        return np.concatenate(out)

    def cleaned(own: pa.RecordBatch, row: np.ndarray, at: np.ndarray) -> pa.Table:
        texts = column_texts(own)
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        lo, hi = np.searchsorted(row, np.arange(len(texts)), "left"), np.searchsorted(row, np.arange(len(texts)), "right")
        sizes, removed, spans, kept = [], [], [], []
        for text, a, z in zip(texts, lo.tolist(), hi.tolist(), strict=True):
            size, gone, n_spans, left = without(text, at[a:z], spec)
            sizes.append(size)
            removed.append(gone)
            spans.append(n_spans)
            kept.append(left)
        return pa.table([*(own.column(k) for k in names), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), blobs(kept)], [*names, "n_symbols", "n_removed", "n_spans", "kept"])

    held = rows.mapInArrow(list_blocks, PACKED)
    replies = rows.mapInArrow(list_anchors, PACKED).groupBy("key").applyInArrow(count_anchors, PACKED)
    asked = cut(held.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(ask, PACKED), by="kind")
    crowds = asked.where(F.col("kind") == HOT_CONTEXTS)
    if not crowds.isEmpty():
        counts = crowds.mapInArrow(list_windows, PACKED).groupBy("key").applyInArrow(count_windows, PACKED)
        asked = asked.unionByName(cut(crowds.groupBy("key").cogroup(counts.groupBy("key")).applyInArrow(ask_windows, PACKED), by="kind"))
    decided = asked.where(F.col("kind").isin(COLD, HOT)).groupBy("key").applyInArrow(decide, PACKED)
    marks = asked.where(F.col("kind").isin(OWN, OWN_HOT)).unionByName(decided)
    schema = StructType([*rows.schema.fields, *(StructField(k, LongType()) for k in ("n_symbols", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    return held.groupBy("key").cogroup(marks.groupBy("key")).applyInArrow(finish, schema)


def without(text: bytes, starts: np.ndarray, spec: Spec) -> tuple[int, int, int, bytes]:
    """Symbols of a text, how many lie under the windows at ``starts`` (rising), in how many spans, and what is left."""
    if len(starts):  # windows that touch or overlap make one span
        apart = np.flatnonzero(np.diff(starts) > spec.length)
        a, z = starts[np.concatenate([[0], apart + 1])], starts[np.concatenate([apart, [-1]])] + spec.length
    else:
        a = z = np.empty(0, np.int64)
    gone = int((z - a).sum())
    if not spec.words:
        keep = zip([0, *z.tolist()], [*a.tolist(), len(text)], strict=True)
        return len(text), gone, len(a), b"".join([text[x:y] for x, y in keep]) if gone else text
    if len(text) <= LINE:
        words = text.split()
        keep = zip([0, *z.tolist()], [*a.tolist(), len(words)], strict=True)
        return len(words), gone, len(a), b" ".join([w for x, y in keep for w in words[x:y]])
    _, begin, end = long_word_line(text)
    n = len(begin)
    parts = [b" ".join(text[begin[x] : end[min(x + 50_000, y) - 1]].split()) for p, y in zip([0, *z.tolist()], [*a.tolist(), n], strict=True) for x in range(p, y, 50_000)]
    return n, gone, len(a), b" ".join(parts)
