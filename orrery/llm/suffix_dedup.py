"""Exact substring dedup over bytes by two-stage suffix sorting.

Candidate contexts are dealt by anchors (see repeats.py), and whole groups are laid in
one line, every context ended by a sign below all bytes. In the two-stage sort only the suffixes
smaller than their successor are sorted directly; the others follow by one scan
over the buckets of first bytes. Adjacent suffixes that share ``length`` bytes are
repeats, and every byte under one is removed, the first copy included.

Edge cases: null or empty text has no bytes; texts shorter than the window lose
nothing; repeated rows lose their shared windows; an empty table gives an empty
result; other columns pass through, but those named n_symbols, n_removed, n_spans,
kept or _bucket give way to the operator's own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .hashing import Hashes, U, mix
from .repeats import Spec, without_repeats

WINDOW_BYTES = 400
GRAM_BYTES = 64


def smaller_than_next(line: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it; the last one is not."""
    n = len(line)
    up = np.zeros(n, bool)
    if n < 2:
        return up
    differ = line[:-1] != line[1:]
    at = np.where(differ, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # first place from here on where neighbours differ
    ok = nearest < n
    i = nearest[ok]
    up[:-1][ok] = line[i] < line[i + 1]
    return up


def words_at(line: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols from each place on packed into one number, and how many; past the end they are 0.

    Eight symbols go into a number where all are below 256, else four below 65,536, else two.
    """
    n = len(line)
    most = int(line.max()) if n else 0
    step = 8 if most < 1 << 8 else 4 if most < 1 << 16 else 2
    bits = np.uint64(64 // step)
    ext = np.concatenate([line.astype(np.uint64), np.zeros(step, np.uint64)])
    keys, have = ext, 1
    while have < step:  # double the symbols held
        keys = (keys[: len(keys) - have] << (bits * np.uint64(have))) | keys[have:]
        have *= 2
    return keys[:n], step


def direct_sort(places: np.ndarray, line: np.ndarray, depth: int) -> np.ndarray:
    """``places`` sorted by the first ``depth`` symbols of their suffixes, most significant symbols first.

    Only places still tied with a neighbour are compared further, number by number of
    words_at(). A tied group whose symbols all hash alike is left as it is: it needs no
    order, and whoever asks for common prefixes compares the symbols themselves.
    """
    keys, step = words_at(line)
    n = len(line)
    places = places[np.argsort(keys[places])]
    k = keys[places]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    hashes = Hashes(mix(line.astype(np.uint64) + U(1)))
    ext = np.concatenate([keys, np.zeros(depth + step, keys.dtype)])
    at = still_tied(same, np.arange(len(same)))
    done = step
    while done < depth and len(at):
        if done % (4 * step) == step:
            whole = hashes.of(np.minimum(places[at] + done, n), np.minimum(places[at] + depth, n))
            head = ~same[at]
            group = np.cumsum(head) - 1
            other = np.concatenate([[False], whole[1:] != whole[:-1]]) & ~head
            at = at[(np.bincount(group[other], minlength=group[-1] + 1) > 0)[group]]
            if not len(at):
                break
        k = ext[places[at] + done]
        head = ~same[at]
        group = np.cumsum(head) - 1
        other = np.concatenate([[False], k[1:] != k[:-1]]) & ~head
        moved = (np.bincount(group[other], minlength=group[-1] + 1) > 0)[group]
        if moved.any():
            sort_tied(places, same, at[moved], k[moved])
            at = still_tied(same, at)
        done += step
    return places


def still_tied(same: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of ``at`` that equal a neighbour so far."""
    tied = same.copy()
    tied[:-1] |= same[1:]
    return at[tied[at]]


def by_group(k: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Order by group ``g`` (rising), then ``k``: sorted by number first, then dealt by group without comparing."""
    if not len(g) or g[-1] >= 1 << 16:
        return np.lexsort((k, g))
    order = np.argsort(k)
    return order[np.argsort(g[order].astype(np.uint16), kind="stable")]


def sort_tied(places: np.ndarray, same: np.ndarray, at: np.ndarray, k: np.ndarray) -> None:
    """Sorts the groups of tied places ``at`` by their next symbols ``k``; tied pairs, the usual case, by one comparison."""
    head = np.flatnonzero(~same[at])
    size = np.diff(np.concatenate([head, [len(at)]]))
    pair = head[size == 2]
    swap = pair[k[pair + 1] < k[pair]]
    x, y = at[swap], at[swap + 1]
    places[x], places[y] = places[y], places[x]
    same[at[pair + 1]] = k[pair + 1] == k[pair]
    if len(pair) < len(head):
        more = np.repeat(size != 2, size)
        own, k = at[more], k[more]
        g = np.repeat(np.arange(len(head)), size)[more]
        order = by_group(k, g)
        places[own] = places[own[order]]
        k = k[order]
        same[own[1:]] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
        same[own[0]] = False


def two_stage_sort(line: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of ``line`` (small integers), ordered by ``depth`` symbols at least.

    With ``starts``, a mask, only those suffixes are wanted: they and the ones after them up
    to the next that is smaller than its successor are sorted, which is all that induction
    needs; the array holds some others, too.
    """
    n = len(line)
    if not n:
        return np.empty(0, np.int64)
    up = smaller_than_next(line)
    need = np.ones(n, bool)
    if starts is not None:
        at = np.where(starts, np.arange(n), -1)
        last = np.maximum.accumulate(at)  # the wanted suffix before each place
        end = np.minimum.accumulate(np.where(up, np.arange(n), n - 1)[::-1])[::-1]  # where its induction begins
        need = (last >= 0) & (np.arange(n) <= end[np.maximum(last, 0)])
    sorted_up = direct_sort(np.flatnonzero(up & need), line, depth)
    top = int(line.max()) + 1
    size = np.bincount(line[need], minlength=top)
    start = np.cumsum(size) - size
    out = np.full(int(size.sum()), -1, np.int64)
    n_down = np.bincount(line[need & ~up], minlength=top)
    head = start.copy()  # next free place of each bucket; larger suffixes stand before smaller-than-next ones
    up_start = start + n_down
    first = line[sorted_up]
    edges = np.searchsorted(first, np.arange(top + 1))
    for c in range(top):
        own = sorted_up[edges[c] : edges[c + 1]]
        out[up_start[c] : up_start[c] + len(own)] = own
    induced = need & ~up

    def place(before: np.ndarray) -> None:
        """Appends suffixes, in order, to the buckets of their first symbols."""
        sym = line[before]
        order = np.argsort(sym.astype(np.uint16) if top < 1 << 16 else sym, kind="stable")
        before, sym = before[order], sym[order]
        count = np.bincount(sym, minlength=top)
        upto = np.cumsum(count) - count
        out[head[sym] + np.arange(len(before)) - upto[sym]] = before
        head[:] += count

    def before(own: np.ndarray) -> np.ndarray:
        """The suffixes that those of ``own`` induce."""
        prev = own[own > 0] - 1
        return prev[induced[prev]]

    if induced[n - 1]:
        place(np.array([n - 1]))  # the last suffix precedes all that start like it
    for c in range(top):
        at = start[c]
        while at < head[c]:  # this bucket grows by suffixes whose successor lies in it
            stop = head[c]
            more = before(out[at:stop])
            at = stop
            if len(more):
                place(more)
        more = before(out[up_start[c] : start[c] + size[c]])
        if len(more):
            place(more)
    return out


def common_at_least(line: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """True where the suffixes at a and b share ``depth`` symbols."""
    keys, step = words_at(line)
    n = len(line)
    ok = (np.maximum(a, b) + depth) <= n
    live = np.flatnonzero(ok)
    if depth < step:
        raise ValueError(f"windows of fewer than {step} symbols")
    for k in range(0, depth, step):
        off = min(k, depth - step)
        live = live[keys[a[live] + off] == keys[b[live] + off]]
        if not len(live):
            break
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated_windows(contexts: list[bytes], span: np.ndarray, copies: np.ndarray, doc: np.ndarray, s: np.ndarray, spec: Spec) -> np.ndarray:
    """For every window of every context, whether an equal one stands elsewhere.

    All contexts are sorted as one line; a context met several times has that many equal ones.
    """
    size = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    begin = np.cumsum(size) - size
    line = np.frombuffer(b"\x00".join([*contexts, b""]) if contexts else b"", np.uint8).astype(np.int64) + 1
    line[begin + size - 1] = 0
    window = np.full(len(line), -1)
    window[np.repeat(begin - np.cumsum(span) + span, span) + np.arange(span.sum())] = np.arange(span.sum())
    order = two_stage_sort(line, spec.length, window >= 0)
    order = order[window[order] >= 0]
    equal = common_at_least(line, order[:-1], order[1:], spec.length)
    out = np.repeat(copies > 1, span)
    out[window[order[:-1]][equal]] = True
    out[window[order[1:]][equal]] = True
    return out


def dedup_bytes(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES) -> DataFrame:
    """All columns of ``docs``, n_symbols (bytes), n_removed, n_spans and kept (the bytes left)."""
    return without_repeats(docs, Spec(words=False, length=window, gram=gram, keep_first=False), repeated_windows)
