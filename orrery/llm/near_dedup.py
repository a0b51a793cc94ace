"""Near-duplicate documents by SuperMinHash, banding, verification and components.

Signatures are SuperMinHash: each shingle gives every place of the signature a rank
through one random permutation, so the ranks of an element are correlated and the
estimate has less variance; ranks rise from step to step, so a document stops once
no place can fall any more. Bands of the signature deal documents with equal shingle
sets' representatives into buckets.

A bucket is never expanded into its pairs: its members point at one of them, and
connected members form a candidate cluster, so all pairs that share a bucket lie in
one cluster. A cluster of up to ``cluster_rows`` sets is compared in one task, as
matrices. In a larger one the member nearest to the most frequent signature values
becomes the hub; in a group of near copies that is the text they were made from, so
most members link to it directly. Only members outside of the hub's component are
then compared, with those that share a bucket with them, bucket by bucket in bounded
blocks. Every pair that shares a bucket is so either compared on full shingle sets or
already connected.

Edge cases: null or empty text has no shingles and is linked with nothing; a text of
fewer words than a shingle is one shingle; equal sets are one node, so groups of
copies cost one row each; rows that share a doc_id are one node; rows without doc_id
are linked with nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import chunks, cut, doc_columns, tidy
from .components import components, smallest_linked
from .hashing import BASE, Hashes, U, long_word_line, mix, word_line


@dataclass(frozen=True)
class NearRules:
    """``bands`` * ``rows`` places: at similarity 0.8, 32 bands of 6 miss about one pair in 16,000; at 0.85, 24 miss one in 80,000."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6
    hub_members: int = 256
    cluster_rows: int = 512
    drawn: int = 64


#: Bytes of a text that is read in pieces, and shingles ranked at once.
LONG = 1 << 20
RANKED = 1 << 17


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, ASCII letters lower-cased."""
    short = [t for t in texts if len(t) <= LONG]
    symbols, per, _, _ = word_line([t.lower() for t in short])
    h = Hashes(symbols)
    ends = np.cumsum(per)
    each = iter(zip((ends - per).tolist(), per.tolist(), strict=True))

    def set_of(h: Hashes, at: int, n: int) -> np.ndarray:
        width = min(shingle, n)
        i = np.arange(at, at + n - width + 1)
        return np.unique(h.of(i, i + width) + U(width)) if n else np.empty(0, U)

    out = []
    for t in texts:
        if len(t) <= LONG:
            out.append(set_of(h, *next(each)))
        else:  # in pieces, so that no array but those of its words follows its length
            own = long_word_line(t.lower())[0]
            out.append(set_of(Hashes(own), 0, len(own)))
    return out


STEPS = np.arange(1, 512, 2, dtype=U) * BASE


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures, one row a set; a value holds its step in the high byte and the rank below it.

    Shingles are ranked ``RANKED`` at a time; a later part of a set starts from what the
    parts before it gave, so it stops the earlier.
    """
    sig = np.full((len(sets), size), np.iinfo(np.uint64).max, U)
    flat = sig.reshape(-1)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seeds = np.concatenate(sets) if sets else np.empty(0, U)
    for part in range(0, len(seeds), RANKED):
        seed, owner = seeds[part : part + RANKED], owners[part : part + RANKED]
        own = slice(int(owner[0]), int(owner[-1]) + 1)
        perm = np.broadcast_to(np.arange(size, dtype=np.uint8), (len(seed), size)).copy()
        row = np.arange(len(seed))
        for j in range(size):
            x = mix(seed + STEPS[j])
            rank = (U(j) << U(56)) | (x >> U(8))
            k = (mix(x ^ U(0x2545F4914F6CDD1D)) % U(size - j)).astype(np.int64) + j
            taken = perm[row, k]
            perm[row, k] = perm[:, j]
            np.minimum.at(flat, owner * size + taken, rank)
            done = (sig[own] < (U(j + 1) << U(56))).all(axis=1)
            live = ~done[owner - own.start]
            if not live.all():
                seed, owner, perm = seed[live], owner[live], perm[live]
                row = np.arange(len(seed))
                if not len(seed):
                    break
    return sig


def band_keys(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    out = np.empty((len(sig), rules.bands), np.int64)
    for b in range(rules.bands):
        h = np.full(len(sig), (b + 1) * int(BASE) & (2**64 - 1), U)
        for i in range(b * rules.rows, (b + 1) * rules.rows):
            h = mix(h ^ sig[:, i]) + BASE
        out[:, b] = h.view(np.int64)
    return out


def batch_texts(b: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]


def profiles(docs: DataFrame, rules: NearRules) -> DataFrame:
    """doc_id, n_shingles, set_hi and set_lo (equal for equal sets), bands (array of keys, none for empty sets), sig (16 bits a place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=1 << 20):
            sets = shingle_sets(batch_texts(b), rules.shingle)
            n = np.array([len(s) for s in sets], np.int64)
            hi = np.array([mix(s).sum(dtype=U) for s in sets], U).view(np.int64)
            lo = np.array([mix(s ^ BASE).sum(dtype=U) for s in sets], U).view(np.int64)
            sig = super_minhash(sets, rules.bands * rules.rows)
            short = [x.tobytes() for x in (mix(sig) & U(0xFFFF)).astype("<u2")]
            keys = band_keys(sig, rules)
            keys = keys[n > 0].reshape(-1)
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, rules.bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(pa.array(at), pa.array(keys)), pa.array(short, pa.binary())], ["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sig"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>, sig binary")


def stored_sets(docs: DataFrame, wanted: DataFrame, rules: NearRules) -> DataFrame:
    """``wanted`` (node, cluster, n) with grams, the sorted little-endian uint64 shingles of its document.

    Texts meet what is wanted before they become sets, so sets are not shuffled here. The
    join is merged at every size: the wanted ids have no bound a broadcast could rely on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            grams = [s.tobytes() for s in shingle_sets(batch_texts(b), rules.shingle)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("cluster"), b.column("n"), pa.array(grams, pa.binary())], ["node", "cluster", "n", "grams"])
        tidy()

    texts = doc_columns(docs).withColumnRenamed("doc_id", "node").join(wanted.hint("merge"), "node").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node long, cluster long, n long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, hub) whose sets reach the similarity; a hub's members are split into bounded groups."""
    share = pairs.groupBy("hub").agg(F.count("*").alias("n")).select("hub", F.ceil(F.col("n") / rules.hub_members).cast("int").alias("parts"))
    left = pairs.join(share, "hub").select("a", "hub", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    left = left.join(sets.select(F.col("doc_id").alias("a"), "grams"), "a").select("hub", "part", "a", "grams")
    hubs = share.join(sets.select(F.col("doc_id").alias("hub"), F.col("grams").alias("hub_grams")), "hub")
    right = hubs.select(F.col("hub").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"), "hub_grams")

    def check(members: pa.Table, hub: pa.Table) -> pa.Table:
        links: list[int] = []
        hubs = [np.frombuffer(g, "<u8") for g in hub.column("hub_grams").to_pylist()]
        for a, g in zip(members.column("a").to_pylist(), members.column("grams").to_pylist(), strict=True):
            x = np.frombuffer(g, "<u8")
            for y in hubs:
                if 100 * min(len(x), len(y)) < rules.percent * max(len(x), len(y)):
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * both >= rules.percent * (len(x) + len(y) - both):
                    links.append(a)
                    break
        of = members.column("hub")[0].as_py() if members.num_rows else None
        return pa.table([pa.array(links, pa.int64()), pa.array([of] * len(links), pa.int64())], ["a", "b"])

    return left.groupBy("hub", "part").cogroup(right.groupBy("of", "of_part")).applyInArrow(check, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by blocks of shingles that stand in several sets."""
    both = [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, code, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    keep = n[code] > 1
    owner, code = owner[keep], (np.cumsum(n > 1) - 1)[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        a, z = np.searchsorted(code, [at, at + columns])
        table = np.zeros((len(both), columns), np.float32)
        table[owner[a:z], code[a:z] - at] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out.astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    common = overlaps(left, right)
    size = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None]
    return 100 * common >= percent * (size - common)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """Edges (a, b) that connect what ``links`` connects: every node to the least one it reaches."""
    least_l, least_r = smallest_linked(links, left, right)
    ids, to = np.concatenate([left, right]), np.concatenate([least_l, least_r])
    return pa.table([pa.array(ids[ids != to], pa.int64()), pa.array(to[ids != to], pa.int64())], ["a", "b"])


def grams_of(t: pa.Table, column: str = "grams") -> list[np.ndarray]:
    return [np.frombuffer(g, "<u8") for g in t.column(column).to_pylist()]


EDGES = "a long, b long"


def small_clusters(nodes: DataFrame, rules: NearRules) -> DataFrame:
    """Links within clusters of (cluster, node, grams), one bounded task a cluster."""

    def compare(t: pa.Table) -> pa.Table:
        ids, sets = t.column("node").to_numpy(), grams_of(t)
        return forest(linked(sets, sets, rules.percent), ids, ids)

    return nodes.groupBy("cluster").applyInArrow(compare, EDGES)


def hubs_of(nodes: DataFrame, rules: NearRules) -> DataFrame:
    """(cluster, hub): the member that agrees most with the commonest values of some drawn signatures."""
    w = Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node")
    drawn = nodes.select("cluster", "node", "sig").withColumn("at", F.row_number().over(w)).where(F.col("at") <= rules.drawn)

    def common(t: pa.Table) -> pa.Table:
        sig = np.array([np.frombuffer(x, "<u2") for x in t.column("sig").to_pylist()])
        mode = np.array([np.bincount(c).argmax() for c in sig.T], "<u2")
        return pa.table([t.column("cluster").slice(0, 1), pa.array([mode.tobytes()], pa.binary())], ["of", "mode"])

    modes = drawn.groupBy("cluster").applyInArrow(common, "of long, mode binary")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).sum()) for x, y in zip(b.column("sig").to_pylist(), b.column("mode").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("node"), pa.array(n, pa.int64())], ["cluster", "node", "agree"])

    near = nodes.select("cluster", "node", "sig").join(modes, F.col("cluster") == F.col("of")).select("cluster", "node", "sig", "mode").mapInArrow(agree, "cluster long, node long, agree long")
    return near.groupBy("cluster").agg(F.max_by("node", F.struct("agree", -F.col("node"))).alias("hub"))


def across(nodes: DataFrame, banded: DataFrame, labels: DataFrame, hubs: DataFrame, rules: NearRules) -> DataFrame | None:
    """Links between members outside of their hub's component and the members that share a bucket with them; None if there are none.

    Pairs meet by bucket. Buckets with the same members are one, and a bucket whose
    members are all connected already is none. A bucket is compared in bounded blocks.
    """
    own = labels.select(F.col("node"), F.col("component").alias("own"))
    x = nodes.select("cluster", "node").join(own, "node", "left").select("cluster", "node", F.coalesce("own", "node").alias("own"))
    main = hubs.join(own.select(F.col("node").alias("hub"), F.col("own").alias("main")), "hub", "left").select("cluster", F.coalesce("main", "hub").alias("main"))
    x = x.join(main, "cluster").select("node", "own", (F.col("own") != F.col("main")).alias("outside"))
    x = cut(banded.select(F.col("rep").alias("node"), "bucket").join(x, "node"))
    size = x.groupBy("bucket").agg(F.count(F.when(F.col("outside"), 1)).alias("o"), F.count("*").alias("m"), F.min("own").alias("a"), F.max("own").alias("b"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"))
    size = size.where("o > 0 AND a < b").groupBy("members", "m", "o").agg(F.min("bucket").alias("bucket"))
    parts = lambda c: F.ceil(F.col(c) / rules.hub_members).cast("int")
    size = cut(size.select("bucket", parts("o").alias("lefts"), parts("m").alias("rights")))
    if size.isEmpty():
        return None
    x = x.join(size, "bucket").join(nodes.select("node", "grams"), "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = x.where("outside").select("bucket", deal("lefts").alias("l"), every("rights").alias("r"), "node", "own", "grams")
    right = x.select(F.col("bucket").alias("b2"), every("lefts").alias("l2"), deal("rights").alias("r2"), F.col("node").alias("node2"), F.col("own").alias("own2"), F.col("grams").alias("grams2"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        apart = a.column("own").to_numpy()[:, None] != b.column("own2").to_numpy()[None]
        if not apart.any():
            return pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        links = linked(grams_of(a), grams_of(b, "grams2"), rules.percent) & apart
        return forest(links, a.column("node").to_numpy(), b.column("node2").to_numpy())

    return left.groupBy("bucket", "l", "r").cogroup(right.groupBy("b2", "l2", "r2")).applyInArrow(compare, EDGES)


def near_components(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id linked, directly or not) for every row of ``docs``."""
    rules = rules or NearRules()
    seen = cut(profiles(docs, rules))
    full = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = full.groupBy("set_hi", "set_lo", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = cut(same)
    of_rep = full.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = of_rep.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(shared.select("bucket", "hub"), "bucket").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = cut(components(stars).withColumnRenamed("component", "cluster"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    nodes = cut(stored_sets(docs, clusters.join(size, "cluster").select("node", "cluster", "n"), rules))
    links = cut(small_clusters(nodes.where(F.col("n") <= rules.cluster_rows), rules))
    large = nodes.where(F.col("n") > rules.cluster_rows)
    if not large.isEmpty():
        large = cut(large.join(seen.select(F.col("doc_id").alias("node"), "sig").dropDuplicates(["node"]), "node"))
        hubs = cut(hubs_of(large, rules))
        pairs = large.select("cluster", "node").join(hubs, "cluster").where("node <> hub").select(F.col("node").alias("a"), "hub")
        to_hub = cut(verified(pairs, large.select(F.col("node").alias("doc_id"), "grams"), rules))
        more = across(large, banded, components(to_hub), hubs, rules)
        links = links.unionByName(to_hub)
        links = links.unionByName(cut(more)) if more is not None else links
    labels = components(links)
    of_set = seen.join(reps, ["set_hi", "set_lo", "n_shingles"], "left")
    out = of_set.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """The documents that are the least of their component, all columns as they were."""
    gone = near_components(docs, rules).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
