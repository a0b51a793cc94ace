"""SentencePiece encoding through a relational lattice, and decoding.

Texts are cut into units that no piece spans: between two characters that stand side by
side in no piece. Over the distinct units of the corpus (see distinct.py) bounded-length
substrings are exploded, equi-joined to the piece table, and the edges found are grouped
by unit and folded with a higher-order aggregate. For BPE models the fold merges in the
order of scores (a Viterbi path is not what such a model means): an edge is taken if both
its ends are borders of symbols and exactly one border lies between, which goes. Borders
are bits of one long, or entries of an array for units of more than 61 characters.

A fold in one pass over the scores needs the model's merges to be in that order, that is,
every piece to be worth less than the two it is merged from; this is checked when a model
is loaded, and another model is refused.

Edge cases: null or empty text has no ids and decodes to the empty text; characters
without a piece become byte pieces; a unit longer than ``MOST_UNIT`` characters, which an
edge's bits can't hold (a run of so many letters without a space or sign), is encoded by
the library itself; repeated doc_ids are encoded row by row; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import doc_columns, shuffle_partitions, text_bytes
from .distinct import Block, assembled, distinct_units, held, listed, opened, packed_rows, places, planes, ranges_array, sealed, stable, units_array, whole
from .words import ragged

SPACE = "▁"
#: Characters of a unit whose borders fit into one long, and of one whose edges do.
MOST_CHARS, MOST_UNIT = 61, 2047
#: Bits of an edge that hold its length.
MOST_PIECE = 31
#: Entries of a piece table that may be broadcast.
MOST_PIECES = 1_000_000
#: Characters in pieces up to which their pairs are a table; beyond, they are searched.
MOST_KINDS = 4096


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """A model's tables: how texts are cut, and the bytes of every id."""

    def __init__(self, path: str):
        self.model = m = load_model(path)
        raw, plain = [], {}
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            raw.append(bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace(SPACE, " ").encode())
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                plain[p] = m.get_score(i)
        self.longest = max(map(len, plain), default=1)
        if self.longest > MOST_PIECE:
            raise ValueError(f"a piece of {self.longest} characters is longer than {MOST_PIECE}")
        worth = {p: score if len(p) > 1 else np.inf for p, score in plain.items()}  # a character needs no merge
        for p, score in plain.items():
            halves = [min(worth[p[:k]], worth[p[k:]]) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
            if len(p) > 1 and halves and max(halves) < score:
                raise ValueError(f"the merges of this model are not in the order of scores: {p!r}")
        self.size = np.array([len(x) for x in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        pairs = {(a, b) for p in plain for a, b in zip(p.replace(SPACE, " "), p.replace(SPACE, " ")[1:], strict=False)}
        chars = sorted({c for p in pairs for c in p})
        self.kind = np.zeros(0x110000, np.uint32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        keys = np.array(sorted(int(self.kind[ord(a)]) * self.kinds + int(self.kind[ord(b)]) for a, b in pairs), np.int64)
        if self.kinds <= MOST_KINDS:
            self.beside = np.zeros(self.kinds * self.kinds, bool)
            self.beside[keys] = True
        else:
            self.beside, self.keys = None, keys

    def together(self, chars: np.ndarray) -> np.ndarray:
        """True where a character and the next one stand side by side in some piece."""
        k = self.kind[chars].astype(np.int64)
        pair = k[:-1] * self.kinds + k[1:]
        return self.beside[pair] if self.beside is not None else np.isin(pair, self.keys)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts in order, with the space that the model puts before a text, and units per text."""
        texts = pc.replace_substring(texts, SPACE, " ")  # the model takes its sign for a space
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        data, at = text_bytes(texts)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        begin = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        chars = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
        edge = np.ones(len(chars), bool)
        edge[1:] = ~self.together(chars)
        edge[np.searchsorted(begin, at[:-1][at[:-1] < len(data)])] = True
        start = begin[edge]
        return ranges_array(data, np.concatenate([start, [len(data)]])), np.diff(np.searchsorted(start, at))

    def spell(self, ids: np.ndarray, per: np.ndarray) -> list[str]:
        """The texts of rows of ids, without the space put before them."""
        size = self.size[ids]
        data = self.bytes[ragged(self.first[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(per)].tolist()
        return [data[a:z].decode("utf-8", "replace")[1:] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


_MODELS: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The tables of a model, kept by the worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """(sub, id, rank) of the ordinary pieces, best score first, and the ids of the 256 byte pieces."""
    m = pieces_of(path).model
    if m.vocab_size() > MOST_PIECES:
        raise ValueError(f"{m.vocab_size()} pieces are too many to broadcast")
    byte_ids, plain = [m.unk_id()] * 256, []
    for i in range(m.vocab_size()):
        if m.is_byte(i):
            byte_ids[int(m.id_to_piece(i)[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            plain.append(i)
    order = {x: r for r, x in enumerate(sorted({m.get_score(i) for i in plain}, reverse=True))}
    rows = [("", 0, 0), *((m.id_to_piece(i).replace(SPACE, " "), i, order[m.get_score(i)]) for i in plain)]
    return spark.createDataFrame(rows, "sub string, id int, rank int"), byte_ids


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """(key, unit, ids) for distinct ``units`` (key, unit) of at most MOST_UNIT characters.

    An edge is one long: rank, start, length and id from the high bits down, so edges of a
    unit sort by score, then place. The units should be partitioned by unit.
    """
    pieces, byte_ids = piece_table(units.sparkSession, path)
    longest = pieces_of(path).longest
    spans = F.expr(f"""explode(concat(array(0), flatten(transform(sequence(0, length(unit) - 1),
        s -> transform(sequence(1, least({longest}, length(unit) - s)), l -> s * 32 + l)))))""")
    subs = units.select("key", "unit", spans.alias("x")).select("key", "unit", "x", F.expr("substring(unit, x div 32 + 1, x % 32)").alias("sub"))
    edges = subs.join(F.broadcast(pieces), "sub").select("key", "unit", F.expr("shiftleft(CAST(rank AS BIGINT), 40) | shiftleft(CAST(x AS BIGINT), 24) | id").alias("e"))
    grouped = edges.groupBy("key", "unit").agg(F.array_sort(F.collect_list("e")).alias("es"))
    start, length = "CAST(shiftright(e, 29) & 2047 AS INT)", "CAST(shiftright(e, 24) & 31 AS INT)"
    named = grouped.select("key", "unit", F.expr(f"transform(filter(es, e -> {length} > 0), e -> named_struct('s', {start}, 'l', {length}, 'id', CAST(e & 16777215 AS INT)))").alias("es"))

    ends = "(shiftleft(1L, e.s) | shiftleft(1L, e.s + e.l))"
    inner = "(shiftleft(1L, e.s + e.l) - shiftleft(2L, e.s))"
    short = named.where(F.length("unit") <= MOST_CHARS).withColumn("m", F.expr(f"""aggregate(filter(es, e -> e.l > 1), shiftleft(1L, length(unit) + 1) - 1,
        (m, e) -> IF((m & {ends}) = {ends} AND bit_count(m & {inner}) = 1, m & ~{inner}, m))"""))
    long = named.where(F.length("unit") > MOST_CHARS).withColumn("m", F.expr("""aggregate(filter(es, e -> e.l > 1), array_repeat(true, length(unit) + 1),
        (m, e) -> IF(m[e.s] AND m[e.s + e.l] AND size(filter(slice(m, e.s + 2, e.l - 1), x -> x)) = 1, transform(m, (x, i) -> x AND (i <= e.s OR i >= e.s + e.l)), m))"""))

    def spelled(merged: DataFrame, is_edge: str, count: str, border: str) -> DataFrame:
        kept = merged.withColumn("k", F.expr(f"array_sort(transform(filter(es, e -> {is_edge}), e -> struct(e.s, e.id)))"))
        table = f"array({','.join(map(str, byte_ids))})"
        fallback = f"""flatten(transform(filter(sequence(0, length(unit) - 1), i -> {border}), i -> coalesce(
            transform(slice(filter(k, e -> e.s = i), 1, nullif(size(filter(k, e -> e.s = i)), 0)), e -> e.id),
            transform(sequence(1, octet_length(substring(unit, i + 1, 1))), b -> {table}[int(conv(substring(hex(encode(substring(unit, i + 1, 1), 'UTF-8')), 2 * b - 1, 2), 16, 10))]))))"""
        return kept.select("key", "unit", F.expr(f"IF(size(k) = {count} - 1, transform(k, e -> e.id), {fallback})").alias("ids"))

    a = spelled(short, f"(m & {ends}) = {ends} AND (m & {inner}) = 0", "bit_count(m)", "(m & shiftleft(1L, i)) != 0")
    b = spelled(long, "m[e.s] AND m[e.s + e.l] AND NOT exists(slice(m, e.s + 2, e.l - 1), x -> x)", "size(filter(m, x -> x))", "m[i]")
    return a.unionByName(b)


def encode_long(units: DataFrame, path: str) -> DataFrame:
    """(key, unit, ids) by the library; a line end is put before a unit, so no space sign is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces_of(path).model
        lead = len(m.encode("\n"))  # a line end first takes the sign that the library puts before a text
        for b in batches:
            ids = [m.encode("\n" + u)[lead:] for u in b.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("unit"), pa.array(ids, pa.list_(pa.int32()))], ["key", "unit", "ids"])

    return units.mapInArrow(run, "key long, unit string, ids array<int>")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian uint32), n_tokens and decoded (the text of the ids) for every row."""
    rows, n = stable(doc_columns(docs)), shuffle_partitions(docs.sparkSession)

    def cutter(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return pieces_of(path).cut(texts)

    lists = listed(rows, cutter, n)

    def distinct(t: pa.Table) -> pa.Table:
        known = distinct_units(t)[1]
        return pa.table([pa.array(np.full(len(known), t.column("key")[0].as_py())), known.cast(pa.string())], ["key", "unit"])

    units = lists.groupBy("key").applyInArrow(distinct, "key long, unit string").repartition(4 * n, "unit")  # by number: few bytes, much work
    size = F.length("unit")
    known = encode_units(units.where(size <= MOST_UNIT), path).unionByName(encode_long(units.where(size > MOST_UNIT), path)).withColumnRenamed("key", "of")

    def reply(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids = answers.column("ids").combine_chunks()
        names = answers.column("unit").combine_chunks().cast(pa.binary())
        out = []
        for blob in t.column("blob").to_pylist():
            own = ids.take(pa.array(places(units_array(opened(blob)), names)))
            out.append(sealed((planes(own.value_lengths().to_numpy()), planes(own.flatten().to_numpy()))))
        return pa.Table.from_batches([packed_rows(t.column("block").to_pylist(), t.column("key").to_pylist(), out)])

    replies = lists.groupBy("key").cogroup(known.groupBy("of")).applyInArrow(reply, "key long, block long, blob binary")

    def finish(b: Block) -> pa.Table:
        tables, size, begin, pool, at = pieces_of(path), np.zeros(len(b.bucket), np.int64), np.zeros(len(b.bucket), np.int64), [np.empty(0, np.int64)], 0
        for codes, (lengths, ids) in b.answers():
            own, flat = whole(lengths), whole(ids)
            size[codes], begin[codes] = own, at + np.cumsum(own) - own
            pool.append(flat)
            at += len(flat)
        lens = size[b.codes]
        ids = np.concatenate(pool)[ragged(begin[b.codes], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(b.per)])]
        per = np.diff(upto)
        data = ids.astype("<u4")
        blobs = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(data)])
        return pa.table([pa.array(b.ids, pa.int64()), blobs, pa.array(per), pa.array(tables.spell(ids, per), pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return assembled(held(rows, cutter, n, ordered=True), replies, finish, "doc_id long, ids binary, n_tokens long, decoded string")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column text: the ids' text without the space put before it; null ids are no text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces_of(path)
        for b in batches:
            own = [np.frombuffer(x or b"", "<u4") for x in b.column(0).to_pylist()]
            texts = tables.spell(np.concatenate([np.empty(0, "<u4"), *own]).astype(np.int64), np.array([len(x) for x in own], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    cols = encoded.select(ids, *[c for c in encoded.columns if c not in (ids, "text")])
    from pyspark.sql.types import StringType, StructField, StructType

    return cols.mapInArrow(run, StructType([*cols.schema.fields, StructField("text", StringType())]))
