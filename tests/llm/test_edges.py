"""Every operator and stage on empty tables, null tables, clashing column names and very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import lattice, near_dedup, packing, quality_model, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_metadata", "kept", "node", "sig", "bucket", "block", "key", "blob", "kind", "cluster", "grams", "score", "rest", "h", "ids", "quality", "learn", "value", "n_symbols", "rep", "hub", "component", "arrival"]


def model():
    return quality_model.Model((b".",) * 4, np.array([1.0, 2.0, 0.5]), 2048, 3)


PATH = tokenizers.path
#: Operators with a row a document.
PER_ROW = {
    "op3": lambda d: quality_model.score(d, model()),
    "op4": lambda d: lattice.encode(d, PATH("piece_bpe_32k.model")),
    "op5": quality_rules.apply_rules,
    "op6": suffix_dedup.dedup_bytes,
    "op8": lambda d: token_counts.count_tokens(d, PATH("word_bpe_49k.json")),
    "op9": substring_dedup.dedup_words,
    "op10": near_dedup.near_components,
}
#: Stages: some of the rows, all columns as they were.
STAGES = {
    "rules": quality_rules.clean,
    "model": lambda d: quality_model.select(d, model()),
    "near": near_dedup.keep_one,
    "substring": substring_dedup.clean,
}
OTHERS = {"op1": lambda d: packing.pack(d, PATH("byte_bpe_50k.json"))}


def clashing(df):
    for i, c in enumerate(CLASHING):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(f"x{i}"))
    return df


@pytest.mark.parametrize("name", [*PER_ROW, *STAGES, *OTHERS])
def test_empty_tables(spark, name):
    df = clashing(spark.createDataFrame([], SCHEMA))
    out = (PER_ROW | STAGES | OTHERS)[name](df)
    assert out.count() == 0
    assert name not in STAGES or out.columns == df.columns


@pytest.mark.parametrize("name", [*PER_ROW, *STAGES, *OTHERS])
def test_null_tables(spark, name):
    df = clashing(spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)] * 2, SCHEMA))
    rows = (PER_ROW | STAGES | OTHERS)[name](df).collect()
    if name in PER_ROW:
        assert sorted((r.doc_id is None, r.doc_id) for r in rows) == [(False, 1)] * 2 + [(True, None)] * 3
    elif name == "rules":
        assert rows == []  # texts without words fail
    elif name == "op1":
        assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1)] * 2 + [(True, 1)] * 3
    else:
        assert len(rows) == 5 and all(r["_metadata"] == "x0" and r["kept"] == 1 for r in rows)


@pytest.mark.parametrize("name", [*PER_ROW, *STAGES, *OTHERS])
def test_clashing_names(spark, name):
    text = " ".join(f"word{i % 37} of {i}." for i in range(60))
    plain = spark.createDataFrame([(i, text if i < 2 else f"{text} and {i}", "en", "s", 9) for i in range(4)], SCHEMA)
    f = (PER_ROW | STAGES | OTHERS)[name]
    a, b = f(plain), f(clashing(plain))
    same = [c for c in a.columns if name not in STAGES or c not in CLASHING]
    key = lambda d: sorted(str(tuple(r)) for r in d.select(*same).collect())
    assert name == "op1" or key(a) == key(b)
    if name in STAGES:
        assert b.columns == clashing(plain).columns and {r["_metadata"] for r in b.collect()} == {"x0"}
    if name == "op1":
        assert sum(r.length for r in a.collect()) == sum(r.length for r in b.collect())


def test_shards_of_odd_tables(spark, tmp_path):
    for i, rows in enumerate(([], [(None, None, None, None, None)] * 3, [(1, "x" * 3_000_000, None, None, None)] * 2)):
        df = clashing(spark.createDataFrame(rows, SCHEMA))
        store = sharding.ShardStore(spark, str(tmp_path / str(i)), df.schema)
        store.append(df)
        store.append_all(df, F.lit(0))
        store.compact()
        assert store.read().columns == df.columns and store.read().count() == 2 * len(rows)


LONG = None


def long_texts():
    """A text of 6 MB, longer than every line, block and chunk, with a passage that a short one has, too."""
    global LONG
    if LONG is None:
        rng = random.Random(0)
        vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
        words = [rng.choice(vocab) for _ in range(1_000_000)]
        passage = " ".join(rng.choice(vocab) for _ in range(120))
        words[600_000] = passage
        LONG = [" ".join(words), passage, "\n".join(" ".join(words[i : i + 12]) for i in range(0, 1000, 12))]
    return LONG


@pytest.mark.parametrize("name", [*PER_ROW, *STAGES, *OTHERS])
def test_very_long_texts(spark, name):
    texts = long_texts()
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = (PER_ROW | STAGES | OTHERS)[name](df).collect()
    rows = {r.doc_id: r for r in got}
    n_words = len(texts[0].split())
    if name in ("op6", "op9"):
        first, second = rows[0], rows[1]
        assert first.n_symbols == (n_words if name == "op9" else len(texts[0].encode()))
        assert second.n_removed == second.n_symbols and (name == "op6") == (first.n_removed >= second.n_symbols)
    elif name == "op8":
        from orrery.llm.words import load_tokenizer

        assert rows[0].n_tokens == len(load_tokenizer(PATH("word_bpe_49k.json")).encode(texts[0], add_special_tokens=False).ids)
    elif name == "op4":
        assert rows[0].decoded == texts[0] and rows[1].n_tokens == len(lattice.load_model(PATH("piece_bpe_32k.model")).encode(texts[1]))
    elif name == "op1":
        from orrery.llm.words import load_tokenizer

        assert sum(r.length for r in got if r.doc_id == 0) == 1 + len(load_tokenizer(PATH("byte_bpe_50k.json")).encode(texts[0], add_special_tokens=False).ids)
    elif name == "op10":
        assert rows[0].n_shingles > 900_000 and {r.component_id for r in got} == {0, 1, 2}
    elif name == "op5":
        assert rows[0].n_words == n_words and rows[0].kept
    elif name == "op3":
        assert 0 <= rows[0].score <= 1
    else:
        assert set(rows) <= {0, 1, 2} and 0 in rows
