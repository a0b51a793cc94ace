"""Operators against brute force on fixtures with nulls, empties, ties, repeats and odd columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import lattice, multi_index, near_dedup, packing, quality_model, quality_rules, sharding, substring_dedup, suffix_dedup, token_counts
from orrery.llm.words import Memo, byte_bpe_units, load_tokenizer

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, texts, extra=True):
    rows = [(i, t, "en", None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("kept_", F.lit(1)).withColumn("bucket", F.lit("x")) if extra else df


def make_texts(seed=0, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    vocab = [word() for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    long_passage = " ".join(rng.choice(vocab) for _ in range(150))
    out = [None, "", " ", "\n\n", "one", "a b", "  odd   spacing\tand\ttabs \r\n x ", "x" * 500, "<|endoftext|> in a <|startoftext|> text", "a\x00b c", "▁ under ▁▁ line"]
    for i in range(n):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 200)))
        if i % 3 == 0:
            t = t + " " + passage + " " + word()
        if i % 5 == 0:
            t = long_passage + "\n" + t + ". " + long_passage
        out.append(t)
    return [*out, out[-1], out[-1], "la " * 300, "la " * 300]


TEXTS = make_texts()
EMPTY: list = []


def test_quality_rules(spark):
    df = corpus(spark, [*TEXTS, "menu | home | about | news\n" + "words in a clean sentence that goes on and on. " * 8 + "\nmenu | home | about"])
    got = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    assert len(got) == df.count()
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        grams = list(zip(words, words[1:], words[2:], strict=False))
        cover = {j + o for j, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(words), len(cover))
        assert got[i].base_failed == (len(words) < 50 or 100 * len(cover) > 50 * len(words))
    last = got[len(TEXTS)]
    assert last.n_removed_lines == 2 and "|" not in last.clean_text
    assert quality_rules.clean(corpus(spark, EMPTY)).count() == 0
    assert quality_rules.clean(df).columns == df.columns


LINE_TEXTS = [
    "wow!\xa0ok\xa0yes!", "a!\u3000b! c!\nplain words here", "Home\nAbout us\nNews\nContact\nA sentence that ends.\nHome", "one\ntwo\nthree\nStop.", "one\n\ntwo\nthree\nfour\nfive\nsix",
    "Read more\nx. " * 5, "same line here now please\n" * 4, "same line here now please\n" * 3, "a | b\n» c » d\n• e", "Tous Droits RÉSERVÉS 2020.\nUn texte.", "ends with a quote”\nshort)\nx\ny\nz \t", " \x0b\n\x1c\n#$ x", "Hello!!! you there",
    "ﬁn\nẞ\nǅ x\nok\nInfo", None, "",
]


def test_quality_rules_of_lines(spark):
    """Odd white space, menus, repeated lines and phrases against the SQL."""
    import duckdb

    from orrery.llm.sql import QUALITY_RULES

    got = quality_rules.apply_rules(corpus(spark, LINE_TEXTS), with_text=False)
    documents = pa.table({"doc_id": list(range(len(LINE_TEXTS))), "text": LINE_TEXTS})  # noqa: F841
    want = duckdb.sql(QUALITY_RULES).fetchall()
    names = [d[0] for d in duckdb.sql(QUALITY_RULES).description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want)
    rules = quality_rules.LineRules()
    lines = ["Home", "About us", "News", "Contact", "A sentence that ends.", "x"]
    assert quality_rules.faults(lines, [1, 2, 1, 1, 4, 1], rules) == [True] * 4 + [False] * 2
    assert rules.fault("alle Rechte vorbehalten", 3) == "boilerplate" and rules.fault("eins › zwei", 3) == "navigation"


def test_packing(spark):
    path = tokenizers.path("byte_bpe_50k.json")
    tok = load_tokenizer(path)
    df = corpus(spark, TEXTS).repartition(3)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    seen, seqs = {i: [None] * len(v) for i, v in want.items()}, {}
    for r in packing.pack(df, path, packing.PackRules(size=256)).collect():
        ids = list(struct.unpack(f"<{r.length}I", r.ids))
        assert want[r.doc_id][r.start : r.start + r.length] == ids and r.doc_tokens == len(want[r.doc_id])
        assert seen[r.doc_id][r.start : r.start + r.length] == [None] * r.length
        seen[r.doc_id][r.start : r.start + r.length] = ids
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == want
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(corpus(spark, EMPTY), path).count() == 0


def test_best_cuts_is_optimal():
    rng = random.Random(1)
    for _ in range(50):
        places = [0]
        for _ in range(rng.randrange(1, 9)):
            places.append(places[-1] + rng.randrange(1, 10))
        pen = [0, *[rng.randrange(0, 6) for _ in places[1:]]]
        n = len(places)
        cost = [0.0] + [1e9] * (n - 1)
        for j in range(1, n):
            for i in range(j):
                if places[j] - places[i] <= 12:
                    cost[j] = min(cost[j], cost[i] + 12 - (places[j] - places[i]) + pen[j])
        got, last = 0, 0
        for j in packing.best_cuts(places, pen, 12):
            got += 12 - (places[j] - last) + pen[j]
            last = places[j]
        assert got == cost[-1] and last == places[-1]


def test_units_concatenate():
    path = tokenizers.path("byte_bpe_50k.json")
    tok = load_tokenizer(path)
    for t in [*TEXTS, "it's 12,5 a\nb  c", "foo.\nBar 'll"]:
        ids = [i for u in byte_bpe_units(t or "") for i in tok.encode(u, add_special_tokens=False).ids]
        assert ids == tok.encode(t or "", add_special_tokens=False).ids


def odd_texts(seed, n):
    """Texts of signs that pre-tokenisers treat in their own ways."""
    rng = random.Random(seed)
    parts = ["ab", "c", " ", "  ", "\n", "\n\n", "\t", "é", "'s", ".", "\u3000", "\xa0", "\x1c", "12", "<|endoftext|>", "\u200b", "!?", "\x00", "\r\n", "İ", "ß", "e\u0301", "A.", "<\u0338"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 15))) for _ in range(n)]


def test_units_of_odd_spacing():
    path = tokenizers.path("byte_bpe_50k.json")
    tok, m = load_tokenizer(path), Memo(path)
    for t in odd_texts(3, 2000):
        units = byte_bpe_units(t)
        m.learn(units)
        count, first, _, pool = m.tables()
        ids = [int(x) for k in m.rows(units) for x in pool[first[k] : first[k] + count[k]]]
        assert "".join(units) == t and ids == tok.encode(t, add_special_tokens=False).ids
    assert max(len(u) for u in byte_bpe_units("word. " * 50 + "\n\n" + "\tindented\n\n\n" * 50)) < 12


def test_memo_is_bounded():
    m = Memo(tokenizers.path("byte_bpe_50k.json"), most=50, most_bytes=400)
    for i in range(100):
        units = [f" w{i}x{k}" for k in range(20)]
        m.learn(units)
        assert len(m.row) <= 50 and m.held <= 400 + sum(map(len, units))
        count, first, _, pool = m.tables()
        assert [int(x) for k in m.rows(units[:1]) for x in pool[first[k] : first[k] + count[k]]] == m.tok.encode(units[0], add_special_tokens=False).ids


def test_token_counts(spark):
    path = tokenizers.path("word_bpe_49k.json")
    tok = load_tokenizer(path)
    texts = [*TEXTS, *odd_texts(5, 300), "x" * 100_000]
    for df in (corpus(spark, texts), corpus(spark, texts).repartition(3)):
        got = {r.doc_id: r for r in token_counts.count_tokens(df, path, 50).collect()}
        for i, t in enumerate(texts):
            n = len(tok.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50), t
    twice = corpus(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.n_tokens for r in token_counts.count_tokens(twice, path).collect()] == [2, 2]
    assert token_counts.count_tokens(corpus(spark, EMPTY), path).count() == 0


def test_sentencepiece(spark):
    path = tokenizers.path("piece_bpe_32k.model")
    m = lattice.load_model(path)
    rng = random.Random(4)
    texts = [*TEXTS, "日本語 🙂 x", "y" * 200 + " z", "tab\tend \n", "e" * 62, "l" * 300, "s" * 3000 + "e", "".join(rng.choice("estinraol") for _ in range(900)), " ".join("".join(rng.choice("estinra") for _ in range(rng.randrange(55, 70))) for _ in range(40))]
    out = lattice.encode(corpus(spark, texts), path)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert list(np.frombuffer(got[i].ids, "<u4")) == m.encode(t or "")
        assert got[i].decoded == (t or "").replace("▁", " ")
    back = {r.doc_id: r.text for r in lattice.decode(out.select("doc_id", "ids"), path).collect()}
    assert all(back[i] == got[i].decoded for i in back)
    assert lattice.encode(corpus(spark, EMPTY), path).count() == 0


def brute_words(texts, window):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            q = tuple(w[s : s + window])
            if q in seen:
                gone[s : s + window] = [True] * window
            seen.add(q)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark):
    df = corpus(spark, TEXTS).repartition(5, "doc_id")
    got = {r.doc_id: (r.n_symbols, r.n_removed, bytes(r.kept)) for r in substring_dedup.dedup_words(df).collect()}
    assert got == brute_words(TEXTS, 20)
    odd = df.withColumn("kept", F.lit("k")).withColumn("n_removed", F.lit(7)).withColumn("_bucket", F.lit(1.5)).withColumn("block", F.lit("b"))
    out = substring_dedup.clean(odd)
    assert out.columns == odd.columns and {tuple(r) for r in out.select("kept", "n_removed", "_bucket").distinct().collect()} == {("k", 7, 1.5)}
    assert substring_dedup.dedup_words(odd).columns == [*df.columns, "_bucket", "block", "n_symbols", "n_removed", "n_spans", "kept"]
    assert substring_dedup.dedup_words(corpus(spark, EMPTY)).count() == 0


def test_large_groups_are_split(spark):
    """A frequent phrase with many contexts goes by whole windows; the result is the same."""
    from orrery.llm.repeats import Spec, without_repeats

    rng = random.Random(5)
    phrase = " ".join(f"p{i}" for i in range(9))
    tail = " ".join(f"q{i}" for i in range(15))
    texts = [" ".join(f"w{rng.randrange(1000)}" for _ in range(15)) + f" {phrase} " + (tail if i % 4 == 0 else " ".join(f"w{rng.randrange(1000)}" for _ in range(15))) for i in range(80)]
    texts += texts[:40]  # equal copies of the whole phrase, too
    for limit, block in ((4, 2 << 20), (4, 2000), (1, 500), (4096, 2000)):
        spec = Spec(words=True, length=20, gram=8, keep_first=True, group_limit=limit, block_bytes=block, batch_bytes=3000)
        got = {r.doc_id: (r.n_symbols, r.n_removed, bytes(r.kept)) for r in without_repeats(corpus(spark, texts).repartition(3, "doc_id"), spec, substring_dedup.earlier_windows).collect()}
        assert got == brute_words(texts, 20)


def brute_bytes(texts, window):
    where = {}
    raw = [(t or "").encode() for t in texts]
    for i, b in enumerate(raw):
        for s in range(len(b) - window + 1):
            where.setdefault(b[s : s + window], []).append((i, s))
    masks = [bytearray(len(b)) for b in raw]
    for spots in where.values():
        if len(spots) > 1:
            for i, s in spots:
                masks[i][s : s + window] = b"\x01" * window
    return {i: (len(b), sum(m), hashlib.sha256(bytes(x for x, g in zip(b, m, strict=True) if not g)).hexdigest()) for i, (b, m) in enumerate(zip(raw, masks, strict=True))}


@pytest.mark.parametrize(("limit", "block"), [(2, 2 << 20), (2, 3000), (4096, 3000)])
def test_suffix_dedup(spark, limit, block):
    from orrery.llm.repeats import Spec, without_repeats

    spec = Spec(words=False, length=100, gram=50, keep_first=False, group_limit=limit, block_bytes=block, batch_bytes=5000)
    got = {r.doc_id: (r.n_symbols, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in without_repeats(corpus(spark, TEXTS), spec, suffix_dedup.repeated_windows).collect()}
    assert got == brute_bytes(TEXTS, 100)
    assert suffix_dedup.dedup_bytes(corpus(spark, EMPTY)).count() == 0


def test_nothing_is_removed_but_by_the_resolver(spark):
    """Hashes deal contexts; with a resolver that finds nothing, only further copies of a whole context in a block go, and none where all copies go."""
    from orrery.llm.repeats import Spec, without_repeats

    nothing = lambda contexts, span, *_: np.zeros(span.sum(), bool)
    for limit in (2, 4096):
        out = without_repeats(corpus(spark, TEXTS), Spec(words=False, length=100, gram=50, keep_first=False, group_limit=limit), nothing)
        assert out.agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_in_long_texts(spark, monkeypatch):
    """Texts longer than a line are read in overlapping lines; the result is the same."""
    from orrery.llm import repeats

    monkeypatch.setattr(repeats, "LINE", 300)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(200)) + "\n" + passage + "  " + " ".join(word() for _ in range(rng.randrange(400))) for _ in range(6)]
    runs = repeats.runs_of([t.encode() for t in texts], repeats.Spec(words=True, length=20, gram=8, keep_first=True))
    assert runs["span"].sum() == sum(len(t.split()) - 19 for t in texts)
    for t in texts:
        starts = np.array(sorted(rng.sample(range(len(t.split()) - 20), 5)))
        gone = {i for s in starts.tolist() for i in range(s, s + 20)}
        want = b" ".join(w for i, w in enumerate(t.encode().split()) if i not in gone)
        got = repeats.without(t.encode(), starts, repeats.Spec(words=True, length=20, gram=8, keep_first=True))
        assert (got[0], got[1], got[3]) == (len(t.split()), len(gone), want)


def test_prefix_sets_and_nodes():
    rng = np.random.default_rng(3)
    line = np.concatenate([rng.integers(1, 4, 400), [0]])
    places = np.arange(380)
    for most in (1, 7, 1000):
        seen = []
        for k, leaves in substring_dedup.prefix_sets(line, places, 6, most):
            heads = [tuple(line[p : p + k]) for p in leaves]
            assert heads == sorted(heads) and (k == 6 or max(heads.count(x) for x in set(heads)) <= most)
            order, node = substring_dedup.deep_nodes(line, leaves, 8)
            for a, b, same in zip(order[:-1], order[1:], node[1:] == node[:-1], strict=True):
                assert same == (a + 8 <= len(line) and b + 8 <= len(line) and (line[a : a + 8] == line[b : b + 8]).all())
            seen += leaves.tolist()
        assert sorted(seen) == places.tolist()


def test_two_stage_sort():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(rng.choice([1, 2, 6])) for _ in range(rng.randrange(1, 60))]
        want = sorted(range(len(a)), key=lambda i: a[i:])
        assert suffix_dedup.two_stage_sort(np.array(a), 100).tolist() == want
        some = np.array([rng.random() < 0.3 for _ in a])
        assert [i for i in suffix_dedup.two_stage_sort(np.array(a), 100, some).tolist() if some[i]] == [i for i in want if some[i]]


def near_truth(texts, shingle, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("cluster_rows", [4, 512])
def test_near_dedup(spark, cluster_rows):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = list(TEXTS)
    for i in range(30):
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w).upper() if i % 2 else " ".join(w))
    rules = near_dedup.NearRules(shingle=3, percent=85, bands=32, rows=5, cluster_rows=cluster_rows, hub_members=7, drawn=8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(corpus(spark, texts), rules).collect()}
    assert got == near_truth(texts, 3, 85)
    assert near_dedup.near_components(corpus(spark, EMPTY)).count() == 0


def test_super_minhash_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = near_dedup.super_minhash([a, b, a[:3]], 192)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.12
    assert (s != np.iinfo(np.uint64).max).all()


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + 0.1 * rng.normal(size=(60, 16))
    x[160:170] = x[1]
    x[170:200] = 3 * x[2] + 0.5 * rng.normal(size=(30, 16))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, [1.0] * 5, 1), (305, [0.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    label = np.arange(300)
    while True:
        new = np.minimum(label, np.where(link, label[None], 999).min(1))
        if (new == label).all():
            break
        label = new
    rules = multi_index.IndexRules(block=16, cell_rows=20, target_recall=1.0)
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_vectors(df, rules).collect()}
    found, true = sum(got[i][0] for i in range(300)), int(link.sum())
    assert 0.98 * true <= found <= true
    assert all(got[i][0] <= link[i].sum() for i in range(300))
    assert all(got[i] == (0, i) for i in range(300, 306))
    assert multi_index.near_vectors(df.where("vec_id < 0")).count() == 0


def test_embeddings_of_many_lengths(spark):
    rows = [(i, [float(i % 3 == k) + 0.01 * (i == k) for k in range(8)]) for i in range(12)]
    rows += [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 3.0]), (22, [2.0, 4.0, 6.1]), (23, [-1.0, 2.0, 0.0]), (30, [2.0]), (31, [5.0]), (32, [-1.0]), (33, [2.0]), (34, [0.0]), (35, []), (36, [-4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    link = lambda a, b: len(a) == len(b) and np.dot(a, b) >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b) > 0
    near = {i: [j for j, b in rows if j != i and link(a, b)] for i, a in rows}
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_vectors(df).collect()}
    assert got == {i: (len(js), min([i, *js])) for i, js in near.items()}
    ones = {r.vec_id: r.n_links for r in multi_index.near_vectors(df.where("size(embedding) <= 1")).collect()}
    assert ones == {30: 2, 31: 2, 32: 1, 33: 2, 34: 0, 35: 0, 36: 1}


def test_quality_model(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "and", "slept"]) for _ in range(80)) + "." for _ in range(120)]
    bad = [" | ".join(rng.choice(["buy", "now", "click", "here", "free"]) for _ in range(60)) for _ in range(120)]
    df = corpus(spark, [None, "", *good, *bad])
    labels = spark.createDataFrame([(i + 2, int(i < 120)) for i in range(240)] + [(0, None), (None, 1), (999, 1)], "doc_id long, quality int")
    train = labels.where("doc_id % 3 <> 0 OR doc_id IS NULL")
    model = quality_model.fit(df, train)
    got = {r.doc_id: r.score for r in quality_model.score(df, model).collect()}
    held = [(got[i + 2], i < 120) for i in range(240) if (i + 2) % 3 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    assert quality_model.select(df, model, 0.5).columns == df.columns
    none = quality_model.fit(df, labels.where("false"))
    assert {r.score for r in quality_model.score(df, none).collect()} == {0.5}
    one = quality_model.fit(df, labels.where("quality = 1"))
    assert len({r.score for r in quality_model.score(df, one).collect()}) == 1
    assert quality_model.score(corpus(spark, EMPTY), model).count() == 0 and quality_model.select(corpus(spark, EMPTY), model).count() == 0
    assert {r.score for r in quality_model.score(corpus(spark, [None, ""]), model).collect()} == {got[0]}


def test_quality_scores_by_brute_force(spark):
    """The size differences taken again from the model's dictionaries, and their logistic value."""
    import zstandard

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "Cat", "sat", "on", "a", "mat", "12"]) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randrange(1, 2000))) for _ in range(60)]
    texts += [" | ".join(rng.choice(["BUY", "now", "click", "99%"]) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    df = corpus(spark, texts)
    model = quality_model.fit(df, spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int"))
    for r in quality_model.score(df, model).collect():
        t, d = texts[r.doc_id].encode(), []
        for view, pair in ((t, model.dictionaries[:2]), (quality_model.shape(t), model.dictionaries[2:])):
            sizes = []
            for own in pair:
                c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes.append(sum(len(c.compress(view[i : i + 2048])) for i in range(0, len(view), 2048)))
            d.append((sizes[1] - sizes[0]) / len(t))
        z = model.slope[0] + 20 * (model.slope[1] * d[0] + model.slope[2] * d[1])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-12


def test_quality_prior_does_not_follow_the_sample(spark):
    """Scores keep the labels' own shares when half a label is drawn of either side."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat"] if (i % 10) or rng.random() < 0.5 else ["cat", "mat", "buy", "now"]) for _ in range(40)) for i in range(600)]
    df, labels = corpus(spark, texts), spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id long, quality int")
    means = [quality_model.score(df, quality_model.fit(df, labels, quality_model.FitRules(most_rows=n))).agg(F.avg("score")).first()[0] for n in (120, 6000)]
    assert abs(means[0] - 0.9) < 0.06 and abs(means[1] - 0.9) < 0.06


def test_quality_model_of_repeated_rows(spark):
    """Documents and labels that stand there several times give the model of one copy, not a larger sample."""
    rng = random.Random(4)
    df = corpus(spark, [" ".join(rng.choice(["good", "plain", "words"] if i < 60 else ["BUY", "$$$", "now!!"]) + str(rng.randrange(50)) for _ in range(40)) for i in range(120)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    rules = quality_model.FitRules(most_rows=60)
    one = quality_model.fit(df, labels, rules)
    many = quality_model.fit(df.unionByName(df).unionByName(df), labels.unionByName(labels).unionByName(labels), rules)
    assert many.dictionaries == one.dictionaries and np.allclose(many.slope, one.slope)
    other = df.withColumn("text", F.concat("text", F.lit(" and more")))
    a, b = (quality_model.fit(x.unionByName(y), labels, rules) for x, y in ((df, other), (other, df)))
    assert a.dictionaries == b.dictionaries and sum(map(len, a.dictionaries)) < 1.5 * sum(map(len, one.dictionaries))


def test_shards(spark, tmp_path):
    df = corpus(spark, TEXTS)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), df.schema)
    assert store.read().count() == 0
    for i in range(6):
        assert store.append(df.where(F.col("doc_id") % 6 == i).coalesce(1)) == i + 1
    before = store.manifest().count()
    at = store.compact()
    assert at == 7 and store.manifest().count() < before
    key = lambda d: sorted((r.doc_id, r.text or "") for r in d.collect())
    assert key(store.read()) == key(df) and key(store.read(1)) == key(df.where("doc_id % 6 = 0"))
    with pytest.raises(sharding.VersionTaken):
        store.commit(store.manifest(), 7)
    assert store.append(df.limit(0)) == 8 and key(store.read()) == key(df)
    assert store.compact() == 8 and key(store.read(3)) == key(df.where("doc_id % 6 < 3"))
    assert store.vacuum() > 0 and key(store.read()) == key(df)
    many = sharding.ShardStore(spark, str(tmp_path / "t"), df.schema)
    assert many.append_all(df, F.col("doc_id") % 5) == [1, 2, 3, 4, 5]
    assert many.read(1).count() < many.read(5).count() == len(TEXTS)


def test_shards_of_similar_size_are_merged(spark, tmp_path):
    df = spark.range(4000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 8) AS text")
    rules = sharding.TierRules(target_bytes=60_000, min_run=3)
    store = sharding.ShardStore(spark, str(tmp_path), df.schema, rules)
    for n in (1, 1, 1, 900, 900, 1):
        store.append(df.where(f"doc_id < {n}").coalesce(1))
    tiers = {r.path: (r.tier, r.rows) for r in store.manifest().collect()}
    chosen = {r.path for r in store.plan(store.manifest()).collect()}
    assert sorted(tiers[p] for p in chosen) == [max(tiers.values())] * 4  # the tiny ones only
    store.compact()
    assert sorted(r.rows for r in store.manifest().collect()) == [4, 900, 900] and store.read().count() == 1804


def test_shards_with_other_writers(spark, tmp_path):
    """Two writers at once lose nothing, and vacuum() spares what is about to be committed."""
    df = corpus(spark, TEXTS).withColumn("_metadata", F.lit("m"))
    store, other = (sharding.ShardStore(spark, str(tmp_path), df.schema) for _ in range(2))
    for i in range(5):
        store.append(df.where(F.col("doc_id") % 6 == i).coalesce(1))
    commit, late = store.commit, []

    def slow(entries, version, base=False):
        if not late:  # while this writer is about to commit, another appends and cleans up
            late.append(other.append(df.where("doc_id % 6 = 5").coalesce(1)))
            other.vacuum()
        return commit(entries, version, base)

    store.commit = slow
    assert store.append(df.limit(3).coalesce(1)) == 7 and late == [6]
    late.clear()
    other.append = lambda rows: sharding.ShardStore.append(other, df.limit(2).coalesce(1))
    assert store.compact() >= 9 and late == [8]
    store.vacuum()
    key = lambda d: sorted((r.doc_id, r.text or "", r._metadata) for r in d.collect())
    assert key(store.read()) == sorted(key(df) + key(df.limit(3)) + key(df.limit(2)))
    assert not list((tmp_path / "open").glob("[!.]*"))


def test_crc_is_unsigned(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00")).alias("c")).first().c == zlib.crc32(b"\x01\x00\x00\x00")
