"""Text functions: tokens, normal forms, n-grams, mention features, spans and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[^\p{L}0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), WORDS), lambda t: t != "")


def normal_numbers(col: Column) -> Column:
    return F.regexp_replace(col, "[0-9]", "0")


def fact_token(col: Column) -> Column:
    """A token that may stand in a fact line: no white space, no #."""
    return F.replace(F.regexp_replace(F.trim(col), r"\s+", "_"), F.lit("#"), F.lit("-HASH-"))


def coarse_frame(col: Column) -> Column:
    """propbank/ frames cut at their last dash, framenet/ frames as they are; others raise."""
    cut = F.regexp_replace(col, r"-[^-]*$", "")
    return F.when(col.startswith("propbank/"), cut).when(col.startswith("framenet/"), col).otherwise(F.raise_error(F.concat(F.lit("no such frame: "), col)))


def mid_dots(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "^/", ""), "/", ".")


def mid_of_url(col: Column) -> Column:
    """/m/x of a URL that ends in m.x or in m/x."""
    return F.concat(F.lit("/m/"), F.regexp_extract(col, r"m[./]([^./>]+)>?$", 1))


def is_kb_node(col: Column) -> Column:
    return col.startswith("http://")


def uuid_prefix(col: Column) -> Column:
    return F.substring(F.regexp_replace(col, "[^A-Za-z0-9]", ""), 1, 8)


def byte_count(col: Column) -> Column:
    """A count that fits a signed byte; it must be positive."""
    return F.when(col > 0, F.least(col, F.lit(127))).otherwise(F.raise_error(F.lit("a count must be positive"))).cast("byte")


def ngrams(words: Column, n: int, sep: str = "_") -> Column:
    """All runs of ``n`` words, joined."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, n), sep))).otherwise(F.array().cast("array<string>"))


def padded_bigrams(words: Column, before: str = "BBBB", after: str = "AAAA", sep: str = "_") -> Column:
    left, right = F.concat(F.array(F.lit(before)), words), F.concat(words, F.array(F.lit(after)))
    return F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(sep), b))


def mention_words(mention: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(normal_numbers(F.regexp_replace(mention, "-", " ")), r"[^A-Za-z0 ]", ""), r"\s+", " ")
    return F.filter(F.split(F.trim(clean), " "), lambda w: w != "")


def gram_features(mention: Column) -> Column:
    """``pi:`` unigrams and ``pb:`` padded bigrams of a mention, lower-case."""
    w = F.transform(mention_words(mention), lambda x: F.lower(x))
    return F.concat(F.transform(w, lambda x: F.concat(F.lit("pi:"), x)), F.transform(padded_bigrams(w), lambda x: F.concat(F.lit("pb:"), x)))


#: Prefixes of mention features, and the words and runs of zeros too frequent to search by.
FEATURE_PREFIXES = ("p:", "pi:", "pb:", "h:", "hi:", "hp:", "hip:")
STOP_WORDS = ("s_AAAA", "s", "i", "I", "a", "A", "the", "BBBB_the", "of")
MOST_ZEROS = 9
STOP_FEATURES = [p + w for p in FEATURE_PREFIXES for w in (*STOP_WORDS, *(x for n in range(1, MOST_ZEROS + 1) for x in ("0" * n, "0" * n + "_AAAA", "BBBB_" + "0" * n)))]


def mention_features(mention: Column, heads: Column) -> Column:
    """Grams; ``h:`` a headword (normalised from four digits on), ``hi:`` in lower case and ``hp:`` as it is, where they differ from it. Stop features go."""
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    form = lambda x: F.when(digits(x) >= 4, normal_numbers(x)).otherwise(x)
    named = lambda x: F.array(F.concat(F.lit("h:"), form(x)), F.when(F.lower(x) != form(x), F.concat(F.lit("hi:"), F.lower(x))), F.when(x != form(x), F.concat(F.lit("hp:"), x)))
    every = F.concat(gram_features(mention), F.flatten(F.transform(F.filter(heads, lambda x: x.isNotNull()), named)))
    stop = F.array(*[F.lit(s) for s in STOP_FEATURES])
    return F.filter(every, lambda f: f.isNotNull() & ~F.array_contains(stop, f))


#: Weight of a feature by its prefix.
PREFIX_WEIGHTS = (("hip:", 8.0), ("hi:", 20.0), ("hp:", 16.0), ("h:", 30.0), ("pb:", 5.0), ("pi:", 1.0), ("p:", 2.0))


def feature_weight(feature: Column) -> Column:
    out = None
    for prefix, w in PREFIX_WEIGHTS:
        out = F.when(feature.startswith(prefix), w) if out is None else out.when(feature.startswith(prefix), w)
    return out.otherwise(1.0)


def namespace(feature: Column, sep: str = ":") -> Column:
    """What stands before the first delimiter; its absence raises."""
    return F.when(F.instr(feature, sep) > 0, F.substring_index(feature, sep, 1)).otherwise(F.raise_error(F.concat(F.lit("no namespace: "), feature)))


def digest_hash(key: Column, bits: int = 31) -> Column:
    """A hash that any engine can repeat: the first ``bits`` (60 at most) of the MD5 digest."""
    return F.shiftright(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), 60 - bits)


def digest_slice(key: Column, i: int, digits: int) -> Column:
    """The ``i``-th run of ``digits`` hexadecimal digits of the MD5 digest as a number."""
    return F.conv(F.substring(F.md5(key), i * digits + 1, digits), 16, 10).cast("long")


def bit_slice(key: Column, i: int, bits: int) -> Column:
    """The ``i``-th bucket number of ``bits`` bits for a key."""
    return F.xxhash64(key, F.lit(i)).bitwiseAND(F.lit((1 << bits) - 1))


def shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def span(start: Column, end: Column) -> Column:
    """[start, end)"""
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def width(s: Column) -> Column:
    return s["end"] - s["start"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def crossing(a: Column, b: Column) -> Column:
    """They share a token and neither contains the other."""
    return overlaps(a, b) & ~contains(a, b) & ~contains(b, a)


def span_relation(a: Column, b: Column) -> Column:
    return (
        F.when(a["end"] <= b["start"], "before").when(b["end"] <= a["start"], "after").when((a["start"] == b["start"]) & (a["end"] == b["end"]), "same")
        .when(contains(b, a), "within").when(contains(a, b), "covers").otherwise("overlap")
    )


def bounded_bin(value: Column, step: int, most: int) -> Column:
    """floor(value / step), ``most`` at most."""
    return F.least(F.floor(value / step), F.lit(most)).cast("int")


def length_bucket(n: Column, bounds: tuple[int, ...] = (5, 10, 20, 40)) -> Column:
    """Number of bounds that ``n`` reaches."""
    out = F.lit(0)
    for b in bounds:
        out += F.when(n >= b, 1).otherwise(0)
    return out


def pos_pattern(tags: Column) -> Column:
    """First letters of tags, runs collapsed: DT JJ NNS NNS -> D J N+."""
    letters = F.array_join(F.transform(tags, lambda t: F.substring(t, 1, 1)), "")
    return F.trim(F.regexp_replace(F.regexp_replace(letters, r"([A-Z])\1+", "$1+"), r"([A-Z]\+?)", "$1 "))


def majority(tags: Column) -> Column:
    """The most frequent element; of equals the least."""
    ranked = F.transform(F.array_distinct(tags), lambda t: F.struct((-F.size(F.filter(tags, lambda x: x == t))).alias("n"), t.alias("t")))
    return F.array_min(ranked)["t"]


def endpoint_score(tag: Column) -> Column:
    return F.when(tag.startswith("NNP") | (tag == "CD"), 1.0).otherwise(0.5)


def has_main_verb(tags: Column) -> Column:
    """A verb stands in the sentence, but not first."""
    return F.exists(tags, lambda t: t.startswith("V")) & ~F.coalesce(F.get(tags, F.lit(0)).startswith("V"), F.lit(False))


def unique(values: Column) -> Column:
    return F.array_distinct(values)


def head_of(start: Column, end: Column, depths: Column) -> Column:
    """Place of the token of a span that is nearest to the root; of equals the first."""
    at = F.transform(F.sequence(start, end - 1), lambda i: F.struct(F.get(depths, i).alias("d"), i.alias("i")))
    return F.array_min(at)["i"]


def sentence_key(words: Column, idf: Column, mids: Column, k: int = 2) -> Column:
    """Mids in order joined by _, then the ``k`` rarest words outside mentions in sentence order joined by #.

    ``idf`` is an array beside ``words``, null inside mentions.
    """
    w = F.filter(F.zip_with(F.sequence(F.lit(0), F.size(words) - 1), F.zip_with(words, idf, lambda a, b: F.struct(a.alias("w"), b.alias("idf"))), lambda i, p: F.struct((-p["idf"]).alias("r"), i.alias("i"), p["w"].alias("w"))), lambda x: x["r"].isNotNull())
    top = F.array_sort(F.transform(F.slice(F.array_sort(w), 1, k), lambda x: F.struct(x["i"], x["w"])))
    return F.concat_ws("#", F.array_join(mids, "_"), F.array_join(F.transform(top, lambda x: x["w"]), "#"))


QUOTES = ("''", "``", '"')


def target_head(tags: Column, start: Column, end: Column) -> Column:
    """Place of the head of a span by tags: quotes and signs around it are left out, also a relative pronoun at its end.

    Then of the rest the last noun before the first preposition, else the first verb, else the last token.
    """
    at = F.sequence(start, end - 1)
    outer = lambda i: F.get(tags, i).rlike(r"^[^A-Za-z]+$")
    inner = F.filter(at, lambda i: ~outer(i))
    last = F.element_at(inner, -1)
    inner = F.when((F.size(inner) > 1) & F.get(tags, last).isin("WP", "WDT"), F.slice(inner, 1, F.size(inner) - 1)).otherwise(inner)
    cut = F.get(F.filter(inner, lambda i: F.get(tags, i).isin("IN", "TO")), F.lit(0))
    front = F.filter(inner, lambda i: cut.isNull() | (i < cut))
    noun = F.try_element_at(F.filter(front, lambda i: F.get(tags, i).startswith("N")), F.lit(-1))
    verb = F.get(F.filter(inner, lambda i: F.get(tags, i).startswith("V")), F.lit(0))
    return F.coalesce(noun, verb, F.try_element_at(inner, F.lit(-1)), end - 1)
