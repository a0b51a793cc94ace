"""Line-oriented sources: facts, many-document files, CoNLL, linked sentences, RDF, VW, alphabets.

Readers take a DataFrame of lines (file, ord, value), as lines() gives, so that any
text source works. What depends on the order of lines is computed within a file.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACT = "cmd string, rel string, args array<string>, comment string, provenance string"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, value) of text files, compressed or not; ord rises with the line within a file."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value")
    return df


#: Low bits of ord that count within one split of a file, as lines() gives it.
SPLIT_BITS = 33


def by_split(df: DataFrame) -> tuple[DataFrame, Window]:
    """``df`` with the split of every line, and the order of lines within it; no task holds more than a split of a file."""
    return df.withColumn("_split", F.shiftright(F.col("ord").cast("long"), SPLIT_BITS)), Window.partitionBy("file", "_split").orderBy("ord")


def running(df: DataFrame, **values: Column) -> DataFrame:
    """Running sums over a file's lines: sums within splits, and those of the splits before from a table of one row a split."""
    own, w = by_split(df)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = own.groupBy("file", "_split").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "_split", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    for k, v in values.items():
        own = own.withColumn(k, F.sum(v).over(upto))
    own = own.join(sums, ["file", "_split"])
    for k in values:
        own = own.withColumn(k, F.col(k) + F.col(f"_{k}"))
    return own.drop("_split", *[f"_{k}" for k in values])


def last_before(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The last value that is not null up to each line of its file, carried over splits as running() does."""
    own, w = by_split(df)
    own = own.withColumn("_v", value).withColumn(name, F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = own.where("_v IS NOT NULL").groupBy("file", "_split").agg(F.max_by("_v", "ord").alias("_l"))
    every = own.select("file", "_split").distinct().join(lasts, ["file", "_split"], "left")
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("file", "_split", F.last("_l", ignorenulls=True).over(before).alias("_l"))
    return own.join(every, ["file", "_split"]).withColumn(name, F.coalesce(name, "_l")).drop("_split", "_v", "_l")


def without_comment(line: Column) -> Column:
    return F.trim(F.substring_index(line, "#", 1))


def comment(line: Column) -> Column:
    """What follows the first #, or null."""
    return F.when(line.contains("#"), F.trim(F.expr("substring(value, instr(value, '#') + 1)")))


def fact_lines(df: DataFrame, skip: Column | None = None) -> DataFrame:
    """``cmd rel arg ... # comment`` lines; blank ones go, ``skip`` is applied to the raw line."""
    df = df.where(~skip) if skip is not None else df
    tokens = F.filter(F.split(without_comment(F.col("value")), r"\s+"), lambda t: t != "")
    out = running(df.withColumn("tokens", tokens).where(F.size("tokens") > 0), _line=F.lit(1))
    return out.select(
        "file", "ord", F.col("tokens")[0].alias("cmd"), F.try_element_at("tokens", F.lit(2)).alias("rel"), F.expr("slice(tokens, 3, greatest(size(tokens) - 2, 0))").alias("args"),
        comment(F.col("value")).alias("comment"), F.concat(F.lit("line "), F.col("_line").cast("string"), F.lit(" of "), F.col("file")).alias("provenance"))


def many_docs(facts: DataFrame, dedup: bool = False) -> DataFrame:
    """Fact lines with the docid of the last ``startdoc`` line before them; lines before the first one have none.

    ``dedup`` keeps the first of equal lines in a document.
    """
    out = last_before(facts, "docid", F.when(F.col("cmd") == "startdoc", F.col("rel"))).where("cmd <> 'startdoc'")
    if dedup:
        first = Window.partitionBy("docid", "cmd", "rel", "args").orderBy("file", "ord")
        out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out


def documents_of(facts: DataFrame) -> DataFrame:
    """One row a document with its lines in order."""
    return facts.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("ord", "cmd", "rel", "args"))).alias("lines"))


KNOWN_COMMANDS = ("def", "schema", "x", "y", "startdoc")


def routed(facts: DataFrame) -> dict[str, DataFrame]:
    """Relations, permanent facts, observed facts and labels by command; an unknown command raises when it is met."""
    checked = facts.withColumn("cmd", F.when(F.col("cmd").isin(*KNOWN_COMMANDS), F.col("cmd")).otherwise(F.raise_error(F.concat(F.lit("unknown command "), F.col("cmd")))))
    pick = lambda c: checked.where(F.col("cmd") == c)
    types = F.transform("args", lambda a: F.regexp_replace(a, "[<>]", ""))
    return {
        "relations": pick("def").select(F.col("rel").alias("name"), types.alias("types")),
        "schema": pick("schema").withColumn("is_schema", F.lit(True)),
        "observed": pick("x"),
        "labels": pick("y"),
        "documents": pick("startdoc").select(F.col("rel").alias("docid")),
    }


def relation_frame(facts: DataFrame, rel: str, columns: list[str]) -> DataFrame:
    """The facts of one relation with named columns."""
    return facts.where(F.col("rel") == rel).select(*[F.col("args")[i].alias(c) for i, c in enumerate(columns)])


def sentences(df: DataFrame, fields: list[str], sep: str = r"\s+", doc_mark: str | None = None) -> DataFrame:
    """Column files with a blank line between sentences, and a mark between documents: one row a token.

    Columns: file, doc, sent, at (from 0), then ``fields``.
    """
    blank = F.trim("value") == ""
    mark = F.col("value").startswith(doc_mark) if doc_mark else F.lit(False)
    out = running(df, doc=mark.cast("int"), sent=(blank | mark).cast("int")).where(~blank & ~mark)
    out = out.withColumn("at", F.row_number().over(Window.partitionBy("file", "sent").orderBy("ord")) - 1)
    # gaps of several blank lines must not skip numbers
    numbers = out.select("file", "sent").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("sent")) - 1)
    out = out.join(numbers, ["file", "sent"]).withColumn("sent", F.col("_n")).drop("_n")
    parts = F.split(F.trim("value"), sep)
    return out.select("file", "doc", "sent", "at", *[F.try_element_at(parts, F.lit(i + 1)).alias(f) for i, f in enumerate(fields)])


def conll03(df: DataFrame) -> DataFrame:
    return sentences(df, ["word", "pos", "chunk", "ner"], doc_mark="-DOCSTART-")


CONLLX = ["id", "form", "lemma", "cpos", "pos", "feats", "head", "deprel", "phead", "pdeprel"]


def conllx(df: DataFrame) -> DataFrame:
    """Dependency rows; head counts from 0 and is -1 at the root."""
    out = sentences(df, CONLLX, sep="\t")
    return out.withColumn("head", F.expr("try_cast(head AS int)") - 1).withColumn("id", F.expr("try_cast(id AS int)") - 1)


def column_facts(tokens: DataFrame, columns: list[str]) -> DataFrame:
    """Facts (rel, args) = (column, [place, value]) of token rows."""
    pairs = ", ".join(f"'{c}', cast({c} AS string)" for c in columns)
    out = tokens.select("file", "sent", "at", F.expr(f"stack({len(columns)}, {pairs}) AS (rel, v)"))
    return out.select("file", "sent", "rel", F.array(F.col("at").cast("string"), "v").alias("args"))


LINK = r"\[FREEBASE mid=(/m/[0-9a-z_]+) ([^\]]+)\]"


def linked_sentences(df: DataFrame, most_tokens: int | None = 100) -> DataFrame:
    """Sentences with [FREEBASE mid=... text] spans: text without marks, links and token count.

    Lines with a mark that does not close, or longer than ``most_tokens`` (100 is the rule of
    this format; None takes all), are dropped.
    """
    mids, texts = F.regexp_extract_all("value", F.lit(LINK), F.lit(1)), F.regexp_extract_all("value", F.lit(LINK), F.lit(2))
    marks = F.size(F.split("value", r"\[FREEBASE")) - 1
    out = df.withColumn("mids", mids).withColumn("mentions", texts).where(F.size("mids") == marks)
    out = out.withColumn("text", F.regexp_replace("value", LINK, "$2"))
    before = F.transform(F.split("value", LINK), lambda p: F.length(p))
    # a mention starts after all text before it and all mentions before it
    start = lambda i: F.aggregate(F.slice(before, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("mentions", 1, i), F.lit(0), lambda a, x: a + F.length(x))
    link = F.transform("mids", lambda m, i: F.struct(m.alias("mid"), start(i).alias("start"), (start(i) + F.length(F.col("mentions")[i])).alias("end"), F.col("mentions")[i].alias("text")))
    out = out.withColumn("links", link).withColumn("n_tokens", F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")))
    out = out if most_tokens is None else out.where(F.col("n_tokens") <= most_tokens)
    return out.select("file", "ord", "text", "links", "n_tokens")


TRIPLE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*$"


def rdf_kind(token: Column) -> Column:
    """Kind of an RDF object: entity, integer, string or other."""
    return (
        F.when(token.startswith("<"), "entity").when(token.rlike(r'^"[+-]?\d+"\^\^<[^>]*[iI]nt(eger)?>$'), "integer").when(token.rlike(r'^".*"(@[\w-]+)?$'), "string").otherwise("other")
    )


def rdf_text(token: Column) -> Column:
    """The value without brackets, quotes, language and type."""
    return F.when(token.startswith("<"), F.regexp_replace(token, r"^<|>$", "")).when(token.startswith('"'), F.regexp_extract(token, r'^"(.*)"', 1)).otherwise(token)


def triples(df: DataFrame) -> DataFrame:
    """subj, verb, obj, kind and obj_long of .ttl lines; others are dropped."""
    part = lambda i: F.regexp_extract("value", TRIPLE, i)
    out = df.where(F.col("value").rlike(TRIPLE) & ~F.col("value").startswith("#"))
    obj = part(3)
    return out.select(
        rdf_text(part(1)).alias("subj"), rdf_text(part(2)).alias("verb"), rdf_text(obj).alias("obj"), rdf_kind(obj).alias("kind"),
        F.when(rdf_kind(obj) == "integer", rdf_text(obj)).cast("long").alias("obj_long"))


def skipped_share(df: DataFrame) -> DataFrame:
    """Share of lines that are not triples."""
    return df.agg(F.avg((~F.col("value").rlike(TRIPLE)).cast("double")).alias("skipped"))


def vw_lines(df: DataFrame) -> DataFrame:
    """``y |ns f f |ns ...``: y and an array of (name, feats)."""
    parts = F.split("value", r"\|")
    names = lambda p: F.filter(F.split(p, r"\s+"), lambda t: t != "")
    ns = F.transform(F.slice(parts, 2, 1000000), lambda p: F.struct(F.when(p.startswith(" "), F.lit("")).otherwise(F.substring_index(F.trim(p), " ", 1)).alias("name"), F.when(p.startswith(" "), names(p)).otherwise(F.slice(names(p), 2, 1000000)).alias("feats")))
    return df.select("file", "ord", F.expr("try_cast(trim(split(value, '[|]')[0]) AS double)").alias("y"), ns.alias("ns"))


def keep_namespaces(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("ns", F.filter("ns", lambda n: n["name"].isin(*names)))


def positional(*frames: DataFrame) -> DataFrame:
    """Rows of files zipped by line number, the files of a frame in the order of their names; a file that ends early raises.

    Columns get the frame's number as suffix.
    """
    numbered = []
    for i, f in enumerate(frames):
        files = f.select("file").distinct().withColumn("_file", F.row_number().over(Window.orderBy("file")))  # one row a file
        n = running(f, _line=F.lit(1)).join(files, "file")
        numbered.append(n.select("_file", "_line", *[F.col(c).alias(f"{c}_{i}") for c in f.columns]))
    out = numbered[0]
    for i, n in enumerate(numbered[1:], 1):
        out = out.join(n, ["_file", "_line"], "full_outer").withColumn(f"ord_{i}", F.coalesce(f"ord_{i}", F.raise_error(F.lit(f"file {i} is shorter")).cast("long")))
        out = out.withColumn("ord_0", F.coalesce("ord_0", F.raise_error(F.lit(f"file {i} is longer")).cast("long")))
    return out.drop("_file")


def vw_instances(locations: DataFrame, features: DataFrame, *scores: DataFrame) -> DataFrame:
    """Locations and features joined by place with the mean of the score files."""
    out = positional(locations, features, *scores)
    mean = sum((F.col(f"value_{i + 2}").cast("double") for i in range(len(scores))), F.lit(0.0)) / max(1, len(scores))
    return out.select("_line", F.col("value_0").alias("location"), F.col("value_1").alias("features"), mean.alias("score"))


def bialphabet(df: DataFrame) -> DataFrame:
    """newT, newF, strT, strF and, in six-column files, oldT, oldF (-1 if absent)."""
    c = F.split("value", "\t")
    num = lambda i: F.coalesce(F.expr(f"try_cast(try_element_at(split(value, '\t'), {i + 1}) AS int)"), F.lit(-1))
    return df.select(num(0).alias("newT"), num(1).alias("newF"), c[2].alias("strT"), c[3].alias("strF"), num(4).alias("oldT"), num(5).alias("oldF"))


def feature_file(df: DataFrame) -> DataFrame:
    """Five columns of metadata (target span in 2, argument span in 3), then template:feature pairs."""
    c = F.split("value", "\t")
    span = lambda s: F.struct(F.substring_index(s, "-", 1).cast("int").alias("start"), F.substring_index(s, "-", -1).cast("int").alias("end"))
    feats = F.transform(F.filter(F.slice(c, 6, 1000000), lambda p: p.contains(":")), lambda p: F.struct(F.substring_index(p, ":", 1).cast("int").alias("t"), F.substring_index(p, ":", -1).cast("int").alias("f")))
    return df.select("file", "ord", F.slice(c, 1, 5).alias("meta"), span(c[1]).alias("target"), span(c[2]).alias("arg"), feats.alias("feats"))


def sorted_features(df: DataFrame) -> DataFrame:
    return df.withColumn("feats", F.array_sort("feats"))


def feature_set_file(df: DataFrame) -> DataFrame:
    """Eight columns; the last one is a product of templates joined by *."""
    c = F.split("value", "\t")
    return df.where(F.size(c) >= 8).select(*[c[i].cast("double").alias(n) for i, n in enumerate(["score", "ig", "hx", "selectivity"])], c[4].cast("int").alias("arity"), F.split(c[7], r"\*").alias("templates"))


def document_frequencies(df: DataFrame) -> DataFrame:
    """term and df of files whose first line is the number of documents; files add up."""
    n = running(df, _n=F.lit(1))
    head = n.where("_n = 1").agg(F.sum(F.col("value").cast("long")).alias("n_docs"))
    c = F.split("value", "\t")
    body = n.where("_n > 1").groupBy(c[0].alias("term")).agg(F.sum(c[1].cast("long")).alias("df"))
    return body.crossJoin(F.broadcast(head))  # one row


def key_lists(df: DataFrame, key: int, value: int, sep: str = "\t", dedup: bool = False) -> DataFrame:
    """key -> values of a delimited file, in line order; ``dedup`` keeps the first of equal values."""
    c = F.split("value", sep)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("file", "ord", c[value].alias("v")))), lambda s: s["v"])
    out = df.groupBy(c[key].alias("k")).agg(ordered.alias("vs"))
    return out.withColumn("vs", F.array_distinct("vs")) if dedup else out


GIGAWORD = r"^([A-Za-z0-9]+)_([A-Za-z]+)_(\d{4})(\d{2})(\d{2})\.(\d+)$"


def gigaword_id(col: Column) -> Column:
    """source, language, year, month, day, index and date of ``SRC_LANG_YYYYMMDD.NNNN``; null fields if it isn't one."""
    hit = col.rlike(GIGAWORD)
    part = lambda i: F.when(hit, F.regexp_extract(col, GIGAWORD, i))
    year, month, day = (part(i).cast("int") for i in (3, 4, 5))
    ok = hit & month.between(1, 12) & day.between(1, 31)
    return F.struct(part(1).alias("source"), part(2).alias("lang"), year.alias("year"), month.alias("month"), day.alias("day"), part(6).cast("int").alias("index"), F.when(ok, F.to_date(F.concat_ws("-", part(3), part(4), part(5)))).alias("date"))


def same_time(a: Column, b: Column, unit: str) -> Column:
    """Whether two ids agree in year, in month (and so year) or in day (and so month); false for null."""
    parts = ["year", "month", "day"][: ["year", "month", "day"].index(unit) + 1]
    out = F.lit(True)
    for p in parts:
        out &= a[p] == b[p]
    return F.coalesce(out, F.lit(False))


def same_field(a: Column, b: Column, name: str) -> Column:
    return F.coalesce(a[name] == b[name], F.lit(False))


#: Id prefixes of the named profiles; full takes all.
PROFILES = {"tiny": ("NYT_ENG_200909",), "small": ("NYT_ENG_2007",), "medium": ("APW_ENG_2",), "full": ()}


def in_profile(col: Column, profile: str) -> Column:
    """Ids in a profile, as ranges, so that files and row groups can be skipped; ids are in capitals."""
    out = F.lit(not PROFILES[profile])
    for p in PROFILES[profile]:
        out |= (col >= p) & (col < p[:-1] + chr(ord(p[-1]) + 1))
    return out


def between_ids(col: Column, low: str | None = None, high: str | None = None) -> Column:
    out = F.lit(True)
    if low is not None:
        out &= col >= low
    if high is not None:
        out &= col < high
    return out


def open_source(spark: SparkSession, uri: str) -> DataFrame:
    """Documents by scheme: ``parquet:``, ``text:``, ``json:``, ``xml:TAG:``, or ``table:`` and a place."""
    kind, _, place = uri.partition(":")
    if kind == "xml":
        tag, _, place = place.partition(":")
        return spark.read.format("xml").option("rowTag", tag).load(place)
    if kind == "table":
        return spark.table(place)
    if kind == "text":
        return lines(spark, place)
    if kind in ("parquet", "json", "orc", "csv"):
        return spark.read.format(kind).load(place)
    raise ValueError(f"unknown source {uri}")


def frames_xml(spark: SparkSession, path: str) -> DataFrame:
    """Frame name and its element names from frame files."""
    df = spark.read.format("xml").option("rowTag", "frame").option("attributePrefix", "").load(path)
    return df.select("name", F.expr("transform(FE, x -> x.name)").alias("roles"))


def flattened_tokens(df: DataFrame, sections: str = "sections", most: int | None = 1000) -> DataFrame:
    """doc, section, sentence and tokens of nested documents; longer sentences are dropped, none for ``most`` None."""
    out = df.select("doc", F.posexplode(sections).alias("section", "s")).select("doc", "section", F.posexplode("s").alias("sentence", "tokens"))
    return out if most is None else out.where(F.size("tokens") <= most)


def memoised(requests: DataFrame, memo: DataFrame, fetch, key: str) -> DataFrame:
    """Answers by ``key``: those in ``memo``, and ``fetch(missing)`` for the rest."""
    known = memo.join(requests.select(key).distinct(), key, "left_semi")
    missing = requests.select(key).distinct().join(memo, key, "left_anti")
    return known.unionByName(fetch(missing))


def substituted(df: DataFrame, pattern: str, replacement: str, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, pattern, replacement))


def full_text(spark: SparkSession, path: str) -> DataFrame:
    """sentence, frame, label, start and end (exclusive) of frame-annotated XML: one row a label of a layer of an annotation set.

    Sentences hold a text and annotation sets with a frame name; their layers hold labels with first and last characters.
    """
    df = spark.read.format("xml").option("rowTag", "sentence").option("attributePrefix", "").schema(
        "ID string, text string, annotationSet array<struct<frameName:string,layer:array<struct<name:string,label:array<struct<name:string,start:int,end:int>>>>>>").load(path)
    sets = df.select(F.col("ID").alias("id"), "text", F.explode("annotationSet").alias("a")).where("a.frameName IS NOT NULL")
    layers = sets.select("id", "text", F.col("a.frameName").alias("frame"), F.explode("a.layer").alias("l"))
    labels = layers.select("id", "text", "frame", F.col("l.name").alias("layer"), F.explode("l.label").alias("b")).where("b.start IS NOT NULL")
    return labels.select("id", "frame", "layer", F.col("b.name").alias("label"), F.col("b.start").alias("start"), (F.col("b.end") + 1).alias("end"), F.expr("substring(text, b.start + 1, b.end - b.start + 1)").alias("text"))


PROP = r"^(\d+):(\d+)"


def proposition_lines(df: DataFrame) -> DataFrame:
    """Predicate-argument lines: tree file, tree, terminal, tagger, lemma, sense, inflection, then terminal:height-label.

    Gives file, tree, terminal, lemma, sense and arguments (terminal, height, label); of a chain of places the first one counts.
    """
    c = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    arg = lambda a: F.struct(F.regexp_extract(a, PROP, 1).cast("int").alias("terminal"), F.regexp_extract(a, PROP, 2).cast("int").alias("height"), F.regexp_extract(a, r"^[^-]*-(.*)$", 1).alias("label"))
    args = F.transform(F.filter(F.slice(c, 8, 1_000_000), lambda a: a.rlike(PROP)), arg)
    out = df.where(F.size(c) >= 7)
    return out.select(c[0].alias("tree_file"), c[1].cast("int").alias("tree"), c[2].cast("int").alias("terminal"), F.regexp_replace(c[4], "-[a-z]$", "").alias("lemma"), c[5].alias("sense"), args.alias("args"))


def archive_members(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, name and data of the files in .tar, .tar.gz or .tgz archives, as binaryFile reads them.

    An archive is read member by member; what the members hold is for a decoder of the caller's.
    """

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append((p, m.name, tar.extractfile(m).read()))
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["path", "name", "data"])

    return archives.select(path, content).mapInArrow(run, "path string, name string, data binary")


def open_archives(spark: SparkSession, place: str) -> DataFrame:
    """The members of all archives under a place."""
    return archive_members(spark.read.format("binaryFile").load(place))


def fetched(ids: DataFrame, key: str, client: Callable[[], Callable[[list], list]], schema: str, batch: int = 256) -> DataFrame:
    """Rows that a service gives for the ids, asked ``batch`` at a time; ``client`` makes a connection in each task.

    The connection takes a list of ids and gives a list of tuples of ``schema``.
    """

    def run(batches):
        ask = client()
        for b in batches:
            own = b.column(0).to_pylist()
            for i in range(0, len(own), batch):
                yield pd.DataFrame(ask(own[i : i + batch]), columns=names).pipe(pa.RecordBatch.from_pandas, preserve_index=False)

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return ids.select(key).mapInArrow(run, schema)
