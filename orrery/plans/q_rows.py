"""One query for each operator that no other query shows: sources, sinks, filters, joins, evaluation, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infogain as ig
from ..functions import scores, sketch, text, vectors
from ..functions import templates as tp
from ..operators import decide, evaluate, extras, facts, retrieval, sample
from ..sources import sinks
from ..sources import text as src
from .lineage import scratch_path
from .q_stats import BUCKET
from .registry import query
from .rules import infer_types, join_orders, parse_rule, parse_rules, type_graph_dot

S = F.col


def as_lines(df, file, order, value):
    return df.select(F.lit(file).alias("file") if isinstance(file, str) else file.cast("string").alias("file"), order.cast("long").alias("ord"), value.alias("value"))


# sources

@query("""SELECT 'documents' AS what, count(*) AS n FROM orders UNION ALL SELECT 'labels', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'observed', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'schema', count(*) FROM nation UNION ALL SELECT 'relations', 1""")
def command_loader(t):
    """Lines of all commands, routed to relations, permanent facts, observed facts, labels and documents."""
    k = S("o_orderkey").cast("string")
    fact = F.concat(F.when(S("o_orderstatus") == "F", "y").otherwise("x"), F.lit(" status "), k, F.lit(" "), S("o_orderstatus"))
    lines = as_lines(t.orders, "f", 2 * S("o_orderkey"), F.concat(F.lit("startdoc d"), k)).unionByName(as_lines(t.orders, "f", 2 * S("o_orderkey") + 1, fact))
    lines = lines.unionByName(as_lines(t.nation, "f", -S("n_nationkey") - 1, F.concat(F.lit("schema nation "), S("n_nationkey").cast("string"))))
    lines = lines.unionByName(t.spark.createDataFrame([("f", -100, "def status <order> <letter> # two arguments")], "file string, ord long, value string"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in src.routed(src.fact_lines(lines)).items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


TURN_WORDS = r"list_filter(string_split_regex(text, '[ \t\n\r\x0b\f]+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT conv_id, turn, role, {TURN_WORDS} AS ws FROM conversations), x AS (SELECT conv_id, turn, role, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
s AS (SELECT DISTINCT conv_id, turn FROM x), n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sent FROM s)
SELECT x.conv_id, sent::INT AS sent, pos::INT AS "at", word, role AS ner FROM x JOIN n ON n.conv_id = x.conv_id AND n.turn = x.turn""")
def conll03_scan(t):
    """Turns as sentences of a column file a conversation, with document and sentence breaks."""
    words = F.filter(F.split("text", r"[ \t\n\r\x0B\f]+"), lambda w: w != "")
    body = t.conversations.select("conv_id", "turn", "role", F.posexplode(words).alias("at", "w"))
    lines = as_lines(body, S("conv_id"), S("turn") * 1_000_000 + S("at") + 1, F.concat_ws(" ", "w", F.lit("X"), F.lit("O"), "role"))
    blank = as_lines(t.conversations, S("conv_id"), S("turn") * 1_000_000, F.lit(""))
    head = as_lines(t.conversations.select("conv_id").distinct(), S("conv_id"), F.lit(-1), F.lit("-DOCSTART- -X- O O"))
    out = src.conll03(lines.unionByName(blank).unionByName(head))
    return out.select(S("file").cast(t.conversations.schema["conv_id"].dataType).alias("conv_id"), S("sent").cast("int").alias("sent"), S("at").cast("int").alias("at"), "word", "ner")


LINES_OF = "SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, max(l_quantity)::INT AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2"


def lines_of(t):
    return t.lineitem.groupBy(S("l_orderkey").alias("k"), S("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.max("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"))


@query(f"""SELECT k, (row_number() OVER (PARTITION BY k ORDER BY n) - 1)::INT AS "at", 'w' || p AS form, f AS pos, (n - 2)::INT AS head, 'd' || q AS deprel FROM ({LINES_OF})""")
def conllx_scan(t):
    """Orders as dependency files: ten columns, heads from 1."""
    n = S("n").cast("string")
    row = F.concat_ws("\t", n, F.concat(F.lit("w"), "p"), F.lit("_"), F.lit("_"), "f", F.lit("_"), (S("n") - 1).cast("string"), F.concat(F.lit("d"), "q"), F.lit("_"), F.lit("_"))
    out = src.conllx(as_lines(lines_of(t), S("k"), S("n"), row))
    return out.select(S("file").cast("long").alias("k"), S("at").cast("int").alias("at"), "form", "pos", "head", "deprel")


@query("""SELECT c_custkey, '/m/' || lower(hex(c_custkey)) AS mid, 3 AS "start", 3 + length(c_name) AS "end", c_name AS mention, 'at ' || c_name || ' and Bob' AS text FROM customer WHERE c_custkey % 2 = 0""")
def linked_sentence_scan(t):
    """Marked sentences; those whose mark does not close are dropped."""
    mid = F.concat(F.lit("/m/"), F.lower(F.hex("c_custkey")))
    mark = F.concat(F.lit("at [FREEBASE mid="), mid, F.lit(" "), S("c_name"), F.when(S("c_custkey") % 2 == 0, "]").otherwise(""), F.lit(" and Bob"))
    out = src.linked_sentences(as_lines(t.customer, "f", S("c_custkey"), mark))
    return out.select(S("ord").alias("c_custkey"), F.explode("links").alias("x"), "text").select("c_custkey", "x.mid", "x.start", "x.end", S("x.text").alias("mention"), "text")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS line, 'loc' || p_partkey AS location, p_brand AS features, round((p_size + p_retailprice) / 2, 4) AS score FROM part""")
def vw_instances(t):
    """Locations, features and two score files zipped by line."""
    f = lambda name, v: as_lines(t.part, name, S("p_partkey"), v)
    out = src.vw_instances(f("a", F.concat(F.lit("loc"), S("p_partkey").cast("string"))), f("b", S("p_brand")), f("c", S("p_size").cast("string")), f("d", S("p_retailprice").cast("string")))
    return out.select(S("_line").cast("long").alias("line"), "location", "features", F.round("score", 4).alias("score"))


@query("""SELECT p_partkey::INT AS "newT", p_size AS "newF", p_brand AS "strT", p_type AS "strF", CASE WHEN p_partkey % 2 = 0 THEN p_partkey::INT ELSE -1 END AS "oldT", CASE WHEN p_partkey % 2 = 0 THEN 7 ELSE -1 END AS "oldF" FROM part""")
def bialphabet_scan(t):
    k = S("p_partkey").cast("string")
    four = F.concat_ws("\t", k, S("p_size").cast("string"), "p_brand", "p_type")
    return src.bialphabet(as_lines(t.part, "f", S("p_partkey"), F.when(S("p_partkey") % 2 == 0, F.concat_ws("\t", four, k, F.lit("7"))).otherwise(four)))


FEATURES = f"SELECT k, n, f AS x, p % 50 AS a, q % 50 AS b FROM ({LINES_OF})"


def feature_lines(t):
    v = lambda c: (S(c) % 50).cast("string")
    value = F.concat_ws("\t", S("k").cast("string"), F.concat(S("n").cast("string"), F.lit("-"), (S("n") + 1).cast("string")), F.lit("0-2"), "f", F.lit("m"), F.concat(F.lit("9:"), v("p")), F.concat(F.lit("2:"), v("q")))
    return as_lines(lines_of(t), S("k"), S("n"), value)


@query(f"""SELECT k, n AS "start", n + 1 AS "end", 2 AS arg_end, x AS meta, a AS first_feature, b AS second_feature FROM ({FEATURES})""")
def feature_file_scan(t):
    x = src.feature_file(feature_lines(t))
    return x.select(S("file").cast("long").alias("k"), S("target.start").alias("start"), S("target.end").alias("end"), S("arg.end").alias("arg_end"), S("meta")[3].alias("meta"), S("feats")[0]["f"].cast("long").alias("first_feature"), S("feats")[1]["f"].cast("int").alias("second_feature"))


@query(f"""SELECT k, n, 2 AS t, b AS f FROM ({FEATURES}) WHERE k % 4 = 1""")
def feature_file_shard(t):
    """One shard of a feature file, its features sorted by template."""
    x = src.sorted_features(src.feature_file(feature_lines(t))).withColumn("k", S("file").cast("long"))
    return sample.sharded(x, S("k"), 4, 1, hashed=S("k")).select("k", S("ord").cast("int").alias("n"), S("feats")[0]["t"].alias("t"), S("feats")[0]["f"].alias("f"))


def stored(t, df, name):
    """A folder of XML documents, one for each value of ``part`` with the values of its rows under one root."""
    path = scratch_path(t.spark, name)
    roots = df.groupBy("part").agg(F.concat(F.lit("<all>"), F.array_join(F.collect_list("value"), ""), F.lit("</all>")).alias("value"))
    roots.repartition("part").write.partitionBy("part").text(path)
    return path


@query("""SELECT p_brand AS name, list_sort(list(DISTINCT p_size::VARCHAR)) AS roles FROM part GROUP BY 1""")
def frame_xml_scan(t):
    """Brands as frames, sizes as their elements."""
    fe = F.array_join(F.transform(F.array_sort(F.collect_set(S("p_size").cast("string"))), lambda s: F.concat(F.lit('<FE name="'), s, F.lit('"/>'))), "")
    x = t.part.groupBy("p_brand").agg(fe.alias("fe")).select(S("p_brand").alias("part"), F.concat(F.lit('<frame name="'), "p_brand", F.lit('">'), "fe", F.lit("</frame>")).alias("value"))
    out = src.frames_xml(t.spark, stored(t, x, "frames"))
    return out.select("name", F.array_sort(F.transform("roles", lambda r: r.cast("string"))).alias("roles"))


@query("""SELECT s_suppkey::VARCHAR AS id, 'Trade' AS frame, 'FE' AS layer, 'Seller' AS label, 0 AS "start", length(s_name) AS "end", s_name AS text FROM supplier""")
def full_text_scan(t):
    """Frame-annotated sentences: the seller is marked in each."""
    last = (F.length("s_name") - 1).cast("string")
    row = F.concat(F.lit('<sentence ID="'), S("s_suppkey").cast("string"), F.lit('"><text>'), "s_name", F.lit(' sells</text><annotationSet><layer name="PENN"><label name="x" start="0" end="1"/></layer></annotationSet><annotationSet frameName="Trade"><layer name="FE"><label name="Seller" start="0" end="'), last, F.lit('"/></layer><layer name="Target"/></annotationSet></sentence>'))
    return src.full_text(t.spark, stored(t, t.supplier.select(S("s_nationkey").alias("part"), row.alias("value")), "fulltext")).where("layer = 'FE'")


@query(f"""SELECT k::INT AS tree, n AS terminal, 'verb' || f AS lemma, 'verb' || f || '.01' AS sense, 'ARG0' AS label, q AS place FROM ({LINES_OF})""")
def proposition_scan(t):
    """Predicate-argument lines: every order line is a verb with one argument; its verb itself has no place in a chain."""
    lemma = F.concat(F.lit("verb"), "f")
    row = F.concat_ws(" ", F.lit("nw/a.parse"), S("k").cast("string"), S("n").cast("string"), F.lit("gold"), F.concat(lemma, F.lit("-v")), F.concat(lemma, F.lit(".01")), F.lit("-----"), F.concat(S("q").cast("string"), F.lit(":0*9:1-ARG0")), F.concat(S("n").cast("string"), F.lit(":0-rel")))
    out = src.proposition_lines(as_lines(lines_of(t), S("k"), S("n"), row))
    return out.select("tree", "terminal", "lemma", "sense", S("args")[0]["label"].alias("label"), S("args")[0]["terminal"].alias("place"))


@query("""SELECT 'n' || n_nationkey AS doc, (c_custkey)::INT AS token, 1 AS sentence, c_name AS text FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def ecb_scan(t):
    """Nations as documents of tokens, whose ids count from 1."""
    tok = F.concat(F.lit('<token t_id="'), (S("c_custkey") + 1).cast("string"), F.lit('" sentence="1">'), "c_name", F.lit("</token>"))
    body = t.customer.groupBy("c_nationkey").agg(F.array_join(F.collect_list(tok), "").alias("body"))
    x = body.select(S("c_nationkey").alias("part"), F.concat(F.lit('<Document doc_name="n'), S("c_nationkey").cast("string"), F.lit('">'), "body", F.lit("</Document>")).alias("value"))
    return extras.ecb_tokens(t.spark, stored(t, x, "ecb"))


@query("SELECT source AS archive, doc_id::VARCHAR AS name, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def archive_scan(t):
    """Documents packed into one compressed archive a source, read member by member."""

    def pack(pdf):
        import io
        import tarfile

        import pandas as pd

        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
            for i, x in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw, info = x.encode(), tarfile.TarInfo(str(i))
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
        return pd.DataFrame({"path": [pdf["source"].iloc[0]], "content": [buffer.getvalue()]})

    archives = t.documents.where("text IS NOT NULL").select("source", "doc_id", "text").groupBy("source").applyInPandas(pack, "path string, content binary")
    return src.archive_members(archives).select(S("path").alias("archive"), "name", F.md5("data").alias("digest"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1000")
def table_scan(t):
    """A stored table by scheme and place, cut to a range of ids."""
    x = src.open_source(t.spark, f"parquet:{t.sf_dir}/orders.parquet")
    return x.where(src.between_ids(S("o_orderkey"), 100, 1000)).select("o_orderkey", "o_orderstatus")


def shouting():
    """A stand-in for a connection: answers ids with rows."""
    return lambda ids: [(i, f"doc {i}", i % 7) for i in ids]


@query("SELECT doc_id, 'doc ' || doc_id AS body, doc_id % 7 AS kind FROM documents")
def fetch_service(t):
    """Documents asked of a service in batches of ids."""
    return src.fetched(t.documents, "doc_id", shouting, "doc_id long, body string, kind long", batch=50)


@query("SELECT doc_id, 'doc ' || doc_id AS body FROM documents WHERE lang = 'en'")
def profile_scan(t):
    """Documents of a data profile, asked of a service."""
    gid = F.concat(F.when(S("lang") == "en", "APW_ENG_2009").otherwise("NYT_ENG_2009"), F.lit("0101.0001"))
    return src.fetched(t.documents.where(src.in_profile(gid, "medium")), "doc_id", shouting, "doc_id long, body string, kind long").select("doc_id", "body")


@query("SELECT doc, section, sentence, n FROM (SELECT conv_id AS doc, 0 AS section, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text)::INT - 1 AS sentence, len(string_split(text, ' ')) AS n FROM conversations) WHERE n <= 40")
def token_flattening(t):
    """Sections of sentences of tokens; sentences of more than 40 are left out."""
    sents = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.split(s["text"], " "))
    nested = t.conversations.groupBy(S("conv_id").alias("doc")).agg(F.array(sents).alias("sections"))
    return src.flattened_tokens(nested, most=40).select("doc", "section", "sentence", F.size("tokens").cast("long").alias("n"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS value FROM pages")
def substituted_input(t):
    return src.substituted(t.pages.select("page_id", S("html").alias("value")), "<[^>]*>", " ")


@query("SELECT c_custkey, upper(c_mktsegment) AS value FROM customer")
def piped_input(t):
    """Lines through an external program; the key travels in the line."""
    line = t.customer.select(F.concat(S("c_custkey").cast("string"), F.lit("\t"), "c_mktsegment").alias("value"))
    out = extras.piped(line, ["tr", "a-z", "A-Z"])
    return out.select(F.substring_index("value", "\t", 1).cast("long").alias("c_custkey"), F.substring_index("value", "\t", -1).alias("value"))


# sinks

def order_facts(t):
    return t.orders.select(F.lit("x").alias("cmd"), F.when(S("o_orderstatus") == "F", "done").otherwise("open").alias("rel"), F.array(S("o_orderkey").cast("string"), "o_orderstatus").alias("args"))


@query("SELECT 'yhat open ' || o_orderkey || ' ' || o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'F'")
def state_dump(t):
    return sinks.state_dump(order_facts(t), skip=["done"])


@query("SELECT lang AS part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE lang <> 'de' GROUP BY 1")
def partition_writer(t):
    """Documents in folders by language, read again; one language is dropped."""
    path = scratch_path(t.spark, "parts")
    sinks.write_partitions(t.documents, F.when(S("lang") != "de", S("lang")), path)
    return t.spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def small_index(t):
    m = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tok"), S("l_orderkey").alias("comm"), F.array(F.concat(F.lit("pi:"), S("l_suppkey") % 10), F.concat(F.lit("pb:"), "l_returnflag")).alias("feats"))
    w = t.lineitem.select(S("l_orderkey").alias("comm"), "l_returnflag").groupBy("comm", S("l_returnflag").alias("word")).agg(F.count("*").alias("cnt"))
    return retrieval.build_index(m, w, w.groupBy("word").agg((1.0 / F.count("*")).alias("idf")))


INDEX_SIZES = """SELECT 'c2w' AS name, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) UNION ALL SELECT 't2c', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
UNION ALL SELECT 'f2t', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, unnest(['pi:' || l_suppkey % 10, 'pb:' || l_returnflag]) AS f FROM lineitem)"""


def sizes(tables):
    out = None
    for name, df in sorted(tables.items()):
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(INDEX_SIZES)
def index_writer(t):
    """Posting tables written and read again."""
    path = scratch_path(t.spark, "index")
    tables = small_index(t)
    sinks.write_index(tables, path)
    return sizes({k: t.spark.read.parquet(f"{path}/{k}") for k in tables})


@query(f"SELECT name, 2 * n AS n FROM ({INDEX_SIZES})")
def index_append(t):
    """The same tables appended twice: appending removes no duplicates."""
    path = scratch_path(t.spark, "index")
    tables = small_index(t)
    for _ in range(2):
        sinks.write_index(tables, path)
    return sizes({k: t.spark.read.parquet(f"{path}/{k}") for k in tables})


@query("""SELECT l_orderkey AS comm, l_returnflag AS word, least(count(*), 127)::INT AS cnt FROM lineitem GROUP BY 1, 2""")
def index_rows(t):
    """Rows of a document: its best words, with counts that fit a byte."""
    return small_index(t)["c2w"].select("comm", "word", S("cnt").cast("int").alias("cnt"))


def through_tsv(t, df, schema):
    path = scratch_path(t.spark, "tsv")
    sinks.write_tsv(df, path)
    return t.spark.read.option("sep", "\t").schema(schema).csv(path)


@query("""SELECT l_orderkey || '-' || l_linenumber AS tok, l_orderkey::VARCHAR AS comm, 'pb:' || l_returnflag AS feat FROM lineitem""")
def feature_tsv(t):
    x = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("tok"), S("l_orderkey").cast("string").alias("comm"), F.concat(F.lit("pb:"), "l_returnflag").alias("feat"))
    return through_tsv(t, x, "tok string, comm string, feat string")


@query(f"""SELECT a.k AS comm, a.n AS i, b.n AS j, a.f || '>' || b.f AS path, a.p AS head_i, b.p AS head_j FROM ({LINES_OF}) a JOIN ({LINES_OF}) b ON a.k = b.k AND a.n < b.n""")
def deprel_tsv(t):
    """A row for every pair of mentions of a sentence."""
    pairs = facts.mention_pairs(lines_of(t).select("k", "n", "p", "f"), "k", "n", 1 << 30)
    x = pairs.select(S("k").alias("comm"), "i", "j", F.concat("f_i", F.lit(">"), "f_j").alias("path"), S("p_i").alias("head_i"), S("p_j").alias("head_j"))
    return through_tsv(t, x, "comm long, i int, j int, path string, head_i long, head_j long")


@query("""SELECT conv_id, turn, role AS frame, length(text)::INT AS size FROM conversations""")
def frame_tsv(t):
    x = t.conversations.select("conv_id", "turn", S("role").alias("frame"), F.length("text").alias("size"))
    return through_tsv(t, x, x.schema)


@query("SELECT DISTINCT p_type AS term, true AS found FROM part")
def hash_log(t):
    """Every term is found again by its hash."""
    log = sinks.hash_log(t.part.select(S("p_type").alias("term")))
    back = t.part.select(S("p_type").alias("term")).distinct().withColumn("hash", F.hash("term")).join(log.withColumnRenamed("term", "named"), "hash")
    return back.groupBy("term").agg(F.bool_or(S("named") == S("term")).alias("found"))


@query("SELECT event_id, '1.0 |a ' || event_type || ' |b u' || user_id || ' all' AS value FROM events")
def vw_writer(t):
    ns = F.array(F.struct(F.lit("a").alias("name"), F.array("event_type").alias("feats")), F.struct(F.lit("b").alias("name"), F.array(F.concat(F.lit("u"), S("user_id").cast("string")), F.lit("all")).alias("feats")))
    x = t.events.select("event_id", F.lit(1.0).alias("y"), ns.alias("ns"))
    back = src.vw_lines(as_lines(sinks.vw_text(x), "f", F.lit(0), S("value")))
    rows = sinks.vw_text(back).select("value", F.regexp_extract("value", r"\|b u(\S+)", 1).cast("long").alias("user_id"), F.regexp_extract("value", r"\|a (\S+)", 1).alias("event_type")).distinct()
    return t.events.select("event_id", "user_id", "event_type").join(rows, ["user_id", "event_type"]).select("event_id", "value")


@query("SELECT c_custkey, 'say \"' || c_name || '\", please' AS question FROM customer")
def task_csv(t):
    """Crowd tasks as CSV, with quotes and commas in their texts."""
    path = scratch_path(t.spark, "tasks")
    x = t.customer.select("c_custkey", F.concat(F.lit('say "'), "c_name", F.lit('", please')).alias("question"))
    x.write.option("escape", '"').csv(path)
    return t.spark.read.schema(x.schema).option("escape", '"').csv(path)


@query("SELECT l_returnflag AS rel, 's' || l_suppkey AS feature, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2")
def weight_store(t):
    """Weights by relation, saved and loaded."""
    path = scratch_path(t.spark, "weights")
    w = t.lineitem.groupBy(S("l_returnflag").alias("rel"), F.concat(F.lit("s"), "l_suppkey").alias("feature")).agg(F.count("*").cast("double").alias("weight"))
    sinks.write_weights(w, path)
    return t.spark.read.parquet(path).select("rel", "feature", "weight")


RULES = "word(i, w) & pos(i, p) => tagged(w, p)\ntagged'(t, w, p) => seen(t)"
TYPES = {"word": ("tok", "string"), "pos": ("tok", "tag")}


@query("""SELECT line FROM (VALUES ('digraph types {'), ('  "pos" -> "tok" [label=0];'), ('  "pos" -> "tag" [label=1];'), ('  "seen" -> "witness-tagged" [label=0];'), ('  "tagged" -> "string" [label=0];'), ('  "tagged" -> "tag" [label=1];'), ('  "word" -> "tok" [label=0];'), ('  "word" -> "string" [label=1];'), ('}')) v(line)""")
def type_graph(t):
    dot = type_graph_dot(infer_types(parse_rules(RULES), TYPES))
    return t.spark.createDataFrame([(x,) for x in dot.strip().split("\n")], "line string")


@query("""SELECT rel, "at", kind FROM (VALUES ('pos', 0, 'tok'), ('pos', 1, 'tag'), ('seen', 0, 'witness-tagged'), ('tagged', 0, 'string'), ('tagged', 1, 'tag'), ('word', 0, 'tok'), ('word', 1, 'string')) v(rel, "at", kind)""")
def type_inference(t):
    """Types spread over shared variables and a fact's own name."""
    found = infer_types(parse_rules(RULES), TYPES)
    return t.spark.createDataFrame([(r, i, k) for r, ks in found.items() for i, k in enumerate(ks)], "rel string, at int, kind string")


@query("""SELECT "start", terms FROM (VALUES (0, 'a,b,c,d'), (1, 'b,a,c,d'), (2, 'c,b,a,d'), (3, 'd,a,b,c')) v("start", terms)""")
def rule_orders(t):
    """Every term may start; the next one shares a variable if any does, and the free term comes when none is left."""
    rule = parse_rule("a(x, y) & b(y, z) & c(z, w) & d(v) => e(x, v)")
    return t.spark.createDataFrame([(o[0], ",".join(rule.body[i].name for i in o)) for o in join_orders(rule)], "start int, terms string")


@query("""SELECT "at", name, args, witness FROM (VALUES (0, 'tagged', 'w,p', 't'), (1, 'limit', 'p,3,''x''', NULL), (2, 'seen', 't,w', NULL)) v("at", name, args, witness)""")
def rule_parse(t):
    rule = parse_rule("tagged'(t, w, p) & limit(p, 3, 'x') => seen(t, w)")
    return t.spark.createDataFrame([(i, x.name, ",".join(x.args), x.witness) for i, x in enumerate([*rule.body, rule.head])], "at int, name string, args string, witness string")


# filters and joins

@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS rel, count(*) AS n FROM orders GROUP BY 1")
def relation_rename(t):
    return facts.renamed(order_facts(t), {"done": "closed"}).groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT 'open' AS rel, count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
def relation_drop(t):
    return facts.kept_relations(order_facts(t), exclude=["done"]).groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT p_brand AS \"strT\", p_type AS \"strF\" FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')")
def template_filter(t):
    x = tp.alphabet(t.part.select(S("p_brand").alias("template"), S("p_type").alias("x"))).select(S("template").alias("strT"), S("x").alias("strF"))
    return tp.templates_in(x, ["Brand#11", "Brand#23"])


@query("""WITH c AS (SELECT event_type, round(value) AS v, count(*) OVER (PARTITION BY event_type, round(value)) AS n, event_id FROM events) SELECT event_id FROM c WHERE n >= 3""")
def oddness_prune(t):
    """Statistics seen fewer than three times are dropped."""
    x = t.events.withColumn("key", F.concat_ws("|", "event_type", F.round("value").cast("string")))
    return facts.frequent(x, "key", 3).select("event_id")


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 IN (1, 2) AND c_custkey % 5 <> 0""")
def entity_mention_filter(t):
    """Mentions of one type that is not O, without tabs."""
    k = S("c_custkey")
    types = F.when(k % 4 == 0, F.array(F.lit("O"))).when(k % 4 == 1, F.array(F.lit("PER"))).when(k % 4 == 2, F.array(F.lit("ORG"), F.lit("ORG"))).otherwise(F.array(F.lit("PER"), F.lit("ORG")))
    mention = F.when(k % 5 == 0, F.concat("c_name", F.lit("\t"))).otherwise(S("c_name"))
    return extras.entity_mentions(t.customer.select(k.alias("id"), types.alias("types"), mention.alias("mention"))).select("id")


@query("""SELECT feat, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'pi:the' WHEN 2 THEN 'h:a' WHEN 3 THEN 'pb:BBBB_the' WHEN 4 THEN 'pi:0000' ELSE 'pi:' || l_returnflag || l_linestatus END AS feat FROM lineitem) WHERE feat NOT IN ('pi:the', 'h:a', 'pb:BBBB_the', 'pi:0000') GROUP BY 1""")
def stop_feature_filter(t):
    n = S("l_linenumber")
    feat = F.when(n == 1, "pi:the").when(n == 2, "h:a").when(n == 3, "pb:BBBB_the").when(n == 4, "pi:0000").otherwise(F.concat(F.lit("pi:"), "l_returnflag", "l_linestatus"))
    return extras.searchable(t.lineitem.select(feat.alias("feat"))).groupBy("feat").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'")
def role_suffix_filter(t):
    role = F.concat(F.lit("ARG0"), F.when(S("l_returnflag") == "R", "/C").when(S("l_returnflag") == "A", "/R").otherwise(""))
    return facts.without_role_suffix(t.lineitem, role).select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey AS mid, s_name AS dbp FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def relevant_links(t):
    return retrieval.relevant_links(t.supplier.select(S("s_suppkey").alias("mid"), S("s_name").alias("dbp")), t.lineitem.where("l_quantity > 49").select(S("l_suppkey").alias("mid")))


@query("""SELECT o_orderkey, o_orderstatus AS label, round(o_totalprice, 4) AS score, n AS places FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def instance_triples(t):
    """Labels, scores and locations of instances, joined to their sentences."""
    f = lambda name, v: as_lines(t.orders, name, S("o_orderkey"), v)
    x = src.positional(f("a", S("o_orderkey").cast("string")), f("b", S("o_orderstatus")), f("c", S("o_totalprice").cast("string")))
    own = x.select(S("value_0").cast("long").alias("sent"), S("value_1").alias("label"), F.round(S("value_2").cast("double"), 4).alias("score"))
    merged = extras.merged_by_sentence(own, t.lineitem.select(S("l_orderkey").alias("sent"), "l_partkey")).where("instances IS NOT NULL")
    return merged.select(S("sent").alias("o_orderkey"), "label", "score", F.size("instances").cast("long").alias("places"))


@query("""SELECT o_custkey AS doc, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""")
def instance_sentences(t):
    """Documents with the facts of their sentences, in order."""
    f = t.orders.select(S("o_custkey").alias("doc"), S("o_orderkey").alias("sent"), F.lit("r").alias("rel"), F.array("o_orderstatus").alias("args"))
    x = extras.attached(t.customer.select(S("c_custkey").alias("doc")), f, "doc").where("facts IS NOT NULL")
    return x.select("doc", F.size("facts").cast("long").alias("n"), S("facts")[0]["sent"].alias("first"))


@query("""SELECT conv_id, turn, length(text) AS size FROM conversations""")
def parse_by_hash(t):
    """Parses are found by the hash of their sentence."""
    parses = t.conversations.select(F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("size")).distinct()
    return retrieval.parses_by_hash(t.conversations.select("conv_id", "turn", "text"), parses).select("conv_id", "turn", "size")


@query(f"SELECT k, n, f AS word, 'w' || p AS form FROM ({LINES_OF})")
def positional_zip(t):
    """Facts and columns of the same files, zipped line by line; every order is a file."""
    a, b = as_lines(lines_of(t), S("k"), S("n"), S("f")), as_lines(lines_of(t), S("k"), S("n"), F.concat(F.lit("w"), "p"))
    return src.positional(a, b).select(S("file_0").cast("long").alias("k"), S("ord_0").cast("int").alias("n"), S("value_0").alias("word"), S("value_1").alias("form"))


# evaluation, association

@query("SELECT doc_id, quality AS gold, (n_chars > 800)::INT AS pred FROM labels JOIN documents USING (doc_id)")
def gold_zip(t):
    """Gold and predicted rows of the same ids."""
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    out = evaluate.zipped(x.select("doc_id", "quality"), x.select("doc_id", (S("n_chars") > 800).cast("int").alias("pred")), "doc_id")
    return out.select(S("g.doc_id").alias("doc_id"), S("quality").alias("gold"), "pred")


ROLES = f"g AS (SELECT k, f AS frame, 'r' || n AS role, q % 3 AS s FROM ({LINES_OF})), h AS (SELECT k, f AS frame, 'r' || n AS role, q % 5 % 3 AS s FROM ({LINES_OF}))"


def role_sides(t):
    x = lines_of(t)
    cols = lambda s: x.select("k", S("f").alias("frame"), F.concat(F.lit("r"), "n").alias("role"), s.alias("s"))
    return cols(S("q") % 3), cols(S("q") % 5 % 3)


RATIOS = "round(tp / greatest(tp + fp, 1), 6) AS p, round(tp / greatest(tp + fn, 1), 6) AS r"


@query(f"""WITH {ROLES}, m AS (SELECT coalesce(g.frame, h.frame) AS frame, coalesce(g.role, h.role) AS role, g.k IS NOT NULL AS a, h.k IS NOT NULL AS b FROM (SELECT * FROM g WHERE s > 0) g FULL JOIN (SELECT * FROM h WHERE s > 0) h ON g.k = h.k AND g.frame = h.frame AND g.role = h.role AND g.s = h.s),
c AS (SELECT frame, role, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE b AND NOT a) AS fp, count(*) FILTER (WHERE a AND NOT b) AS fn FROM m GROUP BY 1, 2) SELECT frame, role, tp, fp, fn, {RATIOS} FROM c""")
def frame_role_quality(t):
    """By frame and role; spans of 0 are null spans and are left out."""
    g, h = role_sides(t)
    out = evaluate.quality(g, h, ["k", "frame", "role", "s"], ["frame", "role"], nil=S("s") == 0)
    p, r = F.round(S("tp") / F.greatest(S("tp") + S("fp"), F.lit(1)), 6), F.round(S("tp") / F.greatest(S("tp") + S("fn"), F.lit(1)), 6)
    return out.select("frame", "role", "tp", "fp", "fn", p.alias("p"), r.alias("r"))


@query(f"""WITH {ROLES}, m AS (SELECT coalesce(g.role, h.role) AS role, g.k IS NOT NULL AS a, h.k IS NOT NULL AS b FROM g FULL JOIN h ON g.k = h.k AND g.frame = h.frame AND g.role = h.role AND g.s = h.s)
SELECT role, count(*) FILTER (WHERE a AND b) AS tp, round(2.0 * count(*) FILTER (WHERE a AND b) / (count(*) FILTER (WHERE a) + count(*) FILTER (WHERE b)), 6)::DOUBLE AS f1 FROM m GROUP BY 1""")
def role_quality(t):
    g, h = role_sides(t)
    return evaluate.quality(g, h, ["k", "frame", "role", "s"], ["role"]).select("role", "tp", F.round("f1", 6).alias("f1"))


@query(f"""WITH x AS ({LINES_OF}) SELECT count(*) FILTER (WHERE q % 2 = 0 AND n <= 3) AS tp, count(*) FILTER (WHERE q % 2 = 0 AND n > 3) AS fn, round(count(*) FILTER (WHERE q % 2 = 0 AND n <= 3) / count(*) FILTER (WHERE q % 2 = 0), 6) AS recall FROM x""")
def pruning_recall(t):
    """How many of the gold spans a mask keeps."""
    x = lines_of(t)
    return evaluate.pruning_recall(x.where("q % 2 = 0").select("k", "n"), x.where("n <= 3").select("k", "n"), ["k", "n"]).select("tp", "fn", F.round("r", 6).alias("recall"))


@query("""WITH j AS (SELECT l_returnflag AS y, p_brand AS x, count(*) AS n_yx FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 4 = 1 GROUP BY 1, 2), c AS (SELECT y, x, n_yx, sum(n_yx) OVER (PARTITION BY y) AS n_y, sum(n_yx) OVER (PARTITION BY x) AS n_x, sum(n_yx) OVER () AS n FROM j) SELECT y, x, round(ln(n_yx::DOUBLE * n / (n_y * n_x)), 7) AS pmi FROM c""")
def pmi_shard(t):
    """Association from one shard of the instances."""
    rows = sample.sharded(t.lineitem, S("l_orderkey"), 4, 1, hashed=S("l_orderkey")).join(t.part, S("l_partkey") == S("p_partkey"))
    return ig.pmi_table(rows.select(S("l_returnflag").alias("y"), S("p_brand").alias("x")), "y", "x").select("y", "x", F.round("pmi", 7).alias("pmi"))


@query("""SELECT l_returnflag AS template, round(avg((l_quantity > 25)::INT), 8) AS selectivity FROM lineitem GROUP BY 1""")
def selectivity(t):
    feats = F.when(S("l_quantity") > 25, F.array("l_partkey")).otherwise(F.array().cast("array<long>"))
    return ig.selectivity(t.lineitem.select(S("l_returnflag").alias("template"), feats.alias("feats")), "feats").select("template", F.round("selectivity", 8).alias("selectivity"))


@query("""SELECT k & 255 AS bucket, max(n) AS n FROM (SELECT l_partkey * 7919 + 13 AS k, count(*) AS n FROM lineitem GROUP BY l_partkey) GROUP BY 1""")
def bucket_cardinality(t):
    """Largest frequency by masked hash, with a hash that SQL can repeat."""
    f = t.lineitem.groupBy(S("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return sketch.bucket_cardinality(f, "k", "n", 8, hashed=S("k") * 7919 + 13)


CELLS = f"SELECT k, n, r, ((k % 2147483647) * ({BUCKET}) + r * 7919) % 2147483647 % 64 AS b FROM f, range(0, 4) AS t(r)"


@query(f"""WITH f AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), c AS ({CELLS}) SELECT r::INT AS row, b AS bucket, max(n) AS value FROM c GROUP BY 1, 2""")
def entity_sketch(t):
    """The cells of a sketch of entity frequencies."""
    f = t.orders.groupBy(S("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return sketch.max_min_sketch(f, "k", "n", 4, 64, sketch.arithmetic_bucket)


@query(f"""WITH f AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), c AS ({CELLS}) SELECT (SELECT sum(n) FROM f)::BIGINT AS total, (SELECT max(n) FROM f) AS most, (SELECT max(s) FROM (SELECT sum(n) AS s FROM c GROUP BY r, b))::BIGINT AS largest_cell""")
def mention_frequencies(t):
    """One pass of mentions: their sketch, the largest frequency and the total."""
    k = t.lineitem.select(S("l_suppkey").alias("k"))
    cells = sketch.count_min_sketch(k, "k", 4, 64, bucket=sketch.arithmetic_bucket)
    f = k.groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return f.crossJoin(F.broadcast(cells.agg(F.max("value").alias("largest_cell"))))  # one row each


# feature lists

def brand_features(t):
    fs = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type", S("p_size").cast("double").alias("w")))), lambda s: F.struct(s["p_type"].alias("name"), s["w"].alias("weight")))
    return t.part.groupBy("p_brand").agg(fs.alias("fs"))


def listed(x, fs):
    return x.select("p_brand", F.explode(fs).alias("f")).select("p_brand", S("f.name").alias("name"), F.round("f.weight", 6).alias("weight"))


@query("SELECT p_brand, p_type AS name, sum(p_size)::DOUBLE AS weight FROM part GROUP BY 1, 2")
def feature_sum(t):
    return listed(brand_features(t), vectors.indexed(S("fs")))


@query("SELECT p_brand, p_type AS name, max(p_size)::DOUBLE AS weight FROM part GROUP BY 1, 2")
def feature_max(t):
    return listed(brand_features(t), vectors.largest_by_name(S("fs")))


@query("SELECT p_brand, round(sum(p_size), 6)::DOUBLE AS total, max(p_size)::DOUBLE AS most, round(avg(p_size), 6) AS mean, 0.0::DOUBLE AS none_mean, 0.0::DOUBLE AS none_most FROM part GROUP BY 1")
def feature_statistics(t):
    """Sum, largest and mean weight; of nothing the mean is 0, and the largest is 0 at least."""
    none, low = vectors.take(S("fs"), 0), vectors.mapped(S("fs"), lambda w: -w)
    return brand_features(t).select("p_brand", F.round(vectors.total(S("fs")), 6).alias("total"), vectors.largest(S("fs")).alias("most"), F.round(vectors.mean(S("fs")), 6).alias("mean"), vectors.mean(none).alias("none_mean"), vectors.largest(low).alias("none_most"))


MAGNITUDE = "SELECT p_brand, p_type AS name, sum(p_size - 25)::DOUBLE AS weight FROM part GROUP BY 1, 2"


def signed(t):
    return brand_features(t).withColumn("fs", vectors.indexed(vectors.mapped(S("fs"), lambda w: w - 25)))


@query(f"SELECT p_brand, name, weight FROM ({MAGNITUDE}) WHERE abs(weight) > 10")
def feature_threshold(t):
    return listed(signed(t), vectors.above(vectors.by_weight(S("fs")), 10.0))


@query(f"SELECT p_brand, name, weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(weight) DESC, name) AS r FROM ({MAGNITUDE})) WHERE r <= 3")
def feature_magnitude(t):
    return listed(signed(t), vectors.by_weight(S("fs"), 3, magnitude=True))


@query("SELECT p_brand, p_type AS name, p_size::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 2")
def feature_take(t):
    return listed(brand_features(t), vectors.take(S("fs"), 2))


@query("SELECT DISTINCT p_brand, p_type AS name, length(p_type)::DOUBLE AS weight FROM part")
def feature_dedup(t):
    """Repeated names have equal weights here; others would raise."""
    fs = F.transform("fs", lambda f: F.struct(f["name"].alias("name"), F.length(f["name"]).cast("double").alias("weight")))
    return listed(brand_features(t), vectors.deduplicated(fs))


@query("SELECT p_brand, p_type AS name, (count(*) * 2)::DOUBLE AS weight FROM part GROUP BY 1, 2")
def feature_promotion(t):
    """Names to features of one weight, and back."""
    x = brand_features(t)
    return listed(x, vectors.indexed(vectors.feats(vectors.names(S("fs")), 2.0)))


@query("SELECT p_brand, p_type AS name, sum(p_size + 1)::DOUBLE AS weight FROM part GROUP BY 1, 2")
def feature_index(t):
    """Several lists as one, weights of a name summed."""
    return listed(brand_features(t), vectors.indexed(S("fs"), vectors.feats(vectors.names(S("fs")), 1.0)))


@query("SELECT p_brand, p_type AS name, round(exp(sum(p_size) / 100.0), 6) AS weight FROM part GROUP BY 1, 2")
def feature_exp(t):
    return listed(brand_features(t), vectors.exponential(vectors.scaled(vectors.indexed(S("fs")), 0.01)))


@query("SELECT p_brand, count(*)::DOUBLE AS overlap FROM part WHERE p_type IN (SELECT p_type FROM part ORDER BY p_partkey LIMIT 3) GROUP BY 1")
def mention_overlap(t):
    """Scores of a mention's features that the source has, repeats included."""
    source = t.part.orderBy("p_partkey").limit(3).agg(F.collect_set("p_type").alias("source"))
    x = brand_features(t).crossJoin(F.broadcast(source))  # one row
    one = F.map_from_arrays("source", F.transform("source", lambda _: F.lit(1.0)))
    return x.select("p_brand", vectors.mention_overlap(S("source"), vectors.names(S("fs")), one).alias("overlap")).where("overlap > 0")


@query("SELECT p_brand, list_sort(list(DISTINCT p_type)) AS kinds, list_sort(list(DISTINCT p_type || 'x')) AS more FROM part GROUP BY 1")
def value_unions(t):
    """Distinct values in order of appearance, and unions of sets."""
    names = vectors.names(S("fs"))
    x = brand_features(t).select("p_brand", F.array_sort(text.unique(names)).alias("kinds"), F.array_sort(F.array_union(F.transform(names, lambda n: F.concat(n, F.lit("x"))), F.array().cast("array<string>"))).alias("more"))
    return x


@query("SELECT p_brand, string_agg(p_type, ',' ORDER BY r) AS kinds FROM (SELECT p_brand, p_type, min(p_partkey) AS r FROM part GROUP BY 1, 2) GROUP BY 1")
def unique_list(t):
    return brand_features(t).select("p_brand", F.array_join(text.unique(vectors.names(S("fs"))), ",").alias("kinds"))


@query("SELECT 'relation' AS what, count(*) AS n FROM orders UNION ALL SELECT 'schema', 25")
def state_union(t):
    """Facts of documents and the permanent ones."""
    perm = t.nation.select(F.lit("schema").alias("what"), S("n_name").alias("x"))
    both = facts.with_schema_facts(t.orders.select(F.lit("relation").alias("what"), F.lit("d").alias("docid")), perm)
    return both.groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT o_custkey::VARCHAR AS k0, count(*) AS n, count(DISTINCT o_orderkey) AS facts FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def edge_groups(t):
    """Facts by relation and key arguments; the groups of several."""
    f = t.orders.where("o_orderstatus = 'F'").select(F.lit("done").alias("rel"), F.array(S("o_custkey").cast("string"), S("o_orderkey").cast("string")).alias("args"))
    return facts.grouped(f, [0]).where("n > 1").select("k0", "n", F.size("facts").cast("long").alias("facts"))


@query("SELECT r_name, list_sort(list(n_name)) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def sorted_values(t):
    x = t.region.join(t.nation, S("r_regionkey") == S("n_regionkey"))
    return facts.multimap(x, "r_name", "n_name").select("r_name", S("values").alias("nations"))


@query("SELECT 'nation' AS what, true AS same UNION ALL SELECT 'region', (SELECT count(*) = 0 FROM region WHERE r_regionkey NOT IN (SELECT c_nationkey FROM customer)) AND (SELECT count(*) = 0 FROM customer WHERE c_nationkey NOT IN (SELECT r_regionkey FROM region))")
def same_keys(t):
    """Whether two groupings have the same keys."""
    n = t.nation.select(S("n_nationkey").alias("k"))
    rows = [("nation", facts.same_keys(n, n.orderBy(F.desc("k")), ["k"])), ("region", facts.same_keys(t.region.select(S("r_regionkey").alias("k")), t.customer.select(S("c_nationkey").alias("k")), ["k"]))]
    return t.spark.createDataFrame(rows, "what string, same boolean")


# decisions and priorities

@query("""SELECT mode, rel, args, keys FROM (VALUES ('EXACTLY_ONE', 'argument4', 't,f,s,k', 't,k'), ('AT_MOST_ONE', 'srl2', '', 'a'), ('AT_LEAST_ONE', 'event1', 't', '')) v(mode, rel, args, keys)""")
def decision_specs(t):
    rows = [decide.parse_spec(x) for x in ("EXACTLY_ONE:argument4(t, f, s, k):t:k", "AT_MOST_ONE:srl2:a", "AT_LEAST_ONE:event1(t)")]
    return t.spark.createDataFrame([(m, r, ",".join(a), ",".join(k)) for m, r, a, k in rows], "mode string, rel string, args string, keys string")


@query("SELECT event_id FROM events WHERE value > 42.5")
def decide_threshold(t):
    return t.events.where(decide.threshold("value", 42.5)).select("event_id")


AGENDA = "SELECT event_id, user_id, value, strftime(ts, '%Y-%m-%d') AS doc FROM events"


@query(f"""SELECT event_id, row_number() OVER (PARTITION BY doc ORDER BY value DESC, event_id) - 1 AS step, value > 50 AS accepted FROM ({AGENDA})""")
def agenda_pops(t):
    """Without rescoring, an agenda pops by priority, ties by key."""
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("doc"), "event_id", "user_id", "value")
    return decide.agenda_inference(e, "doc", "event_id", "value", "user_id", 0.0, 50.0).select("event_id", "step", "accepted")


@query(f"""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY value DESC, event_id) AS step, count(*) OVER (PARTITION BY doc) - row_number() OVER (PARTITION BY doc ORDER BY value DESC, event_id) AS size FROM ({AGENDA})""")
def agenda_sizes(t):
    """Candidates left after each pop."""
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("doc"), "event_id", "user_id", "value")
    out = decide.agenda_inference(e, "doc", "event_id", "value", "user_id", 0.0)
    from pyspark.sql import Window

    return out.select("doc", (S("step") + 1).alias("step"), (F.count("*").over(Window.partitionBy("doc")) - S("step") - 1).alias("size"))


@query("""WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS doc, user_id, event_type, event_id, value - 50 AS score, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY value DESC, event_id) AS n FROM events),
r(doc, n, event_id, ok, us, ts) AS (SELECT doc, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, []::BIGINT[], []::VARCHAR[] FROM e GROUP BY doc
UNION ALL SELECT e.doc, e.n, e.event_id, e.score > 0 AND NOT list_contains(r.us, e.user_id) AND NOT list_contains(r.ts, e.event_type),
CASE WHEN e.score > 0 AND NOT list_contains(r.us, e.user_id) AND NOT list_contains(r.ts, e.event_type) THEN list_append(r.us, e.user_id) ELSE r.us END,
CASE WHEN e.score > 0 AND NOT list_contains(r.us, e.user_id) AND NOT list_contains(r.ts, e.event_type) THEN list_append(r.ts, e.event_type) ELSE r.ts END FROM r JOIN e ON e.doc = r.doc AND e.n = r.n + 1)
SELECT doc, event_id, ok AS accepted FROM r WHERE n > 0""")
def decide_double_at_most_one(t):
    """Accepted while both keys are free, in pop order."""
    e = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("doc"), "user_id", "event_type", "event_id", "value", (S("value") - 50).alias("score"))
    return decide.double_at_most_one(e, "doc", "user_id", "event_type", "value", "score", "event_id").select("doc", "event_id", "accepted")


@query("SELECT event_id, round(tanh(value / 100), 8) AS easyfirst FROM events")
def priority_easyfirst(t):
    return t.events.select("event_id", F.round(scores.easy_first(S("value")), 8).alias("easyfirst"))


@query("SELECT event_id, round(2 * value, 6) AS linear FROM events")
def priority_linear(t):
    """The score itself, by name and weight."""
    return t.events.select("event_id", F.round(decide.weighted("2*easyfirst-linear", {"easyfirst-linear": S("value")}), 6).alias("linear"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 2.0 WHEN 'view' THEN -1.0 ELSE 0.0 END::DOUBLE AS dfs, CASE event_type WHEN 'click' THEN -2.0 WHEN 'view' THEN 1.0 ELSE 0.0 END::DOUBLE AS bfs FROM events")
def priority_stages(t):
    ranks = {"click": 2.0, "view": -1.0}
    return t.events.select("event_id", decide.stage_rank("event_type", ranks).alias("dfs"), decide.stage_rank("event_type", ranks, breadth=True).alias("bfs"))


@query("SELECT l_orderkey, l_linenumber, -(l_partkey + l_quantity::BIGINT // 1000) AS priority FROM lineitem")
def priority_start_width(t):
    """Start, then width in whole thousands."""
    return t.lineitem.select("l_orderkey", "l_linenumber", decide.start_then_width(S("l_partkey"), S("l_quantity").cast("long")).alias("priority"))


@query("SELECT p_partkey, round((row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) - 1) / count(*) OVER (PARTITION BY p_brand), 8) AS share FROM part")
def priority_role_row(t):
    return t.part.select("p_partkey", F.round(decide.row_share(["p_brand"], ["p_type", "p_partkey"]), 8).alias("share"))


@query("SELECT n_name, round(1 - ascii(substr(n_name, 1, 1)) / 256.0 - ascii(substr(n_name, 2, 1)) / 65536.0, 8)::DOUBLE AS rank FROM nation")
def priority_name(t):
    return t.nation.select("n_name", F.round(decide.name_rank(S("n_name"), 2), 8).alias("rank"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 1 ELSE 0 END DESC, value DESC, event_id) AS rank FROM events""")
def priority_orders(t):
    """Orders one after another: a stage first, then the score, then the key."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc(decide.stage_rank("event_type", {"click": 1.0})), F.desc("value"), "event_id")
    return t.events.select("event_id", F.row_number().over(w).cast("long").alias("rank"))


@query("SELECT p_brand, row_number() OVER (ORDER BY (k * 7919 + 104729) % 1000003 / 1000003.0, k) AS rank FROM (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1)")
def random_role_order(t):
    """Roles in an order that only looks drawn."""
    from pyspark.sql import Window

    x = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    return x.select("p_brand", F.row_number().over(Window.orderBy(sample.arithmetic_unit(S("k")), "k")).cast("long").alias("rank"))  # one row a brand


@query("SELECT user_id, min(event_id) FILTER (WHERE n - best >= 5) AS stop FROM (SELECT *, max(CASE WHEN up THEN n END) OVER (PARTITION BY user_id ORDER BY n) AS best FROM (SELECT user_id, event_id, row_number() OVER w AS n, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY 1")
def stopping_condition(t):
    """The step at which a metric has not improved for five steps, and steps that shrink."""
    return evaluate.stopping_step(t.events, ["user_id"], "event_id", "value", 5)


@query("SELECT event_id, round(0.1 / (1 + 0.01 * event_id), 9) AS rate FROM events")
def learning_rate(t):
    return t.events.select("event_id", F.round(evaluate.step_size(S("event_id"), 0.1, 0.01), 9).alias("rate"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS n FROM events),
r(user_id, n, last, event_id, shown) AS (SELECT user_id, n, s, event_id, true FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.s - r.last >= 36000 THEN e.s ELSE r.last END, e.event_id, e.s - r.last >= 36000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id FROM r WHERE shown""")
def time_gate(t):
    """Events at least ten hours after the last one let through."""
    return extras.gated(t.events, ["user_id"], "ts", "event_id", 36000)
