"""Queries that run exporters, searches within facets and the upkeep of an index, each with its SQL equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.operators import components, inverted, search
from folioscope.plans import workflows
from folioscope.plans.catalogue import _bm25, _tokens, query, table, with_title
from folioscope.sources import exports, styles
from folioscope.streaming import ingest


def _folder(spark, what: str) -> str:
    return f"{components.shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _suppliers(spark, sf_dir):
    """Suppliers as records: every third without a year, every fourth without a place."""
    s, n, k = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), F.col("s_suppkey")
    none = F.lit(None).cast("string")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    people = F.array(F.struct(F.col("n_name").alias("surname"), k.cast("string").alias("given")))
    return j.select(k.alias("id"), F.lit("book").alias("type"), F.col("s_name").alias("title"), people.alias("authors"), F.when(k % 3 != 0, F.col("s_nationkey") + 1900).cast("int").alias("year"), F.col("n_name").alias("publisher"), F.when(k % 4 != 0, "Porto").alias("place"), none.alias("doi"), none.alias("isbn"), none.alias("url"))


@query("""
SELECT s_suppkey AS id, '{"id":"' || s_suppkey || '","type":"book","title":"' || s_name || '","author":[{"family":"' || n_name || '","given":"' || s_suppkey || '"}]' || CASE WHEN s_suppkey % 3 <> 0 THEN ',"issued":{"date-parts":[[' || (1900 + s_nationkey) || ']]}' ELSE '' END
|| ',"publisher":"' || n_name || '"' || CASE WHEN s_suppkey % 4 <> 0 THEN ',"publisher-place":"Porto"' ELSE '' END || '}' AS json FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def csl_json_export(spark, sf_dir):
    return exports.csl_json(_suppliers(spark, sf_dir))


@query("""
SELECT s_suppkey AS id, '@book{k' || s_suppkey || ',' || chr(10) || '  title = {' || s_name || '},' || chr(10) || '  author = {' || n_name || ', ' || s_suppkey || '},' || chr(10) || CASE WHEN s_suppkey % 3 <> 0 THEN '  year = {' || (1900 + s_nationkey) || '},' || chr(10) ELSE '' END
|| '  publisher = {' || n_name || '}' || CASE WHEN s_suppkey % 4 <> 0 THEN ',' || chr(10) || '  address = {Porto}' ELSE '' END || chr(10) || '}' AS entry FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def bibtex_export(spark, sf_dir):
    return exports.bibtex(_suppliers(spark, sf_dir).withColumn("key", F.concat(F.lit("k"), F.col("id").cast("string"))), "key")


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '> ' ELSE '' END || o_orderpriority || CASE WHEN o_orderkey % 3 <> 0 THEN ' (p. 1)' ELSE '' END || ' #two-words #' || o_orderstatus AS note FROM orders)
SELECT o_custkey, '## Customer ' || o_custkey || chr(10) || chr(10) || string_agg(note, chr(10) || chr(10) ORDER BY o_orderkey) AS markdown FROM n GROUP BY o_custkey
""")
def notes_markdown_export(spark, sf_dir):
    k = F.col("o_orderkey")
    notes = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("title"), k.alias("ord"), F.when(k % 2 == 0, "quotation").otherwise("note").alias("kind"), F.when(k % 3 != 0, "p. 1").otherwise("").alias("location"), F.col("o_orderpriority").alias("text"), F.array(F.lit("two words"), F.col("o_orderstatus")).alias("tags"))
    return exports.notes_markdown(notes, "o_custkey", "title")


@query("SELECT CAST(ceil(doc_id / 100.0) AS BIGINT) AS block, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text <> '' GROUP BY 1")
def text_blocks_written(spark, sf_dir):
    path = _folder(spark, "blocks")
    exports.text_blocks(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id", path)
    back = spark.read.schema("doc_id long, content string, block long").json(path)
    return back.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS content FROM orders GROUP BY 1")
def latest_texts(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("updated"), F.concat(F.col("o_orderpriority"), F.char(F.lit(0))).alias("content"))
    return exports.latest_text(texts, "o_custkey", "updated")


@query("SELECT c_custkey, c_name, 'first' AS run FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 'second' FROM customer WHERE c_custkey % 3 = 0")
def audit_appended(spark, sf_dir):
    path, c = _folder(spark, "audit"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for every, run in ((2, "first"), (3, "second")):
        exports.append_audit(c.where(F.col("c_custkey") % every == 0).withColumn("run", F.lit(run)), path)
    return spark.read.schema("c_custkey long, c_name string, run string").json(path).select("c_custkey", "c_name", "run")


_HITS = _bm25([("len(list_filter({c}, lambda w: starts_with(w, 'thon')))", "starts_with(w, 'thon')"), ("len(list_filter({c}, lambda w: starts_with(w, 'ering')))", "")], 20)


@query(f"SELECT h.doc_id, h.score, h.rank, d.lang FROM ({_HITS}) h JOIN documents d ON d.doc_id = h.doc_id WHERE d.lang = 'en' OR d.doc_id % 2 = 0")
def search_in_facets(spark, sf_dir):
    docs = with_title(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    hits = workflows.search_with_facets(docs, {"title": 10.0, "source": 5.0, "text": 1.0}, "thon ering", (F.col("lang") == "en") | (F.col("doc_id") % 2 == 0), 20)
    return hits.select("doc_id", "score", "rank", "lang")


@query("SELECT doc_id, CAST(NULL AS BIGINT) AS rank FROM documents WHERE lang = 'en'")
def search_without_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    assert not search.compile_query(" ")
    return workflows.search_with_facets(docs, {"text": 1.0}, " ", F.col("lang") == "en").select("doc_id", "rank")


@query(f"""
WITH n AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_distinct({_tokens("e")}), ' ') AS tokens FROM n
""")
def index_maintained(spark, sf_dir):
    base = _folder(spark, "index")
    static = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "props")
    stream = ingest.watched(spark, f"{sf_dir}/event[s].parquet", static.schema.simpleString()[7:-1].replace(":", " "), "parquet")
    run = ingest.maintain_index(stream, "user_id", ["event_type"], f"{base}/out", f"{base}/checkpoint", updated="event_id")
    try:
        run.processAllAvailable()
        last = max(p["batchId"] for p in run.recentProgress if p["numInputRows"])
    finally:
        run.stop()
    return spark.read.parquet(f"{base}/out/v{last % 2}").select("user_id", F.array_join("tokens", " ").alias("tokens"))


_KEPT = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'thon ering ' || source ELSE text END AS text, source FROM documents WHERE doc_id % 7 <> 3)"


@query(f"SELECT doc_id, score, rank FROM ({_HITS.replace('FROM documents', f'FROM {_KEPT} AS documents')})")
def search_kept_index(spark, sf_dir):
    """Documents in three batches: most of them, the others with new versions of every tenth, and deletions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("deleted", F.lit(False))
    longer = docs.withColumn("text", F.concat("text", F.lit("\nthon ering "), "source"))
    first = docs.where("doc_id % 3 <> 1 or doc_id % 10 = 0")
    second = docs.where("doc_id % 3 = 1 and doc_id % 10 <> 0").unionByName(longer.where("doc_id % 10 = 0"))
    third = docs.where("doc_id % 7 = 3").withColumn("deleted", F.lit(True))
    index = inverted.Index(spark, _folder(spark, "postings"), "doc_id", ["title", "source", "text"])
    for batch in (first, second, third):
        index.add(with_title(batch), deleted="deleted")
    return index.ranked({"title": 10.0, "source": 5.0, "text": 1.0}, search.compile_query("thon ering"), 20)


#: A style by author and date; journals in italics, books with place and publisher.
STYLE = """<style xmlns="http://purl.org/net/xbiblio/csl" class="in-text"><locale><terms><term name="no date" form="short">n.d.</term><term name="and">and</term></terms></locale>
<macro name="year"><choose><if variable="issued"><date variable="issued"><date-part name="year"/></date></if><else><text term="no date" form="short"/></else></choose></macro>
<bibliography et-al-min="3" et-al-use-first="1"><layout suffix="."><group delimiter=" "><names variable="author"><name name-as-sort-order="all" initialize-with="." and="text"/></names><text macro="year" prefix="(" suffix=")"/>
<choose><if type="article-journal"><group delimiter=", "><text variable="title" quotes="true"/><text variable="container-title" font-style="italic"/><group delimiter=" "><label variable="page"/><text variable="page" prefix="pp. "/></group></group></if>
<else><group delimiter=". "><text variable="title" font-style="italic" text-case="uppercase"/><group delimiter=": "><text variable="publisher-place"/><text variable="publisher"/></group></group></else></choose></group></layout></bibliography></style>"""


@query("""
WITH s AS (SELECT s_suppkey, s_name, n_name, s_nationkey, CAST(floor(abs(s_acctbal)) AS BIGINT) AS b, CASE WHEN s_acctbal > 3000 THEN CAST(1900 + s_nationkey AS VARCHAR) ELSE 'n.d.' END AS y FROM supplier JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT *, upper(substr(n_name, 1, 1)) || '.' AS i, b % 4 AS n FROM s)
SELECT s_suppkey, CASE n WHEN 0 THEN '' WHEN 1 THEN n_name || ', ' || i || ' ' WHEN 2 THEN n_name || ', ' || i || ' and ' || s_name || ', S.' || i || ' ' ELSE n_name || ', ' || i || ' et al. ' END || '(' || y || ') '
|| CASE WHEN b % 2 = 0 THEN '“' || s_name || '”, <i>' || n_name || '</i>, pp. ' || b || '-' || (b + 9) || '.' ELSE '<i>' || upper(s_name) || '</i>. ' || n_name || ': Press &amp; Co.' END AS entry FROM a
""")
def styled_bibliography(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    b = F.floor(F.abs("s_acctbal")).cast("long")
    person = lambda family, given: F.struct(family.alias("family"), given.alias("given"), F.lit(None).cast("string").alias("literal"))
    nation, name = F.col("n_name"), F.col("s_name")
    people = F.slice(F.array(person(nation, nation), person(name, F.concat(F.lit("S "), nation)), person(name, name)), F.lit(1), (b % 4).cast("int"))
    texts = F.create_map(F.lit("title"), name, F.lit("container-title"), nation, F.lit("publisher-place"), nation, F.lit("publisher"), F.lit("Press & Co"), F.lit("page"), F.concat(b.cast("string"), F.lit("-"), (b + 9).cast("string")))
    years = F.create_map(F.lit("issued"), F.when(F.col("s_acctbal") > 3000, F.array((F.col("s_nationkey") + 1900).cast("int"))))
    items = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.when(b % 2 == 0, "article-journal").otherwise("book").alias("type"), texts.alias("text"), F.create_map(F.lit("author"), people).alias("names"), years.alias("dates"))
    return styles.Style(STYLE, markup="html").bibliography(items).select("s_suppkey", "entry")
