"""Catalogue queries on the driver's tables, each with its SQL equivalent."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import dates, identifiers, names, similarity, text
from folioscope.operators import components, dedup, edit, facets, grouping, keywords, linkage, rank, search
from folioscope.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has: a small file is one task's, however much is worked out of each row. A number that is asked for is kept."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def longs(*cols: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in cols]


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(x)}, ' '), lambda t: length(t) > 1))"


def _tokens(x: str) -> str:
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: t <> '')"


def _dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0 END"


def _contained(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) >= 3 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) * 1.0 / len({a}) ELSE 0 END"


def _round6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


TITLE = "split_part(text, chr(10), 1)"


def with_title(docs: DataFrame) -> DataFrame:
    """A document's first line is its title."""
    return docs.withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))


# search -----------------------------------------------------------------------------------------------------------------


def _bm25(match: list[tuple[str, str]], limit: int) -> str:
    """match: for each term its hits in t (title), s (source) and x (text), as list expressions over {c}."""
    f = [f"(10.0 * {m.format(c='t')} + 5.0 * {m.format(c='s')} + 1.0 * {m.format(c='x')})" for m, _ in match]
    cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(f))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(f)))
    idf = [f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END" for i in range(len(f))]
    score = " ".join(f"- ({idf[i]}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / avg_len))" for i in range(len(f)))
    where = " AND ".join(f"f{i} > 0" for i in range(len(f)))
    return f"""
WITH r AS (SELECT doc_id, {_tokens(f"coalesce({TITLE}, '')")} AS t, {_tokens("coalesce(source, '')")} AS s, {_tokens("coalesce(text, '')")} AS x FROM documents),
c AS (SELECT doc_id, len(t) + len(s) + len(x) AS l, {cols}, x, list_position(list_transform(x, lambda w: {match[0][1]}), true) AS p FROM r),
st AS (SELECT count(*) AS n, avg(l) AS avg_len, {stats} FROM c),
m AS (SELECT doc_id, {_round6("0.0 " + score)} AS score, CASE WHEN p > 0 THEN array_to_string(x[greatest(1, p - 4) : greatest(1, p - 4) + 13], ' ') END AS excerpt FROM c, st WHERE {where})
SELECT doc_id, score, excerpt, row_number() OVER (ORDER BY score, doc_id) AS rank FROM m ORDER BY score, doc_id LIMIT {limit}
"""


def _ranked(spark, sf_dir, q: str, limit: int) -> DataFrame:
    docs = with_title(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return search.ranked(docs, {"title": 10.0, "source": 5.0, "text": 1.0}, search.compile_query(q), limit)


@query(_bm25([("len(list_filter({c}, lambda w: starts_with(w, 'thon')))", "starts_with(w, 'thon')"), ("len(list_filter({c}, lambda w: starts_with(w, 'ering')))", "")], 20))
def search_ranked_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, "thon ering", 20)


@query(_bm25([("len(list_filter(range(1, len({c})), lambda i: {c}[i] = 'of' AND {c}[i + 1] = 'the'))", "w = 'of'"), ("len(list_filter(range(1, len({c})), lambda i: {c}[i] = 'and' AND starts_with({c}[i + 1], 'th')))", "")], 500))
def search_prefix_and_phrase(spark, sf_dir):
    return _ranked(spark, sf_dir, '"of the" and-th', 500)


@query(f"""
WITH r AS (SELECT doc_id, {_norm(f"replace(coalesce({TITLE}, ''), 'ß', 'ss')")} AS t, {_norm("coalesce(source, '')")} AS a, {_norm("coalesce(lang, '')")} AS k, {_norm("replace(coalesce(text, ''), 'ß', 'ss')")} AS o FROM documents),
h AS (SELECT *, concat_ws(' ', t, a, k, o) AS hay FROM r)
SELECT doc_id, CAST((SELECT sum(1 + CASE WHEN contains(t, q) THEN 4 ELSE 0 END + CASE WHEN contains(a, q) THEN 2 ELSE 0 END + CASE WHEN contains(k, q) THEN 1 ELSE 0 END) FROM (SELECT unnest(['heit', 'src1']) AS q)) AS BIGINT) AS score
FROM h WHERE contains(hay, 'heit') AND contains(hay, 'src1')
""")
def search_contains_score(spark, sf_dir):
    return search.contains_score(with_title(table(spark, sf_dir, "documents")), "heit src1", "title", "source", "lang", "text")


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 17")
def search_number_shortcut(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == search.number_of(" #17 ")).select("doc_id", "source", "lang", "n_chars")


@query("""
SELECT doc_id, CAST(strpos(text, 'ation') AS BIGINT) AS at, substr(text, greatest(1, strpos(text, 'ation') - 90), 240) AS excerpt FROM documents WHERE contains(text, 'ation')
""")
def search_snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("text").contains("ation"))
    at = F.instr("text", "ation")
    return d.select("doc_id", at.cast("long").alias("at"), F.substring("text", F.greatest(F.lit(1), at - 90), F.lit(240)).alias("excerpt"))


# facets and order -------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.lang, d.source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en' AND quality = 1 AND contains(lower(source), 'src1') AND n_chars >= 500 AND n_chars <= 5000")
def facet_filter(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.where(facets.facet_filter({"lang": "en", "quality": 1}, like={"source": "src1"}, years=("n_chars", 500, 5000))).select("doc_id", "lang", "source", "quality")


@query("SELECT source, lang, quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def facet_counts(spark, sf_dir):
    return facets.counts(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "source", "lang", "quality")


@query("SELECT source, lang, count(*) AS n, CAST(grouping(source, lang) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (source, lang)")
def facet_rollup(spark, sf_dir):
    return facets.rollup(table(spark, sf_dir, "documents"), "source", "lang").withColumn("level", F.col("level").cast("long"))


_EXT = "regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '\\.([A-Za-z0-9]{1,5})$', 1)"


@query(f"SELECT CASE WHEN {_EXT} = '' THEN 'none' ELSE lower({_EXT}) END AS format, count(*) AS n FROM pages GROUP BY 1")
def format_counts(spark, sf_dir):
    return facets.counts(table(spark, sf_dir, "pages").select(facets.extension(F.col("url")).alias("format")), "format")


@query(f"SELECT page_id, url FROM pages WHERE lower({_EXT}) IN ('html', 'php')")
def format_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(facets.format_filter(F.col("url"), ["html", "php"])).select("page_id", "url")


@query(f"""
WITH k AS (SELECT p_partkey, p_name, array_to_string(list_transform({_tokens("regexp_replace(lower(p_name), '^(the|an|a)\\s+', '')")}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]{{1,8}}') THEN lpad(t, 8, '0') ELSE t END), ' ') AS key FROM part)
SELECT p_partkey, key, rank() OVER (ORDER BY key) AS place FROM k
""")
def catalog_sort_title(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", text.title_key(F.col("p_name")).alias("key"))
    sizes = p.withColumnRenamed("key", "k").groupBy("k").agg(F.count("*").alias("n"))
    sizes = grouping.running_total(sizes, F.col("k").asc_nulls_last(), F.col("n")).withColumn("place", F.col("before") + 1)
    return p.join(sizes, F.col("key").eqNullSafe(F.col("k"))).select("p_partkey", "key", *longs("place"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT) AS key FROM orders ORDER BY key, o_orderkey")
def catalog_sort_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", dates.date_key(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("long").alias("key"))
    return o.orderBy("key", "o_orderkey")


# derived columns --------------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, concat_ws(' ', c_name, n_name, c_mktsegment, 'n' || c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0'), coalesce(o.notes, '')) AS document
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS notes FROM orders GROUP BY 1) o ON o_custkey = c_custkey
""")
def index_document_assembly(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    notes = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), " ").alias("notes"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(notes, c.c_custkey == notes.o_custkey, "left")
    key = F.col("c_custkey").cast("string")
    return rows.select("c_custkey", F.concat_ws(" ", "c_name", "n_name", "c_mktsegment", F.concat(F.lit("n"), key), F.lpad(key, 8, "0"), F.coalesce("notes", F.lit(""))).alias("document"))


@query("""
SELECT o_orderkey, CAST(coalesce(nullif(regexp_extract(strftime(o_orderdate, 'printed %d.%m.%Y'), '([0-9]{4})', 1), ''), '0') AS INTEGER) AS year,
coalesce(nullif(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, ''), 'default') AS nature FROM orders
""")
def derive_year_nature(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    nature = text.first_filled(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), F.lit("default"))
    return o.select("o_orderkey", dates.year(F.date_format("o_orderdate", "'printed' dd.MM.yyyy")).alias("year"), nature.alias("nature"))


@query("""
WITH k AS (SELECT c_custkey, 'customer' || CAST(c_nationkey + 1900 AS VARCHAR) || lower(c_mktsegment) AS key FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c_custkey) AS n FROM k)
SELECT c_custkey, CASE WHEN n = 1 THEN key WHEN n <= 26 THEN key || chr(CAST(96 + n AS INTEGER)) ELSE key || '-' || n END AS citation_key FROM r
""")
def citation_key_unique(spark, sf_dir):
    key = names.citation_key(F.split_part("c_name", F.lit("#"), F.lit(1)), F.col("c_nationkey") + 1900, F.col("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key")).withColumn("n", F.expr("row_number() over (partition by key order by c_custkey)"))
    suffix = F.when(F.col("n") == 1, "").when(F.col("n") <= 26, F.char(96 + F.col("n"))).otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    return c.select("c_custkey", F.concat("key", suffix).alias("citation_key"))


@query("""
SELECT s_suppkey, 'S' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'article-journal' ELSE 'book' END AS type, split_part(s_name, '#', 1) AS family, split_part(s_name, '#', 2) AS given, n_name AS publisher_place
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")
def csl_projection(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.select("s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_acctbal") < 0, "article-journal").otherwise("book").alias("type"), F.split_part("s_name", F.lit("#"), F.lit(1)).alias("family"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("given"), F.col("n_name").alias("publisher_place"))


@query("SELECT p_partkey, p_name, p_brand, concat_ws(' / ', p_type, p_brand) AS shelf, trim(regexp_replace(regexp_replace(p_name || ':' || p_type, '[<>:\"/\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g')) AS file_name FROM part")
def list_projection(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", "p_brand", F.concat_ws(" / ", "p_type", "p_brand").alias("shelf"), text.safe_segment(F.concat("p_name", F.lit(":"), "p_type")).alias("file_name"))


# duplicates -------------------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS keeper, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


_ENDS = "(?:^| )([0-9]{1,3}|[ivxlc]+)$"
_BEGINS = "starts_with({b}.ct, {a}.ct) AND length({a}.ct) >= 30 AND length({a}.ct) < length({b}.ct) AND NOT regexp_matches(substr({b}.ct, length({a}.ct) + 1), '^([0-9]{{1,3}}|[ivxlc]+)$') AND (a.e = '' OR b.e = '' OR a.e = b.e)"


@query(f"""
WITH r AS (SELECT doc_id AS id, substr(replace({_norm(TITLE)}, ' ', ''), 1, 80) AS ct, regexp_extract({_norm(TITLE)}, '{_ENDS}', 1) AS e FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, substr(ct, 1, 30) AS key FROM r WHERE length(ct) >= 8),
p AS (SELECT a.id, b.id AS match FROM k a JOIN k b ON a.key = b.key AND a.id <> b.id WHERE a.ct = b.ct OR ({_BEGINS.format(a="a", b="b")}) OR ({_BEGINS.format(a="b", b="a")}))
SELECT id, min(match) AS match, CAST(3 AS BIGINT) AS priority FROM p GROUP BY id
""")
def key_duplicates_compat(spark, sf_dir):
    d = with_title(table(spark, sf_dir, "documents").where("text is not null")).select(F.col("doc_id").alias("id"), "title")
    return dedup.title_duplicates(d).select("id", "match", F.lit(3).cast("long").alias("priority"))


_MEAN = "list_transform(range(0, 16), lambda i: CAST(embedding[4 * i + 1] AS DOUBLE) + CAST(embedding[4 * i + 2] AS DOUBLE) + CAST(embedding[4 * i + 3] AS DOUBLE) + CAST(embedding[4 * i + 4] AS DOUBLE))"
_BITS = f"(SELECT array_to_string(list_transform(range(1, 16), lambda i: CASE WHEN m[i] > m[i + 1] THEN '1' ELSE '0' END), '') FROM (SELECT {_MEAN} AS m))"
_PAIRS = f"""
v AS (SELECT vec_id, label, {_BITS} AS bits FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(CAST(a.bits AS BIT), CAST(b.bits AS BIT))) AS BIGINT) AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE length(a.bits) = length(b.bits)),
q AS (SELECT * FROM p WHERE distance <= 1)
"""


def _fingerprint_pairs(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", dedup.neighbour_bits(F.col("embedding"), 4).alias("bits"))
    return dedup.fingerprint_pairs(v, 15, 1, "label")


@query(f"WITH {_PAIRS} SELECT a, b, distance FROM q")
def near_duplicate_pairs(spark, sf_dir):
    return _fingerprint_pairs(spark, sf_dir)


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM q UNION SELECT b, a FROM q), r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS component_id FROM r GROUP BY id")
def near_duplicate_components(spark, sf_dir):
    return components.connected_components(_fingerprint_pairs(spark, sf_dir))


@query("""
WITH g AS (SELECT d.doc_id, sha256(text) AS h, n_chars, CASE WHEN quality = 1 THEN 1000 ELSE 500 END + CASE WHEN lang IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN toxic = 0 THEN 50 ELSE 0 END AS points
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS k, count(*) OVER (PARTITION BY h) AS n FROM g)
SELECT doc_id AS keeper, CAST(points AS BIGINT) AS points, n FROM r WHERE k = 1 AND n > 1
""")
def duplicate_keeper(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    points = dedup.keeper_score(F.when(F.col("quality") == 1, "complete"), lang=F.when(F.col("lang").isNotNull(), 30).otherwise(0), toxic=F.when(F.col("toxic") == 0, 50).otherwise(0))
    s = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"), points.alias("points"))
    best = s.groupBy("h").agg(F.max_by(F.struct("doc_id", "points"), F.struct("points", -F.col("doc_id"))).alias("x"), F.count("*").alias("n")).where("n > 1")
    return best.select(F.col("x.doc_id").alias("keeper"), F.col("x.points").cast("long").alias("points"), "n")


# linkage ----------------------------------------------------------------------------------------------------------------

_LINK = f"""
WITH d AS (SELECT doc_id AS id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id AS match, {_words("text")} AS w FROM benchmark WHERE text IS NOT NULL)
"""


def _linked(spark, sf_dir, share: float, ratio: float | None = None) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("words"))
    b = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("match"), text.words(F.col("text")).alias("words"))
    return linkage.word_links(d, b, share, ratio)


@query(_LINK + f"SELECT id, match, {_round6(_dice('d.w', 'b.w'))} AS dice FROM d, b WHERE {_dice('d.w', 'b.w')} >= 0.5")
def dice_linkage(spark, sf_dir):
    p = _linked(spark, sf_dir, 1 / 3, 3.0).withColumn("dice", similarity.dice_from(F.col("shared"), F.col("na"), F.col("nb")))
    return p.where("dice >= 0.5").select("id", "match", similarity.round6(F.col("dice")).alias("dice"))


@query(_LINK + f"SELECT id, match, {_round6(_contained('b.w', 'd.w'))} AS share FROM d, b WHERE {_contained('b.w', 'd.w')} >= 0.85")
def containment_linkage(spark, sf_dir):
    p = _linked(spark, sf_dir, 0.85).withColumn("share", similarity.containment_from(F.col("shared"), F.col("nb"), F.col("na")))
    return p.where("share >= 0.85").select("id", "match", similarity.round6(F.col("share")).alias("share"))


@query("""
WITH c AS (SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS a FROM customer), s AS (SELECT s_suppkey, regexp_extract(s_name, '([0-9]+)$', 1) AS b FROM supplier)
SELECT c_custkey, s_suppkey, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM c, s WHERE levenshtein(a, b) <= greatest(1, floor(greatest(length(a), length(b)) / 4)) OR (substr(a, 1, 3) = substr(b, 1, 3) AND least(length(a), length(b)) >= 5 AND levenshtein(a, b) <= 2)
""")
def edit_distance_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).alias("a"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_extract("s_name", "([0-9]+)$", 1).alias("b"))
    pairs = linkage.similar_names(c, s).join(c, "a").join(s, "b")
    return pairs.select("c_custkey", "s_suppkey", F.levenshtein("a", "b").alias("distance"))


@query("""
SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE floor(c_acctbal) = floor(s_acctbal) OR (c_custkey = s_suppkey)
""")
def or_key_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("bal", F.floor("c_acctbal"))
    s = table(spark, sf_dir, "supplier").withColumn("bal", F.floor("s_acctbal"))
    return linkage.or_join(c, s.withColumnRenamed("bal", "sbal"), [("bal", "sbal"), ("c_custkey", "s_suppkey")], "c_custkey", "s_suppkey")


_RANGES = "SELECT s_suppkey AS band, s_acctbal * 50 AS lo, s_acctbal * 50 + 400 AS hi FROM supplier"


@query(f"WITH r AS ({_RANGES}) SELECT o_orderkey, band FROM orders JOIN r ON o_totalprice BETWEEN lo AND hi")
def range_bucket_join(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("band"), (F.col("s_acctbal") * 50).alias("lo"), (F.col("s_acctbal") * 50 + 400).alias("hi"))
    return linkage.range_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), r, "o_totalprice", "lo", "hi", 1000.0).select("o_orderkey", "band")


@query("""
SELECT c_custkey, 'noted' AS state FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders) USING (c_custkey)
UNION ALL SELECT c_custkey, 'bare' FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders) USING (c_custkey)
""")
def semi_anti_notes(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    # one pass for both halves
    return c.join(o, "c_custkey", "left").select("c_custkey", F.when(F.col("has"), "noted").otherwise("bare").alias("state"))


_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '')"


@query(f"""
WITH p AS (SELECT page_id, string_split({_PATH}, '/') AS parts FROM pages),
k AS (SELECT DISTINCT array_to_string(parts[1:2], '/') AS prefix FROM p WHERE page_id % 3 = 0),
x AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS depth, parts FROM p),
y AS (SELECT page_id, depth, array_to_string(parts[1:depth], '/') AS prefix FROM x),
r AS (SELECT page_id, prefix, depth, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC) AS n FROM y SEMI JOIN k USING (prefix))
SELECT page_id, prefix, CAST(depth AS INTEGER) AS depth FROM r WHERE n = 1
""")
def prefix_ancestor_lookup(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    known = p.where("page_id % 3 = 0").select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix"))  # the origin map covers some pages
    return linkage.nearest_ancestor(p, known, "path", "page_id")


@query("""
WITH n AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS s, o_orderdate AS t FROM orders WHERE o_orderkey % 7 <> 3),
p AS (SELECT o_orderkey AS k, CAST(floor(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END + 0.5) AS BIGINT) AS s, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 1 SECOND WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 5 SECOND ELSE o_orderdate END AS t FROM orders WHERE o_orderkey % 11 <> 2)
SELECT coalesce(n.k, p.k) AS k, CASE WHEN n.k IS NULL THEN 'delete' WHEN p.k IS NULL THEN 'copy' WHEN n.s = p.s AND abs(epoch(n.t) - epoch(p.t)) <= 2 THEN 'same' ELSE 'copy' END AS action FROM n FULL JOIN p ON n.k = p.k
""")
def manifest_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, price, day = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    needed = o.where(k % 7 != 3).select(k.alias("k"), F.floor(price + 0.5).alias("s"), day.alias("t"))
    late = F.when(k % 4 == 0, day + F.expr("interval 1 second")).when(k % 4 == 1, day + F.expr("interval 5 seconds")).otherwise(day)
    present = o.where(k % 11 != 2).select(k.alias("k"), F.floor(F.when(k % 5 == 0, price + 1).otherwise(price) + 0.5).alias("s"), late.alias("t"))
    return linkage.manifest_diff(needed, present, "k", "s", "t", 2)


@query("""
WITH c AS (SELECT l_orderkey AS q, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE false),
a AS (SELECT l_orderkey AS q, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_orderkey AS q, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT q AS l_orderkey, v AS l_suppkey, CAST(0 AS INTEGER) AS step FROM a WHERE n = 1
UNION ALL SELECT b.q, b.v, 1 FROM b ANTI JOIN a ON a.q = b.q WHERE n = 1
""")
def single_answer_cascade(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return linkage.cascade([li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'")], "l_orderkey", "l_suppkey")


@query("""
SELECT p_partkey, coalesce(a.s, b.s) AS answer, CASE WHEN a.s IS NOT NULL THEN 'lineitem' WHEN b.s IS NOT NULL THEN 'supplier' ELSE 'none' END AS origin FROM part
LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem WHERE l_quantity > 45 GROUP BY 1) a ON a.l_partkey = p_partkey
LEFT JOIN (SELECT s_suppkey AS s FROM supplier) b ON b.s = p_partkey
""")
def lookup_priority_coalesce(spark, sf_dir):
    p, li, s = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    a = li.where("l_quantity > 45").groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"))
    j = p.join(a, p.p_partkey == a.l_partkey, "left").join(s.select(F.col("s_suppkey").alias("b")), F.col("p_partkey") == F.col("b"), "left")
    return j.select("p_partkey", F.coalesce("a", "b").alias("answer"), F.when(F.col("a").isNotNull(), "lineitem").when(F.col("b").isNotNull(), "supplier").otherwise("none").alias("origin"))


# candidates -------------------------------------------------------------------------------------------------------------

_CAND = f"""
WITH d AS (SELECT doc_id, lang, source, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {_words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT item_id, doc_id AS id, lang, source, len(d.w) AS work, floor(greatest({_dice('b.w', 'd.w')}, 0.9 * {_contained('b.w', 'd.w')}) * 100 + 0.5) / 100.0 AS confidence FROM d, b WHERE len(list_intersect(b.w, d.w)) > 0)
"""


def _candidates(spark, sf_dir, keep: linkage.Keep | None = None, more: DataFrame | None = None) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), text.words(F.col("text")).alias("words"), "lang", "source")
    if more is not None:
        d = d.join(more, "id", "left")  # a row for each document, not for each of its candidates
    b = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("match"), text.words(F.col("text")).alias("words"))
    p = linkage.shared_words(d, b, keep)
    return p.select(F.col("match").alias("item_id"), F.col("na").alias("work"), rank.confidence_of(F.col("shared"), F.col("nb"), F.col("na")).alias("confidence"), *[c for c in d.columns if c != "words"])


@query(_CAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, id) AS k FROM c),
a AS (SELECT * FROM r WHERE k = 1), s AS (SELECT * FROM r WHERE k = 2)
SELECT a.item_id, a.id AS winner, a.confidence, CASE WHEN a.confidence < 0.8 THEN 'low' WHEN s.confidence IS NOT NULL AND a.work <> s.work AND (CASE WHEN a.confidence >= 1 THEN s.confidence >= 1 ELSE a.confidence - s.confidence <= 0.05 + 1e-9 END) THEN 'tie' ELSE 'accepted' END AS decision
FROM a LEFT JOIN s ON a.item_id = s.item_id""")
def candidate_rank_choose(spark, sf_dir):
    return rank.choose(_candidates(spark, sf_dir, rank.best(2)), "item_id", "work")


@query(_CAND + """SELECT item_id, id, CASE WHEN lang <> 'en' OR toxic = 1 THEN least(confidence, 0.5) ELSE confidence END AS confidence,
concat_ws(',', CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM c LEFT JOIN labels l ON l.doc_id = c.id""")
def candidate_veto(spark, sf_dir):
    c = _candidates(spark, sf_dir, more=table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic"))
    out = rank.vetoed(c, {"language": F.col("lang") != "en", "toxic": F.col("toxic") == 1})
    return out.select("item_id", "id", "confidence", F.array_join("reasons", ",").alias("reasons"))


@query(_CAND + """, r AS (SELECT *, nullif(CASE WHEN id % 2 = 0 THEN '' ELSE source END, '') AS publisher, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, id) AS k FROM c),
w AS (SELECT * FROM r WHERE k = 1),
f AS (SELECT w.item_id, arg_min(r.publisher, r.k) FILTER (WHERE r.publisher IS NOT NULL) AS p FROM w JOIN r ON r.item_id = w.item_id AND r.k > 1 AND w.confidence - r.confidence <= 0.05 + 1e-9 AND r.lang IS NOT DISTINCT FROM w.lang GROUP BY 1)
SELECT w.item_id, w.id, w.confidence, coalesce(w.publisher, f.p) AS publisher FROM w LEFT JOIN f ON f.item_id = w.item_id""")
def fill_from_near_equal(spark, sf_dir):
    c = _candidates(spark, sf_dir, rank.near_best).withColumn("publisher", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("source")))
    return rank.fill_winner(c, "item_id", "lang", ["publisher"])


@query(_CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, id) AS rank FROM c) SELECT item_id, id, confidence, rank FROM r WHERE rank <= 10")
def candidate_topk(spark, sf_dir):
    return rank.top(_candidates(spark, sf_dir, rank.best(10)), "item_id", 10, "confidence desc, id").select("item_id", "id", "confidence", *longs("rank"))


@query(_CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang, source ORDER BY id) AS k FROM c) SELECT item_id, id, lang, source FROM r WHERE k = 1")
def candidate_first_occurrence(spark, sf_dir):
    return rank.earliest(_candidates(spark, sf_dir), ["item_id", "lang", "source"], "id").select("item_id", "id", "lang", "source")


# identifiers ------------------------------------------------------------------------------------------------------------

_BODY = "lpad(CAST(p_partkey * 7919 AS VARCHAR), 12, '9')"
_EAN = f"CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({_BODY}, i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR)"


@query(f"""
SELECT p_partkey, {_BODY} || {_EAN} AS ean, substr({_BODY}, 12, 1) = {_EAN} AS repeated_digit,
CASE WHEN d = 10 THEN 'X' ELSE CAST(d AS VARCHAR) END AS isbn10_digit
FROM (SELECT p_partkey, CAST((11 - list_sum(list_transform(range(1, 10), lambda i: CAST(substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), i, 1) AS INTEGER) * (11 - i))) % 11) % 11 AS INTEGER) AS d FROM part)
""")
def isbn_ean_checksum(spark, sf_dir):
    body = F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "9")
    digit = identifiers.ean_check_digit(body)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(body, digit).alias("ean"), (F.substring(body, 12, 1) == digit).alias("repeated_digit"), identifiers.isbn10_check_digit(F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("isbn10_digit"))


@query("""
SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(https?://[^\\s"''<>]+)', 1))) AS INTEGER) AS n_urls,
array_to_string(list_sort(list_distinct(regexp_extract_all(html, '([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)', 1))), ' ') AS addresses FROM pages
""")
def doi_url_extract(spark, sf_dir):
    mails = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)"), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.size(identifiers.urls(F.col("html"))).alias("n_urls"), F.array_join(mails, " ").alias("addresses"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS n_links, array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1)[1:3], ' ') AS first_links FROM pages
""")
def html_title_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(links).alias("n_links"), F.array_join(F.slice(links, 1, 3), " ").alias("first_links"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_field_read(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


# keywords and names -----------------------------------------------------------------------------------------------------


@query(keywords.computed_sql(TITLE))
def keywords_topk(spark, sf_dir):
    docs = with_title(table(spark, sf_dir, "documents"))
    return keywords.computed(docs, F.col("title"), F.col("text"), "doc_id")


@query(keywords.language_sql(_tokens("text")))
def language_guess(spark, sf_dir):
    return keywords.language_guess(table(spark, sf_dir, "documents"), text.tokens(F.col("text")), "doc_id")


@query("""
WITH a AS (SELECT lower(n_name) AS surname, c_mktsegment AS given, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT surname, CAST(sum(k) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS given_names, arg_max(given, (k, given)) AS commonest FROM a GROUP BY surname HAVING sum(k) >= 2
""")
def author_dictionary(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    a = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.lower(text.fold(F.col("n_name"))).alias("surname"), F.col("c_mktsegment").alias("given")).agg(F.count("*").alias("k"))
    return a.groupBy("surname").agg(F.sum("k").alias("n"), F.count("*").alias("given_names"), F.max_by("given", F.struct("k", "given")).alias("commonest")).where("n >= 2")


_NAME = "CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ', ' || c_name WHEN c_custkey % 4 = 1 THEN c_name WHEN c_custkey % 4 = 2 THEN 'Maria van der ' || c_mktsegment ELSE c_mktsegment || ' University' END"


@query(f"""
WITH n AS (SELECT c_custkey, {_NAME} AS t FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN split_part(t, ', ', 1) WHEN 1 THEN t WHEN 2 THEN substr(t, 7) END AS surname, CASE c_custkey % 4 WHEN 0 THEN split_part(t, ', ', 2) WHEN 2 THEN 'Maria' END AS given, CASE c_custkey % 4 WHEN 3 THEN t END AS literal FROM n
""")
def person_parse(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_mktsegment", F.lit(", "), "c_name")).when(F.col("c_custkey") % 4 == 1, F.col("c_name")).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("Maria van der "), "c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" University")))
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("t")).select("c_custkey", names.person(F.col("t")).alias("p")).select("c_custkey", "p.*")


# sessions and groups ----------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2
""")
def sessionize_events(spark, sf_dir):
    s = grouping.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1800)
    return s.groupBy("user_id", *longs("session")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
r AS (SELECT user_id, island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2),
m AS (SELECT *, coalesce(n <= 2 AND lag(event_type) OVER w = lead(event_type) OVER w, false) AS inn FROM r WINDOW w AS (PARTITION BY user_id ORDER BY island)),
g AS (SELECT *, CASE WHEN island = 1 THEN 1 WHEN inn OR lag(inn) OVER w THEN 0 ELSE 1 END AS go FROM m WINDOW w AS (PARTITION BY user_id ORDER BY island))
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, n, CAST(sum(go) OVER (PARTITION BY user_id ORDER BY island) AS BIGINT) AS merged FROM g
""")
def sandwich_merge(spark, sf_dir):
    runs = grouping.islands(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return grouping.sandwich_merge(runs, "user_id", "event_type").select("user_id", *longs("island"), "event_type", "n", *longs("merged"))


@query("""
WITH n AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_size || ' ' || p_type), '[^a-z0-9]+'), lambda t: t <> '') AS w FROM part),
k AS (SELECT p_partkey, array_to_string(w[1 : coalesce(list_filter(range(2, len(w) + 1), lambda i: regexp_full_match(w[i], '[0-9]{1,3}'))[1] - 1, len(w))], ' ') AS key FROM n)
SELECT key, count(*) AS n, min(p_partkey) AS first FROM k WHERE length(regexp_replace(key, '[^a-z]', '', 'g')) >= 3 GROUP BY key
""")
def batch_key_grouping(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", grouping.batch_key(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), "p_type")).alias("key"))
    return p.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN n >= 6 AND hits < n * (1.0 / 3) THEN CAST(0 AS BIGINT) ELSE hits END AS released FROM g
""")
def group_protection(spark, sf_dir):
    return grouping.protected(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders) WHERE rank % 20 = 0")
def systematic_sample(spark, sf_dir):
    return grouping.systematic(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 20).select("o_orderkey", *longs("rank"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || n || ')' END AS unique_label FROM n
""")
def unique_labels(spark, sf_dir):
    return grouping.unique_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "unique_label")


@query("SELECT l_orderkey, substr(sha1(string_agg(l_partkey || ':' || CAST(l_quantity AS BIGINT), chr(10) ORDER BY l_partkey || ':' || CAST(l_quantity AS BIGINT))), 1, 16) AS signature FROM lineitem GROUP BY 1")
def folder_signature(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    return grouping.folder_signature(li, "l_orderkey", "l_partkey", "size")


# edits and merges -------------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, c_mktsegment, 'REVIEW' AS new_c_mktsegment, true AS changed FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'REVIEW'
UNION ALL SELECT c_custkey, c_mktsegment, c_mktsegment, false FROM customer WHERE c_acctbal >= 0
""")
def bulk_edit_before_after(spark, sf_dir):
    changes = {"c_mktsegment": ("replace", "REVIEW")}
    edit.validated(changes, ["c_mktsegment", "c_name"])
    return edit.bulk_edit(table(spark, sf_dir, "customer"), changes, F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment", "new_c_mktsegment", "changed")


@query("""
SELECT o_orderkey, CASE WHEN strong OR nd = '' OR starts_with(od, nd) AND length(od) > length(nd) THEN od ELSE nd END AS date, CASE WHEN op = '' THEN np WHEN strong OR np = '' THEN op ELSE np END AS priority
FROM (SELECT o_orderkey, o_orderstatus = 'F' AS strong, strftime(o_orderdate, '%Y-%m-%d') AS od, strftime(o_orderdate + INTERVAL (CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 400 END) DAY, '%Y') AS nd, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS op, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'new' END AS np FROM orders)
""")
def protected_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(k, (F.col("o_orderstatus") == "F").alias("strong"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("od"), F.date_format(F.when(k % 3 == 0, F.col("o_orderdate")).otherwise(F.col("o_orderdate") + F.expr("interval 400 days")), "yyyy").alias("nd"), F.when(k % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("op"), F.when(k % 5 == 0, "").otherwise("new").alias("np"))
    return rows.select("o_orderkey", edit.protect(F.col("od"), F.col("nd"), F.col("strong"), keep_precise=True).alias("date"), edit.protect(F.col("op"), F.col("np"), F.col("strong")).alias("priority"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders)
SELECT l_orderkey, l_linenumber, CASE WHEN before <> after AND l_linestatus = before THEN after ELSE l_linestatus END AS status, before <> after AND l_linestatus = before AS taken FROM lineitem JOIN c ON l_orderkey = o_orderkey
""")
def propagate_parent_change(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    changes = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("before"), F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("after"))
    parents = o.select(F.col("o_orderkey").alias("l_orderkey"))
    children = li.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("status")).join(parents, "l_orderkey", "left_semi")
    return edit.propagate(children, changes, "l_orderkey", "status").select("l_orderkey", "l_linenumber", "status", "taken")


@query("""
SELECT count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (WHERE l_returnflag = 'R') AS aside_files, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS aside_bytes,
floor(1000.0 * sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R') / sum(CAST(l_quantity AS BIGINT)) + 0.5) / 10.0 AS percent,
(1000.0 * sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R') / sum(CAST(l_quantity AS BIGINT)) > 100.0) AS over_limit FROM lineitem
""")
def space_report(spark, sf_dir):
    size, aside = F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R"
    r = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(aside).alias("aside_files"), F.sum(F.when(aside, size)).alias("aside_bytes"))
    part = F.lit(1000.0) * F.col("aside_bytes") / F.col("bytes")
    return r.select("*", (F.floor(part + 0.5) / 10.0).alias("percent"), (part > 100).alias("over_limit"))


@query("""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '> ' || text ELSE text END || ' (' || turn || ') #' || role, chr(10) ORDER BY turn, role, text) AS notes, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
""")
def conversation_notes_export(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"), F.count("*").alias("n"))
    md = F.transform("x", lambda t: F.concat(F.when(t["role"] == "user", F.concat(F.lit("> "), t["text"])).otherwise(t["text"]), F.lit(" ("), t["turn"].cast("string"), F.lit(") #"), t["role"]))
    return g.select("conv_id", F.array_join(md, "\n").alias("notes"), "n")


# streams ----------------------------------------------------------------------------------------------------------------


def _drained(spark, sf_dir, build, mode: str) -> DataFrame:
    base = f"{components.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    static = table(spark, sf_dir, "events")  # a pattern also admits a table that is one file
    stream = ingest.watched(spark, f"{sf_dir}/event[s].parquet", static.schema.simpleString()[7:-1].replace(":", " "), "parquet")
    ingest.drained(build(stream.withColumn("ts", F.col("ts").cast("timestamp"))), f"{base}/out", mode, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) + 1800000000 AS BIGINT) AS end_us FROM s GROUP BY user_id, session
""")
def stream_sessions(spark, sf_dir):
    out = _drained(spark, sf_dir, lambda s: ingest.sessions(s, "user_id", "ts", "30 minutes", "1 hour"), "complete")
    return out.select("user_id", "n", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """A key is forgotten 40 days after it was first seen, so the state is that of 40 days; the table holds 30."""
    keyed = lambda s: s.select("user_id", "event_type", "ts", F.concat_ws("/", "user_id", "event_type").alias("key"))
    return _drained(spark, sf_dir, lambda s: ingest.first_seen(keyed(s), "key", "ts", "40 days").select("user_id", "event_type"), "append")


@query("""
WITH e AS (SELECT user_id, length(event_type) AS size, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS t, ts FROM events),
c AS (SELECT *, CASE WHEN size IS DISTINCT FROM lag(size) OVER w THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, size)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, size ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT user_id, run, min(size) AS size, min(t) AS since, max(t) AS last FROM g GROUP BY 1, 2),
n AS (SELECT *, lead(since) OVER (PARTITION BY user_id ORDER BY run) AS next FROM r)
SELECT CAST(user_id AS VARCHAR) AS path, size, since AS since_ms FROM n WHERE greatest(last, coalesce(next, 0)) >= since + 43200000 OR next IS NULL AND since + 43200000 < (SELECT max(t) - 3600000 FROM e)
""")
def settled_files(spark, sf_dir):
    """Events as listings of a file for each user, as large as the event's name is long; at rest after half a day."""
    seen = lambda s: s.select(F.col("user_id").cast("string").alias("path"), F.length("event_type").alias("size"), "ts")
    out = _drained(spark, sf_dir, lambda s: ingest.settled(seen(s), 43_200, "1 hour"), "append")
    return out.select("path", "size", F.unix_millis("since").alias("since_ms"))
