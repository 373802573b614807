"""Queries that hold single column rules against SQL on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import dates, identifiers, names, rules, similarity, text
from folioscope.plans.catalogue import _norm, query, table


@query("""
SELECT page_id, '10.' || CAST(1000 + page_id AS VARCHAR) || '/ab.' || CAST(page_id AS VARCHAR) || ' 10.5555/x(' || CAST(page_id % 7 AS VARCHAR) AS dois FROM pages
""")
def doi_extract(spark, sf_dir):
    k = F.col("page_id").cast("string")
    body = F.concat(F.lit("see doi:10."), (F.col("page_id") + 1000).cast("string"), F.lit("/AB."), k, F.lit("), and again 10."), (F.col("page_id") + 1000).cast("string"), F.lit("/ab."), k, F.lit(". <10.5555/X("), (F.col("page_id") % 7).cast("string"), F.lit(");>"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(identifiers.dois(body), " ").alias("dois"))


@query("""
WITH n AS (SELECT p_partkey, p_size AS n FROM part)
SELECT p_partkey, n AS value, CAST(floor((1400 + n * 10 - 1) / 100) + 1 AS INTEGER) AS century,
CASE WHEN n * 97 >= 3600 THEN CAST(n * 97 // 3600 AS VARCHAR) || ':' || lpad(CAST((n * 97 // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((n * 97) % 60 AS VARCHAR), 2, '0') ELSE CAST(n * 97 // 60 AS VARCHAR) || ':' || lpad(CAST((n * 97) % 60 AS VARCHAR), 2, '0') END AS duration FROM n
""")
def roman_century_duration(spark, sf_dir):
    tens, ones = (F.split(F.lit(x), ",") for x in (",X,XX,XXX,XL,L", ",I,II,III,IV,V,VI,VII,VIII,IX"))
    n = F.col("p_size")
    numeral = F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.get(ones, n % 10))
    return table(spark, sf_dir, "part").select("p_partkey", dates.roman(numeral).alias("value"), dates.century(n * 10 + 1400).alias("century"), dates.duration(n * 97).alias("duration"))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 3 = 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS m, o_orderkey % 3 = 1 AS circa, CAST(NULL AS VARCHAR) AS literal,
o_orderkey % 3 = 0 AS more, o_orderkey % 2 = 0 AS years_ok FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT o_orderkey, NULL, NULL, false, 'undated', false, true FROM orders WHERE o_orderkey % 3 = 2
""")
def free_dates(spark, sf_dir):
    k, y = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    d = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k % 3 == 1, F.concat(F.lit("about "), y)).otherwise("undated")
    other = F.when(k % 2 == 0, F.concat(F.lit("in "), y)).otherwise("in 1066")
    x = dates.csl_date(d)
    return table(spark, sf_dir, "orders").select("o_orderkey", x["y"].alias("y"), x["m"].alias("m"), x["circa"].alias("circa"), x["literal"].alias("literal"), dates.more_precise(d, F.when(k % 3 == 0, y).otherwise("x")).alias("more"), similarity.years_ok(d, other).alias("years_ok"))


@query("""
SELECT c_custkey, array_to_string([c_mktsegment, c_name, 'Ana', 'Rui'], '|') AS artists, c_custkey % 3 = 0 AS institution FROM customer
""")
def artists_and_institutions(spark, sf_dir):
    t = F.concat("c_mktsegment", F.lit(", "), "c_name", F.lit(" feat. Ana & Rui"))
    owner = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Library of "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(names.split_artists(t), "|").alias("artists"), rules.institution(owner).alias("institution"))


@query(f"""
SELECT doc_id, {_norm("text")} AS normal, length(trim(coalesce(lang, ''))) = 0 AS blank FROM documents WHERE text IS NOT NULL
""")
def normalised_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.normalise(F.col("text")).alias("normal"), text.is_blank(F.col("lang")).alias("blank"))


@query("""
SELECT n_nationkey, 'The ' || n_name || ' of {other}' AS label, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_values FROM nation
""")
def templates_and_maps(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("comment"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(""), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.filled(F.lit("The {name} of {other}"), text.drop_empty(m)).alias("label"), F.size(text.drop_empty(m)).alias("n_values"))


@query("SELECT page_id, page_id % 4 = 0 AS safe FROM pages")
def safe_paths(spark, sf_dir):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, "a/b/c.txt").when(k % 4 == 1, "/a/b").when(k % 4 == 2, "a/../b").otherwise("a//b")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_path(path).alias("safe"))
