"""Queries for files, names, rules, references and upkeep of the catalogue, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import rules, text
from folioscope.operators import components, dedup, grouping, registry
from folioscope.plans.catalogue import _PAIRS, _fingerprint_pairs, query, table
from folioscope.sources import exports

# names and rules --------------------------------------------------------------------------------------------------------

_URLPATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '')"


@query(f"""
SELECT page_id, coalesce(regexp_extract({_URLPATH}, '([^/]*)$', 1), '') AS name, len(list_filter(string_split({_URLPATH}, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe,
length({_URLPATH}) > 240 OR len(list_filter(string_split({_URLPATH}, '/'), lambda p: regexp_matches(p, '[<>:"|?*]') OR regexp_matches(p, '[. ]$'))) > 0 AS bad FROM pages
""")
def file_name_rules(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(path, "([^/]*)$", 1).alias("name"), text.safe_path(path).alias("safe"), rules.bad_file_name(path).alias("bad"))


_WORK = "CASE p_partkey % 4 WHEN 0 THEN 'Sonata in C minor, BWV ' || p_size WHEN 1 THEN 'Concerto in G, RV. ' || p_size || ' ' || p_name WHEN 2 THEN 'Two fugues Op. ' || p_size ELSE p_name END"


@query(f"""
WITH w AS (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'BWV ' || p_size WHEN 1 THEN 'RV ' || p_size WHEN 2 THEN 'Op.' || p_size END AS number, CASE k WHEN 0 THEN 'C minor' WHEN 1 THEN 'G major' END AS key, CASE k WHEN 0 THEN 'sonata' WHEN 1 THEN 'concerto' END AS form FROM w
""")
def catalogue_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_WORK).alias("t"))
    return p.select("p_partkey", rules.catalogue_number(F.col("t")).alias("number"), rules.key_of_title(F.col("t")).alias("key"), rules.form_of_title(F.col("t")).alias("form"))


_PRINTED = "CASE p_partkey % 8 WHEN 0 THEN 'Partita BWV Anh. ' || p_size WHEN 1 THEN 'Trio, Hob. XV : ' || p_size WHEN 2 THEN 'Rondo KV ' || p_size || 'a' WHEN 3 THEN 'Duo_Wq_' || p_size WHEN 4 THEN 'Aria Z ' || (p_size + 10) || ' and RV ' || p_size WHEN 5 THEN 'Ouverture TWV 55 D ' || p_size WHEN 6 THEN 'Quartets op. 59, no. II, and Op. ' || p_size ELSE 'Fantazias 20-' || p_size END"


@query("""
WITH n AS (SELECT p_partkey, p_size AS s, p_partkey % 8 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'BWV Anh.' || s WHEN 1 THEN 'Hob.XV:' || s WHEN 2 THEN 'K.' || s || 'a' WHEN 3 THEN 'Wq.' || s WHEN 4 THEN 'RV ' || s WHEN 5 THEN 'TWV 55:D' || s WHEN 6 THEN 'Op.59 No.2' END AS number,
CASE k WHEN 0 THEN 'BWV Anh.' || s WHEN 1 THEN 'Hob.XV:' || s WHEN 2 THEN 'K.' || s || 'a' WHEN 3 THEN 'Wq.' || s WHEN 4 THEN 'RV ' || s || ' Z.' || (s + 10) WHEN 5 THEN 'TWV 55:D' || s WHEN 6 THEN CASE WHEN s = 59 THEN 'Op.59' ELSE 'Op.59 Op.' || s END ELSE '' END AS numbers,
CASE k WHEN 0 THEN 'Bach' WHEN 1 THEN 'Haydn' WHEN 2 THEN 'Mozart' WHEN 3 THEN 'Bach' WHEN 4 THEN 'Vivaldi' WHEN 5 THEN 'Telemann' END AS owner, k = 7 AND s > 20 AS several FROM n
""")
def catalogue_number_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PRINTED).alias("t"))
    number = rules.catalogue_number(F.col("t"))
    return p.select("p_partkey", number.alias("number"), F.array_join(rules.catalogue_numbers(F.col("t")), " ").alias("numbers"), rules.catalogue_owner(number).alias("owner"), rules.number_range(F.col("t")).alias("several"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment END AS author, CASE c_custkey % 3 WHEN 0 THEN CAST(1900 + c_nationkey AS INTEGER) WHEN 2 THEN CAST(1900 + c_nationkey AS INTEGER) END AS year,
'On some matters' AS title, c_custkey % 3 = 2 AS probable FROM customer
""")
def file_name_parser(spark, sf_dir):
    y = (F.col("c_nationkey") + 1900).cast("string")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit("_"), y, F.lit("_On some_matters.pdf"))).when(F.col("c_custkey") % 3 == 1, F.concat("c_mktsegment", F.lit(" - On some matters.PDF"))).otherwise(F.concat(F.lit("("), y, F.lit(") On some  matters.djvu")))
    return table(spark, sf_dir, "customer").select("c_custkey", rules.file_name_parts(name).alias("x")).select("c_custkey", "x.*")


@query("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Porto' END AS place, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN n_name END AS publisher, CASE n_nationkey % 3 WHEN 0 THEN '1999' END AS date FROM nation
""")
def imprint_split(spark, sf_dir):
    s = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Porto : "), "n_name", F.lit(", 1999."))).when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise("[s.n.]")
    return table(spark, sf_dir, "nation").select("n_nationkey", rules.imprint(s).alias("x")).select("n_nationkey", "x.*")


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(lower(p_name), 2) || ' XIV' AS title, len(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) > 1 AND w <> 'new'))) < 2 AS generic FROM part")
def case_repair(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.case_repaired(F.concat(F.upper("p_name"), F.lit(" XIV"))).alias("title"), rules.generic_name(F.col("p_name")).alias("generic"))


@query("""
WITH n AS (SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || '_' || CASE WHEN p_size % 5 = 0 THEN '0000' ELSE CAST(1900 + p_size AS VARCHAR) END || '_' || replace(p_name, ' ', '-') AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS file_name FROM r
""")
def file_naming_collisions(spark, sf_dir):
    year = F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") + 1900)
    p = table(spark, sf_dir, "part").select("p_partkey", rules.file_values(F.col("p_brand"), year, F.col("p_name")).alias("name"))
    k = p.withColumn("k", F.expr("row_number() over (partition by name order by p_partkey)"))
    return k.select("p_partkey", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("k").cast("string"))).alias("file_name"))


@query("""
SELECT p_partkey, array_to_string(list_filter([lower(p_brand), 'doe', 'jane doe', 'J. Doe', p_type], lambda k: NOT list_contains(['jane doe', 'doe jane', 'doe', 'j doe', 'doe j'], trim(regexp_replace(lower(k), '[^a-z0-9]+', ' ', 'g')))), ',') AS keywords FROM part
""")
def owner_keywords_removed(spark, sf_dir):
    k = F.array(F.lower("p_brand"), F.lit("doe"), F.lit("jane doe"), F.lit("J. Doe"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rules.without_owner(k, "Jane Doe"), ",").alias("keywords"))


_SCORE = "CASE WHEN yq IS NULL OR yc IS NULL THEN 0.15 WHEN yq = yc THEN 0.35 ELSE -0.3 END + CASE WHEN f IS NULL THEN 0.15 WHEN f THEN 0.25 ELSE 0.0 END + 0.4 * s"


@query(f"""
WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE year(o_orderdate) END AS yq, 1997 AS yc, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'O' END AS f, (o_orderkey % 11) / 10.0 AS s, o_orderstatus = 'P' AS d FROM orders)
SELECT o_orderkey, CAST(floor(greatest(0.0, least(0.96, CAST(CASE WHEN d THEN ({_SCORE}) * 0.7 ELSE {_SCORE} END AS DOUBLE))) * 100 + 0.5) / 100.0 AS DOUBLE) AS score FROM (SELECT * REPLACE (CAST(s AS DOUBLE) AS s) FROM q)
""")
def music_score(spark, sf_dir):
    k = F.col("o_orderkey")
    s = rules.music_score(F.when(k % 9 != 0, F.year("o_orderdate")), F.lit(1997), F.when(k % 5 != 0, F.col("o_orderstatus") == "O"), (k % 11) / 10.0, F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("score"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS pa, CAST(l_quantity AS INTEGER) + l_linenumber % 4 AS pb, l_suppkey % 60 AS low, l_partkey % 150 AS high FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(pa - pb) > 2 OR high > 120 OR (pa <> pb AND (least(pa, pb) < 2 OR low > 40)) THEN 'different' WHEN pa = pb AND low <= 20 AND high <= 50 AND pa % 3 <> 0 THEN 'certain' ELSE 'doubtful' END AS verdict FROM p
""")
def document_verdict(spark, sf_dir):
    a = F.col("l_quantity").cast("int")
    v = rules.verdict(a, a + F.col("l_linenumber") % 4, F.col("l_suppkey") % 60, F.col("l_partkey") % 150, a % 3 == 0, F.lit(True))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("verdict"))


# upkeep -----------------------------------------------------------------------------------------------------------------


@query("SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem), (SELECT max(ts) FROM events)) AS last_update")
def last_update(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.max(c).alias("u")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return parts[0].union(parts[1]).union(parts[2]).agg(F.max("u").alias("last_update"))


@query("""
WITH m AS (SELECT max(c_custkey) AS m FROM customer WHERE c_acctbal >= 0)
SELECT c_custkey, m + row_number() OVER (ORDER BY c_custkey) AS number FROM customer, m WHERE c_acctbal < 0
""")
def next_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = grouping.systematic(c.where("c_acctbal < 0").select("c_custkey"), "c_custkey", 1)
    top = c.where("c_acctbal >= 0").agg(F.max("c_custkey")).first()[0] or 0
    return new.select("c_custkey", (F.lit(top) + F.col("rank")).cast("long").alias("number"))


@query("SELECT lower(p_name) || '/' || lower(p_brand) AS path, count(*) AS n, array_to_string(list_sort(list(p_partkey)), ',') AS parts FROM part GROUP BY 1 HAVING count(*) > 1")
def case_clashes(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", F.lower("p_name"), F.lower("p_brand")).alias("path")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("parts"))
    return p.where("n > 1")


@query("""
WITH RECURSIVE k AS (SELECT c_custkey AS id, 'b' || CAST(floor(c_acctbal / 2) AS BIGINT) AS code FROM customer UNION ALL SELECT c_custkey, 'n' || CAST(floor((c_acctbal + 1) / 2) AS BIGINT) FROM customer),
e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.code = b.code AND a.id <> b.id),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id, min(root) AS component_id FROM r GROUP BY id
""")
def shared_code_groups(spark, sf_dir):
    c, bal = table(spark, sf_dir, "customer"), F.col("c_acctbal")
    codes = c.select(F.col("c_custkey").alias("id"), F.explode(F.array(F.concat(F.lit("b"), F.floor(bal / 2).cast("string")), F.concat(F.lit("n"), F.floor((bal + 1) / 2).cast("string")))).alias("code"))
    # all that share a code hang on its smallest: as many edges as rows, however many share it
    low = codes.groupBy("code").agg(F.min("id").alias("b"))
    return components.connected_components(codes.join(low, "code").select(F.col("id").alias("a"), "b"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus || l_returnflag) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, n, CASE WHEN n = d AND n >= 2 THEN 'group' ELSE 'single' END AS kept_as FROM g
""")
def part_grouping(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct(F.concat("l_linestatus", "l_returnflag")).alias("d"))
    return g.select("l_orderkey", "n", F.when((F.col("n") == F.col("d")) & (F.col("n") >= 2), "group").otherwise("single").alias("kept_as"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS turn FROM events")
def priority_queue(spark, sf_dir):
    turn = F.expr("row_number() over (partition by user_id order by case when event_type = 'error' then 0 else 1 end, event_id)")
    return table(spark, sf_dir, "events").select("user_id", "event_id", turn.cast("long").alias("turn"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20")
def largest_first(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(50)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 48")
def newest_kept(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(48)


@query(f"WITH {_PAIRS} SELECT a, b FROM q WHERE (a + b) % 3 <> 0")
def undecided_pairs(spark, sf_dir):
    pairs = _fingerprint_pairs(spark, sf_dir).select("a", "b")
    decided = pairs.where((F.col("a") + F.col("b")) % 3 == 0).select(F.col("b").alias("x"), F.col("a").alias("y"))  # written in either order
    key = lambda p, q: F.array_sort(F.array(p, q))
    return pairs.withColumn("k", key("a", "b")).join(decided.select(key("x", "y").alias("k")), "k", "left_anti").select("a", "b")


@query("""
WITH r AS (SELECT o_orderkey, unnest(regexp_extract_all('see #' || o_custkey || ' and #' || (o_orderkey % 50), '#([0-9]+)', 1)) AS n FROM orders)
SELECT c_custkey, count(DISTINCT o_orderkey) AS n FROM r JOIN customer ON c_custkey = CAST(r.n AS BIGINT) GROUP BY 1
""")
def references_to_records(spark, sf_dir):
    notes = F.concat(F.lit("see #"), F.col("o_custkey").cast("string"), F.lit(" and #"), (F.col("o_orderkey") % 50).cast("string"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array_distinct(F.regexp_extract_all(notes, F.lit("#([0-9]+)"), F.lit(1)))).alias("c")).withColumn("c_custkey", F.col("c").cast("long"))
    return r.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN l_returnflag || ' ' || l_linestatus || ' x y' WHEN 1 THEN l_returnflag || ' ' || l_linestatus ELSE l_returnflag || ' z' END AS key FROM lineitem),
k AS (SELECT * FROM (VALUES ('A F', 1), ('R', 2), ('N O x', 3)) AS t(key, id)),
e AS (SELECT *, unnest(range(1, len(string_split(key, ' ')) + 1)) AS m FROM b),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, m, id FROM e JOIN k ON k.key = array_to_string(string_split(e.key, ' ')[1:m], ' '))
SELECT l_orderkey, l_linenumber, l_partkey, arg_max(id, m) AS id FROM f GROUP BY ALL
""")
def shortening_key_lookup(spark, sf_dir):
    key = F.when(F.col("l_linenumber") % 3 == 0, F.concat_ws(" ", "l_returnflag", "l_linestatus", F.lit("x y"))).when(F.col("l_linenumber") % 3 == 1, F.concat_ws(" ", "l_returnflag", "l_linestatus")).otherwise(F.concat_ws(" ", "l_returnflag", F.lit("z")))
    known = spark.createDataFrame([("A F", 1), ("R", 2), ("N O x", 3)], "key string, id int")  # the batches there are
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.split(key, " ").alias("w"))
    e = b.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda m: F.struct(m.alias("m"), F.array_join(F.slice("w", F.lit(1), m), " ").alias("key")))).alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "x.*")
    found = e.join(F.broadcast(known), "key").drop("key")  # a few keys are those of all rows, so rows are not dealt by key
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max_by("id", "m").alias("id"))


@query("""
WITH t AS (SELECT p_name, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p_partkey, CASE WHEN n = 1 THEN target END AS target, coalesce(n, 0) > 1 AS ambiguous FROM part LEFT JOIN t ON part.p_name = t.p_name
""")
def unique_name_linkage(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.where("p_size > 45").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("target"))
    return p.join(t, "p_name", "left").select("p_partkey", F.when(F.col("n") == 1, F.col("target")).alias("target"), (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


@query("""
SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(c_name, s_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation, concat_ws('+', CASE WHEN c_custkey IS NOT NULL THEN 'customer' END, CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' END) AS sources
FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) FULL JOIN supplier ON c_custkey = s_suppkey
""")
def merged_catalogues(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), table(spark, sf_dir, "supplier")
    j = c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "full_outer")
    return j.select(F.coalesce("c_custkey", "s_suppkey").alias("id"), F.coalesce("c_name", "s_name").alias("name"), F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.concat_ws("+", F.when(F.col("c_custkey").isNotNull(), "customer"), F.when(F.col("s_suppkey").isNotNull(), "supplier")).alias("sources"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 250000) AS high, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("high"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_tolerant(spark, sf_dir):
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(broken, "k long")["k"], F.lit(-1)).cast("long").alias("k"))


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber, CAST(0 AS INTEGER) AS level FROM lineitem WHERE l_quantity > 40 GROUP BY 1 UNION ALL SELECT l_orderkey, min(l_linenumber), 1 FROM lineitem WHERE l_quantity < 10 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) GROUP BY 1")
def identifier_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    catalogues = [li.where(c).select("l_orderkey", "l_linenumber") for c in ("l_quantity > 40", "l_quantity < 10")]
    return registry.by_identifier(li.select("l_orderkey"), catalogues, "l_orderkey")


@query("WITH i AS (SELECT CAST(unnest([9, 3, 77, 3, 100000000]) AS BIGINT) AS o_orderkey, CAST(unnest(range(1, 6)) AS BIGINT) AS pos) SELECT pos, o_orderkey, o_totalprice FROM i JOIN orders USING (o_orderkey)")
def scan_by_ids(spark, sf_dir):
    ids = spark.createDataFrame([(k, i) for i, k in enumerate([9, 3, 77, 3, 100000000], 1)], "o_orderkey long, pos long")  # a list the user gives
    return table(spark, sf_dir, "orders").join(F.broadcast(ids), "o_orderkey").select("pos", "o_orderkey", "o_totalprice").orderBy("pos")


@query("""
SELECT s_suppkey, 'TY  - BOOK' || chr(10) || 'TI  - ' || s_name || chr(10) || 'AU  - ' || n_name || ', ' || s_suppkey || chr(10) || 'PY  - ' || (1900 + s_nationkey) || chr(10) || 'PB  - ' || n_name || chr(10) || 'ER  - ' AS entry FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def ris_export(spark, sf_dir):
    j = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nothing = F.lit(None).cast("string")
    r = j.select(F.col("s_suppkey").alias("id"), F.lit("book").alias("type"), F.col("s_name").alias("title"), F.array(F.struct(F.col("n_name").alias("surname"), F.col("s_suppkey").cast("string").alias("given"))).alias("authors"), (F.col("s_nationkey") + 1900).alias("year"), F.col("n_name").alias("publisher"), nothing.alias("place"), nothing.alias("doi"), nothing.alias("isbn"), nothing.alias("url"))
    return exports.ris(r).withColumnRenamed("id", "s_suppkey")


@query("SELECT CAST(ceil(doc_id / 100.0) AS BIGINT) AS block, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text <> '' GROUP BY 1")
def text_block_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''")
    return d.groupBy(F.ceil(F.col("doc_id") / exports.BLOCK).cast("long").alias("block")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("""
WITH d AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kept FROM lineitem GROUP BY 1), x AS (SELECT o_orderkey, o_orderpriority AS tag FROM orders WHERE o_orderkey % 3 = 0)
SELECT l_orderkey, CASE WHEN tag IS NULL THEN kept ELSE kept || ',' || tag END AS tags FROM d LEFT JOIN x ON l_orderkey = o_orderkey
""")
def merged_tags(spark, sf_dir):
    keep = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("tags"))
    drop = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_orderpriority").alias("tags"))
    return dedup.merged(keep, drop, "l_orderkey", [], ["tags"]).select("l_orderkey", F.array_join("tags", ",").alias("tags"))


@query("""
WITH f AS (SELECT p_partkey, p_name || ' ' || p_size AS name FROM part)
SELECT p_partkey, CASE WHEN contains(name, 'red') THEN 0 ELSE 1 END AS weight, array_to_string(list_transform(string_split(name, ' '), lambda t: CASE WHEN regexp_full_match(t, '[0-9]{1,8}') THEN lpad(t, 8, '0') ELSE t END), ' ') AS key FROM f
""")
def page_order(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(name.contains("red"), 0).otherwise(1).alias("weight"), text.padded(name).alias("key"))


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)")
def unowned_files(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(used, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


