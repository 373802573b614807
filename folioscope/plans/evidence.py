"""Queries that hold rules, readers and workflows against SQL: each applies them to texts made from a table's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import evidence, identifiers, names, pages, rules, text, wiki
from folioscope.operators import clusters, edit, grouping, keywords, rank, registry, sigla
from folioscope.operators.components import stored
from folioscope.plans import workflows
from folioscope.plans.catalogue import _norm, _words, query, spread, table
from folioscope.sources import exports, records
from folioscope.streaming import ingest


def dealt(key: str, *values: Column | str) -> Column:
    """The value whose place is the key modulo their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col(key) % len(values) == i, v).otherwise(out)
    return out


def _person(surname: Column | str | None, given: str | None, role: Column | str | None = None, literal: Column | None = None) -> Column:
    parts = {"literal": literal, "surname": surname, "given": given, "role": role}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in parts.items()])


# files, titles, texts ---------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'document' WHEN 2 THEN 'document' WHEN 4 THEN 'image' ELSE 'other' END AS category, p_partkey % 5 IN (1, 2, 3) AS ignored,
p_partkey % 5 IN (0, 2) OR p_partkey % 5 = 4 AND p_size * 2500 >= 61440 AS source, p_name AS base FROM part
""")
def file_tests(spark, sf_dir):
    n = F.col("p_name")
    name = dealt("p_partkey", F.concat(n, F.lit(".pdf")), F.concat(F.lit("."), n, F.lit(".")), F.concat(F.lit("~$"), n, F.lit(".docx")), F.concat(n, F.lit(".part")), F.concat(n, F.lit(".JPG")))
    p = table(spark, sf_dir, "part").withColumn("file", name).withColumn("category", ingest.category("file"))
    page = F.concat(n, F.lit("_0"), F.col("p_size").cast("string"))
    return p.select("p_partkey", "category", rules.ignored_file(F.col("file")).alias("ignored"), rules.source_file(F.col("category"), F.col("p_size") * 2500).alias("source"), grouping.base_name(page).alias("base"))


@query("""
SELECT c_custkey, c_custkey % 6 = 0 AS internal, c_custkey % 6 NOT IN (3, 5) AS useful, c_custkey % 6 IN (0, 3, 4) AS plausible, c_custkey % 3 = 0 AS person FROM customer
""")
def title_tests(spark, sf_dir):
    t = dealt("c_custkey", "Table of contents", "glo - ri - a in ex", "P-Cug MM 44", "Microsoft Word - draft", F.col("c_mktsegment"), "12 34")
    who = dealt("c_custkey", F.concat(F.lit("Ana van "), F.initcap("c_mktsegment")), "the red book", "Coimbra University")
    return table(spark, sf_dir, "customer").select("c_custkey", rules.internal_title(t).alias("internal"), evidence.useful_title(t).alias("useful"), evidence.plausible_title(t).alias("plausible"), rules.person_like(who).alias("person"))


@query("""
SELECT o_orderkey, 2 * (o_orderkey % 200) > 100 * least(o_orderkey % 5 + 1, 3) AS useful, o_orderkey % 40 >= 25 OR o_orderkey % 40 > 0.15 * (o_orderkey % 40 + 4) AS musical FROM orders
""")
def text_layer_tests(spark, sf_dir):
    k = F.col("o_orderkey")
    glyphs = F.concat(F.repeat(F.lit("&# "), (k % 40).cast("int")), F.lit("some words of text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.useful_text(F.repeat(F.lit("ab "), (k % 200).cast("int")), k % 5 + 1).alias("useful"), evidence.musical_text(glyphs).alias("musical"))


@query(f"""
WITH w AS (SELECT p_partkey, p_name, {_words("p_name")} AS a, {_words("split_part(p_name, ' ', 1) || ' and some other matter'")} AS b FROM part)
SELECT p_partkey, {_norm("p_name")} AS core, 2 * len(list_intersect(a, b)) >= least(len(a), len(b)) AS compatible FROM w
""")
def title_cores(spark, sf_dir):
    t = F.concat("p_name", F.lit(" (arranged) BWV "), F.col("p_size").cast("string"))
    other = F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit(" and some other matter"))
    return table(spark, sf_dir, "part").select("p_partkey", evidence.core_title(t).alias("core"), evidence.titles_compatible(F.col("p_name"), other).alias("compatible"))


@query("SELECT c_custkey, 'aesop oeuvre strasse ' || lower(c_mktsegment) AS reader, 'iulius ' || translate(lower(c_mktsegment), 'vj', 'ui') AS latin, 'Asop ' || c_mktsegment AS folded FROM customer")
def spellings(spark, sf_dir):
    s = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.reader_normalise(F.concat(F.lit("Æſop Œuvre, Straße: "), s)).alias("reader"), text.latin(F.concat(F.lit("Jvlivs "), s)).alias("latin"), text.fold(F.concat(F.lit("Äsóp "), s)).alias("folded"))


@query("SELECT p_partkey, p_name || ' ' || p_brand || '.|' || p_type AS entries FROM part")
def joined_entries(spark, sf_dir):
    lines = F.array(F.concat(F.lit("  "), "p_name"), F.concat("p_brand", F.lit(".")), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(evidence.joined_lines(lines), "|").alias("entries"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'author' ELSE 'catalogue' END AS origin, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) || '|' || p_brand ELSE p_type END AS words FROM part
""")
def keyword_cascade(spark, sf_dir):
    printed = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Abstract\nKeywords: "), F.lower("p_name"), F.lit("; "), "p_brand")).otherwise("Abstract")
    x = keywords.cascade(("author", keywords.author_keywords(printed)), ("catalogue", F.array("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.origin", F.array_join("x.words", "|").alias("words"))


# evidence ---------------------------------------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS printed, 1700 + o_orderkey % 300 AS yr, 1750 + o_orderkey % 40 AS yf FROM orders),
m AS (SELECT o_orderkey AS k, printed OR yr >= 1800 AND yr > yf + 25 AS modern, printed = (o_orderkey % 2 = 0) AS contradiction FROM k)
SELECT k AS o_orderkey, modern, contradiction, CASE WHEN contradiction THEN 'review' WHEN k % 5 <> 0 AND k % 7 <> 0 AND (k % 11 <> 0 OR modern) OR k % 13 = 0 THEN 'complete' ELSE 'review' END AS state FROM m
""")
def record_states(spark, sf_dir):
    k = F.col("o_orderkey")
    form, support = dealt("o_orderkey", "printed", "manuscript", "autograph"), dealt("o_orderkey", "manuscript", "print")
    modern, against = rules.modern_edition(form, k % 300 + 1700, k % 40 + 1750), rules.form_contradiction(form, support)
    authors = F.when(k % 7 != 0, F.array(_person("Doe", "J"))).otherwise(F.slice(F.array(_person("Doe", "J")), 1, 0))
    state = evidence.state(F.when(k % 5 != 0, "A title").otherwise(" "), authors, F.when(k % 11 != 0, "1999"), modern, against, k % 13 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", modern.alias("modern"), against.alias("contradiction"), state.alias("state"))


@query("""
WITH p AS (SELECT n_nationkey, n_nationkey % 3 = 0 AS lib, n_name FROM nation)
SELECT n_nationkey, CASE WHEN lib THEN n_name || ' Library' ELSE n_name END AS principal, 'Ed, X; ' || CASE WHEN lib THEN n_name || ' Library' ELSE n_name || ', A' END AS display, 'Ed, X et al.' AS short,
CASE WHEN n_nationkey % 2 = 0 THEN 'Ed' ELSE n_name || '|Ed' END AS academic FROM p
""")
def author_rules(spark, sf_dir):
    k = F.col("n_nationkey")
    a = F.array(_person("Ed", "X", "translator"), _person(F.col("n_name"), "A", F.when(k % 2 == 0, "editor"), F.when(k % 3 == 0, F.concat("n_name", F.lit(" Library")))))
    study = evidence.academic_authors(F.array(_person(F.col("n_name"), "A", "composer"), _person("Ed", "X")), F.when(k % 2 == 0, F.concat(F.lit("The motets of "), "n_name")).otherwise("The motets"))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.principal(a).alias("principal"), names.display(a).alias("display"), names.display(a, 1).alias("short"), F.array_join(F.transform(study, lambda p: p["surname"]), "|").alias("academic"))


@query("""
SELECT p_partkey, 'ABC ' || (100 + p_size) AS label, CAST(1950 + p_size AS INTEGER) AS rights, CASE p_partkey % 3 WHEN 0 THEN 'lp' WHEN 1 THEN 'cd' END AS medium, p_partkey % 4 = 0 OR p_partkey % 3 = 0 AS confirmed,
CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 > 1 THEN 'denied' WHEN p_partkey % 5 <> 0 OR p_partkey % 2 = 1 THEN 'confirmed' ELSE 'open' END AS edition,
p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 AND CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 11 >= 8 ELSE p_partkey % 7 < 4 END AS replaces FROM part
""")
def codes_and_editions(spark, sf_dir):
    k = F.col("p_partkey")
    printed = F.concat(F.lit("ABC "), (F.col("p_size") + 100).cast("string"), dealt("p_partkey", " LP ", " CD ", " tape "), F.lit("℗ "), (F.col("p_size") + 1950).cast("string"))
    seen = F.concat("p_name", F.lit(" played by Anabela"))
    sure = evidence.code_confirmed(k % 4 == 0, F.when(k % 3 == 0, "Anabela Sousa").otherwise("Rui Melo"), F.lit("zz yy"), seen)
    edition = evidence.edition_confirmed(F.lit(1990), F.when(k % 5 != 0, k % 4 + 1990), F.lit("AB-1"), F.when(k % 2 == 1, "ab 1"), F.lit("12 3"), F.lit(None).cast("string"))
    replaces = rank.replace_ok(k % 3 == 0, k % 2 != 0, k % 5 == 0, F.when(k % 7 != 0, k % 7 < 4), (k % 11) / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", evidence.label_number(printed).alias("label"), evidence.rights_year(printed).alias("rights"), evidence.medium(printed).alias("medium"), sure.alias("confirmed"), edition.alias("edition"), replaces.alias("replaces"))


@query("SELECT page_id, 'ark=ark:/12345/b' || page_id || ' bsb=bsb' || lpad(CAST(page_id AS VARCHAR), 8, '0') || ' urn=urn:nbn:de:x' || page_id AS ids, 'http://x.org/' || page_id AS urls FROM pages")
def library_identifiers(spark, sf_dir):
    k = F.col("page_id").cast("string")
    body = F.concat(F.lit("see ark:/12345/b"), k, F.lit(" and bsb"), F.lpad(k, 8, "0"), F.lit(" or urn:nbn:de:x"), k, F.lit(" at http://x.org/"), k, F.lit(" again http://x.org/"), k)
    shown = F.array_join(F.transform(evidence.library_ids(body), lambda i: F.concat(i["kind"], F.lit("="), i["id"])), " ")
    return table(spark, sf_dir, "pages").select("page_id", shown.alias("ids"), F.array_join(identifiers.urls(body), " ").alias("urls"))


@query("""
WITH c AS (SELECT n_nationkey, n_nationkey % 8 AS k, (14 + n_nationkey % 5) * 100 AS b FROM nation)
SELECT n_nationkey, CASE k WHEN 6 THEN 'c. 1730' WHEN 7 THEN CASE WHEN n_nationkey % 16 = 7 THEN 'before 1800' ELSE NULL END ELSE (b + [26, 1, 1, 67, 1, 67][k + 1]) || '-' || (b + [50, 50, 33, 100, 100, 100][k + 1]) END AS dated FROM c
""")
def early_datings(spark, sf_dir):
    c = (F.col("n_nationkey") % 5 + 15).cast("string")
    told = lambda before, after: F.concat(F.lit(before), c, F.lit(after))
    d = dealt("n_nationkey", told("2. Viertel ", ". Jh."), told("1. Hälfte des ", ". Jh."), told("Anfang ", ". Jahrhundert"), told("late ", "th century"), told("", "th cent."), told("3. Drittel ", ". Jh."), "um 1730", F.when(F.col("n_nationkey") % 16 == 7, "vor 1800").otherwise("undated"))
    return table(spark, sf_dir, "nation").select("n_nationkey", evidence.dating(d).alias("dated"))


@query("""
SELECT o_orderkey, 'P-Cug' AS siglum, 'MM ' || (o_orderkey % 90 + 10) AS shelfmark, '3v-7r' AS folios, CASE WHEN o_orderkey % 2 = 0 THEN 1550 END AS year, o_orderkey % 3 = 0 AS abbreviates, CAST([0, 10, 60, 360, 360][o_orderkey % 5 + 1] AS INTEGER) AS wait FROM orders
""")
def early_sources(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("P-Cug MM "), (k % 90 + 10).cast("string"), F.lit("_ff. 3v-7r"), F.when(k % 2 == 0, " 1550").otherwise(""), F.lit(".pdf"))
    short = dealt("o_orderkey", "P-Cug", "D-Cug", "P-Cgu")
    x = pages.source_clues(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", x["siglum"].alias("siglum"), x["shelfmark"].alias("shelfmark"), x["folios"].alias("folios"), x["year"].alias("year"), rules.siglum_abbreviates(short, F.lit("P-Cuimg")).alias("abbreviates"), rules.retry_wait(k % 5).cast("int").alias("wait"))


@query("""
SELECT p_partkey, 'violin' AS part, CAST(p_partkey % 5 + 1 AS INTEGER) AS version, CAST(p_partkey % 9 + 1 AS INTEGER) AS number, 'G major' AS key, 'RV ' || p_size AS catalogue, 'Doe - Aria RV ' || p_size || '.pdf' AS best FROM part
""")
def notation_names(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat("p_name", F.lit(" RV "), n, F.lit(" in G no. "), (k % 9 + 1).cast("string"), F.lit(" - violin v"), (k % 5 + 1).cast("string"), F.lit(".mscz"))
    x = pages.notation_name(name)
    best = pages.best_name(F.array(F.lit("scan.pdf"), F.concat(F.lit("Doe - Aria RV "), n, F.lit(".pdf")), F.concat(F.lit("Aria RV "), n, F.lit(".pdf"))))
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", x["part"].alias("part"), x["version"].alias("version"), x["number"].alias("number"), x["key"].alias("key"), x["catalogue"].alias("catalogue"), best.alias("best"))


@query("""
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN p_size = 9 WHEN 1 THEN true WHEN 2 THEN p_size = 6 WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN true WHEN 6 THEN p_size = 4 WHEN 7 THEN false WHEN 8 THEN p_partkey % 20 = 8 ELSE p_partkey % 20 = 9 END AS compatible FROM part
""")
def work_vetoes(spark, sf_dir):
    n = F.col("p_size").cast("string")
    titled = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    even = F.col("p_partkey") % 20 < 10
    title = dealt(
        "p_partkey", titled("Concerto RV ", n), titled("Concerto RV ", n), titled("Sonata No. ", n), "Sonata II", "Six Sonatas", "Six Sonatas", titled(n, " pieces"), "Sonata in C minor", F.when(even, "Gigue").otherwise("Rigaudon"), F.when(even, "Sonata in G").otherwise("Missa brevis")
    )
    work = dealt("p_partkey", "Violin Concerto, RV 9", "Violin Concerto, Op. 8", "Trio Sonata No. 6", "10 Sonatas, Op. 3", "Recorder Sonata", "6 Sonatas, Op. 3", "4 pieces", "Sonata in B minor", "Cello Suite", "Triosonate, Flute Sonata in G major")
    movements = F.when(F.col("p_partkey") % 10 == 8, "Allemande\nCourante\nGigue")
    movements = F.when(F.col("p_partkey") % 20 == 18, "Allemande\nCourante").otherwise(movements)
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", title.alias("title"), work.alias("work"), movements.alias("movements"))
    return p.select("p_partkey", pages.work_compatible(F.col("title"), F.col("work"), F.col("movements")).alias("compatible"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'title' ELSE 'place,publisher' END AS fields, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title FROM supplier
""")
def record_corrections(spark, sf_dir):
    even = F.col("s_suppkey") % 2 == 0
    m = evidence.corrections(F.when(even, F.concat("s_name", F.lit(" /"))).otherwise(F.col("s_name")), F.when(even, "Press").otherwise("[s.n.]"), F.when(even, "Porto").otherwise("S.l."))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.sort_array(F.map_keys(m)), ",").alias("fields"), F.try_element_at(m, F.lit("title")).alias("title"))


# pages ------------------------------------------------------------------------------------------------------------------


@query("""
SELECT s_suppkey, 'On ' || s_name AS title, 'Ana Sousa|Rui Melo' AS authors, 'Some Journal' AS journal, CAST(s_suppkey AS VARCHAR) AS volume, '2' AS issue, CAST(1999 AS INTEGER) AS year, '1-20' AS pages, false AS review, 'http://x.org/' || s_suppkey AS stable_id,
s_name AS book, 'second' AS edition, 'Porto' AS place, CAST(s_suppkey % 7 + 1 AS INTEGER) AS page FROM supplier
""")
def printed_sheets(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    sheet = pages.article_sheet(F.concat(F.lit("On "), "s_name", F.lit("\nAuthor(s): Ana Sousa and Rui Melo\nSource: Some Journal, Vol. "), k, F.lit(", No. 2 (May, 1999), pp. 1-20\nPublished by: X\nStable URL: http://x.org/"), k))
    imprint = pages.imprint_page(F.concat(F.lit("Title: "), "s_name", F.lit("\nEdition\n   second\nPlace: Porto\nTitle: again")))
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("[p. "), i.cast("string"), F.lit("] x"))), "\n")
    page = pages.page_of(marks, ((F.col("s_suppkey") % 7 + 1) * 9 - 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", sheet.alias("a"), imprint.alias("i"), page.alias("page"))
    return s.select("s_suppkey", "a.title", F.array_join("a.authors", "|").alias("authors"), *[f"a.{c}" for c in ("journal", "volume", "issue", "year", "pages", "review", "stable_id")], F.col("i")["title"].alias("book"), F.col("i")["edition"].alias("edition"), F.col("i")["place"].alias("place"), "page")


@query("SELECT p_partkey, p_name AS title, 'Ana Sousa' AS author, CAST(1900 + p_size AS INTEGER) AS year, 'a ' || p_brand || '|c' AS lines FROM part")
def covers_and_lines(spark, sf_dir):
    block = lambda t, y, h: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("text"), F.lit(float(y)).alias("y"), F.lit(float(h)).alias("height"))
    x = pages.cover(F.array(block(F.col("p_name"), 10, 30), block("Ana Sousa", 20, 12), block(F.concat(F.lit("Porto "), (F.col("p_size") + 1900).cast("string")), 40, 10)))
    word = lambda t, at, y: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("text"), F.lit(float(at)).alias("x"), F.lit(float(y)).alias("y"), F.lit(1.0).alias("height"))
    lines = F.transform(pages.lines_of(F.array(word(F.col("p_brand"), 2, 0), word("c", 1, 9), word("a", 1, 0.1))), lambda v: v["text"])
    return table(spark, sf_dir, "part").select("p_partkey", x["title"].alias("title"), x["author"].alias("author"), x["year"].alias("year"), F.array_join(lines, "|").alias("lines"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderkey % 5 AS a0, o_orderkey % 7 AS a1, o_orderkey % 3 AS b0, o_orderkey % 4 AS b1, o_orderkey % 6 AS b2 FROM orders)
SELECT o_orderkey, CAST(CASE WHEN abs(a0 - b1) < abs(a0 - b0) THEN abs(a0 - b1) + least(abs(a1 - b1), abs(a1 - b2)) ELSE abs(a0 - b0) + least(abs(a1 - b0), abs(a1 - b1)) END AS DOUBLE) AS distance FROM v
""")
def page_alignment(spark, sf_dir):
    of = lambda *n: F.array(*[(F.col("o_orderkey") % i).cast("double") for i in n])
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.aligned_distance(of(5, 7), of(3, 4, 6), 1).alias("distance"))


# readers ----------------------------------------------------------------------------------------------------------------


@query("""
SELECT s_suppkey, s_name AS marc, 'A & B' AS xml, s_name || '|x' AS solr, 'Porto' AS html, s_name AS tag, CAST(s_suppkey AS DOUBLE) AS seconds, s_name AS score, CASE s_suppkey % 3 WHEN 0 THEN 'article-journal' WHEN 1 THEN 'chapter' ELSE 'book' END AS kind FROM supplier
""")
def payload_readers(spark, sf_dir):
    n, k = F.col("s_name"), F.col("s_suppkey")
    marc = F.concat(F.lit('<m:datafield tag="245" ind1="1" ind2="0"><m:subfield code="a">'), n, F.lit('</m:subfield><m:subfield code="c">no</m:subfield></m:datafield>'))
    solr = F.concat(F.lit('<doc><str name="t">'), n, F.lit('</str><arr name="k"><str>x</str></arr></doc>'))
    html = F.lit("<tr><th>Place</th><td><b>Porto</b></td></tr><tr><th>Place</th><td>Lisboa</td></tr>")
    probe = records.media_tags(F.concat(F.lit('{"format": {"duration": "'), k.cast("string"), F.lit('", "tags": {"TITLE": "'), n, F.lit('"}}}')))
    score = records.score_metadata(F.concat(F.lit("<score><title>Untitled</title><title>"), n, F.lit("</title></score>")))
    solr_doc = F.get(records.solr_docs(solr), F.lit(0))
    kind = records.probable_type(F.lit("book"), F.when(k % 3 != 2, "A journal"), F.when(k % 3 == 0, "7"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.get(records.marc_values(records.marc_fields(marc), "245", "ab"), F.lit(0)).alias("marc"), F.get(records.xml_texts(F.lit("<r><d:t lang='x'>A &amp; <i>B</i></d:t></r>"), "t"), F.lit(0)).alias("xml"),
        F.concat_ws("|", solr_doc["t"][0], solr_doc["k"][0]).alias("solr"), records.html_pairs(html)["Place"].alias("html"), probe["tags"]["title"].alias("tag"), probe["duration"].alias("seconds"), score["title"].alias("score"), kind.alias("kind"),
    )


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS even FROM nation")
def settings_read(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 2).cast("string").alias("value"))
    m = records.settings_map(s)
    return m.select(F.size("settings").cast("long").alias("n"), F.size(F.filter(F.map_values("settings"), lambda v: v == "0")).cast("long").alias("even"))


@query("""
SELECT p_partkey, CAST(p_size AS DOUBLE) AS pages, p_brand || '|' || p_type AS makers, CASE WHEN p_partkey % 2 = 0 THEN true END AS signed, CASE WHEN p_partkey % 2 = 0 THEN 'other' ELSE 'other,form' END AS invalid, p_partkey % 3 <> 0 AS allowed FROM part
""")
def typed_metadata(spark, sf_dir):
    t = registry.RecordType("score", "musical_score")
    for f in (registry.Field("pages", "Pages", "number"), registry.Field("makers", "Makers", "list"), registry.Field("signed", "Signed", "yes/no"), registry.Field("form", "Form", options=("print", "manuscript"))):
        t.add(f)
    k = F.col("p_partkey")
    m = F.create_map(F.lit("pages"), F.col("p_size").cast("string"), F.lit("makers"), F.concat_ws("; ", "p_brand", "p_type"), F.lit("signed"), F.when(k % 2 == 0, "true").otherwise("perhaps"), F.lit("form"), F.when(k % 2 == 0, "print").otherwise("stone"), F.lit("other"), F.when(k % 3 != 0, "x").otherwise(" "))
    kept = rules.allowed_metadata(m, F.array(F.lit("other"), F.lit("form")))
    p = table(spark, sf_dir, "part").select("p_partkey", *registry.typed(m, t), F.array_join(registry.invalid_keys(m, t), ",").alias("invalid"), F.map_contains_key(kept, "other").alias("allowed"))
    return p.select("p_partkey", "pages", F.array_join("makers", "|").alias("makers"), "signed", "invalid", "allowed")


# changes and workflows --------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def upserted(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return edit.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")), "c_custkey")


@query("SELECT event_id FROM events WHERE CAST(ts AS TIMESTAMP) < TIMESTAMP '2024-01-15 00:00:00'")
def late_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ingest.late_rows(e, "ts", "2024-01-15 00:00:00").select("event_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'skipped' WHEN c_mktsegment = 'REVIEW' THEN 'same' ELSE 'changed' END AS action FROM customer WHERE c_custkey BETWEEN 5 AND 60")
def bulk_edit_audit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "processing").otherwise("ready").alias("state"))
    return workflows.bulk_edit(c, {"c_mktsegment": ("replace", "REVIEW")}, list(range(5, 61)), ["c_mktsegment"], "c_custkey")[1]


@query("""
SELECT CASE n_nationkey % 5 WHEN 0 THEN 'not found' WHEN 1 THEN 'no composer' WHEN 4 THEN 'diverges' ELSE 'confirmed' END AS verdict, count(*) AS n FROM nation GROUP BY 1
""")
def model_records_verified(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    title = F.concat(F.lit("A long enough title of "), "n_name")
    found = n.where("n_nationkey % 5 <> 0").select("n_nationkey", F.when(k % 5 == 4, "Another matter altogether").otherwise(title).alias("title"), F.when(k % 5 != 1, "DOE").alias("surname"))
    return workflows.verification(n.select("n_nationkey", title.alias("title"), F.lit("Doe").alias("surname")), found, "n_nationkey")


@query("""
WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '10.1/' || (p_partkey // 2) ELSE '10.2/' || (p_partkey // 10) END AS doi FROM part WHERE p_partkey % 2 = 1),
l AS (SELECT p_partkey AS id, '10.1/' || (p_partkey // 2) AS doi FROM part WHERE p_partkey % 2 = 0), f AS (SELECT doi, min(id) AS first FROM e GROUP BY 1)
SELECT e.id AS entry, CASE WHEN l.id IS NOT NULL THEN 'duplicate' WHEN first < e.id THEN 'folded' ELSE 'new' END AS action, CASE WHEN l.id IS NOT NULL THEN l.id WHEN first < e.id THEN first END AS match FROM e LEFT JOIN l USING (doi) JOIN f USING (doi)
""")
def entries_imported(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    half, tenth = F.floor(k / 2).cast("string"), F.floor(k / 10).cast("string")
    made = lambda f, doi: f.select(k.alias("id"), F.lit("x").alias("title"), F.lit(None).cast("string").alias("date"), doi.alias("doi"), F.lit(None).cast("string").alias("isbn"))
    entries = made(p.where("p_partkey % 2 = 1"), F.when(k % 3 == 0, F.concat(F.lit("10.1/"), half)).otherwise(F.concat(F.lit("10.2/"), tenth)))
    return workflows.import_entries(entries, made(p.where("p_partkey % 2 = 0"), F.concat(F.lit("10.1/"), half)))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 4 <> 0, o_orderstatus) ELSE min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 4 <> 0, o_orderpriority) END AS cluster FROM orders
""")
def constrained_clusters(spark, sf_dir):
    coded = F.col("o_orderkey") % 4 != 0
    codes, weak = F.when(coded, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")), F.when(~coded, F.col("o_orderpriority"))
    i = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("id"), codes.alias("codes"), weak.alias("weak"))
    return clusters.constrained(i, "o_custkey").select("id", "cluster")


@query("""
WITH r AS (SELECT 'f' || o_orderkey AS path, 'h' || o_orderkey AS sha FROM orders WHERE o_orderkey % 4 <> 0),
p AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'old' || o_orderkey ELSE 'f' || o_orderkey END AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'other' || o_orderkey ELSE 'h' || o_orderkey END AS sha, o_orderkey % 3 = 0 AS made FROM orders WHERE o_orderkey % 6 <> 1),
g AS (SELECT sha, min(path) AS source FROM p WHERE path NOT IN (SELECT path FROM r) GROUP BY 1)
SELECT r.path, CASE WHEN p.sha = r.sha THEN 'up to date' WHEN source IS NOT NULL THEN 'renamed' ELSE 'copy' END AS action, CASE WHEN p.sha = r.sha THEN NULL ELSE source END AS source FROM r LEFT JOIN p ON p.path = r.path LEFT JOIN g ON g.sha = r.sha
UNION ALL SELECT path, CASE WHEN made THEN 'delete' ELSE 'junk' END, NULL FROM p WHERE path NOT IN (SELECT path FROM r)
""")
def static_copy_plan(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n = k.cast("string")
    required = o.where("o_orderkey % 4 <> 0").select(F.concat(F.lit("f"), n).alias("path"), F.concat(F.lit("h"), n).alias("sha256"))
    p = o.where("o_orderkey % 6 <> 1").select(k, F.concat(F.when(k % 5 == 0, "old").otherwise("f"), n).alias("path"), F.concat(F.when(k % 7 == 0, "other").otherwise("h"), n).alias("sha256"))
    return exports.static_plan(required, p.drop("o_orderkey"), p.where("o_orderkey % 3 = 0").drop("o_orderkey"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS m, 'A rather long title ' || p_partkey AS t FROM part)
SELECT 'in/Doe - ' || t || CASE WHEN m = 0 THEN '.part' ELSE '.pdf' END AS path, CASE m WHEN 0 THEN 'ignored' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'filed' WHEN 3 THEN 'filed' ELSE 'review' END AS action, CASE WHEN m IN (1, 2, 3) THEN k END AS match,
CASE WHEN m = 2 THEN 'Title ' || k WHEN m > 2 THEN t END AS title, CASE WHEN m = 2 THEN 'Roe' WHEN m > 2 THEN 'Doe' END AS surname, CAST(CASE m WHEN 2 THEN 1990 WHEN 3 THEN 1999 END AS INTEGER) AS year,
CASE m WHEN 2 THEN 'ROE_1990_title-' || k WHEN 3 THEN 'DOE_1999_a-rather-long-title-' || k END AS file_name FROM p
""")
def files_ingested(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p, title, m = table(spark, sf_dir, "part"), F.concat(F.lit("A rather long title "), n), F.col("p_partkey") % 6
    sha = F.concat(F.lit("h"), n)
    files = p.select(F.concat(F.lit("in/Doe - "), title, F.when(m == 0, ".part").otherwise(".pdf")).alias("path"), F.when(m != 5, sha).alias("sha256"), F.lit(70000).alias("size"), F.when(m == 2, F.concat(F.lit("doi:10.1000/"), n, F.lit("."))).alias("text"))
    twins = p.where(m == 1).select(F.explode(F.array(k, k + 1)).alias("id"), sha.alias("sha256"))
    made = lambda at, doi, t, who, y: p.where(m == at).select(k.alias("id"), doi.alias("doi"), t.alias("title"), F.lit(who).alias("surname"), F.lit(y).alias("year"))
    none = F.lit(None).cast("string")
    twice = made(4, none, title, "Doe", 1999)
    known = made(2, F.concat(F.lit("10.1000/"), n), F.concat(F.lit("Title "), n), "Roe", 1990).unionByName(made(3, none, title, "Doe", 1999)).unionByName(twice).unionByName(twice.withColumn("id", F.col("id") + 1000000))
    return workflows.ingest_files(files, twins, known)


@query("""
WITH w AS (SELECT DISTINCT upper(substr(lang, 1, 1)) AS country, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
k AS (SELECT country, upper(word[1:1]) || word[2:2] AS two, word[3:] AS rest, country || '-' || upper(word[1:1]) || word[2:] AS siglum FROM w WHERE length(word) BETWEEN 4 AND 7),
a AS (SELECT DISTINCT country, two, regexp_replace(rest, '(.)(.?)', '\\1', 'g') AS short FROM k),
m AS (SELECT country || '-' || two || short AS name, siglum, country || '-' || two || short = siglum AS same FROM a JOIN k USING (country, two) WHERE regexp_matches(rest, '^.*' || regexp_replace(short, '(.)', '\\1.*', 'g') || '$')),
x AS (SELECT name, bool_or(same) AS exact, count(*) AS n, min(siglum) AS siglum FROM m GROUP BY 1)
SELECT name, CASE WHEN exact THEN name ELSE siglum END AS siglum, CAST(CASE WHEN exact THEN 0 ELSE 1 END AS INTEGER) AS step FROM x WHERE exact OR n = 1
""")
def library_sigla(spark, sf_dir):
    """Words of each language as libraries of a country; asked for with every other letter after the second left out."""
    d = table(spark, sf_dir, "documents").where("lang is not null and text is not null")
    w = d.select(F.upper(F.substring("lang", 1, 1)).alias("country"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("word"))
    w = stored(w.where(F.length("word").between(4, 7)).distinct(), "words")  # texts are read once, for all that is asked and known
    k = w.withColumn("head", F.concat("country", F.lit("-"), F.upper(F.substring("word", 1, 1)), F.substring("word", 2, 1)))
    rest = F.substring("word", 3, 10)
    known = k.select(F.concat("head", rest).alias("siglum"), F.lit(None).cast("string").alias("city"))
    asked = k.select(F.concat("head", F.regexp_replace(rest, "(.)(.?)", "$1")).alias("name")).distinct()
    return sigla.libraries(asked.select(F.col("name").alias("id"), "name"), known).select(F.col("id").alias("name"), "siglum", "step")


@query("""
WITH e AS (SELECT l_orderkey, count(*) AS n, string_agg('Printer ' || l_suppkey || ' ' || CASE WHEN l_quantity > 25 THEN CAST(1600 + l_linenumber AS VARCHAR) ELSE '-' END, ', ' ORDER BY l_suppkey, l_partkey, l_linenumber, l_quantity) AS printers,
string_agg('f' || l_partkey || '.pdf', ' ' ORDER BY l_suppkey, l_partkey, l_linenumber, l_quantity) AS files FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'Works of ' || o_custkey AS title, o_totalprice > 150000 AS collection, CAST(1500 + o_custkey % 400 AS INTEGER) AS first_year, CAST(o_custkey AS VARCHAR) AS first_source, coalesce(n, 0) AS n_editions, coalesce(printers, '') AS printers, coalesce(files, '') AS files
FROM orders LEFT JOIN e ON l_orderkey = o_orderkey
""")
def work_pages_read(spark, sf_dir):
    """A page for each order, with a block of files for each of its items and templates inside templates."""
    text_of = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: F.col(c).cast("string")
    dated = lambda x: F.when(x["l_quantity"] > 25, F.concat(F.lit("ca."), (1600 + x["l_linenumber"]).cast("string"))).otherwise("n.d.")
    block = lambda x: text_of("\n{{#fte:imslpfile\n|File Name 1=f", x["l_partkey"].cast("string"), ".pdf\n|Publisher Information=first {{Note|a|{{b|c}}}} {{P|Printer ", x["l_suppkey"].cast("string"), ",|[[Printer ", x["l_suppkey"].cast("string"), "|The Printer]]|Porto.|", dated(x), "|}}\n|Notes={{d|e}}\n}}")
    order = F.struct("l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for is kept: items are few bytes, their pages are many
    items = table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey")
    blocks = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(order)).alias("items"))
    blocks = blocks.select("o_orderkey", F.array_join(F.transform("items", block), "").alias("blocks"))
    kind = F.when(F.col("o_totalprice") > 150_000, "Collection page").otherwise("Work page")
    page = text_of("{{#fte:imslppage\n|Work Title='''Works of''' [[X|", s("o_custkey"), "]]\n|Page Type=", kind, "\n|Year of First Publication=", (1500 + F.col("o_custkey") % 400).cast("string"), " {{RISM|", s("o_custkey"), "}}\n}}", F.coalesce("blocks", F.lit("")))
    p = table(spark, sf_dir, "orders").join(blocks, "o_orderkey", "left").select("o_orderkey", page.alias("page")).select("o_orderkey", wiki.work_page(F.col("page")).alias("p"))
    by = F.transform("p.editions", lambda e: F.concat(e["printer"], F.lit(" "), F.coalesce(e["year"].cast("string"), F.lit("-"))))
    return p.select("o_orderkey", "p.title", "p.collection", "p.first_year", "p.first_source", F.size("p.editions").cast("long").alias("n_editions"), F.array_join(by, ", ").alias("printers"), F.array_join(F.flatten(F.transform("p.editions", lambda e: e["files"])), " ").alias("files"))
