"""Language guess and weighted n-gram keywords."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.ship import ship

# A few of the commonest function words of each language (folded).
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf", "von", "den", "dem", "zu"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "was", "with", "as", "on", "at", "by"],
    "es": ["el", "los", "las", "que", "del", "por", "con", "una", "para", "como", "es", "y", "esa", "esto"],
    "fr": ["le", "les", "des", "et", "est", "dans", "une", "que", "pour", "qui", "sur", "pas", "par", "du"],
}
# Words of the apparatus of papers and books that say nothing of the subject (a part; the list is a parameter).
GENERIC = ["abstract", "appendix", "bibliography", "chapter", "conclusion", "contents", "doi", "edition", "figure", "ibid", "index", "introduction", "isbn", "issn", "journal", "keywords", "page", "pages", "references", "results", "section", "table", "thesis", "university", "volume"]
# Articles that French and Italian write together with the next word, and what may stand inside a phrase of three words.
ELIDED = ["all", "c", "coll", "d", "dall", "dell", "j", "l", "m", "n", "nell", "qu", "quell", "quest", "s", "sull", "t", "un"]
INNER = ["da", "de", "del", "des", "di", "do", "of"]
# Headings of a list of references; words a text needs; tenths of a point for a use by number of words, and the tenths needed.
HEADINGS = ["references", "bibliography", "works cited", "bibliografia", "referências bibliográficas", "referencias bibliograficas"]
FEWEST, TENTHS, NEEDED = 80, {1: 10, 2: 16, 3: 19}, {1: 30, 2: 32, 3: 32}
_WORD, _EDGE = r"[\p{L}'’-]+", r"^['’-]+|['’-]+$"
_ELISION = r"^(?i:" + "|".join(ELIDED) + r")['’]"
_HEADING = r"\n\s*(?i:" + "|".join(HEADINGS) + r")\s*\n"


def language_guess(docs: DataFrame, tokens: Column, key: str) -> DataFrame:
    """``key, guess, hits``: the language with most function words (ties: first in the alphabet); 'und' without any."""
    rows = docs.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("w"))
    among = lambda s: F.size(F.filter("w", lambda t: t.isin(*s)))
    scored = [F.struct(among(s).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, s) in enumerate(STOP_WORDS.items())]
    best = rows.select(key, F.array_max(F.array(*scored)).alias("x"))
    return best.select(key, F.when(F.col("x.n") > 0, F.col("x.lang")).otherwise("und").alias("guess"), F.col("x.n").cast("long").alias("hits"))


def language_sql(tokens: str) -> str:
    parts = ", ".join("{'n': len(list_filter(w, lambda t: t IN (%s))), 'o': %d, 'lang': '%s'}" % (", ".join(f"'{x}'" for x in s), -i, lang) for i, (lang, s) in enumerate(STOP_WORDS.items()))
    return f"WITH d AS (SELECT doc_id, coalesce({tokens}, []) AS w FROM documents), s AS (SELECT doc_id, list_sort([{parts}], 'DESC')[1] AS x FROM d) SELECT doc_id, CASE WHEN x.n > 0 THEN x.lang ELSE 'und' END AS guess, CAST(x.n AS BIGINT) AS hits FROM s"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def body_of(c: Column) -> Column:
    """A text up to its list of references, if that comes after 5,000 characters; of more than 30,000, without the first 8 % (cover and thanks)."""
    at = F.length(F.get(F.split(c, _HEADING, 2), F.lit(0)))
    cut = F.when((at > 5000) & (at < F.length(c)), F.substring(c, F.lit(1), at)).otherwise(c)
    return _let(cut, lambda x: F.when(F.length(x) > 30000, F.substring(x, F.floor(F.length(x) * 0.08).cast("int") + 1, F.length(x))).otherwise(x))


def spoken(c: Column) -> Column:
    """Words of letters with their capitals, without elided articles and quotes."""
    found = F.regexp_extract_all(c, F.lit(f"({_WORD})"), F.lit(1))
    plain = lambda w: F.regexp_replace(F.regexp_replace(w, _ELISION, ""), _EDGE, "")
    marked = lambda w: w.contains("'") | w.contains("’") | w.contains("-")  # noqa: E731  few words are
    return F.filter(F.transform(found, lambda w: F.when(marked(w), plain(w)).otherwise(w)), lambda w: w != "")


def _chosen(said: list[str], words: list[str], title: set[str], dull: set[str], most: int) -> tuple[list[tuple[int, str]], set[str]]:
    """The keywords of one text by ``(minus tenths, phrase)``, best first, and its names; ``words`` are those it said in lower case."""
    uses = Counter(words)
    capital = Counter(w for o, w in zip(said, words, strict=True) if unicodedata.category(o[0]) == "Lu")
    names = {w for w, n in capital.items() if n >= 3 and 100 * n > 85 * uses[w]}
    # a keyword is used twice or more, so all its words are
    subject = {w for w, n in uses.items() if n > 1 and len(w) >= 3 and w not in dull and (w not in names or w in title)}
    good = [w in subject for w in words]
    grams = Counter({w: n for w, n in uses.items() if w in subject})
    n = len(words)
    grams.update(f"{words[i]} {words[i + 1]}" for i in range(n - 1) if good[i] and good[i + 1])
    grams.update(f"{words[i]} {words[i + 1]} {words[i + 2]}" for i in range(n - 2) if good[i] and good[i + 2] and (good[i + 1] or words[i + 1] in INNER))
    valued, holder = [], {}
    for p, k in grams.items():
        if k > 1 and k * TENTHS[size := p.count(" ") + 1] >= NEEDED[size]:
            valued.append((-k * TENTHS[size] * (1 if title.isdisjoint(p.split(" ")) else 2), p))
    valued.sort()
    for v in valued:
        if " " in v[1]:
            for w in v[1].split(" "):
                holder.setdefault(w, v)  # the best comes first: where it has too few points, so have the others
    taken: list[tuple[int, str]] = []
    for x in valued:
        if len(taken) >= most:
            break
        h = holder.get(x[1])
        k = h if h and 10 * h[0] <= 4 * x[0] else x
        if not any(k[1] in e[1] or e[1] in k[1] for e in taken):
            taken.append(k)
    return taken, names


def computed(docs: DataFrame, title: Column, body: Column, key: str, most: int = 6, stop: list[str] | None = None, generic: list[str] | None = None) -> DataFrame:
    """``key, phrase, value, rank``: up to ``most`` keywords of each text of 80 words or more, best first.

    Words of three letters and more that are neither function words (``stop``) nor ``generic``, and phrases of two and three
    of them (inside one of three a particle may stand). A use is worth 1, 1.6 or 1.9 points by number of words; 3 are needed,
    3.2 by phrases; those with a word of the title count twice. Names (three uses and more, over 85 % with a capital)
    count only if the title has them. A word gives way to the best phrase that holds it and has 40 % of its points; what holds,
    or is held by, one that was taken is passed over. Ties go by the alphabet. Words are found by Spark and counted, text by text,
    in Arrow batches; nothing is shuffled. Null and short texts give no rows; columns other than the key, title and body are not read.
    """
    ship(docs.sparkSession)
    dull = {w for s in STOP_WORDS.values() for w in s} if stop is None else set(stop)
    dull |= set(GENERIC if generic is None else generic)
    heard = F.transform(spoken(F.coalesce(title, F.lit(""))), F.lower)
    rows = docs.select(F.col(key).alias("key"), F.array_join(spoken(body_of(body)), "\n").alias("said"), heard.alias("title"))
    rows = rows.withColumn("words", F.lower("said"))  # a line break ends a word here too
    schema = T.StructType([rows.schema["key"], T.StructField("rank", T.LongType()), T.StructField("tenths", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("named", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, rank, tenths, words, named = [], [], [], [], []
            for i in range(b.num_rows):
                said = (b.column("said")[i].as_py() or "").split("\n")
                if len(said) < FEWEST:
                    continue
                topic = {w for w in b.column("title")[i].as_py() if len(w) >= 3 and w not in dull}
                taken, names = _chosen(said, b.column("words")[i].as_py().split("\n"), topic, dull, most)
                for j, (minus, phrase) in enumerate(taken, 1):
                    row.append(i)
                    rank.append(j)
                    tenths.append(-minus)
                    words.append(phrase.split(" "))
                    named.append([w in names for w in words[-1]])
            columns = [b.column("key").take(pa.array(row, pa.int64())), pa.array(rank, pa.int64()), pa.array(tenths, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(named, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = rows.mapInArrow(run, schema)
    shown = F.array_join(F.zip_with("words", "named", lambda w, n: F.when(n, F.initcap(w)).otherwise(w)), " ")
    phrase = F.concat(F.upper(F.substring(shown, 1, 1)), F.substring(shown, F.lit(2), F.length(shown)))
    return found.select(F.col("key").alias(key), phrase.alias("phrase"), (F.col("tenths") / 10.0).alias("value"), "rank")


def computed_sql(title: str, most: int = 6) -> str:
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    out = quoted(sorted({w for s in STOP_WORDS.values() for w in s} | set(GENERIC)))
    sql = lambda pattern: pattern.replace("'", "''")
    spoken_ = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '{sql(_WORD)}'), lambda w: regexp_replace(regexp_replace(w, '{sql(_ELISION)}', ''), '{sql(_EDGE)}', '', 'g')), lambda w: w <> '')"
    good = lambda i: f"g[{i}]"
    return rf"""
WITH h AS (SELECT doc_id, {title} AS title, text, length(regexp_extract(text, '(?s)^(.*?){sql(_HEADING)}', 1)) AS ends FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, title, CASE WHEN ends > 5000 THEN substr(text, 1, ends) ELSE text END AS x FROM h),
k AS (SELECT doc_id, title, CASE WHEN length(x) > 30000 THEN substr(x, CAST(floor(length(x) * 0.08) AS BIGINT) + 1) ELSE x END AS x FROM c),
o AS (SELECT doc_id, {spoken_("title")} AS t, {spoken_("x")} AS o FROM k),
w AS (SELECT doc_id, list_filter(list_transform(t, lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({out})) AS t, o, list_transform(o, lambda x: lower(x)) AS w FROM o WHERE len(o) >= {FEWEST}),
u AS (SELECT doc_id, unnest(o) AS o FROM w),
nm AS (SELECT doc_id, lower(o) AS name FROM u GROUP BY 1, 2 HAVING count(*) >= 3 AND 100 * count(*) FILTER (WHERE regexp_matches(o, '^\p{{Lu}}')) > 85 * count(*)),
nl AS (SELECT doc_id, list(name) AS n FROM nm GROUP BY 1),
b AS (SELECT w.doc_id, t, w, coalesce(n, []) AS n FROM w LEFT JOIN nl USING (doc_id)),
gd AS (SELECT *, list_transform(w, lambda x: length(x) >= 3 AND x NOT IN ({out}) AND (NOT list_contains(n, x) OR list_contains(t, x))) AS g FROM b),
ph AS (SELECT doc_id, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {good("i")} THEN list_filter([w[i], CASE WHEN {good("i + 1")} THEN w[i] || ' ' || w[i + 1] END, CASE WHEN {good("i + 2")} AND ({good("i + 1")} OR w[i + 1] IN ({quoted(INNER)})) THEN w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END], lambda p: p IS NOT NULL) ELSE [] END))) AS p FROM gd),
ct AS (SELECT doc_id, p, string_split(p, ' ') AS ws, count(*) * CASE len(string_split(p, ' ')) WHEN 1 THEN {TENTHS[1]} WHEN 2 THEN {TENTHS[2]} ELSE {TENTHS[3]} END AS v FROM ph GROUP BY 1, 2),
vl AS (SELECT ct.doc_id, p, ws, v * CASE WHEN len(list_intersect(ws, t)) > 0 THEN 2 ELSE 1 END AS v FROM ct JOIN gd USING (doc_id) WHERE v >= CASE len(ws) WHEN 1 THEN {NEEDED[1]} ELSE {NEEDED[2]} END),
pw AS (SELECT doc_id, p, v, unnest(list_distinct(ws)) AS x FROM vl WHERE len(ws) > 1),
bt AS (SELECT vl.doc_id, vl.p, arg_min({{'p': pw.p, 'v': pw.v}}, {{'m': -pw.v, 'p': pw.p}}) AS b FROM vl JOIN pw ON pw.doc_id = vl.doc_id AND pw.x = vl.p WHERE len(ws) = 1 AND 10 * pw.v >= 4 * vl.v GROUP BY 1, 2),
od AS (SELECT vl.doc_id, list([coalesce(b, {{'p': vl.p, 'v': vl.v}})] ORDER BY vl.v DESC, vl.p) AS l FROM vl LEFT JOIN bt ON bt.doc_id = vl.doc_id AND bt.p = vl.p GROUP BY 1),
ch AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN len(a) >= {most} OR len(list_filter(a, lambda e: contains(e.p, x[1].p) OR contains(x[1].p, e.p))) > 0 THEN a ELSE a || x END) AS l FROM od),
ex AS (SELECT doc_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS rank FROM ch),
sh AS (SELECT ex.doc_id, e, rank, array_to_string(list_transform(string_split(e.p, ' '), lambda x: CASE WHEN list_contains(n, x) THEN upper(x[1]) || substr(x, 2) ELSE x END), ' ') AS s FROM ex JOIN b USING (doc_id))
SELECT doc_id, CASE WHEN s[1] = 'ß' THEN 'SS' ELSE upper(s[1]) END || substr(s, 2) AS phrase, CAST(e.v / 10.0 AS DOUBLE) AS value, rank FROM sh
"""


def author_keywords(text: Column, most: int = 12) -> Column:
    """Keywords an author printed after a label, separated by ; , or dots."""
    line = F.regexp_extract(text, r"(?im)^\s*(?:key ?words|mots[- ]cl[ée]s|palabras clave|palavras[- ]chave|schlagw[öo]rter)\s*[:\-]\s*(.+)$", 1)
    return F.slice(F.filter(F.transform(F.split(line, r"\s*[;,·•]\s*|\.\s*$"), lambda x: F.trim(x)), lambda w: w != ""), 1, most)


def cascade(*sources: tuple[str, Column]) -> Column:
    """struct(origin, words): the first source that has any."""
    out = F.lit(None).cast("struct<origin:string,words:array<string>>")
    for name, words in reversed(sources):
        out = F.when(F.size(F.coalesce(words, F.array().cast("array<string>"))) > 0, F.struct(F.lit(name).alias("origin"), words.alias("words"))).otherwise(out)
    return out
