"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a pattern. Words of a pattern that stand between boundaries can only fit a url that holds the same word, so each
rule is filed under the one of them that is rarest among the urls. The words of a url fetch candidate rules, and only
these run as regular expressions. Up to ``IN_ROW`` rules the index is one value that every task gets, so urls are judged
where they are read, without a shuffle; longer lists meet the urls' words in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which the index goes to every task: at most this many regular expressions of ``LONGEST`` characters, 64 MB.
IN_ROW, LONGEST = 32_768, 2_048
RULE = "rule string, verdict string, part string, pattern string"
#: Parts of a url that a pattern may look at. ``place`` is host and path; its rules go first, the longest first.
PARTS = ("place", "host", "url")

#: Rules by place: (verdict, host, path).
PLACES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words that mark a host as unwanted: gambling, pills, adult, bulk and link pages, advertising and tracking, credit, pirated copies.
WORDS = """casino casinos poker roulette jackpot betting bets slots lottery pills viagra cialis adult porn xxx sex escorts nudes
spam linkfarm ads adserver adclick popunder track tracker tracking payday replica warez keygen cracks torrents""".split()
#: Hosts that hold such a word and are wanted, and pages that hold no text of their own, wherever they are.
WANTED, PAGES = ["^anti-spam^", "^spam-filter^", "^adult-education^", "^ads-b^"], ["/adserver/", "/ads/click^", "/wp-login.php^", "/cgi-bin/redirect^"]


def default_rules(spark: SparkSession) -> DataFrame:
    """The rules by place and the pattern rules of this module as a table."""
    rows = [(f"{h}{p}", v, "place", f"||{h}{p}") for v, h, p in PLACES]
    rows += [(w, "block", "host", f"^{w}^") for w in WORDS] + [(p, "allow", "host", p) for p in WANTED] + [(p, "block", "url", p) for p in PAGES]
    return spark.createDataFrame(rows, RULE)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parts(url: Column) -> dict[str, Column]:
    """``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased), ``path`` (up to ``?``, ``#`` or the end), and ``rest`` (all after the host)."""
    cut = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)(.*)", k), F.lit(""))
    return {"host": lowered(cut(1)), "path": cut(2), "rest": F.concat(cut(2), cut(3))}


def words(text: Column) -> Column:
    """Distinct words of a-z and 0-9, and the empty word under which rules without a word of their own are filed."""
    return F.array_union(F.array(F.lit("")), F.split(lowered(text), "[^a-z0-9]+"))


def compiled(rules: DataFrame) -> DataFrame:
    """``rule, verdict, part, regex, words``: patterns as regular expressions, and the words that any fitting text must hold.

    In a pattern ``||`` at the beginning is the beginning of the host or of one of its parent domains, ``|`` at either end
    that end of the text, ``^`` a character other than a letter A-Z or a digit, or an end; ``*`` stands for any text. All else stands for
    itself; upper case fits only in ``place`` (hosts are lower-cased, paths are not). Rules with a null, an unknown part,
    an empty pattern or a pattern of over ``LONGEST`` characters fit nothing and are left out; repeated rules count once.
    """
    p = F.col("pattern")
    r = rules.select("rule", "verdict", "part", "pattern").where(F.col("rule").isNotNull() & F.col("verdict").isin("block", "allow") & F.col("part").isin(*PARTS) & (F.length(p) > 0) & (F.length(p) <= LONGEST)).distinct()
    r = r.withColumn("pattern", F.when(F.col("part") == "place", p).otherwise(lowered(p)))
    body = F.regexp_replace(p, r"^\|\|?|\|$", "")
    literal = F.regexp_replace(body, r"([\x21-\x29\x2B-\x2F\x3A-\x40\x5B-\x5D\x60\x7B-\x7E])", r"\\$1")  # all signs of ASCII but * ^ _
    inner = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^A-Za-z0-9]|^|\\z)"))
    head = F.when(p.startswith("||"), r"(?s)^(?:[^/?#]*\.)?").when(p.startswith("|"), "(?s)^").otherwise("(?s)")
    # a word is bounded by signs, by ^ or by an anchor; where a pattern is open, or by *, the text's word may go on
    bounded = F.concat(F.when(p.startswith("|"), ".").otherwise("*"), body, F.when(p.endswith("|"), ".").otherwise("*"))
    own = F.regexp_extract_all(lowered(bounded), F.lit("(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0))
    return r.select("rule", "verdict", "part", F.concat(head, inner, F.when(p.endswith("|"), r"\z").otherwise("")).alias("regex"), F.array_distinct(own).alias("words"))


def index(rules: DataFrame, urls: DataFrame, text: Column, few: bool = False) -> DataFrame:
    """``compiled`` rules with ``word``: the rarest of their words in all ``urls`` (by the number of rows; ties: the smallest), empty where there is none. The words of ``few`` rules are broadcast, so that the urls' words need not be dealt out to be counted."""
    rules = compiled(rules)
    asked = rules.select(F.explode("words").alias("word")).distinct()
    asked = F.broadcast(asked) if few else asked
    seen = urls.select(F.explode(words(text)).alias("word")).join(asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    each = rules.select("rule", "verdict", "part", "regex", F.explode("words").alias("word")).join(seen, "word", "left")
    least = each.groupBy("rule", "verdict", "part", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "word"))["word"].alias("word"))
    return least.unionByName(rules.where("size(words) = 0").select("rule", "verdict", "part", "regex", F.lit("").alias("word")))


def _text(part: Column) -> Column:
    return F.when(part == "place", F.concat("__host", "__path")).when(part == "host", F.col("__host")).otherwise(F.concat("__host", lowered(F.col("__rest"))))


def _rank(r: Column) -> Column:
    """What a fitting rule decides by: places before patterns; the longest place, ties by its text; then what is wanted, then the smallest rule."""
    place = r["part"] == "place"
    return F.struct((~place).alias("after"), F.when(place, -F.length(r["rule"])).otherwise(0).alias("len"), F.when(place, F.lit("")).otherwise(r["verdict"]).alias("first"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))


def _in_row(work: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """``work`` with ``__best``, by an index in slots that goes to every task."""
    slots = 2 * n + 1
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(slots))
    filed = found.groupBy(slot(F.col("word")).cast("int").alias("slot")).agg(F.collect_list(F.struct("word", "rule", "verdict", "part", "regex")).alias("filed"))
    every = work.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(filed, "slot", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("filed", F.array()).alias("filed")))), lambda s: s["filed"]).alias("table"))
    out = work.withColumn("__table", table.scalar())
    fetched = F.flatten(F.transform(words(F.concat("__host", "__rest")), lambda w: F.filter(F.get(F.col("__table"), slot(w).cast("int")), lambda r: r["word"] == w)))
    fits = F.filter(fetched, lambda r: F.rlike(_text(r["part"]), r["regex"]))
    return out.withColumn("__best", F.array_min(F.transform(fits, _rank))).drop("__table")


def _joined(work: DataFrame, found: DataFrame) -> DataFrame:
    """The same by a join of the urls' words with the index, for lists of any length."""
    urls = work.select("__host", "__path", "__rest").distinct()
    fetched = urls.withColumn("word", F.explode(words(F.concat("__host", "__rest")))).join(found, "word")
    fits = fetched.where(F.rlike(_text(F.col("part")), F.col("regex")))
    best = fits.groupBy("__host", "__path", "__rest").agg(F.min(_rank(F.struct("rule", "verdict", "part"))).alias("__best"))
    return work.join(best, ["__host", "__path", "__rest"], "left")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", in_row: int = IN_ROW) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the rule by place that fits, else null), ``verdict`` (allow or block) and ``pattern`` (the pattern rule that decided, if no place did).

    ``rules(rule, verdict, part, pattern)`` are patterns (``compiled``) over a part of the url. Of fitting places the
    longest rule wins (ties: the smallest text). Where no place fits, a pattern that allows goes before those that block;
    where nothing fits, the url is allowed. A null url, or one without ``://``, has an empty host and path and is judged like
    any other. Every row is judged on its own, repeated rows alike. Columns called host, path, rule, verdict or pattern are
    replaced, all others kept; an empty table, or one without rules, gives what it should.
    """
    work = pages.drop("host", "path", "rule", "verdict", "pattern") if url not in ("host", "path", "rule", "verdict", "pattern") else pages
    kept = work.columns
    work = work.withColumns({f"__{k}": c for k, c in parts(F.col(url)).items()})
    n = rules.count()
    found = index(rules, work, F.concat("__host", "__rest"), n <= in_row)
    out = _in_row(work, found, n) if n <= in_row else _joined(work, found)
    best, place = F.col("__best"), ~F.col("__best.after")
    new = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.when(place, best["rule"]), "verdict": F.coalesce(best["verdict"], F.lit("allow")), "pattern": F.when(~place, best["rule"])}
    return out.select(*[F.col(c) for c in kept if c not in new], *[c.alias(k) for k, c in new.items()])


#: The same in DuckDB over ``pages``: every rule tried on every url.
SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path,
                  translate(coalesce(regexp_extract(url, '(?s)://[^/?#]*(.*)', 1), ''), '{UPPER}', '{LOWER}') AS rest FROM pages),
p AS (SELECT *, host = 'net' OR ends_with(host, '.net') AS net, host = 'example.net' OR ends_with(host, '.example.net') AS example_net,
             host = 'example.com' OR ends_with(host, '.example.com') AS example_com, host = 'org' OR ends_with(host, '.org') AS org FROM u),
r AS (SELECT *, CASE WHEN example_net AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN example_com AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN org AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN net AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[^a-z0-9])(anti-spam|spam-filter|adult-education|ads-b)([^a-z0-9]|$)') THEN 'allow'
  WHEN regexp_matches(host, '(^|[^a-z0-9])({"|".join(WORDS)})([^a-z0-9]|$)') THEN 'block'
  WHEN contains(host || rest, '/adserver/') OR regexp_matches(host || rest, '(/ads/click|/wp-login[.]php|/cgi-bin/redirect)([^a-z0-9]|$)') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""
