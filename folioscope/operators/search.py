"""Text search: a query compiler, BM25 over weighted columns, and substring search for readers."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.similarity import round6

LIMIT, MOST = 500, 5000


@dataclass(frozen=True)
class Term:
    """Words that stand in a row; the last is a prefix unless the term was quoted. ``column`` restricts where."""

    words: tuple[str, ...]
    prefix: bool
    column: str | None = None


def _plain(s: str) -> list[str]:
    import unicodedata

    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    return re.findall("[a-z0-9]+", s)


def compile_query(q: str, column: str | None = None) -> list[Term]:
    """Quoted text is a phrase; every other token a prefix term, inner punctuation making it a phrase with a prefix at its end."""
    out = []
    for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', q):
        w = _plain(quoted or bare)
        if w:
            out.append(Term(tuple(w), not quoted, column))
    return out


def number_of(q: str) -> int | None:
    """A query that is only a number, perhaps after '#', asks for that record."""
    m = re.fullmatch(r"\s*#?(\d{1,6})\s*", q)
    return int(m[1]) if m else None


def _same(t: Column, w: str, prefix: bool) -> Column:
    return t.startswith(w) if prefix else t == w


def hits(tokens: Column, term: Term) -> Column:
    """How often the term stands in an array of tokens, which is bound to a variable so that it is made once a row."""
    return F.get(F.transform(F.array(tokens), lambda t: _hits(t, term)), F.lit(0))


def _hits(tokens: Column, term: Term) -> Column:
    n = len(term.words)
    if n == 1:
        return F.size(F.filter(tokens, lambda t: _same(t, term.words[0], term.prefix)))
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))

    def here(i: Column) -> Column:
        out = F.lit(True)
        for j, w in enumerate(term.words):
            out = out & F.coalesce(_same(F.get(tokens, i + j), w, term.prefix and j == n - 1), F.lit(False))
        return out

    return F.size(F.filter(at, here))


def first_hit(tokens: Column, term: Term) -> Column:
    """Position of the first token that begins the term, from 0; null if none does."""
    whole = term.prefix and len(term.words) == 1
    at = F.filter(F.transform(tokens, lambda t, i: F.when(_same(t, term.words[0], whole), i)), lambda i: i.isNotNull())
    return F.get(at, F.lit(0))


def ranked(docs: DataFrame, weights: dict[str, float], terms: list[Term], limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """The best rows that hold all terms: ``key, score, rank`` and, of the first term, ``excerpt``. Lower scores are better.

    One scan counts hits row by row; the corpus-wide figures are one aggregated row; nothing is shuffled but sums and the
    top rows. Ties go by key. Nulls are empty columns.
    """
    rows = docs.select(key, *[text.tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in weights])
    size = sum((F.size(c) for c in weights), F.lit(0))
    weighed = [sum((F.lit(float(w)) * hits(F.col(c), t) for c, w in weights.items() if t.column in (None, c)), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(terms)]
    main = list(weights)[-1]
    counted = rows.select(key, size.alias("len"), *weighed, F.when(first_hit(F.col(main), terms[0]).isNotNull(), text.excerpt(F.col(main), first_hit(F.col(main), terms[0]))).alias("excerpt"))
    s = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()  # one row of figures
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log((s.n - s[f"n{i}"] + 0.5) / (s[f"n{i}"] + 0.5))
        idf = idf if idf > 0 else 1e-6
        f = F.col(f"f{i}")
        score = score - F.lit(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(s.avg_len)))
    matched = counted.where(" and ".join(f"f{i} > 0" for i in range(len(terms))))
    found = matched.select(key, round6(score).alias("score"), "excerpt")
    top = found.orderBy("score", key).limit(min(limit, MOST))
    return top.withColumn("rank", F.expr(f"row_number() over (order by score, {key})").cast("long"))


def contains_score(docs: DataFrame, q: str, title: str, authors: str, keywords: str, other: str, key: str = "doc_id") -> DataFrame:
    """Reader's search: every term a substring of the whole record; 1, and 4, 2 and 1 more for title, authors and keywords."""
    terms = _plain(q)
    cols = {n: text.reader_normalise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for n, c in (("t", title), ("a", authors), ("k", keywords), ("o", other))}
    rows = docs.select(key, *[c.alias(n) for n, c in cols.items()]).withColumn("hay", F.concat_ws(" ", "t", "a", "k", "o"))
    for t in terms:
        rows = rows.where(F.col("hay").contains(t))
    score = F.lit(0)
    for t in terms:
        score = score + 1 + F.when(F.col("t").contains(t), 4).otherwise(0) + F.when(F.col("a").contains(t), 2).otherwise(0) + F.when(F.col("k").contains(t), 1).otherwise(0)
    return rows.select(key, score.cast("long").alias("score"))


def postings(docs: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """``token, key, positions``: an index to be kept, one row for each token and record."""
    each = docs.select(key, F.posexplode(text.tokens(F.coalesce(F.col(column), F.lit("")))).alias("pos", "token"))
    return each.groupBy("token", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
