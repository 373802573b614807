"""Whole workflows composed of the operators: search, import, near duplicates, enrichment, merging, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import evidence, identifiers, rules, text
from folioscope.functions.similarity import years_ok
from folioscope.operators import components, dedup, edit, linkage, rank, search
from folioscope.operators.components import stored
from folioscope.streaming.ingest import category


def search_with_facets(docs: DataFrame, weights: dict[str, float], q: str, facets: Column, limit: int = search.LIMIT, key: str = "doc_id") -> DataFrame:
    """A number is a point lookup; other queries are ranked, joined to their records, filtered by facets, in order of rank."""
    n = search.number_of(q)
    if n is not None:
        found = docs.where(F.col(key) == n).limit(1)
        if not found.isEmpty():
            return found.withColumn("rank", F.lit(1).cast("long")).withColumn("score", F.lit(0.0)).withColumn("excerpt", F.lit(None).cast("string"))
    terms = search.compile_query(q)
    if not terms:
        return docs.where(facets).withColumn("rank", F.lit(None).cast("long")).withColumn("score", F.lit(None).cast("double")).withColumn("excerpt", F.lit(None).cast("string"))
    hits = search.ranked(docs, weights, terms, limit, key)
    return hits.join(docs, key).where(facets).orderBy("rank")


def ingest_files(files: DataFrame, library: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``path, action, match, title, surname, year, file_name`` of new files(path, sha256, size, text): read, guessed, looked up, decided.

    'ignored' (no source file), 'duplicate' (``match`` is the smallest id of library(id, sha256) with that content), 'filed'
    (``match`` in catalogue(id, doi, title, surname, year) has the first DOI of the text, or, as the only one and with no
    other year, the title that the file name tells), else 'review' with what the name tells. Of rows with one DOI the
    smallest id counts. Nulls match nothing; each row of a repeated path is decided on its own.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    told = files.select("path", "sha256", "size", category().alias("category"), name.alias("name"), rules.file_name_parts(name).alias("told"), F.get(identifiers.dois(F.coalesce("text", F.lit(""))), F.lit(0)).alias("doi"))
    skip = F.coalesce(rules.ignored_file(F.col("name")) | ~rules.source_file(F.col("category"), F.col("size")), F.lit(True))
    # what has no key takes one of its own, so it does not land in one task
    own = lambda c: F.coalesce(c, F.concat(F.lit("\x00"), F.xxhash64("path", "size").cast("string")))
    row = F.struct("id", "title", "surname", F.col("year").cast("int").alias("year"))
    twins = library.where(F.col("sha256").isNotNull()).groupBy(F.col("sha256").alias("k1")).agg(F.min("id").alias("twin"))
    by_doi = catalogue.where(~text.is_blank(F.col("doi"))).groupBy(F.lower(F.trim("doi")).alias("k2")).agg(F.min_by(row, "id").alias("a"))
    titled = catalogue.groupBy(text.compact_title(F.col("title")).alias("k3")).agg(F.count("*").alias("n"), F.min_by(row, "id").alias("b"))
    titled = titled.where((F.col("n") == 1) & (F.length("k3") >= 8)).drop("n")
    keyed = told.withColumn("k1", own(F.col("sha256"))).withColumn("k2", own(F.col("doi"))).withColumn("k3", own(text.compact_title(F.col("told.title"))))
    j = keyed.join(twins, "k1", "left").join(by_doi, "k2", "left").join(titled, "k3", "left")
    fits = F.coalesce(F.col("told.year") == F.col("b.year"), F.lit(True))
    found = F.coalesce(F.col("a"), F.when(fits, F.col("b")))
    action = F.when(skip, "ignored").when(F.col("twin").isNotNull(), "duplicate").when(found.isNotNull(), "filed").otherwise("review")
    j = j.withColumn("found", found).withColumn("action", action)
    of = lambda c, guess: F.when(F.col("action") == "filed", F.col(f"found.{c}")).when(F.col("action") == "review", F.col(f"told.{guess}"))
    out = j.select("path", "action", F.when(F.col("action") == "duplicate", F.col("twin")).when(F.col("action") == "filed", F.col("found.id")).alias("match"), of("title", "title").alias("title"), of("surname", "author").alias("surname"), of("year", "year").alias("year"))
    filed = rules.file_values(F.coalesce("surname", F.lit("")), F.coalesce("year", F.lit(0)), F.coalesce("title", F.lit("")))
    return out.withColumn("file_name", F.when(F.col("action") == "filed", filed))


def import_entries(entries: DataFrame, library: DataFrame) -> DataFrame:
    """Entries of a reference list, in file order, against the library: ``entry, action, match``.

    'new', 'duplicate' of a library record, or 'folded' into an earlier entry of the file. Frames have id, title, date, doi,
    isbn. Nothing is written.
    """
    keyed = lambda f: f.select("id", "title", "date", dedup.duplicate_keys(F.col("title"), F.col("doi"), F.col("isbn")).alias("keys"))
    new, known = keyed(entries), keyed(library)
    # ids of the two frames are kept apart: library ids are negative here
    inside = dedup.key_duplicates(new, new).where("match < id").select("id", F.col("match").alias("earlier"))
    outside = dedup.key_duplicates(new, known.withColumn("id", -F.col("id") - 1)).select("id", (-F.col("match") - 1).alias("known"))
    out = entries.select("id").join(outside, "id", "left").join(inside, "id", "left")
    action = F.when(F.col("known").isNotNull(), "duplicate").when(F.col("earlier").isNotNull(), "folded").otherwise("new")
    return out.select(F.col("id").alias("entry"), action.alias("action"), F.coalesce("known", "earlier").alias("match"))


def near_duplicates(prints: DataFrame, n_bits: int, certain: int, most: int, group: str, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, doubtful): certain pairs make groups with a keeper (most points(id, points), then lowest id); doubtful pairs
    inside one group are dropped, the others wait for review."""
    pairs = stored(dedup.fingerprint_pairs(prints, n_bits, most, group), "pairs")
    member = stored(components.connected_components(pairs.where(F.col("distance") <= certain)), "groups")
    best = member.join(points, "id").groupBy("component_id").agg(F.max_by("id", F.struct("points", -F.col("id"))).alias("keeper"))
    groups = member.join(best, "component_id").select("id", "component_id", "keeper", (F.col("id") == F.col("keeper")).alias("kept"))
    side = lambda n: member.select(F.col("id").alias(n), F.col("component_id").alias(f"c{n}"))
    rest = pairs.where(F.col("distance") > certain).join(side("a"), "a", "left").join(side("b"), "b", "left")
    return groups, rest.where("ca is null or cb is null or ca <> cb").select("a", "b", "distance")


def enrich(candidates: DataFrame, query: str, work: str, reasons: dict[str, Column], fields: list[str], threshold: float = 0.8) -> DataFrame:
    """Candidates deduplicated in order of arrival, vetoed, chosen with ties, and the accepted ones filled from near-equals."""
    first = rank.first_of(candidates, F.coalesce(F.lower(F.trim("doi")), F.concat_ws("|", text.normalise(F.col("title")), F.substring("date", 1, 4), "source")), query, "arrival")
    judged = stored(rank.vetoed(first, reasons), "candidates")
    chosen = rank.choose(judged, query, work, threshold)
    filled = rank.fill_winner(judged, query, work, fields)
    return chosen.join(filled.drop("id", "confidence"), query)


def space_audit(aside: DataFrame, kept: DataFrame) -> DataFrame:
    """Files set aside (path, sha256) are 'safe' to delete if a kept file has the same content, else 'to check'."""
    same = kept.groupBy("sha256").agg(F.min("path").alias("twin"))
    return aside.join(same, "sha256", "left").select("path", "twin", F.when(F.col("twin").isNotNull(), "safe").otherwise("to check").alias("state"))


def existing_work(new: DataFrame, known: DataFrame) -> DataFrame:
    """``id, match``: for new records the known work without a file they belong to, by words, surname and year; smallest id.

    Frames have id, title, surname, date.
    """
    words = lambda f, n: f.select(F.col("id").alias(n), text.words(F.col("title")).alias("words"))
    pairs = linkage.word_pairs(words(new, "id"), words(known, "match"), 1 / 3)  # each rule needs more than that
    a, b = new.select("id", F.col("surname").alias("sa"), F.col("date").alias("da")), known.select(F.col("id").alias("match"), F.col("surname").alias("sb"), F.col("date").alias("db"))
    j = pairs.join(a, "id").join(b, "match")
    x, y = text.normalise(F.col("sa")), text.normalise(F.col("sb"))
    same = F.coalesce(x.contains(y) | y.contains(x), F.lit(False))
    ok = years_ok(F.col("da"), F.col("db")) & linkage.accepted(F.col("words"), F.col("words_b"), same, text.is_blank(F.col("sb")))
    return j.where(ok).groupBy("id").agg(F.min("match").alias("match"))


def verification(records: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Counts by verdict of records(key, title, surname) that only a model read, against a catalogue of the same columns."""
    c = catalogue.select(key, F.col("title").alias("t2"), F.col("surname").alias("s2"))
    v = evidence.verified(F.col("title"), F.col("t2"), F.col("surname"), F.col("s2"))
    return records.join(c, key, "left").select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def bulk_edit(records: DataFrame, changes: dict[str, tuple[str, object]], ids: list[int], allowed: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(records, audit) after an edit of at most 200 ids; records in processing are skipped and say so in the audit."""
    edit.validated(changes, allowed, 200, len(ids))
    chosen = F.col(key).isin(*ids)
    busy = F.col("state") == "processing"
    out = edit.bulk_edit(records, changes, chosen & ~busy)
    audit = out.where(chosen).select(key, F.when(busy, "skipped").when(F.col("changed"), "changed").otherwise("same").alias("action"))
    return out.select(*[F.col(f"new_{c}").alias(c) if c in changes else F.col(c) for c in records.columns]), audit
