"""User-defined record types and their fields, and tables of pluggable catalogues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("text", "long text", "number", "date", "url", "list", "yes/no")

PERSON = T.StructType([T.StructField(n, T.StringType()) for n in ("surname", "given", "literal", "role")])
CANDIDATE = T.StructType(
    [T.StructField("query_id", T.LongType()), T.StructField("arrival", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("suggested_type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(PERSON))]
    + [T.StructField(n, T.StringType()) for n in ("date", "publisher", "place", "doi", "isbn", "url")]
    + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType()))]
)


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    kind: str = "text"
    options: tuple[str, ...] = ()
    csl: str | None = None


@dataclass
class RecordType:
    name: str
    csl: str
    nature: str = ""
    fields: list[Field] = field(default_factory=list)

    def add(self, f: Field) -> None:
        """Appends a field unless its key is there already, so that migrations may run again."""
        if f.kind not in KINDS:
            raise ValueError(f"unknown kind: {f.kind}")
        if all(x.key != f.key for x in self.fields):
            self.fields.append(f)


def typed(metadata: Column, t: RecordType) -> list[Column]:
    """A column for each field of the type, cast by its kind; what cannot be cast is null."""
    cast = {"number": "double", "date": "string", "yes/no": "boolean"}
    out = []
    for f in t.fields:
        v = F.try_element_at(metadata, F.lit(f.key))
        out.append((F.split(v, r"\s*;\s*") if f.kind == "list" else v.try_cast(cast.get(f.kind, "string"))).alias(f.key))
    return out


def invalid_keys(metadata: Column, t: RecordType) -> Column:
    """Keys of the metadata that the type does not know, and closed-list values that are not options."""
    known = F.array(*[F.lit(f.key) for f in t.fields]) if t.fields else F.array().cast("array<string>")
    unknown = F.array_except(F.map_keys(metadata), known)
    closed = [F.when(F.try_element_at(metadata, F.lit(f.key)).isNotNull() & ~F.try_element_at(metadata, F.lit(f.key)).isin(*f.options), F.lit(f.key)) for f in t.fields if f.options]
    return F.concat(unknown, F.array_compact(F.array(*closed))) if closed else unknown


def candidates_of(frame: DataFrame, source: str, confidence: Column, **columns: Column) -> DataFrame:
    """A catalogue's rows in the candidate schema; columns not given are null, placeholder imprints empty."""
    none = r"(?i)^\W*(s\.?\s*[ln]\.?|sine (loco|nomine))\W*$"
    given = {"source": F.lit(source), "confidence": confidence} | columns
    for name in ("publisher", "place"):
        if name in given:
            given[name] = F.when(~given[name].rlike(none), given[name])
    return frame.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE.fields])


def by_identifier(queries: DataFrame, catalogues: list[DataFrame], key: str) -> DataFrame:
    """For each query the row of the first catalogue, in order, that has its identifier: ``key, level`` and the catalogue's columns."""
    parts = [c.withColumn("level", F.lit(i)) for i, c in enumerate(catalogues)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hit = queries.select(key).distinct().join(every, key)
    cols = [c for c in every.columns if c != key]
    return hit.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("level", *[c for c in cols if c != "level"])).alias("x")).select(key, "x.*")
