"""Secret scans: candidates found by shape, false positives removed by a random forest. DataFrame and pyspark.ml only.

A candidate is a run of 16 or more letters, digits and ``_ + / = -``, or whatever of 8 characters or more is assigned to
the name of a credential. The forest sees its length, its character transitions, how much of it dictionary words cover, its
path, and the neighbouring words; it learns from labelled findings. Where none are given, these are made by a rule: secrets
in the forms that keys and passwords are issued and written down in, and what is most often taken for them (commit hashes,
checksums, UUIDs, encoded images, identifiers, placeholders, numbers), each in several contexts.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.components import stored

RUN = r"[A-Za-z0-9_+/=-]{16,}"
#: Words that announce a credential, and paths of material that is not in use.
ANNOUNCES = r"(?i)(token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)"
EXAMPLES = r"(?i)(test|example|sample|fixture|mock|doc)"
#: The name of a credential and the sign that assigns it, and a value after it.
NAMED = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|secret|auth)[_.-]?key|auth|credentials?)[\"'`]?\s*(?::=|[=:])[\"'`]?"
VALUE = r"[^\s\"'`<>;,]{7,}[^\s\"'`<>;,.)\]}:]"
#: Words that announce an identifier of something public, and prefixes by which issuers mark keys.
IDENTIFIES = r"(?i)(commit|\bsha|md5|checksum|digest|hash|uuid|guid|revision|\brev\b|merge|parent|etag|integrity|image|base64|version|\bid\b|_id\b|record|isbn|number)"
ISSUED = r"^(AKIA|ASIA|gh[pousr]_|glpat-|sk_|pk_|rk_|xox[abprs]-|AIza|npm_|SG\.|hf_)"
PLACEHOLDER = r"(?i)(your|change.?me|example|placeholder|dummy|xxxx|\*\*\*|\$\{|\{\{|<|getenv|environ|insert|replace)"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Labelled findings used for the fit, of each label; uses of a word in the corpus that make it a dictionary word; trees and their depth.
SAMPLE, USES, TREES, DEPTH = 10_000, 5, 20, 6
FEATURES = [
    "length", "turns", "turn_share", "digits", "uppers", "lowers", "symbols", "hexadecimal", "variety", "coverage",
    "path_depth", "path_example", "assigned", "quoted", "announced", "prefix_announced", "next_plain", "before_plain",
    "identified", "issued", "uuid", "placeholder",
]


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, path, at, nth, candidate, before, prefix, suffix, after``: at counts words of the text, nth candidates of the word."""
    words = F.split(F.col(text), r"\s+")
    last = lambda i, n: F.coalesce(F.when(i >= n, F.get("__words", i - n)), F.lit(""))

    def told(w: Column, i: Column) -> Column:
        """Whether what stands before the word, or its own first part, assigns a credential."""
        own = (w.contains("=") | w.contains(":")) & w.rlike(f"{NAMED}{VALUE}")
        ends = last(i, 1).rlike("[=:]$")
        return (F.length(w) >= 8) & (own | (ends & F.concat(last(i, 2), last(i, 1)).rlike(f"{NAMED}$")))

    def kind(w: Column, i: Column) -> Column:
        return F.when(told(w, i), 2).when((F.length(w) >= 16) & w.rlike(RUN), 1).otherwise(0)

    hit = F.filter(F.transform("__words", lambda w, i: F.struct(w.alias("w"), i.alias("i"), kind(w, i).alias("k"))), lambda x: x["k"] > 0)
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), words.alias("__words"))
    rows = rows.select("doc_id", "path", "__words", F.explode(hit).alias("x"))
    near = lambda n: F.coalesce(F.when(F.col("x.i") + n >= 0, F.get("__words", F.col("x.i") + n)), F.lit(""))
    rows = rows.select("doc_id", "path", F.col("x.i").alias("at"), F.col("x.w").alias("word"), "x.k", F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("before"), near(1).alias("after"))
    # a word that names and assigns its value has it after the sign, one that follows such a sign is the value itself
    value = F.when(F.col("word").rlike(f"{NAMED}{VALUE}"), F.regexp_extract("word", f"{NAMED}({VALUE})", 1)).otherwise(F.regexp_extract("word", f"^[\"'`(]*({VALUE})", 1))
    runs = F.when((F.col("k") == 2) & (value != ""), F.array(value)).otherwise(F.regexp_extract_all("word", F.lit(f"({RUN})"), F.lit(1)))
    rows = rows.select("*", F.posexplode(runs).alias("nth", "run"))
    # name=value is taken apart; padding stays with the value
    named = F.when(F.col("k") == 1, F.regexp_extract("run", r"^([A-Za-z_-]+=+)(.+)$", 1)).otherwise("")
    cut = F.when((named != "") & (F.length("run") - F.length(named) >= 8), F.substr("run", F.length(named) + 1)).otherwise(F.col("run"))
    rows = rows.withColumn("candidate", cut).withColumn("place", F.expr("instr(word, run)") + F.length("run") - F.length("candidate"))
    return rows.select("doc_id", "path", "at", "nth", "candidate", "before", F.substr("word", F.lit(1), F.col("place") - 1).alias("prefix"), F.substr("word", F.col("place") + F.length("candidate")).alias("suffix"), "after")


#: Words of which identifiers are made; part of every dictionary.
IDENTIFIER_WORDS = """account action address adapter admin auth base buffer build builder cache callback change channel client code collection column command commit
common config configuration connection container content context controller count create current data database date default delete document element endpoint entity
error event example exception expected factory field file filter find first format from function generator get group handler hash header host icon image import index
info initialize input insert instance interface internal invalid item iterator key label last layout level library line link list listener load local lock log long
manager map match max message method min mock mode model module name network next node not null number object observer offset option order output package page parent
parse parser password path pattern payload place placeholder policy pool previous process processor provider public query queue range read reader record reference
register remote remove render replace repository request reset resource response result return root route row rule runtime schedule schema scope search secret select
send serializer server service session set setting size sort source stack start state static status stop store stream string style system table target task template
test text thread time token transaction transform tree type update upload user util validate validator value variable vector version view widget window word worker
write writer your""".split()


def dictionary(docs: DataFrame, text: str = "text", uses: int = USES) -> DataFrame:
    """``word``: lower-case words of three or more ASCII letters used at least ``uses`` times in all documents, and those of identifiers."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-z]+")).alias("word")).where(F.length("word") >= 3)
    fixed = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= uses).select("word").union(fixed).distinct()


def _hash(n: int) -> str:
    return f"sha2(concat('finding', id, '/', {n}), 256)"


_HEX, _B64 = f"concat({_hash(1)}, {_hash(2)})", f"concat(base64(unhex({_hash(3)})), base64(unhex({_hash(4)})), base64(unhex({_hash(5)})))"
_MIXED = f"regexp_replace({_B64}, '[^A-Za-z0-9]', '')"
_DIGITS = f"translate({_HEX}, 'abcdef', '735182')"
_UPPER = f"upper(regexp_replace({_B64}, '[^A-Z0-9]', ''))"
_LETTERS = f"regexp_replace({_MIXED}, '[0-9]', '')"
_SIZED = f"(16 + pmod(xxhash64(id, 'size'), 33))"
_WORD = "element_at(split('{}', ' '), cast(1 + pmod(xxhash64(id, {}), {}) as int))"
_WORDS = [_WORD.format(" ".join(IDENTIFIER_WORDS), n, len(IDENTIFIER_WORDS)) for n in range(5)]
_UUID = f"concat_ws('-', substr({_HEX}, 1, 8), substr({_HEX}, 9, 4), substr({_HEX}, 13, 4), substr({_HEX}, 17, 4), substr({_HEX}, 21, 12))"
_SHORT = f"concat(substr({_MIXED}, 1, 2 + pmod(id, 5)), element_at(split('! # % & * + ^ @ - _', ' '), cast(1 + pmod(id, 10) as int)), substr({_MIXED}, 20, 4 + pmod(id, 6)), pmod(id, 90))"
_NAMES = ["password", "passwd", "pwd", "secret", "token", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "SECRET_KEY", "apiKey", "db.password", "accessToken"]
_ASSIGNED = [f.format(n=n, v="{}") for n in _NAMES for f in ('{n} = "{v}"', "{n}={v}", "{n}: {v}", "{n}='{v}'", '"{n}": "{v}",', "export {n}={v}", "{n} := `{v}`")]
_BARE = ["using {} for the upload", "the key is {}", "{}", "credentials {} were issued", "({})", "log in with {} now"]
_PROSE = ["see {} for details", "as in {} before", "{}", "we met {} again", "the entry {} is old", "({})", "it was {}.", "about {} and more"]
#: Made findings: kind, whether it is a secret, a value in SQL, and its contexts.
KINDS: list[tuple[str, int, str, list[str]]] = [
    ("hex secret", 1, f"substr({_HEX}, 1, {_SIZED})", _ASSIGNED),
    ("mixed secret", 1, f"substr({_MIXED}, 1, {_SIZED})", [*_ASSIGNED, "Authorization: Bearer {}", "curl -H 'X-Api-Key: {}'"]),
    ("base64 secret", 1, f"substr({_B64}, 1, 40)", _ASSIGNED),
    ("short password", 1, _SHORT, [a for a in _ASSIGNED if a.lstrip('"e').startswith(("pass", "pwd", "db", "xport pass", "xport pwd"))]),
    ("cloud key id", 1, f"concat('AKIA', substr({_UPPER}, 1, 16))", [*_BARE, "aws_access_key_id = {}", 'id: "{}"', "key={}"]),
    ("repository token", 1, f"concat('ghp_', substr({_MIXED}, 1, 36))", [*_BARE, "https://{}@host/x.git", "token: {}"]),
    ("payment key", 1, f"concat('sk_live_', substr({_MIXED}, 1, 24))", [*_BARE, "stripe {}", 'key = "{}"']),
    ("chat token", 1, f"concat('xoxb-', substr({_DIGITS}, 1, 12), '-', substr({_MIXED}, 1, 24))", [*_BARE, 'bot: "{}"']),
    ("uuid", 0, _UUID, [*_PROSE, "request_id={}", '"uuid": "{}"', "id {}", "record {} was moved", 'session = "{}"']),
    ("commit", 0, f"substr({_HEX}, 1, 40)", [*_PROSE, "fixed in commit {}", "commit {}", "merge {} into main", 'rev = "{}"', "parent {}", "reverts {}", "at revision {}", "cherry picked from commit {})"]),
    ("checksum", 0, f"substr({_HEX}, 1, element_at(array(32, 40, 64, 128), cast(1 + pmod(id, 4) as int)))", [*_PROSE, "sha256: {}", "md5sum {}", 'checksum = "{}"', "{} file.tar.gz", "digest sha256:{}", 'hash: "{}"', "sha1={}"]),
    ("encoded image", 0, f"concat('iVBORw0KGgo', {_B64}, {_B64})", ["data:image/png;base64,{}", 'src="data:image/jpeg;base64,{}"', "url(data:image/gif;base64,{})", "image {}", *_PROSE]),
    ("integrity", 0, f"concat('sha512-', {_B64})", ['"integrity": "{}"', "integrity={}", "{}"]),
    ("camel case", 0, f"concat({_WORDS[0]}, initcap({_WORDS[1]}), initcap({_WORDS[2]}), initcap({_WORDS[3]}))", [*_PROSE, "call {}(x)", "{} = 3", "self.{}", *_ASSIGNED[:20]]),
    ("snake case", 0, f"concat_ws('_', {', '.join(_WORDS)})", [*_PROSE, "{} = None", "{}(a, b)", *_ASSIGNED[:20]]),
    ("path", 0, f"concat_ws('/', {', '.join(_WORDS)})", [*_PROSE, "open({})", "file: {}", "path = '{}'"]),
    ("slug", 0, f"concat_ws('-', {', '.join(_WORDS)})", [*_PROSE, "url: {}"]),
    ("number", 0, f"substr({_DIGITS}, 1, 13 + pmod(id, 8))", [*_PROSE, "isbn {}", "number: {}", "phone={}", "ref {}"]),
    ("long word", 0, f"lower(substr({_LETTERS}, 1, {_SIZED}))", _PROSE),
    ("rule", 0, "repeat(element_at(split('- = _ ab', ' '), cast(1 + pmod(id, 4) as int)), 20)", _PROSE),
    ("placeholder", 0, "element_at(array('your_password_here', 'CHANGE_ME_PLEASE', 'xxxxxxxxxxxxxxxx', 'example-secret-value', 'os.getenv(TOKEN)', '${SECRET_VALUE}', 'replace_with_token', '****************'), cast(1 + pmod(id, 8) as int))", _ASSIGNED),
]
PER_KIND = 300


def findings(spark: SparkSession, per_kind: int = PER_KIND, without: tuple[str, ...] = ()) -> DataFrame:
    """``candidates`` of made texts with ``kind`` and ``label``; which path, context and surrounding words one gets does not hang on its label."""
    kinds = [k for k in KINDS if k[0] not in without]
    n = len(kinds)
    pick = lambda options, salt: F.element_at(options, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(options)) + 1).cast("int"))
    quoted = lambda xs: F.array(*map(F.lit, xs))
    rows = spark.range(0, n * per_kind, 1, 4).withColumn("k", F.expr(f"cast(id % {n} + 1 as int)"))
    of = lambda make: F.element_at(F.array(*map(make, kinds)), F.col("k"))
    rows = rows.select("id", of(lambda k: F.lit(k[0])).alias("kind"), of(lambda k: F.lit(k[1])).alias("label"), of(lambda k: F.expr(k[2])).alias("value"), of(lambda k: quoted(k[3])).alias("contexts"))
    around = quoted(["", "please check", "we saw that", "in this file", "and then the", "und dann", "et puis", "para los", "#", "//"])
    paths = quoted(["", "web", "src/app/config.py", "tests/fixtures/data.json", "docs/readme.md", "deploy/prod.env", "lib/a/b/c.js", "example/run.sh"])
    body = F.concat_ws(" ", pick(around, 1), F.replace(pick(F.col("contexts"), 2), F.lit("{}"), F.col("value")), pick(around, 3))
    made = rows.select(F.col("id").alias("doc_id"), "kind", "label", "value", body.alias("text"), pick(paths, 4).alias("source"))
    return candidates(made).join(made.select("doc_id", "kind", "label"), "doc_id")


def features(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the columns of FEATURES; coverage is the share of characters in dictionary words."""
    c = F.col("candidate")
    share = lambda kind: F.regexp_count(c, F.lit(kind)) / F.length(c)
    parts = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), F.lit(1)))
    keyed = found.withColumn("__id", F.xxhash64("candidate"))
    pieces = keyed.select("candidate", F.explode(parts).alias("word")).distinct()
    covered = pieces.join(known, "word", "left_semi").groupBy("candidate").agg(F.sum(F.length("word")).alias("__covered"))
    turns = F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    d = lambda x: x.cast("double")
    columns: dict[str, Column] = {
        "length": d(F.length(c)), "turns": d(turns), "turn_share": turns / F.length(c), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "symbols": share("[_+/=-]"),
        "hexadecimal": d(c.rlike("^([0-9a-f]+|[0-9A-F]+)$") & ~c.rlike("^[0-9]+$")), "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c), "coverage": F.least(F.lit(1.0), F.coalesce("__covered", F.lit(0)) / F.length(c)),
        "path_depth": d(F.regexp_count("path", F.lit("/"))), "path_example": d(F.col("path").rlike(EXAMPLES)), "assigned": d(F.concat("before", F.lit(" "), "prefix").rlike("[=:][\"'\\s]*$")),
        "quoted": d(F.col("prefix").rlike("[\"']$")), "announced": d(F.col("before").rlike(ANNOUNCES)), "prefix_announced": d(F.col("prefix").rlike(ANNOUNCES)),
        "next_plain": d(F.col("after").rlike(r"^[\p{L}]+[.,!?]?$")), "before_plain": d(F.col("before").rlike(r"[\p{L}]+[.,!?]?$")),
        "identified": d(F.concat("before", F.lit(" "), "prefix").rlike(IDENTIFIES)), "issued": d(c.rlike(ISSUED)), "uuid": d(c.rlike(UUID)), "placeholder": d(c.rlike(PLACEHOLDER)),
    }
    out = keyed.join(covered, "candidate", "left")
    return out.select(*found.columns, *[v.alias(k) for k, v in columns.items()])


def fit(labelled: DataFrame, sample: int = SAMPLE, seed: int = 11) -> RandomForestClassificationModel | float:
    """The forest for ``labelled(FEATURES, label 0 or 1)``, or a constant score if only one label (or none) is there.

    At most ``sample`` findings of each label are used, the first by a hash of their features."""
    order = F.xxhash64(*FEATURES, F.lit(seed))
    known = labelled.where("label in (0, 1)").select(*FEATURES, F.col("label").cast("double").alias("label"))
    both = [known.where(F.col("label") == x).orderBy(order).limit(sample) for x in (0.0, 1.0)]
    rows = stored(both[0].union(both[1]), "labelled")
    labels = sorted(r.label for r in rows.select("label").distinct().collect())
    if len(labels) < 2:
        return labels[0] if labels else 0.0
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).coalesce(4)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, maxMemoryInMB=64).fit(vectors)


def judged(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """``found`` with ``score`` (0 to 1) and ``is_secret`` (0.5 and more)."""
    if isinstance(model, float):
        out = found.withColumn("score", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(found)
        model = model.copy().setFeaturesCol("__features").setProbabilityCol("__p").setPredictionCol("").setRawPredictionCol("")
        out = model.transform(vectors).withColumn("score", F.round(vector_to_array("__p")[1], 6))
    return out.drop("__features", "__p").withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, label: Column | None = None, text: str = "text", path: str = "source", without: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, path, at, nth, candidate, score, is_secret`` for every candidate in the whole texts.

    ``label`` gives the label of a finding (0, 1, or null for none) from the columns of :func:`candidates`; findings that
    carry one train the forest. Without it the made findings do (:func:`findings`, less the kinds in ``without``).
    Null or empty texts and texts without candidates have no rows; a null path is empty. Long texts are searched whole.
    Repeated rows give repeated findings; a null doc_id stays null. Columns other than doc_id, text and path are not read.
    """
    found = stored(candidates(docs, text, path), "candidates")
    known = stored(dictionary(docs, text), "dictionary")
    full = stored(features(found, known), "features")
    labelled = full.withColumn("label", label) if label is not None else features(findings(docs.sparkSession, without=without), known)
    return judged(full, fit(labelled)).select("doc_id", "path", "at", "nth", "candidate", "score", "is_secret")
