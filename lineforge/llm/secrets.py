"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame functions and Spark's own forest only. A candidate is a long run of the
characters that keys and tokens are made of, or any value, however short and of whatever
characters but white space, that is assigned to a credential's name or follows the user in
an address. Its features are its length, how usual its
character transitions are in the corpus's words, how much of it words of the corpus cover,
whether it reads like a path, and the words beside it. The forest learns from labelled
findings; where no one has labelled any, ``label_by_format`` does it for formats that leave
no doubt, and the forest decides on the others as well as on those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm.components import split_join
from lineforge.llm.names import col, free_names, without
from lineforge.session import run_dir

LEAST = 16  # characters of a candidate that nothing assigns
CERTAIN = 8  # characters of a value that its assignment alone labels a secret, and that is masked wherever it occurs
THRESHOLD = 0.5
TRAINING_ROWS = 20_000  # labelled findings the forest learns from at most, chosen by hash
TREES, DEPTH, SEED = 20, 6, 17
COMMON = 5  # times a word must occur to count for the dictionary
MASK = "[SECRET]"

_RUN = r"A-Za-z0-9+/_.\-"
# A run that has a digit or 32 letters in a row, is assigned to something, or begins as
# published keys do. It ends in a letter, digit or padding, so a full stop after it is not
# part of it.
CANDIDATE = (
    rf"(?<![{_RUN}])(?:(?=[A-Za-z+/_.\-]*[0-9])|(?=[A-Za-z]{{32}})|(?<=[=:][\"'])|(?<=[=:] [\"'])"
    rf"|(?=A[KS]IA[A-Z]{{12}}|gh[pousr]_|xox[abprs]-|sk-))"
    rf"[{_RUN}]{{{LEAST - 1},}}[A-Za-z0-9+/_]={{0,2}}"
)
# Nouns that name a credential, and published prefixes of keys. Fixed values.
_NOUNS = "(?:token|secret(?:_?key)?|passw(?:or)?d|passphrase|pwd|api_?key|access_?key|auth|credential|bearer|private_?key)"
NOUN = rf"(?i){_NOUNS}\W*$"
PREFIXED = r"^(?:-----BEGIN |(A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})$)"

# Blanks on either side of a sign; Java's look-behind needs a bound.
_BLANKS = r"[ \t]{0,16}"
_TO_NOUN = rf"(?i:{_NOUNS})[\"']?{_BLANKS}[=:]{{1,2}}>?{_BLANKS}"
# A value assigned to a noun: in quotes, up to one without a backslash before it, or else up
# to white space, a quote or the next setting, without punctuation at its end. Or what stands
# between ://user: and @, or inside an element with a noun's name. Short looks behind come
# first, so that the long ones are rarely taken.
ASSIGNED = "|".join(
    (
        *(rf"(?<=[=:> \t]{q})(?<={_TO_NOUN}{q})(?!{q})\S+?(?<!\\)(?={q})" for q in "\"'"),
        rf"(?<=[=:> \t])(?=[^\s\"'=:>])(?<=[=:>]{_BLANKS})(?<={_TO_NOUN})"
        r"[^\s\"']*?[^\s\"'.,;:)\]}>](?=[.,;:)\]}>]*(?:[\s\"']|$)|[&;,]\w{1,64}=)",
        r"(?<=:)(?<=://[^\s/:@\"']{1,255}:)[^\s/@\"']+(?=@)",
        rf"(?<=>)(?<=(?i:{_NOUNS})>)[^\s<>]+(?=</)",
    )
)
# A private key in its armour, over several lines.
PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
)
FOUND = f"{PEM}|{ASSIGNED}|{CANDIDATE}"  # a whole assigned value rather than a run inside it

FINDING = ("finding_no", "value", "before", "after")
FEATURES = (
    "length",
    "transitions",
    "coverage",
    "digits",
    "upper",
    "distinct",
    "hex",
    "path_parts",
    "dots",
    "noun_before",
    "assigned",
    "quoted",
    "word_before",
    "word_after",
)

_CLASSES = 28  # a to z, digit, anything else


@dataclass(frozen=True)
class Transitions:
    """Log probability of each character class after each other, as literal rows."""

    rows: tuple[tuple[float, ...], ...]

    def mean(self, value: Column) -> Column:
        """Mean log probability of the transitions inside a value; 0 for a single character."""
        table = F.array(*[F.lit(p) for row in self.rows for p in row])
        codes = F.transform(F.split(F.lower(value), ""), _class)
        found = F.transform(_pairs(codes), lambda p: F.get(table, p))
        total = F.aggregate(found, F.lit(0.0).cast("double"), lambda a, x: a + x)
        return F.when(F.size(codes) > 1, total / (F.size(codes) - 1)).otherwise(F.lit(0.0))


def _class(char: Column) -> Column:
    code = F.ascii(char)
    return (
        F.when(code.between(97, 122), code - 97).when(code.between(48, 57), F.lit(26)).otherwise(F.lit(27))
    )


def _pairs(codes: Column) -> Column:
    """Neighbouring classes as one number each."""
    size = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, size), F.slice(codes, 2, size), lambda a, b: a * _CLASSES + b)


def common_words(docs: DataFrame, text: str = "text", times: int = COMMON) -> DataFrame:
    """(word): runs of three to twenty letters, lower-cased, that occur often in the whole corpus."""
    runs = docs.select(F.explode(F.split(F.lower(col(text)), r"[^\p{L}]+")).alias("word"))
    return (
        runs.where(F.length("word").between(3, 20))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= times)
        .select("word")
    )


def learn_transitions(words: DataFrame) -> Transitions:
    """Smoothed transition probabilities of the words' letters; at most 784 counts reach the driver."""
    pairs = words.select(F.explode(_pairs(F.transform(F.split("word", ""), _class))).alias("pair"))
    counts = [[1.0] * _CLASSES for _ in range(_CLASSES)]
    for row in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect():
        counts[row["pair"] // _CLASSES][row["pair"] % _CLASSES] += row["n"]
    logs = [[math.log(n / sum(row)) for n in row] for row in counts]
    return Transitions(tuple(map(tuple, logs)))


def candidates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, finding_no (from 0 in each text), value, before and after.

    ``before`` and ``after`` are up to eighty characters of the line around a value. Whole
    texts are searched; null and empty ones have no candidates.
    """
    kept = [col(c) for c in without(keep, (*FINDING, *FEATURES, "score", "is_secret"))]
    body, values, around = free_names([*keep, *FINDING], "body", "values", "around")
    found = (
        docs.select(*kept, col(text).alias(body))
        .withColumn(values, F.regexp_extract_all(col(body), F.lit(FOUND), F.lit(0)))
        .where(F.size(values) > 0)
    )
    between = F.split(col(body), FOUND, -1)
    cut = F.transform(
        between,
        lambda s: F.struct(
            F.substring_index(F.right(s, F.lit(80)), "\n", -1).alias("before"),
            F.substring_index(F.left(s, F.lit(80)), "\n", 1).alias("after"),
        ),
    )
    rows = found.withColumn(around, cut).select(*kept, around, F.posexplode(values).alias("finding_no", "value"))
    return rows.select(
        *kept,
        "finding_no",
        "value",
        F.get(around, F.col("finding_no"))["before"].alias("before"),
        F.get(around, F.col("finding_no") + 1)["after"].alias("after"),
    )


def describe(findings: DataFrame, words: DataFrame, transitions: Transitions) -> DataFrame:
    """The findings with ``FEATURES``.

    What depends on the value alone is computed once for each distinct value; the findings
    of a frequent value may be split by adaptive execution.
    """
    values = findings.select("value").distinct()
    runs = values.select(
        "value", F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("run")
    ).where(F.length("run") >= 3)
    covered = (
        runs.join(words, runs["run"] == words["word"])
        .groupBy("value")
        .agg(F.sum(F.length("run")).alias("covered"))
        .withColumnRenamed("value", "_covered")
    )
    size = F.length("value")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace("value", pattern, "")) / size

    described = values.join(covered, values["value"] == covered["_covered"], "left").select(
        F.col("value").alias("_value"),
        size.cast("double").alias("length"),
        transitions.mean(F.col("value")).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        share("[^0-9]").alias("digits"),
        share("[^A-Z]").alias("upper"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(size, F.lit(64))).alias("distinct"),
        share("[^0-9a-fA-F]").alias("hex"),
        (F.size(F.split("value", "/")) - 1).cast("double").alias("path_parts"),
        (F.size(F.split("value", "[.]")) - 1).cast("double").alias("dots"),
    )
    joined = split_join(findings, "value", described, "_value").drop(described["_value"])
    return joined.select(
        "*",
        F.col("before").rlike(NOUN).cast("double").alias("noun_before"),
        F.col("before").rlike(r"(?:[=:]>?|<\w{1,64}>)\s*[\"']?$").cast("double").alias("assigned"),
        (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double").alias("quoted"),
        F.col("before").rlike(r"\p{L}{2,}[.,;]?\s*$").cast("double").alias("word_before"),
        F.col("after").rlike(r"^[\"'.,;]?\s*\p{L}{2,}").cast("double").alias("word_after"),
    )


def label_by_format() -> Column:
    """1 or 0 where the format of a finding and its neighbours leave no doubt, else null.

    Secrets: a published key prefix, or a value without words that has a digit, is not too
    short and is assigned to a credential's name. Others: digits alone, host names after an at sign, values that words
    cover, and paths or dotted names that words cover by half.
    """
    assigned = (F.col("noun_before") == 1) & (F.col("assigned") == 1) & (F.col("length") >= CERTAIN)
    plain = (F.col("digits") == 1) | F.col("before").endswith("@") | (F.col("coverage") >= 0.8)
    named = (F.col("path_parts") + F.col("dots") > 0) & (F.col("coverage") >= 0.5)
    return (
        F.when(F.col("value").rlike(PREFIXED), 1.0)
        .when(assigned & (F.col("coverage") < 0.3) & F.col("digits").between(0.01, 0.99), 1.0)
        .when(plain | named, 0.0)
    )


def train(
    spark: SparkSession, findings: DataFrame, label: str = "label", rows: int = TRAINING_ROWS
) -> RandomForestClassificationModel | float:
    """A forest from described findings with a label of 0 or 1; other labels are left out.

    Equal findings count once with their number as weight. At most ``rows`` distinct ones
    are used, those of the smallest hash, and written as one sorted file, so that the same
    table gives the same forest. If a class is missing, the smoothed share of secrets
    stands in for the forest.
    """
    path = run_dir(spark, "secret-training")
    known = findings.where(F.col(label).isin(0.0, 1.0)).groupBy(*FEATURES, F.col(label).alias("label"))
    order = F.xxhash64(*FEATURES, "label")
    known.agg(F.count("*").cast("double").alias("weight")).orderBy(order, *FEATURES, "label").limit(rows).coalesce(
        1
    ).write.parquet(path)
    training = spark.read.parquet(path)
    seen = {r["label"]: r["weight"] for r in training.groupBy("label").agg(F.sum("weight").alias("weight")).collect()}
    if len(seen) < 2:
        return (seen.get(1.0, 0.0) + 1) / (sum(seen.values()) + 2)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", weightCol="weight", featuresCol="vector"
    )
    # Both classes weigh the same, and so do frequent and rare findings up to the logarithm.
    even = F.log1p("weight")
    total = training.groupBy("label").agg(F.sum(even).alias("_sum"))
    weighed = training.join(total, "label").withColumn("weight", even / F.col("_sum") * 1000)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(weighed))


def score(findings: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """The described findings with ``score``, the forest's probability of a secret."""
    if isinstance(model, float):
        return findings.withColumn("score", F.lit(model))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector").transform(findings)
    model = model.setFeaturesCol("_vector").setProbabilityCol("_probability")
    model = model.setPredictionCol("").setRawPredictionCol("_raw")
    scored = model.transform(vectors)
    return scored.withColumn("score", vector_to_array("_probability")[1]).drop("_vector", "_probability", "_raw")


def scan(
    spark: SparkSession, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Every finding of whole texts with its features, score and ``is_secret``.

    The dictionary and the transitions come from all texts. Null and empty texts have no
    findings, repeated rows have theirs each; findings of one value and context get one
    score. An empty table gives no rows.
    """
    folder = run_dir(spark, "secret-scan")
    common_words(docs, text).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    candidates(docs, text, keep).write.parquet(f"{folder}/candidates")
    found = spark.read.parquet(f"{folder}/candidates")
    describe(found, words, learn_transitions(words)).write.parquet(f"{folder}/findings")
    findings = spark.read.parquet(f"{folder}/findings")
    model = train(spark, findings.withColumn("label", label_by_format()))
    return score(findings, model).withColumn("is_secret", F.col("score") >= THRESHOLD)


def masked(value: Column) -> Column:
    """The ends of a value; a short one shows nothing."""
    short = F.length(value) < CERTAIN
    return F.when(short, F.lit("***")).otherwise(F.concat(F.left(value, F.lit(2)), F.lit("***"), F.right(value, F.lit(2))))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents; values leave only masked and hashed."""
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("finding_no").cast("long").alias("finding_no"),
        masked(F.col("value")).alias("masked"),
        F.sha2("value", 256).alias("value_sha256"),
        *[c for c in FEATURES],
        label_by_format().alias("label"),
        "score",
        "is_secret",
    )


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in texts are replaced by a mask, n_chars follows.

    A secret is masked where it was found; one of ``CERTAIN`` characters or more also wherever
    else its text has it, which a shorter one may by chance. Texts meet their secrets by a
    hash of the text, so repeated and null ids do no harm.
    """
    hash_, of, found_, places_, clean_ = free_names(docs.columns, "hash", "of", "found", "places", "clean")
    hashed = docs.withColumn(hash_, F.xxhash64("text"))
    found = scan(spark, hashed.select(col(hash_).alias("text_hash"), "text"), keep=("text_hash",))
    values = (
        found.where("is_secret")
        .groupBy(F.col("text_hash").alias(of))
        .agg(
            F.collect_set(F.when(F.length("value") >= CERTAIN, F.col("value"))).alias(found_),
            F.collect_set("finding_no").alias(places_),
        )
    )
    numbered = F.transform(
        F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)),
        lambda v, k: F.when(F.array_contains(places_, k), F.lit(MASK)).otherwise(v),
    )
    pieces = F.zip_with(
        F.split("text", FOUND, -1), numbered, lambda s, v: F.concat(s, F.coalesce(v, F.lit("")))
    )
    # Longer values first, so that none is broken by another inside it.
    ordered = F.transform(
        F.sort_array(F.transform(found_, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"]
    )
    clean = F.aggregate(ordered, F.array_join(pieces, ""), lambda t, v: F.replace(t, v, F.lit(MASK)))
    joined = hashed.join(values, F.col(hash_) == F.col(of), "left").withColumn(
        clean_, F.when(F.col(found_).isNotNull(), clean)
    )
    changed = {
        "text": F.coalesce(clean_, "text"),
        "n_chars": F.coalesce(F.length(clean_).cast("long"), "n_chars"),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else col(c) for c in docs.columns])
