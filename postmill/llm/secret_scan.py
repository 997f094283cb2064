"""Operator 3, secret scans with a random forest against false positives.

Every run of sixteen or more key characters in a text is a candidate.  Its
features are its length, its character transitions, how much of it a
dictionary of the corpus covers, the pieces of its path and its neighbouring
words (hashed).  A random forest (``pyspark.ml``, a DataFrame transformer) trained
on labelled findings scores all candidates.  The dictionary is the set of
three-letter sequences of all words that several documents use: at most
26 ** 3 entries whatever the corpus, which bounds its broadcast.  Built-in
expressions throughout.

A caller passes reviewed findings to ``scan``; without them the forest learns
from those in ``findings``, which were labelled by where they stood and what they
meant.  The texts that are scanned are never trained on.  ``rule_label`` is the
plain rule that scanners use; the tests hold the forest against it on places that
it has not seen.

Defined results: null text counts as empty; a text without candidates gives no
row; a candidate that occurs at several places of a text gives a row for each;
repeated rows repeat their findings; a null path counts as empty, and a null
doc_id stays null; a very long text is split into its words in one task; an empty
table gives no row; findings of one kind only give the rule's own decision as
score; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.findings import reviewed
from postmill.llm.shared import documents, materialise

RUN = r"[A-Za-z0-9+/_-]{16,}"
KEYWORD = r"(?i)(token|secret|passw|passphrase|api.?key|access.?key|private.?key|auth|credential|bearer)"
MASK = "<SECRET>"

#: Bound on the labelled findings that the forest reads, and its shape.
MOST_FINDINGS, TREES, DEPTH = 20_000, 40, 8
THRESHOLD = 0.5

FEATURES = ("n", "digits", "uppers", "lowers", "marks", "kind_changes", "case_changes", "distinct", "hex_only", "covered", "keyword", "assigned", "quoted", "left_length", "right_length")

#: Buckets of hashed words around a candidate and of pieces of its path.
WORD_BUCKETS, PATH_BUCKETS = 128, 64


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = "source") -> DataFrame:
    """doc_id, path, word_no (from 0), value, before (the word up to the
    value), left_2, left_1, right_1 of every candidate."""
    some = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text")).where(F.col("text").rlike(RUN))
    split = some.select("doc_id", "path", F.split("text", r"\s+").alias("words"))
    words = F.col("words")

    def found(word, i):
        near = F.struct(
            i.alias("word_no"), word.alias("word"),
            F.coalesce(F.get(words, i - 2), F.lit("")).alias("left_2"), F.coalesce(F.get(words, i - 1), F.lit("")).alias("left_1"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("right_1"),
        )
        return F.when((F.length(word) >= 16) & word.rlike(RUN), near)

    hits = split.select("doc_id", "path", F.explode(F.filter(F.transform(words, found), lambda x: x.isNotNull())).alias("hit"))
    each = hits.select("doc_id", "path", "hit.*", F.explode(F.regexp_extract_all("hit.word", F.lit(RUN), F.lit(0))).alias("value"))
    before = F.expr("left(word, cast(position(value IN word) AS int) - 1)")
    return each.select("doc_id", "path", F.col("word_no").cast("long").alias("word_no"), "value", before.alias("before"), "left_2", "left_1", "right_1")


def _share(pattern: str):
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def dictionary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 3) -> DataFrame:
    """The three-letter sequences, at most 26 ** 3, of words that at least
    ``least`` rows hold."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+"))).alias("word")).where("length(word) >= 3")
    common = words.groupBy("word").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    threes = common.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.col("word").substr(i, F.lit(3)))).alias("three"))
    return threes.distinct()


def with_features(found: DataFrame, threes: DataFrame) -> DataFrame:
    """``found`` with the columns named in ``FEATURES``."""
    known = [r.three for r in threes.collect()]  # at most 26 ** 3 strings
    low = F.lower("value")
    parts = F.filter(F.transform(F.sequence(F.lit(1), F.length("value") - 2), lambda i: low.substr(i, F.lit(3))), lambda x: x.rlike("^[a-z]{3}$"))
    near = F.concat_ws(" ", "left_2", "left_1", "before")
    return (
        found.withColumn("n", F.length("value").cast("double"))
        .withColumn("digits", _share("[0-9]"))
        .withColumn("uppers", _share("[A-Z]"))
        .withColumn("lowers", _share("[a-z]"))
        .withColumn("marks", _share("[+/_-]"))
        .withColumn("kind_changes", _share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
        .withColumn("case_changes", _share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
        .withColumn("distinct", F.size(F.array_distinct(F.split(low, ""))) / F.length("value"))
        .withColumn("hex_only", F.col("value").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"))
        .withColumn("covered", F.size(F.filter(parts, lambda x: x.isin(known))) / (F.length("value") - 2))
        .withColumn("keyword", near.rlike(KEYWORD).cast("double"))
        .withColumn("assigned", F.concat_ws(" ", "left_1", "before").rlike("[=:]").cast("double"))
        .withColumn("quoted", F.col("before").rlike("[\"'`]$").cast("double"))
        .withColumn("left_length", F.length("left_1").cast("double"))
        .withColumn("right_length", F.length("right_1").cast("double"))
        .withColumn("near_words", F.filter(F.split(F.lower(near), "[^a-z]+"), lambda w: F.length(w) > 1))
        .withColumn("path_words", F.filter(F.split(F.lower("path"), "[^a-z]+"), lambda w: w != ""))
    )


def rule_label():
    """A scanner's plain rule: random-looking characters that are assigned or
    named as a secret."""
    random_like = (F.col("digits") >= 0.1) & (F.col("digits") <= 0.95) & (F.col("kind_changes") >= 0.1) & (F.col("n") >= 20)
    return F.when(random_like & ((F.col("keyword") + F.col("assigned") + F.col("quoted")) >= 1), 1.0).otherwise(0.0)


def with_vector(found: DataFrame) -> DataFrame:
    """``found`` with its features as one vector."""
    hashed = HashingTF(inputCol="near_words", outputCol="near_vector", numFeatures=WORD_BUCKETS, binary=True).transform(found)
    hashed = HashingTF(inputCol="path_words", outputCol="path_vector", numFeatures=PATH_BUCKETS, binary=True).transform(hashed)
    return VectorAssembler(inputCols=[*FEATURES, "near_vector", "path_vector"], outputCol="features").transform(hashed)


def train(findings: DataFrame, most: int = MOST_FINDINGS):
    """A forest over labelled findings (as ``with_features`` gives them, and
    ``label``), the ``most`` with the smallest hashes of each label; None where a
    label is missing."""
    few = findings.select(*FEATURES, "near_words", "path_words", "label", F.xxhash64("value", "word_no").alias("chance"))
    sample = few.where("label = 1").orderBy("chance").limit(most // 2).unionAll(few.where("label = 0").orderBy("chance").limit(most // 2)).drop("chance")
    sample = materialise(sample, "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7, cacheNodeIds=False).fit(with_vector(sample))


def scored(found: DataFrame, forest) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``."""
    if forest is None:
        rows = found.withColumn("score", rule_label())
    else:
        rows = forest.transform(with_vector(found)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return rows.withColumn("is_secret", F.col("score") >= THRESHOLD)


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", path: str = "source") -> DataFrame:
    """Every candidate of every text, scored.  ``findings``: candidates (as
    ``candidates`` gives them) with ``label``; without them the reviewed ones."""
    threes = materialise(dictionary(docs, text, doc_id), "dictionary")
    found = materialise(with_features(candidates(docs, text, doc_id, path), threes), "candidates")
    known = with_features(reviewed(docs.sparkSession) if findings is None else findings, threes)
    return scored(found, train(known)).select("doc_id", "path", "word_no", "value", "left_1", *FEATURES, "score", "is_secret")


def redact(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by a mask; n_chars follows.  Rows
    match their secrets by doc_id, those with a null doc_id by their text."""
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64("text").cast("string"))))
    found = scan(keyed, findings, doc_id="__key").where("is_secret")
    per_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("__secrets")).withColumnRenamed("doc_id", "__id")
    may = F.coalesce(F.col("text").rlike(RUN), F.lit(False))  # others have no candidate, so they need not travel
    joined = keyed.where(may).join(per_doc, F.col("__key") == F.col("__id"), "left")
    masked = F.aggregate("__secrets", F.col("text"), lambda t, s: F.replace(t, s, F.lit(MASK)))
    has = F.col("__secrets").isNotNull()
    clean = joined.withColumn("text", F.when(has, masked).otherwise(F.col("text"))).withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return keyed.where(~may).select(*docs.columns).unionAll(clean.select(*docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "path", "word_no", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"), F.round("covered", 6).alias("covered"), "score", "is_secret")
