"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a word of eight or more characters with a digit and a run of eight key characters, or
a value assigned to a password-like name. The forest sees its length, its character
transitions (changes of character class, and how usual its letter pairs are in the corpus),
how much of it dictionary words cover, the path of its document and the words around it.

Labelled findings can be given; without them, those of certain kinds are labelled: vendor
formats and long random values assigned to a password-like name are secrets; mail and network
addresses, telephone and card numbers, URLs, dates, placeholders and dictionary words are not. The
model decides about all candidates, labelled or not.

Only DataFrame functions and the ML library are used. The dictionary and the letter pairs are
counted over all documents; the forest is fitted on at most ``train_rows`` labelled rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import ref, text_of
from strikeline.plans.tables import settle

SPACE = r"[\x20\x09-\x0D]+"
NAMES = "passw|pwd|secret|token|api.?key|access.?key|auth|credential|private"
VENDOR = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)$"
NOT_SECRET = {
    "mail": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "url": r"^(?:[a-z]+://|www\.)\S+$",
    "address": r"^\d{1,3}(?:\.\d{1,3}){3}(?:[:/]\d+)?$",
    "number": r"^[+(]?\d[\d().,/:+-]*$",
    "date": r"^\d{4}-\d\d-\d\d(?:T[\d:.]+Z?)?$",
    "placeholder": r"(?i)x{4,}|changeme|example|placeholder|your[_-]|<[^>]*>|\*{3,}|0{8,}|1234567",
}
FEATURES = ["length", "digits", "uppers", "class_changes", "pair_score", "covered", "assigned", "named_before", "sample_before", "quoted", "operator_before", "next_length", "path_test", "path_depth", "path_mark"]


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: letter words of three or more letters, in lower case, with their places in all documents."""
    words = F.explode(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 3))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pairs_of(word: Column) -> Column:
    """Adjacent character pairs; digits become 0, other signs #."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(word), "[0-9]", "0"), "[^a-z0]", "#")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.substr(plain, i, F.lit(2)))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, path, word_no, word, value, name, before, after`` of ``docs(doc_id, path, text)``."""
    words = F.split("text", SPACE)
    assigned = rf"(?i)(?:{NAMES})[a-z_-]*[\"']?[=:].{{4,}}"

    def wanted(c: Column) -> Column:
        w = c["w"]
        return (F.length(w) >= 8) & ((w.rlike("[0-9]") & w.rlike("[A-Za-z0-9+/_=-]{8,}")) | w.rlike(assigned))

    def around(c: Column) -> Column:
        near = [F.coalesce(F.get("words", c["i"] - k), F.lit("")) for k in (3, 2, 1)]
        return F.struct(c["w"].alias("w"), c["i"].alias("i"), F.concat_ws(" ", *near).alias("before"), F.coalesce(F.get("words", c["i"] + 1), F.lit("")).alias("after"))

    x = docs.withColumn("words", words)
    found = F.transform(F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), wanted), around)
    x = x.select("doc_id", "path", F.explode(found).alias("c")).select("doc_id", "path", F.col("c.i").alias("word_no"), F.col("c.w").alias("word"), F.col("c.before").alias("before"), F.col("c.after").alias("after"))
    bare = F.regexp_replace("word", r"^[\"'(\[{<]+|[\"')\]}>,;.!?]+$", "")
    name = F.regexp_extract(bare, r"^([A-Za-z_-]{2,})[\"']?[=:]", 1)
    value = F.when((name != "") & ~bare.rlike("^[a-z]+://"), F.regexp_extract(bare, r"^[A-Za-z_-]{2,}[\"']?[=:][\"']?(.*)$", 1)).otherwise(bare)
    return x.withColumns({"value": value, "name": F.lower(name)})


def features(found: DataFrame, counts: DataFrame, dictionary_words: int) -> DataFrame:
    """The candidates with a number ``id`` and the columns of ``FEATURES``."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    few = counts.orderBy(F.desc("n"), "word").limit(dictionary_words).select("word")
    pairs = counts.select(F.explode(pairs_of(F.concat(F.lit("#"), F.col("word"), F.lit("#")))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = settle(pairs, "pairs")  # at most 28 * 28 rows
    usual = pairs.select("pair", F.log1p("n").alias("usual"))
    base = settle(found.withColumn("id", F.monotonically_increasing_id()), "candidates")
    paired = base.select("id", F.explode(pairs_of(v)).alias("pair")).join(usual, "pair", "left").groupBy("id").agg(F.avg(F.coalesce("usual", F.lit(0.0))).alias("pair_score"))
    runs = base.select("id", F.explode(F.regexp_extract_all(F.lower(v), F.lit("([a-z]{3,})"), 1)).alias("word")).join(settle(few, "dictionary"), "word")
    covered = runs.groupBy("id").agg(F.sum(F.length("word")).cast("double").alias("letters"))
    out = base.join(paired, "id", "left").join(covered, "id", "left")
    before = F.lower("before")
    number = lambda c: c.cast("double")
    return out.withColumns({
        "length": n, "digits": F.regexp_count(v, F.lit("[0-9]")) / n, "uppers": F.regexp_count(v, F.lit("[A-Z]")) / n,
        "class_changes": F.regexp_count(v, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        "pair_score": F.coalesce("pair_score", F.lit(0.0)), "covered": F.coalesce(F.col("letters"), F.lit(0.0)) / n,
        "assigned": number(F.col("name").rlike(NAMES)), "named_before": number(before.rlike(NAMES)), "sample_before": number(before.rlike("example|sample|test|dummy|fake")),
        "quoted": number(F.col("word").rlike("[\"']")), "operator_before": number(before.rlike("[=:]$")), "next_length": F.length("after").cast("double"),
        "path_test": number(F.lower("path").rlike("test|example|fixture|mock|doc")), "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "path_mark": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double"),
    }).drop("letters")


def certain(x: DataFrame) -> Column:
    """1 or 0 for findings of certain kinds, else null."""
    v = F.col("value")
    named = (F.col("assigned") + F.col("named_before")) > 0
    no = (F.col("covered") >= 0.8) | F.lit(False)
    for pattern in NOT_SECRET.values():
        no = no | v.rlike(pattern)
    yes = v.rlike(VENDOR) | (named & v.rlike("^[A-Za-z0-9+/_=-]{16,}$") & (F.regexp_count(v, F.lit("[0-9]")) >= 4))
    return F.when(yes & ~v.rlike(NOT_SECRET["placeholder"]), 1.0).when(no, 0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, train_rows: int = 20_000, dictionary_words: int = 20_000, trees: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, word_no, kind, value, value_length, label, score, is_secret`` and the features: one row per candidate.

    ``word_no`` is the number of the word in the text, from 0; ``kind`` is vendor, assigned or token; ``label`` is
    that of a certain kind (null: none); ``score`` the forest's probability, ``is_secret`` score >= 0.5.
    ``labelled``: rows with the columns of ``FEATURES`` and ``label`` (0.0 or 1.0) to fit on instead of the certain
    kinds; of either, the ``train_rows`` first in the order of a hash are used. Where they lack one
    of the labels no forest can be fitted: the score is then the label, or 0.5 without one.

    Null text has no candidates; a null path is empty. Repeated rows and null ids are kept. Extra columns
    are not read. Without candidates the result is empty.
    """
    path = F.coalesce(ref(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    texts = docs.select(ref(id_col).alias("doc_id"), path.alias("path"), text_of(text_col).alias("text"))
    counts = settle(word_counts(texts), "words")
    found = features(candidates(texts), counts, dictionary_words)
    found = settle(found.withColumn("label", certain(found)), "findings")
    known = (found if labelled is None else labelled).where(F.col("label").isNotNull()).select(*FEATURES, "label")
    known = known.orderBy(F.xxhash64(*FEATURES, "label"), *FEATURES).limit(train_rows).coalesce(1)
    known = settle(known, "labelled")
    if known.select("label").distinct().count() < 2:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.5)))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        model = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=6, seed=seed, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_prediction").fit(vectors.transform(known))
        scored = model.transform(vectors.transform(found)).withColumn("score", vector_to_array("_p")[1])
    kind = F.when(F.col("value").rlike(VENDOR), "vendor").when((F.col("assigned") > 0) | ((F.col("named_before") > 0) & (F.col("operator_before") > 0)), "assigned").otherwise("token")
    return scored.select("doc_id", "word_no", kind.alias("kind"), "value", F.length("value").alias("value_length"), "label", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"), *FEATURES)
