"""Samples for training count different rows: repeated rows change nothing."""

from pyspark.sql import functions as F

from vitrina.llm import string_kernel, toxicity

DOCS = "doc_id long, text string, lang string, x int, draw long"


def test_languages_survive_repeated_rows(spark):
    words = {"en": "the and of with this that", "de": "der die das und nicht ist", "fr": "le la les dans avec pour"}
    rows = [(100 * n + k, f"{text} {text[k:]} {k}", lang, 1, 1) for n, (lang, text) in enumerate(words.items()) for k in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    repeated = docs.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("again")
    once, often = (string_kernel.train(d, F.lit(True), per_class=10) for d in (docs, repeated))
    assert once.languages == often.languages == ["de", "en", "fr"]
    assert abs(once.weights - often.weights).max() < 1e-3
    few = string_kernel.train(repeated, F.lit(True), per_class=5)
    assert set(few.languages) <= {"de", "en", "fr"} and len(few.languages) >= 2


def test_toxicity_survives_repeated_rows(spark):
    rows = [(k, "you utter idiot scum" if k % 2 else f"a kind word {k}", "en", 1, 1) for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    repeated = docs.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("again")
    once, often = (toxicity.train(d, marks, F.lit(True), sample=30) for d in (docs, repeated))
    texts = ["you idiot scum", "a kind word", "", None]
    assert once.trees is not None and (once.score(texts) == often.score(texts)).all() and once.lexicon == often.lexicon
    chosen = toxicity.chosen_rows(repeated, marks, F.lit(True), 30, 60)
    assert chosen.count() == chosen.select("doc_id").distinct().count() <= 60


def test_choice_of_training_rows_is_bounded_and_unlabelled_rows_never_train(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    marks = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    chosen = toxicity.chosen_rows(docs, marks, F.col("doc_id") % 3 != 0, 100, 200).collect()
    uses = [r.use for r in chosen]
    assert uses.count("lexicon") == 200 and uses.count("trees") == 100 and uses.count("calibration") == 100
    assert all(r.doc_id % 2 == 0 and r.doc_id % 3 and r.toxic == (r.doc_id % 10 == 0) for r in chosen)
    assert toxicity.chosen_rows(docs.limit(0), marks, F.lit(True), 10, 10).collect() == []
