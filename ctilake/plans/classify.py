"""Bag-of-words baselines on the exploit classes, with the library's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctilake.operators import metrics as M
from ctilake.sources.tables import broadcast_if_small, table

MODELS = {
    "lr": lambda: LogisticRegression(maxIter=20, regParam=1e-3, weightCol="weight", family="multinomial"),
    "nb": lambda: NaiveBayes(modelType="complement"),
    "dt": lambda: DecisionTreeClassifier(maxDepth=12, weightCol="weight"),
    "rf": lambda: RandomForestClassifier(numTrees=40, maxDepth=10, weightCol="weight", seed=42),
    "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20)),
}


VOCABULARY, HASHED = 50_000, 1 << 12  # words and pairs of words that linear learners weigh; trees take hashed ones


def train(rows: DataFrame, model: str = "lr"):
    """Pipeline of unigram and bigram TF-IDF and a learner, fitted on (text, label) with balanced weights.

    Linear learners have the VOCABULARY most frequent terms of at least two rows, trees HASHED classes of terms.
    """
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    weighted = rows.join(broadcast_if_small(n), "label").withColumn("weight", F.lit(float(total)) / F.col("_n"))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[A-Za-z0-9_\-]{2,}", gaps=False), NGram(n=2, inputCol="w", outputCol="b"), SQLTransformer(statement="select *, concat(w, b) as g from __THIS__"),
        HashingTF(inputCol="g", outputCol="tf", numFeatures=HASHED) if model in ("dt", "rf") else CountVectorizer(inputCol="g", outputCol="tf", vocabSize=VOCABULARY, minDF=2), IDF(inputCol="tf", outputCol="features", minDocFreq=2), MODELS[model](),
    ]
    index = StringIndexer(inputCol="label", outputCol="labelIndex", handleInvalid="keep").fit(weighted)
    stages[-1].setLabelCol("labelIndex") if hasattr(stages[-1], "setLabelCol") else stages[-1]
    return index, Pipeline(stages=stages).fit(index.transform(weighted))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "task2_exploit_type").select("rec_id", F.col("_split").alias("split"), "source", F.coalesce("text", F.lit("")).alias("text"), "label").filter("label is not null")


def _scored(rows: DataFrame, model: str) -> DataFrame:
    index, fitted = train(rows.filter("split = 'train'"), model)
    names = F.array(*map(F.lit, index.labels))
    predicted = fitted.transform(rows.filter("split = 'test'")).select("label", F.coalesce(F.get(names, F.col("prediction").cast("int")), F.lit("none")).alias("predicted"))
    return M.class_f1(predicted, "label", "predicted")


def classify_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of every class on the test split of a balanced logistic regression fitted on the training split."""
    return _scored(_rows(spark, sf_dir), "lr")


def classify_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a linear support vector machine, one class against the rest."""
    return _scored(_rows(spark, sf_dir), "svm")


def classify_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a complement naive Bayes model."""
    return _scored(_rows(spark, sf_dir), "nb")


def classify_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a decision tree."""
    return _scored(_rows(spark, sf_dir), "dt")


def classify_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a random forest."""
    return _scored(_rows(spark, sf_dir), "rf")


def classify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a logistic regression that sees nothing but the source: what a label owes to where it came from."""
    return _scored(_rows(spark, sf_dir).withColumn("text", F.regexp_replace("source", "[^A-Za-z0-9]", "_")), "lr")


QUERIES = {f.__name__: f for f in (classify_bow, classify_svm, classify_bayes, classify_tree, classify_forest, classify_source)}
SQL: dict[str, str] = {}
