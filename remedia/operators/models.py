"""Text and risk models on MLlib: features, fitting, seeded search and scoring."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remedia import policy
from remedia.functions.text import model_text
from remedia.operators import metrics
from remedia.operators.retrieval import unit
from remedia.session import scratch_path, stored, unnest

# search space of the text models: name, low, high, kind
TEXT_SPACE = [
    ("C", 0.05, 40.0, "log"), ("min_df", 1, 6, "int"), ("max_features", 4000, 40000, "int"),
    ("ngram_high", 1, 2, "int"), ("balanced", 0, 1, "int")]
FRAUD_SPACE = [("C", 0.005, 20.0, "log"), ("balanced", 0, 1, "int")]


# fixed values: accented Latin letters and their base letters
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BASE = "aaaaaaceeeeiiiinooooouuuuyy"


def outcome_text(df: DataFrame) -> DataFrame:
    return df.withColumn("features_text", model_text(
        F.col("narrative"), issue=F.col("issue"), size=F.col("company_size"),
        via=F.col("submitted_via")))


def escalation_text(df: DataFrame, response: str = "label_outcome",
                    timely: str = "timely_response") -> DataFrame:
    return df.withColumn("features_text", model_text(
        F.col("narrative"), issue=F.col("issue"), resp=F.col(response),
        size=F.col("company_size"), timely=F.initcap(F.col(timely).cast("string"))))


def with_terms(df: DataFrame, text: str, ngram_high: int = 1) -> DataFrame:
    """Add ``terms``: lower-cased words of two or more characters, and their pairs.

    Accented Latin letters count as their base letters.
    """
    plain = F.translate(F.lower(F.col(text)), ACCENTED, BASE)
    words = F.regexp_extract_all(plain, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    df = df.withColumn("_words", words)
    if ngram_high == 1:
        return df.withColumn("terms", F.col("_words")).drop("_words")
    pairs = F.zip_with(
        F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))),
        F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b))
    return df.withColumn("terms", F.concat("_words", pairs)).drop("_words")


def class_weights(df: DataFrame, label: str, balanced: bool) -> DataFrame:
    """Add ``_weight``: ``n / (classes * class size)`` when balanced, else 1.

    The weights are one row per class, so the label table is small.
    """
    if not balanced:
        return df.withColumn("_weight", F.lit(1.0))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n") / F.count(F.lit(1))).scalar()
    return df.join(
        sizes.withColumn("_weight", total / F.col("_n")).drop("_n"), label).withColumn(
        "_weight", F.col("_weight").cast("double"))


@dataclass(frozen=True)
class TextParams:
    C: float = 4.0
    min_df: int = 2
    max_features: int = 20000
    ngram_high: int = 1
    balanced: bool = False
    max_iter: int = 50


@dataclass(frozen=True)
class TextModel:
    """Vocabulary (``term, column, idf``, at most ``max_features`` rows), classes, classifier."""

    vocabulary: DataFrame
    classes: list[str]
    classifier: LogisticRegressionModel
    ngram_high: int

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.vocabulary.sparkSession.createDataFrame(
            [(self.classes, self.ngram_high)], "classes array<string>, ngram_high int"
        ).write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextModel:
        said = spark.read.schema("classes array<string>, ngram_high int").json(
            f"{path}/settings").first()
        return TextModel(spark.read.parquet(f"{path}/vocabulary"), list(said["classes"]),
                         LogisticRegressionModel.load(f"{path}/classifier"), said["ngram_high"])


def vocabulary(rows: DataFrame, params: TextParams) -> DataFrame:
    """The most frequent terms of at least ``min_df`` documents, with smoothed idf."""
    n = rows.agg(F.count(F.lit(1))).scalar()
    seen = unnest(rows, F.col("terms"), "term", "_row").groupBy("_row", "term").agg(
        F.count(F.lit(1)).alias("tf")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = seen.where(F.col("df") >= params.min_df).orderBy(F.desc("cf"), "term").limit(
        int(params.max_features))
    order = Window.partitionBy(F.lit(0)).orderBy("term")  # at most max_features rows
    return kept.withColumn("_n", n).select(
        "term", (F.row_number().over(order) - 1).alias("column"),
        (F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1.0).alias("idf"))


def text_features(df: DataFrame, text: str, terms: DataFrame, size: int, ngram_high: int,
                  ) -> DataFrame:
    """Add ``features``: sublinear tf times idf at unit length, as sparse vectors.

    The vector is laid out as the columns a stored vector has, written, and read
    back as vectors, so no row passes through Python. The term table is broadcast:
    it has at most ``max_features`` rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "features")
    # the key is made once and stored, so that both uses below agree on it
    df.withColumn("_row", F.expr("uuid()")).write.parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows")
    tf = unnest(with_terms(kept, text, ngram_high), F.col("terms"), "term", "_row").groupBy(
        "_row", "term").agg(
        (1.0 + F.ln(F.count(F.lit(1)))).alias("tf"))
    cells = tf.join(F.broadcast(terms), "term").groupBy("_row").agg(F.array_sort(
        F.collect_list(F.struct("column", (F.col("tf") * F.col("idf")).alias("w")))).alias("c"))
    at = F.coalesce(F.transform("c", lambda x: x["column"]), F.array().cast("array<int>"))
    values = F.coalesce(
        unit(F.transform("c", lambda x: x["w"])), F.array().cast("array<double>"))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
                      at.alias("indices"), values.alias("values"))
    kept.join(cells, "_row", "left").select(
        *df.columns, vector.alias("features")).write.parquet(f"{path}/vectors")
    schema = T.StructType([*df.schema.fields, T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def fit_text(train: DataFrame, text: str, label: str, params: TextParams = TextParams(),
             ) -> TextModel:
    """TF-IDF and multinomial logistic regression, L2-regularised.

    The penalty ``1 / (C n)`` is the same objective as a ``C``-weighted loss sum.
    """
    spark = train.sparkSession
    path = scratch_path(spark, "vocabulary")
    keyed = with_terms(train.select(text), text, params.ngram_high).withColumn(
        "_row", F.monotonically_increasing_id())
    vocabulary(keyed, params).write.parquet(path)
    terms = spark.read.parquet(path)
    size = terms.count()
    rows = class_weights(train.select(text, label), label, params.balanced)
    ready = text_features(rows, text, terms, size, params.ngram_high)
    indexer = StringIndexer(
        inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(ready)
    classifier = LogisticRegression(
        featuresCol="features", labelCol="_label", weightCol="_weight",
        regParam=1.0 / (params.C * max(ready.count(), 1)), elasticNetParam=0.0,
        standardization=False, maxIter=params.max_iter, family="multinomial",
    ).fit(indexer.transform(ready))
    return TextModel(terms, list(indexer.labels), classifier, params.ngram_high)


def score_text(model: TextModel, df: DataFrame, text: str) -> DataFrame:
    """Add ``predicted`` (class name) and ``probabilities`` (array in class order)."""
    ready = text_features(df, text, model.vocabulary, model.classifier.numFeatures,
                          model.ngram_high)
    names = F.array(*[F.lit(c) for c in model.classes])
    return model.classifier.transform(ready).select(
        *df.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"),
        vector_to_array("probability").alias("probabilities"))


def fit_risk(train: DataFrame, features: list[str], label: str, C: float = 1.0,
             balanced: bool = False, max_iter: int = 100) -> PipelineModel:
    """Standardised features and a binary logistic regression.

    ``train`` is read for the class sizes, for the scales and for the fit, which keeps it:
    store it first where its columns are costly or it serves several fits.
    """
    sizes = train.groupBy(label).count().collect()  # a row a class
    known = {r[label]: r["count"] for r in sizes if r[label] is not None}
    rows, n = train.withColumn("_weight", F.lit(1.0)), sum(r["count"] for r in sizes)
    if balanced:
        n = sum(known.values())
        weight = F.create_map(*[F.lit(x) for k, size in known.items() for x in (k, n / len(known) / size)]) if n else None
        rows = train.where(F.col(label).isNotNull()).withColumn("_weight", weight[F.col(label)] if n else F.lit(1.0))
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="features", labelCol=label, weightCol="_weight",
            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False,
            maxIter=max_iter)]).fit(rows)


def score_risk(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(
        *df.columns, vector_to_array("probability")[1].alias("score"))


def coefficients(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    fitted = model.stages[-1].coefficients.toArray()
    return spark.createDataFrame(
        [(n, float(c)) for n, c in zip(features, fitted, strict=True)],
        "feature string, coefficient double")


def sample_params(space, rng: random.Random) -> dict:
    out = {}
    for name, low, high, kind in space:
        if kind == "log":
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            out[name] = rng.randint(int(low), int(high))
    return out


def random_search(objective: Callable[[dict], float], space, trials: int, seed: int,
                  spark: SparkSession) -> tuple[dict, DataFrame]:
    """Seeded trials, each a distributed fit; returns the best and the trial table.

    ``improved`` marks trials that beat every earlier one.
    """
    rng = random.Random(seed)
    rows, best, best_score = [], {}, -math.inf
    for trial in range(trials):
        params = sample_params(space, rng)
        score = float(objective(params))
        rows.append((trial, score, {k: float(v) for k, v in params.items()}, score > best_score))
        if score > best_score:
            best, best_score = params, score
    return best, spark.createDataFrame(
        rows, "trial int, score double, params map<string,double>, improved boolean")


def issue_classifier(folds: DataFrame, params: TextParams = TextParams(),
                     text: str = "narrative", label: str = "label_issue"):
    """Fit on train and validation, report on test: macro and micro F1."""
    model = fit_text(folds.where("split <> 'test'"), text, label, params)
    scored = score_text(model, folds.where("split = 'test'"), text)
    return model, metrics.classification_summary(scored, label, "predicted")


def random_split(df: DataFrame, id_column: str, share: float = 0.84, seed: int = 0) -> DataFrame:
    """A shuffled reference split: the same ids fall the same way on every run."""
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(10_000))
    return df.withColumn("split", F.when(draw < int(share * 10_000), "train").otherwise("test"))


def stored_scores(model: PipelineModel, test: DataFrame, label: str, tie: str) -> DataFrame:
    return stored(score_risk(model, test).select(tie, label, "score"), "risk-scores")


def risk_recall(model: PipelineModel, test: DataFrame, label: str, tie: str,
                budget: float = policy.ALERT_BUDGET) -> float | None:
    """Recall at the alert budget alone, as ``risk_report`` gives it; what a search asks of a trial."""
    return metrics.recall_at_budget(
        stored_scores(model, test, label, tie), label, "score", tie, budget).select("recall").first()[0]


def risk_report(model: PipelineModel, test: DataFrame, label: str, tie: str,
                budget: float = policy.ALERT_BUDGET) -> DataFrame:
    """Recall and precision at the alert budget, lift and AUC of a scored fold."""
    scored = stored_scores(model, test, label, tie)
    auc = metrics.roc_auc(scored, label, "score").select("roc_auc").scalar()
    return metrics.recall_at_budget(scored, label, "score", tie, budget).withColumn(
        "roc_auc", auc)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
