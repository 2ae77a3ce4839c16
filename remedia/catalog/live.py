"""Queries that run a stream to its end, or fit a model, and return the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedia import policy
from remedia.catalog.base import disputes, table
from remedia.catalog.cases import AS_OF, VALID_SECTIONS, VERIFIED_SQL, claims
from remedia.catalog.search import corpus, questions
from remedia.operators import layers, metrics, models, retrieval, shadow, trials
from remedia.plans import triage as plan
from remedia.session import scratch_path, stored
from remedia.streaming import feeds


def _feed(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    feed = feeds.file_feed(spark, sf_dir, schema, glob=f"{name}.parquet")
    return feed.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in feed.columns else feed


def streaming_daily_psi(spark, sf_dir):
    """Drift of each closed day of events against the first week."""
    out = scratch_path(spark, "daily-psi")
    base = table(spark, sf_dir, "events").where("ts < TIMESTAMP '2024-01-08'")
    feeds.start_daily_psi(
        _feed(spark, sf_dir, "events"), base, "ts", ["event_type", "user_id"], f"{out}/rows",
        f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.select(F.col("window_start").cast("date").alias("day"), "signal",
                       F.round("psi", 6).alias("psi"), "status")


DAILY_SQL = """
WITH long AS (
  SELECT ts, 'event_type' AS signal, event_type AS category FROM events
  UNION ALL SELECT ts, 'user_id', CAST(user_id AS VARCHAR) FROM events),
base AS (SELECT signal, category, count(*) AS n FROM long WHERE ts < TIMESTAMP '2024-01-08'
         GROUP BY ALL),
days AS (SELECT CAST(ts AS DATE) AS day, signal, category, count(*) AS n FROM long
         WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL),
grid AS (SELECT DISTINCT day, d.signal, b.category, b.n AS bn FROM days d JOIN base b
         ON b.signal = d.signal),
j AS (SELECT coalesce(g.day, d.day) AS day, coalesce(g.signal, d.signal) AS signal,
        coalesce(bn, 0) AS bn, coalesce(d.n, 0) AS cn
      FROM grid g FULL JOIN days d
      ON g.day = d.day AND g.signal = d.signal AND g.category = d.category),
s AS (SELECT *, greatest(bn / sum(bn) OVER p, 1e-6) AS b, greatest(cn / sum(cn) OVER p, 1e-6) AS c
      FROM j WINDOW p AS (PARTITION BY day, signal)),
v AS (SELECT day, signal, sum((c - b) * ln(c / b)) AS psi FROM s GROUP BY 1, 2)
SELECT day, signal, round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'stable'
  WHEN psi < 0.25 THEN 'investigate' ELSE 'alert' END AS status FROM v"""


def streaming_daily_numeric_psi(spark, sf_dir):
    """Numeric drift of each closed day of events against the stored edges of the first week."""
    out = scratch_path(spark, "daily-numeric")
    names = ["value", "user_id"]
    base = feeds.store_numeric_baseline(
        table(spark, sf_dir, "events").where("ts < TIMESTAMP '2024-01-08'"), names, f"{out}/baseline")
    feeds.start_daily_numeric_psi(
        _feed(spark, sf_dir, "events"), base, "ts", names, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        F.col("window_start").cast("date").alias("day"), "signal", "rows", F.round("psi", 6).alias("psi"),
        "status", F.round("baseline_mean", 6).alias("baseline_mean"),
        F.round("current_mean", 6).alias("current_mean"))


DAILY_NUMERIC_SQL = """
WITH long AS (
  SELECT ts, 'value' AS signal, value AS v FROM events WHERE value IS NOT NULL
  UNION ALL SELECT ts, 'user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id IS NOT NULL),
base AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY v) - 1 AS r,
         count(*) OVER (PARTITION BY signal) AS n FROM long WHERE ts < TIMESTAMP '2024-01-08'),
edges AS (SELECT signal, v AS edge FROM base, range(1, 10) t(i) WHERE r = (n * i) // 10),
binned AS (SELECT l.*, (SELECT count(*) FROM edges e WHERE e.signal = l.signal AND e.edge < l.v) AS bin
           FROM long l),
b AS (SELECT signal, bin, count(*) AS bn FROM binned WHERE ts < TIMESTAMP '2024-01-08' GROUP BY ALL),
bm AS (SELECT signal, avg(v) AS baseline_mean FROM base GROUP BY 1),
days AS (SELECT CAST(ts AS DATE) AS day, signal, bin, count(*) AS cn, sum(v) AS total FROM binned
         WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY ALL),
m AS (SELECT day, signal, CAST(sum(cn) AS BIGINT) AS n, sum(total) / sum(cn) AS mean FROM days GROUP BY 1, 2),
grid AS (SELECT day, m.signal, bin, bn FROM m JOIN b USING (signal)),
j AS (SELECT coalesce(g.day, d.day) AS day, coalesce(g.signal, d.signal) AS signal,
        coalesce(bn, 0) AS bn, coalesce(cn, 0) AS cn
      FROM grid g FULL JOIN days d ON g.day = d.day AND g.signal = d.signal AND g.bin = d.bin),
s AS (SELECT *, greatest(bn / sum(bn) OVER p, 1e-6) AS b, greatest(cn / sum(cn) OVER p, 1e-6) AS c
      FROM j WINDOW p AS (PARTITION BY day, signal)),
v AS (SELECT day, signal, sum((c - b) * ln(c / b)) AS psi FROM s GROUP BY 1, 2)
SELECT day, signal, n AS "rows", round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'stable'
  WHEN psi < 0.25 THEN 'investigate' ELSE 'alert' END AS status,
  round(baseline_mean, 6) AS baseline_mean, round(mean, 6) AS current_mean
FROM v JOIN m USING (day, signal) JOIN bm USING (signal)"""


def streaming_triage(spark, sf_dir):
    """Orders as a feed of disputes through the case chain; status counts at the end."""
    out = scratch_path(spark, "triage")
    valid = F.array(*[F.lit(x) for x in VALID_SECTIONS])
    feeds.start_triage(
        claims(spark, sf_dir, _feed(spark, sf_dir, "orders")),
        lambda batch: plan.triage(batch, F.to_date(F.lit(AS_OF)), valid_sections=valid),
        out, f"{out}/checkpoint").awaitTermination()
    return feeds.triage_status(spark, out).groupBy("state", "queue").agg(
        F.sum("cases").alias("cases"))


def _flaky(case: dict, attempt: int) -> None:
    """Some cases fail twice, some always."""
    if case["key"] % 17 == 0 or (case["key"] % 13 == 0 and attempt < 3):
        raise RuntimeError(f"attempt {attempt}")


def streaming_retries(spark, sf_dir):
    """Orders as cases whose work may fail: how many ended how, after how many attempts."""
    out = scratch_path(spark, "attempts")
    feed = _feed(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    try:
        feeds.run_attempts(lambda: feeds.start_attempts(
            feed, _flaky, lambda cases: cases, "key", out, f"{out}/checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    done = spark.read.parquet(f"{out}/cases").select(F.lit("succeeded").alias("state"), F.col("work_attempts").alias("attempts"), "amount")
    dead = spark.read.parquet(f"{out}/dead").select(F.lit("dead").alias("state"), "attempts", F.get_json_object(
        "payload", "$.amount").cast("double").alias("amount"))
    return done.unionByName(dead).groupBy("state", "attempts").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.sum("amount"), 2).alias("amount"))


RETRIES_SQL = """
SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'dead' ELSE 'succeeded' END AS state,
  CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 THEN 3 ELSE 1 END AS attempts,
  count(*) AS cases, round(sum(o_totalprice), 2) AS amount
FROM orders GROUP BY 1, 2"""


def streaming_shadow(spark, sf_dir):
    """Two rules on the event feed per closed day and segment, against labels that come
    up to a day and a half after their event; those later than a day don't count."""
    out = scratch_path(spark, "shadow")
    events = _feed(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    labels = _feed(spark, sf_dir, "events").where("event_id % 3 <> 0").select(
        "event_id", F.timestamp_add("HOUR", (F.col("event_id") % 36).cast("int"), "ts").alias("known"),
        F.when(F.col("value") > 180, "1").otherwise("0").alias("truth"))
    value, kind = F.col("value"), F.col("event_type")
    counts = feeds.shadow_windows(
        feeds.labelled(events, labels, "event_id", "ts", "known", "24 hours"), "ts",
        F.when(value > 200, "1").otherwise("0"),
        F.when((value > 150) | (kind == "error"), "1").otherwise("0"),
        shadow.value_segment(value * 3, kind == "purchase"), F.col("truth"))
    feeds.start_shadow(counts, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        F.col("window_start").cast("date").alias("day"), "segment", "n", "agreed", "labelled",
        "incumbent_right", "candidate_right", "contested", "incumbent_wins", "candidate_wins")


SHADOW_SQL = """
WITH r AS (
  SELECT CAST(ts AS DATE) AS day, CASE WHEN value > 200 THEN '1' ELSE '0' END AS i,
    CASE WHEN value > 150 OR event_type = 'error' THEN '1' ELSE '0' END AS c,
    CASE WHEN value * 3 >= 750 THEN 'high_value' WHEN event_type = 'purchase'
      THEN 'high_escalation' ELSE 'standard' END AS segment,
    CASE WHEN event_id % 3 <> 0 AND event_id % 36 <= 24 THEN CASE WHEN value > 180 THEN '1' ELSE '0' END END AS o
  FROM events
  WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 2 DAY - INTERVAL 24 HOUR FROM events))
SELECT day, segment, count(*) AS n, count(*) FILTER (i = c) AS agreed, count(o) AS labelled,
  count(*) FILTER (i = o) AS incumbent_right, count(*) FILTER (c = o) AS candidate_right,
  count(*) FILTER (i <> c AND o IS NOT NULL) AS contested,
  count(*) FILTER (i <> c AND i = o) AS incumbent_wins,
  count(*) FILTER (i <> c AND c = o) AS candidate_wins
FROM r GROUP BY 1, 2"""


def document_folds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = F.col("doc_id") % 10
    return docs.withColumn("split", F.when(d < 7, "train").when(d < 8, "validation")
                           .otherwise("test"))


def issue_classifier_metrics(spark, sf_dir):
    report = trials.issue_report(
        document_folds(spark, sf_dir), models.TextParams(C=4.0, min_df=2, max_features=4000), "text", "lang")
    return report.select("rows", "classes", "macro_f1", "micro_f1", "balanced_accuracy")


RISK_FEATURES = ["value", "hour", "k", "is_error"]


def risk_rows(spark, sf_dir):
    """Events with numeric features, a noisy label and a split by day."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e, "value", F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "error").cast("double").alias("is_error"),
        ((F.col("value") > 180) & (e * 7919 % 10 < 6)).cast("int").alias("label"),
        layers.temporal_split(F.dayofmonth("ts"), 19, 23).alias("split"))


def fraud_model_metrics(spark, sf_dir):
    rows = stored(risk_rows(spark, sf_dir), "risk-rows")
    model = models.fit_risk(rows.where("split <> 'test'"), RISK_FEATURES, "label")
    return models.risk_report(model, rows.where("split = 'test'"), "label", "event_id")


def fraud_coefficients(spark, sf_dir):
    rows = stored(risk_rows(spark, sf_dir).where("split <> 'test'"), "risk-rows")
    model = models.fit_risk(rows, RISK_FEATURES, "label")
    return models.coefficients(model, RISK_FEATURES, spark)


def fraud_search(spark, sf_dir):
    """Seeded search scored on the validation fold. The rows are derived once for all trials."""
    rows = stored(risk_rows(spark, sf_dir).where("split <> 'test'"), "risk-rows")
    train, held = rows.where("split = 'train'"), rows.where("split = 'validation'")

    def objective(p):
        model = models.fit_risk(train, RISK_FEATURES, "label", p["C"], bool(p["balanced"]), 20)
        return models.risk_recall(model, held, "label", "event_id")

    _, trials = models.random_search(objective, models.FRAUD_SPACE, 3, 17, spark)
    return trials.select("trial", "score", "improved")


def issue_search(spark, sf_dir):
    """Text trials over the whole search space, halved on the validation fold; every trial's end."""
    _, table_ = trials.search(document_folds(spark, sf_dir), "text", "lang", "split", models.TEXT_SPACE, 6, 23)
    return table_.select("trial", F.round("score", 6).alias("score"), "rung", "passes", "chosen")


def complaint_cases(spark, sf_dir):
    """Documents as narratives of disputes; the label of a document says whether it was escalated."""
    docs = table(spark, sf_dir, "documents").withColumns({
        "o_orderkey": F.col("doc_id"), "o_totalprice": F.col("n_chars").cast("double"),
        "o_orderdate": F.date_add(F.to_date(F.lit("1996-01-01")), F.pmod("doc_id", F.lit(900)).cast("int")),
        "o_orderpriority": F.col("source"), "o_orderstatus": F.col("lang")})
    facts = disputes(spark, sf_dir, docs.where("doc_id IS NOT NULL")).drop("consumer_disputed")
    told = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("narrative"))
    known = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(
        (F.max("toxic") == 1).alias("consumer_disputed"))
    return facts.join(told, "key").join(known, "key", "left").withColumns({
        "label_outcome": F.col("company_response"), "timely_response": F.col("key") % 4 != 0,
        "company_size": F.col("priority_class")})


def escalation_scores(spark, sf_dir):
    """Each case with the probability of escalation from the model that left its fold out."""
    told = models.escalation_text(complaint_cases(spark, sf_dir))
    return trials.out_of_fold(told, "features_text", "consumer_disputed", "true", ["key"],
                              models.TextParams(C=4.0, min_df=2, max_features=4000, balanced=True))


def escalation_auc(spark, sf_dir):
    """How well scores out of their fold order the labelled cases."""
    scored = stored(escalation_scores(spark, sf_dir), "escalation")
    known = scored.where("label IS NOT NULL").select((F.col("label") == "true").cast("int").alias("label"), "score")
    return metrics.roc_auc(known).select("positives", "negatives", F.round("roc_auc", 6).alias("roc_auc"))


def escalation_triage(spark, sf_dir):
    """The case chain with priorities from the fitted model: cases by priority, queue and label."""
    scored = escalation_scores(spark, sf_dir).select("key", F.col("score").alias("escalation_probability"))
    valid = F.array(*[F.lit(x) for x in VALID_SECTIONS])
    done = plan.triage(complaint_cases(spark, sf_dir).join(scored, "key"), F.to_date(F.lit(AS_OF)),
                       valid_sections=valid)
    return done.groupBy("priority", "queue", "consumer_disputed").agg(F.count(F.lit(1)).alias("cases"))


def outcome_temporal_penalty(spark, sf_dir):
    """Balanced accuracy under a split by id and under a shuffled split."""
    return trials.temporal_penalty(
        document_folds(spark, sf_dir), "doc_id", "text", "lang",
        models.TextParams(C=1.0, min_df=2, max_features=2000), passes=10)


def case_sections(spark, sf_dir):
    """Documents as complaints: the governing sections of each, from the question corpus."""
    regs = ["REG_E", "REG_Z", "FCRA", "FDCPA", "CIRCULAR"]
    i = F.col("query_id")
    sections = questions(spark, sf_dir).select(
        F.concat(F.lit("S-"), i.cast("string")).alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in regs]), (i % 5 + 1).cast("int")).alias(
            "regulation"), F.lit("").alias("title"), F.col("query").alias("text"))
    k = F.col("id")
    day = F.date_add(F.to_date(F.lit("2023-01-02")), (k % 365).cast("int"))
    docs = corpus(spark, sf_dir).select(
        F.concat(F.lit("D"), k.cast("string")).alias("complaint_id"),
        F.element_at(F.array(*[F.lit(x) for x in policy.KNOWN_ISSUES]),
                     (k % 20 + 1).cast("int")).alias("issue"),
        F.col("text").alias("narrative"), F.lit(10.0).alias("disputed_amount"),
        F.date_sub(day, 20).alias("transaction_date"), F.date_sub(day, 10).alias("statement_date"),
        day.alias("notice_date"))
    done = plan.triage(docs, F.to_date(F.lit("2025-01-01")), sections,
                       retrieval.fit_projection(sections))
    return done.select(
        "complaint_id", "regulation", "queue", F.concat_ws(",", F.transform(
            "sections", lambda s: s["id"])).alias("sections"),
        F.col("verification.citations").alias("citations"))


QUERIES = {
    "streaming_daily_psi": (streaming_daily_psi, DAILY_SQL),
    "streaming_daily_numeric_psi": (streaming_daily_numeric_psi, DAILY_NUMERIC_SQL),
    "streaming_triage": (streaming_triage, VERIFIED_SQL + """
        SELECT 'succeeded' AS state, queue, CAST(count(*) AS BIGINT) AS cases
        FROM (SELECT queue FROM final UNION ALL SELECT 'manual_review' FROM disputes
              WHERE key % 31 = 0) GROUP BY 2"""),
    "streaming_shadow": (streaming_shadow, SHADOW_SQL),
    "streaming_retries": (streaming_retries, RETRIES_SQL),
    "issue_classifier_metrics": (issue_classifier_metrics, None),
    "issue_search": (issue_search, None),
    "escalation_auc": (escalation_auc, None),
    "escalation_triage": (escalation_triage, None),
    "outcome_temporal_penalty": (outcome_temporal_penalty, None),
    "fraud_model_metrics": (fraud_model_metrics, None),
    "fraud_coefficients": (fraud_coefficients, None),
    "fraud_search": (fraud_search, None),
    "case_sections": (case_sections, None),
}
