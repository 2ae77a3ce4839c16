"""Queries over drift, shadow comparison, metrics, gates and difficulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from remedia import policy
from remedia.catalog.base import DISPUTES_SQL, disputes, sql_str, table
from remedia.operators import curriculum, drift, metrics, shadow


# --- drift ----------------------------------------------------------------------

def monitored(spark, sf_dir):
    """Disputes with a channel and an outcome that change in 2000."""
    late, k = F.year("statement_date") >= 2000, F.col("key")
    return disputes(spark, sf_dir).select(
        "complaint_id", "key", "statement_date", "issue", "status", "consumer_disputed",
        F.when(late & (k % 3 == 0), F.concat(F.lit("App "), (k % 9).cast("string")))
        .otherwise(F.col("priority_class")).alias("channel"),
        F.when(late & (k % 4 == 0), F.lit("Untimely response"))
        .otherwise(F.col("company_response")).alias("company_response"),
        "disputed_amount",
        (F.col("disputed_amount") * F.when(late, 1.5).otherwise(1.0)).alias("exposure"),
        (k % 23).cast("int").alias("days_open"))


MONITORED_SQL = f"""{DISPUTES_SQL},
monitored AS (
  SELECT complaint_id, key, statement_date, issue, status, consumer_disputed,
    CASE WHEN year(statement_date) >= 2000 AND key % 3 = 0 THEN 'App ' || (key % 9)
         ELSE priority_class END AS channel,
    CASE WHEN year(statement_date) >= 2000 AND key % 4 = 0 THEN 'Untimely response'
         ELSE company_response END AS company_response,
    disputed_amount,
    disputed_amount * CASE WHEN year(statement_date) >= 2000 THEN 1.5 ELSE 1.0 END::DOUBLE
      AS exposure,
    CAST(key % 23 AS INT) AS days_open
  FROM disputes),
base AS (
  SELECT * FROM monitored WHERE statement_date <
    (SELECT date_trunc('month', min(statement_date)) + INTERVAL 12 MONTH FROM monitored)),
curr AS (SELECT * FROM monitored WHERE statement_date >= DATE '2000-01-01')"""

CATEGORICAL = ["issue", "status", "channel", "consumer_disputed"]
NUMERIC = ["disputed_amount", "exposure", "days_open"]


def windows(spark, sf_dir):
    rows = monitored(spark, sf_dir)
    return (drift.reference_window(rows, "statement_date", 12),
            rows.where("statement_date >= DATE '2000-01-01'"))


def _sql_category(name):
    if name == "consumer_disputed":
        return "CASE WHEN consumer_disputed THEN 'True' ELSE 'False' END"
    return f"CAST({name} AS VARCHAR)"


def _freq_sql(named):
    sides = []
    for side, flag in (("base", 1), ("curr", 0)):
        for signal, name in named.items():
            sides.append(f"SELECT '{signal}' AS signal, {_sql_category(name)} AS category, "
                         f"{flag} AS old FROM {side}")
    return f"""freq AS (
      SELECT signal, category, CAST(sum(old) AS BIGINT) AS baseline_n,
        CAST(sum(1 - old) AS BIGINT) AS current_n
      FROM ({' UNION ALL '.join(sides)}) GROUP BY 1, 2)"""


CONTRIB_SQL = """totals AS (
  SELECT signal, sum(baseline_n) AS b, sum(current_n) AS c FROM freq GROUP BY 1),
shares AS (
  SELECT signal, category, baseline_n, current_n, greatest(baseline_n / b, 1e-6) AS bs,
    greatest(current_n / c, 1e-6) AS cs FROM freq JOIN totals USING (signal)),
contrib AS (SELECT *, (cs - bs) * ln(cs / bs) AS contribution FROM shares)"""

_LABELLED = {n: n for n in CATEGORICAL} | {"realised_outcome": "company_response"}
STATUS_SQL = ("CASE WHEN sum(contribution) < 0.10 THEN 'stable' "
              "WHEN sum(contribution) < 0.25 THEN 'investigate' ELSE 'alert' END")


def psi_categorical(spark, sf_dir):
    base, curr = windows(spark, sf_dir)
    found = drift.psi(drift.contributions(drift.frequencies(base, curr, _LABELLED)))
    return found.select("signal", F.round("psi", 6).alias("psi"), "status")


def psi_contributors(spark, sf_dir):
    base, curr = windows(spark, sf_dir)
    contrib = drift.contributions(drift.frequencies(base, curr, _LABELLED))
    return drift.top_contributors(contrib).select(
        "signal", "rank", "category", "baseline_n", "current_n",
        F.round("contribution", 6).alias("contribution"))


def new_categories(spark, sf_dir):
    base, curr = windows(spark, sf_dir)
    return drift.new_categories(drift.frequencies(base, curr, _LABELLED), None).select(
        "signal", "category", "current_n")


def psi_numeric(spark, sf_dir):
    base, curr = windows(spark, sf_dir)
    freq = drift.numeric_frequencies(base, curr, NUMERIC)
    contrib = drift.contributions(freq.drop("baseline_sum", "current_sum"))
    return drift.psi(contrib).join(drift.numeric_means(freq), "signal").select(
        "signal", F.round("psi", 6).alias("psi"), "status",
        F.round("baseline_mean", 4).alias("baseline_mean"),
        F.round("current_mean", 4).alias("current_mean"))


def numeric_edges(spark, sf_dir):
    base, _ = windows(spark, sf_dir)
    edges = drift.baseline_edges(base, NUMERIC)
    return edges.select("signal", F.posexplode("edges").alias("edge", "value"))


def _numeric_sql():
    longs = {side: " UNION ALL ".join(
        f"SELECT '{n}' AS signal, CAST({n} AS DOUBLE) AS value FROM {side}" for n in NUMERIC)
        for side in ("base", "curr")}
    return f"""blong AS ({longs['base']}), clong AS ({longs['curr']}),
    ranked AS (SELECT signal, value, row_number() OVER (PARTITION BY signal ORDER BY value) - 1
                 AS r, count(*) OVER (PARTITION BY signal) AS n FROM blong),
    edges AS (SELECT signal, CAST(i - 1 AS INT) AS edge, value FROM ranked, range(1, 10) t(i)
              WHERE r = (n * i) // 10),
    both_sides AS (SELECT *, 1 AS old FROM blong UNION ALL SELECT *, 0 FROM clong),
    binned AS (
      SELECT signal, value, old,
        (SELECT count(*) FROM edges e WHERE e.signal = v.signal AND e.value < v.value) AS category
      FROM both_sides v),
    freq AS (SELECT signal, CAST(category AS VARCHAR) AS category, sum(old) AS baseline_n,
               sum(1 - old) AS current_n FROM binned GROUP BY 1, 2)"""


def drift_signals(spark, sf_dir):
    base, curr = windows(spark, sf_dir)
    return drift.signals(base, curr, CATEGORICAL, NUMERIC, label="company_response").select(
        "signal", "kind", "statistic", F.round("value", 6).alias("value"), "status")


def drift_monitor_rollup(spark, sf_dir):
    base, curr = windows(spark, sf_dir)
    return drift.roll_up(drift.signals(
        base, curr, CATEGORICAL, NUMERIC, label="company_response"))


def reference_window_counts(spark, sf_dir):
    base, _ = windows(spark, sf_dir)
    return base.groupBy(F.date_format("statement_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("disputes"))


def event_mix_drift(spark, sf_dir):
    """Events of the first ten days against the last ten: type and user mix."""
    events = table(spark, sf_dir, "events").select("ts", "event_type", "user_id")
    base = events.where("ts < TIMESTAMP '2024-01-11'")
    curr = events.where("ts >= TIMESTAMP '2024-01-20'")
    contrib = drift.contributions(drift.frequencies(base, curr, ["event_type", "user_id"]))
    return drift.psi(contrib).select("signal", F.round("psi", 6).alias("psi"), "status")


SIGNALS_SQL = f"""
WITH {MONITORED_SQL}, {_freq_sql(_LABELLED)}, {CONTRIB_SQL}, cat AS (
  SELECT signal, sum(contribution) AS value, {STATUS_SQL} AS status FROM contrib GROUP BY 1),
num AS (WITH {_numeric_sql()}, {CONTRIB_SQL}
  SELECT signal, sum(contribution) AS value, {STATUS_SQL} AS status FROM contrib GROUP BY 1),
signals AS (
  SELECT signal, CASE signal WHEN 'realised_outcome' THEN 'concept' ELSE 'data' END AS kind,
    'psi' AS statistic, value, status FROM (SELECT * FROM cat UNION ALL SELECT * FROM num))"""


# --- shadow ----------------------------------------------------------------------

def shadow_records(spark, sf_dir):
    """Two rules predicting the quality label of a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", "left")
    incumbent = F.when(F.col("n_chars") > 600, "1").otherwise("0")
    candidate = F.when((F.col("n_chars") > 250) | (F.col("lang") == "de"), "1").otherwise("0")
    return shadow.records(
        df, "doc_id", incumbent, candidate,
        shadow.value_segment(F.col("n_chars"), F.col("toxic") == 1),
        F.col("quality").cast("string"))


RECORDS_SQL = """rec AS (
  SELECT doc_id AS key, CASE WHEN n_chars > 600 THEN '1' ELSE '0' END AS incumbent,
    CASE WHEN n_chars > 250 OR lang = 'de' THEN '1' ELSE '0' END AS candidate,
    CASE WHEN n_chars >= 750 THEN 'high_value' WHEN toxic = 1 THEN 'high_escalation'
         ELSE 'standard' END AS segment, CAST(quality AS VARCHAR) AS observed
  FROM documents LEFT JOIN labels USING (doc_id))"""

TOTALS_SQL = f"""
WITH {RECORDS_SQL},
t AS (
  SELECT count(*) AS records, avg((incumbent = candidate)::INT) AS overall_agreement,
    count(observed) AS labelled_records,
    count(*) FILTER (observed IS NOT NULL AND incumbent <> candidate) AS contested,
    count(*) FILTER (incumbent <> candidate AND candidate = observed) AS candidate_correct,
    count(*) FILTER (incumbent <> candidate AND incumbent = observed) AS incumbent_correct,
    count(*) FILTER (segment LIKE 'high%' AND incumbent <> candidate) AS high
  FROM rec)"""


def shadow_by_segment(spark, sf_dir):
    r6 = lambda n: F.round(n, 6).alias(n)
    return shadow.by_segment(shadow_records(spark, sf_dir)).select(
        "segment", "n", r6("agreement"), "disagreements", "labelled", r6("incumbent_correct"),
        r6("candidate_correct"))


def shadow_overall(spark, sf_dir):
    return shadow.report(shadow_records(spark, sf_dir)).select(
        "records", F.round("overall_agreement", 6).alias("overall_agreement"),
        "labelled_records", "contested", "candidate_correct", "incumbent_correct",
        "neither_correct", "verdict")


def shadow_recommendation(spark, sf_dir):
    return shadow.report(shadow_records(spark, sf_dir)).select(
        F.concat_ws(",", "high_value_segments_with_disagreement").alias("high_segments"),
        "recommendation")


def shadow_prediction_mix(spark, sf_dir):
    return shadow.prediction_mix(shadow_records(spark, sf_dir))


def shadow_disagreements(spark, sf_dir):
    return shadow.disagreement_examples(shadow_records(spark, sf_dir), 5).select(
        "key", "incumbent", "candidate", "segment", "observed")


def value_segments(spark, sf_dir):
    df = disputes(spark, sf_dir)
    segment = shadow.value_segment(
        F.when(F.col("key") % 3 == 0, F.col("disputed_amount")), F.col("consumer_disputed"))
    return df.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("disputes"))


def challenger_predictions(spark, sf_dir):
    """Second choice where no class share of a user's events exceeds the confidence floor."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    shares = events.groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == x).alias(x) for x in kinds],
        F.count(F.lit(1)).alias("n"))
    prob = F.array(*[(F.col(x) * 10 + i) / (F.col("n") * 10 + 10) for i, x in enumerate(kinds)])
    return shares.select("user_id", shadow.challenger(prob, kinds).alias("prediction"))


# --- metrics ----------------------------------------------------------------------

def predictions(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("label"),
        F.when(n % 3 == 0, F.lit("en")).when(d % 7 == 0, F.lit("xx"))
        .otherwise(F.col("lang")).alias("prediction"))


PRED_SQL = """pred AS (
  SELECT doc_id, lang AS label, CASE WHEN n_chars % 3 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'xx'
    ELSE lang END AS prediction FROM documents),
cls AS (
  SELECT class, count(*) FILTER (label = class) AS support,
    count(*) FILTER (label = class AND prediction = class) AS tp,
    count(*) FILTER (prediction = class) AS predicted
  FROM pred, (SELECT label AS class FROM pred UNION SELECT prediction FROM pred) GROUP BY 1),
pr AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM cls),
rep AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
    ELSE 0 END AS f1 FROM pr)"""


def class_metrics(spark, sf_dir):
    rep = metrics.class_report(metrics.confusion(predictions(spark, sf_dir)))
    return rep.select(
        F.col("class").alias("class_name"), "support", "tp", "predicted",
        *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")])


def classification_metrics(spark, sf_dir):
    s = metrics.classification_summary(predictions(spark, sf_dir))
    return s.select("rows", "classes", *[
        F.round(n, 6).alias(n) for n in ("accuracy", "macro_f1", "micro_f1")])


def balanced_accuracy(spark, sf_dir):
    return metrics.classification_summary(predictions(spark, sf_dir)).select(
        F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def weakest_classes(spark, sf_dir):
    rep = metrics.class_report(metrics.confusion(predictions(spark, sf_dir)))
    return metrics.weakest_classes(rep).select(
        F.col("class").alias("class_name"), F.round("f1", 6).alias("f1"))


def scored_events(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (F.col("value") > 200).cast("int").alias("label"),
        ((e * 7919 % 211) / 211.0 + F.when(F.col("value") > 150, 0.25).otherwise(0.0))
        .alias("score"))


SCORED_SQL = """scored AS (
  SELECT event_id AS id, CAST(value > 200 AS INT) AS label,
    (event_id * 7919 % 211) / 211.0::DOUBLE + CASE WHEN value > 150 THEN 0.25 ELSE 0.0 END::DOUBLE
      AS score FROM events)"""

AUC_SQL = f"""{SCORED_SQL},
mid AS (
  SELECT label, avg(r) OVER (PARTITION BY score) AS mr
  FROM (SELECT *, row_number() OVER (ORDER BY score) AS r FROM scored)),
auc AS (
  SELECT sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives,
    (sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0)
      / (sum(label) * sum(1 - label))::DOUBLE AS roc_auc FROM mid)"""

BUDGET_PART = """k AS (SELECT greatest(1, CAST(round_even(count(*) * 0.02, 0) AS BIGINT)) AS k, count(*) AS n,
        sum(label) AS p FROM scored),
top AS (SELECT label FROM scored, k QUALIFY row_number() OVER (ORDER BY score DESC, id) <= k),
bud AS (
  SELECT (SELECT count(*) FROM top) AS alerts, (SELECT sum(label) FROM top)::BIGINT AS caught,
    p::BIGINT AS positives, n AS rows FROM k)"""
BUDGET_SQL = f"{SCORED_SQL}, {BUDGET_PART}"


def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_events(spark, sf_dir)).select(
        "positives", "negatives", F.round("roc_auc", 6).alias("roc_auc"))


def recall_at_budget(spark, sf_dir):
    return metrics.recall_at_budget(scored_events(spark, sf_dir)).select(
        "alerts", "caught", "positives", "rows",
        *[F.round(n, 6).alias(n) for n in ("recall", "precision", "base_rate", "lift")])


def top_scored_events(spark, sf_dir):
    return metrics.top_rows(
        scored_events(spark, sf_dir), "score", "id",
        F.greatest(F.lit(1), F.expr("_n div 50"))).select(
        "id", "label", F.round("score", 6).alias("score"))


def eta_squared(spark, sf_dir):
    return metrics.eta_squared(
        table(spark, sf_dir, "documents").select("lang", "n_chars"), "lang", "n_chars").select(
        "classes", F.round("eta_squared", 6).alias("eta_squared"))


def large_institution_share(spark, sf_dir):
    return metrics.share_where(
        table(spark, sf_dir, "customer"), F.col("c_acctbal") > 5000).select(
        F.round("share", 6).alias("share"))


# --- difficulty -------------------------------------------------------------------

PARTS = ["length", "noise"]


def graded(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"),
        (F.least(n, F.lit(4000)) / 8000.0 + F.when(n % 5 == 0, 0.25).otherwise(0.0)).alias(
            "difficulty"),
        (F.least(n, F.lit(4000)) / 4000.0).alias("length"),
        F.when(n % 5 == 0, 1.0).otherwise(0.0).alias("noise"))


GRADED_SQL = """graded AS (
  SELECT doc_id AS example_id,
    least(n_chars, 4000) / 8000.0::DOUBLE + CASE WHEN n_chars % 5 = 0 THEN 0.25 ELSE 0 END::DOUBLE
      AS difficulty, least(n_chars, 4000) / 4000.0::DOUBLE AS length,
    CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS noise FROM documents)"""


def difficulty_summary(spark, sf_dir):
    s = curriculum.difficulty_summary(graded(spark, sf_dir))
    return s.select("examples", *[F.round(n, 6).alias(n) for n in (
        "difficulty_min", "difficulty_median", "difficulty_max")])


def difficulty_drivers(spark, sf_dir):
    return curriculum.top_drivers(graded(spark, sf_dir), PARTS).select(
        "hardest", *[F.round(n, 6).alias(n) for n in PARTS])


def curriculum_buckets(spark, sf_dir):
    return curriculum.curriculum_buckets(graded(spark, sf_dir)).select(
        "example_id", F.col("rank").cast("long").alias("rank"), "bucket")


QUERIES = {
    "psi_categorical": (psi_categorical, f"""
        WITH {MONITORED_SQL}, {_freq_sql(_LABELLED)}, {CONTRIB_SQL}
        SELECT signal, round(sum(contribution), 6) AS psi, {STATUS_SQL} AS status
        FROM contrib GROUP BY 1"""),
    "psi_contributors": (psi_contributors, f"""
        WITH {MONITORED_SQL}, {_freq_sql(_LABELLED)}, {CONTRIB_SQL},
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY signal
                ORDER BY abs(round(contribution, 6)) DESC, category) AS INT) AS rank FROM contrib)
        SELECT signal, rank, category, baseline_n, current_n,
          round(contribution, 6) AS contribution FROM r WHERE rank <= 5"""),
    "new_categories": (new_categories, f"""
        WITH {MONITORED_SQL}, {_freq_sql(_LABELLED)}
        SELECT signal, category, current_n FROM freq WHERE baseline_n = 0 AND current_n > 0"""),
    "psi_numeric": (psi_numeric, f"""
        WITH {MONITORED_SQL}, {_numeric_sql()}, {CONTRIB_SQL},
        means AS (SELECT signal, avg(value) FILTER (old = 1) AS bm,
                    avg(value) FILTER (old = 0) AS cm FROM both_sides GROUP BY 1)
        SELECT signal, round(sum(contribution), 6) AS psi, {STATUS_SQL} AS status,
          round(any_value(bm), 4) AS baseline_mean, round(any_value(cm), 4) AS current_mean
        FROM contrib JOIN means USING (signal) GROUP BY 1"""),
    "numeric_edges": (numeric_edges, f"""
        WITH {MONITORED_SQL}, {_numeric_sql()} SELECT signal, edge, value FROM edges"""),
    "drift_signals": (drift_signals, SIGNALS_SQL + """
        SELECT signal, kind, statistic, round(value, 6) AS value, status FROM signals"""),
    "drift_monitor_rollup": (drift_monitor_rollup, SIGNALS_SQL + f"""
        , r AS (SELECT max(CASE status WHEN 'alert' THEN 2 WHEN 'investigate' THEN 1 ELSE 0 END)
                  AS worst, coalesce(bool_or(kind = 'concept' AND status <> 'stable'), FALSE)
                  AS concept, count(*) AS signals FROM signals)
        SELECT ['stable', 'investigate', 'alert'][worst + 1] AS overall_status,
          concept AS concept_drift_detected, signals,
          CASE WHEN concept THEN {sql_str(drift.ACTIONS['concept'])}
               WHEN worst = 2 THEN {sql_str(drift.ACTIONS['alert'])}
               WHEN worst = 1 THEN {sql_str(drift.ACTIONS['investigate'])}
               ELSE {sql_str(drift.ACTIONS['stable'])} END AS action FROM r"""),
    "reference_window_counts": (reference_window_counts, f"""
        WITH {MONITORED_SQL} SELECT strftime(statement_date, '%Y-%m') AS month,
          count(*) AS disputes FROM base GROUP BY 1"""),
    "event_mix_drift": (event_mix_drift, f"""
        WITH base AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-11'),
        curr AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20'),
        {_freq_sql({'event_type': 'event_type', 'user_id': 'user_id'})}, {CONTRIB_SQL}
        SELECT signal, round(sum(contribution), 6) AS psi, {STATUS_SQL} AS status
        FROM contrib GROUP BY 1"""),
    "shadow_by_segment": (shadow_by_segment, f"""
        WITH {RECORDS_SQL}
        SELECT segment, count(*) AS n, round(avg((incumbent = candidate)::INT), 6) AS agreement,
          count(*) FILTER (incumbent <> candidate) AS disagreements, count(observed) AS labelled,
          round(avg((incumbent = observed)::INT), 6) AS incumbent_correct,
          round(avg((candidate = observed)::INT), 6) AS candidate_correct
        FROM rec GROUP BY 1"""),
    "shadow_overall": (shadow_overall, TOTALS_SQL + """
        SELECT records, round(overall_agreement, 6) AS overall_agreement, labelled_records,
          contested, candidate_correct, incumbent_correct,
          contested - candidate_correct - incumbent_correct AS neither_correct,
          CASE WHEN candidate_correct > incumbent_correct
                 THEN 'candidate better on contested cases'
               WHEN incumbent_correct > candidate_correct
                 THEN 'incumbent better on contested cases'
               ELSE 'no separation on contested cases' END AS verdict FROM t"""),
    "shadow_recommendation": (shadow_recommendation, TOTALS_SQL + f"""
        SELECT coalesce((SELECT string_agg(segment, ',' ORDER BY segment) FROM
          (SELECT DISTINCT segment FROM rec WHERE segment LIKE 'high%'
           AND incumbent <> candidate)), '') AS high_segments,
          CASE WHEN records = 0 THEN {sql_str(shadow.KEEP_IN_SHADOW)}
            WHEN candidate_correct > incumbent_correct AND high = 0 THEN {sql_str(shadow.PROMOTE)}
            WHEN candidate_correct > incumbent_correct
              THEN {sql_str(shadow.PROMOTE_AFTER_REVIEW)}
            WHEN incumbent_correct > candidate_correct THEN {sql_str(shadow.DO_NOT_PROMOTE)}
            ELSE {sql_str(shadow.HOLD)} END AS recommendation FROM t"""),
    "shadow_prediction_mix": (shadow_prediction_mix, f"""
        WITH {RECORDS_SQL}
        SELECT 'incumbent' AS model, incumbent AS prediction, count(*) AS n FROM rec GROUP BY ALL
        UNION ALL
        SELECT 'candidate', candidate, count(*) FROM rec GROUP BY ALL"""),
    "shadow_disagreements": (shadow_disagreements, f"""
        WITH {RECORDS_SQL}
        SELECT CAST(key AS VARCHAR) AS key, incumbent, candidate, segment, observed FROM rec
        WHERE incumbent <> candidate ORDER BY CAST(key AS VARCHAR) LIMIT 5"""),
    "value_segments": (value_segments, f"""
        WITH {DISPUTES_SQL}
        SELECT CASE WHEN key % 3 = 0 AND disputed_amount >= 750 THEN 'high_value'
          WHEN consumer_disputed THEN 'high_escalation' ELSE 'standard' END AS segment,
          count(*) AS disputes FROM disputes GROUP BY 1"""),
    "challenger_predictions": (challenger_predictions, """
        WITH s AS (
          SELECT user_id, k, i, count(*) FILTER (event_type = k) AS m, count(*) AS n
          FROM events, (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3),
                               ('view', 4)) t(k, i) GROUP BY ALL),
        p AS (SELECT user_id, k, (m * 10 + i) / (n * 10 + 10) AS p FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, k DESC) AS r,
                max(p) OVER (PARTITION BY user_id) AS top FROM p)
        SELECT user_id, k AS prediction FROM r WHERE r = CASE WHEN top > 0.35 THEN 1 ELSE 2 END"""),
    "class_metrics": (class_metrics, f"""
        WITH {PRED_SQL} SELECT class AS class_name, support, tp, predicted,
          round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
        FROM rep"""),
    "classification_metrics": (classification_metrics, f"""
        WITH {PRED_SQL} SELECT CAST(sum(support) AS BIGINT) AS rows, count(*) AS classes,
          round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
          round(sum(tp) / sum(predicted), 6) AS micro_f1 FROM rep"""),
    "balanced_accuracy": (balanced_accuracy, f"""
        WITH {PRED_SQL} SELECT round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy
        FROM rep"""),
    "weakest_classes": (weakest_classes, f"""
        WITH {PRED_SQL} SELECT class AS class_name, round(f1, 6) AS f1 FROM rep
        WHERE support > 0 ORDER BY rep.f1, class LIMIT 3"""),
    "roc_auc": (roc_auc, f"""
        WITH {AUC_SQL} SELECT positives, negatives, round(roc_auc, 6) AS roc_auc FROM auc"""),
    "recall_at_budget": (recall_at_budget, f"""
        WITH {BUDGET_SQL} SELECT alerts, caught, positives, rows,
          round(caught / positives, 6) AS recall, round(caught / alerts, 6) AS precision,
          round(positives / rows, 6) AS base_rate,
          round((caught / alerts) / (positives / rows), 6) AS lift FROM bud"""),
    "top_scored_events": (top_scored_events, f"""
        WITH {SCORED_SQL} SELECT id, label, round(score, 6) AS score FROM scored
        QUALIFY row_number() OVER (ORDER BY scored.score DESC, id)
          <= (SELECT count(*) // 50 FROM scored)"""),
    "eta_squared": (eta_squared, """
        WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY 1),
        t AS (SELECT avg(n_chars) AS grand, var_pop(n_chars) * count(*) AS total FROM documents)
        SELECT count(*) AS classes, round(sum(n * (m - grand) ** 2) / any_value(total), 6)
          AS eta_squared FROM g, t"""),
    "large_institution_share": (large_institution_share, """
        SELECT round(avg((c_acctbal > 5000)::INT), 6) AS share FROM customer"""),
    "difficulty_summary": (difficulty_summary, f"""
        WITH {GRADED_SQL},
        r AS (SELECT difficulty, row_number() OVER (ORDER BY difficulty) - 1 AS r,
                count(*) OVER () AS n FROM graded)
        SELECT count(*) AS examples, round(min(difficulty), 6) AS difficulty_min,
          round(max(difficulty) FILTER (r = n // 2), 6) AS difficulty_median,
          round(max(difficulty), 6) AS difficulty_max FROM r"""),
    "difficulty_drivers": (difficulty_drivers, f"""
        WITH {GRADED_SQL},
        h AS (SELECT * FROM graded QUALIFY row_number() OVER (
                ORDER BY difficulty DESC, example_id)
                <= greatest(1, (SELECT count(*) FROM graded) // 10))
        SELECT count(*) AS hardest, round(avg(length), 6) AS length, round(avg(noise), 6) AS noise
        FROM h"""),
    "curriculum_buckets": (curriculum_buckets, f"""
        WITH {GRADED_SQL},
        r AS (SELECT example_id, row_number() OVER (ORDER BY difficulty, example_id) - 1 AS rank,
                greatest(1, count(*) OVER () // 5) AS size FROM graded)
        SELECT example_id, rank, rank // size AS bucket FROM r"""),
}
