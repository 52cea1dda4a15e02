"""SQL counterparts of the registered queries, for an independent engine on the same tables.

They are written in their own way (ranks instead of running sums, DISTINCT instead of
digests, UNION ALL instead of arrays), so that agreement means something.
"""

from __future__ import annotations

from tidewatch.catalog.queries import EXPLAINED_BATCH, SHORT_HEADER
from tidewatch.functions import text
from tidewatch.schema import (
    CATEGORICAL_FEATURES,
    NUMERIC_FEATURES,
    REPORT_COLUMNS,
    REPORT_DECIMALS,
    REPORT_FLAGS,
)

TRANSACTIONS = """
base AS (
  SELECT
    concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS transaction_id,
    concat('B', year(l_shipdate)) AS batch_id,
    CASE WHEN year(l_shipdate) <= 1996 THEN 'baseline'
         WHEN year(l_shipdate) = 1998 THEN 'feature_drift'
         WHEN year(l_shipdate) = 1999 THEN 'prediction_drift'
         WHEN year(l_shipdate) = 2000 THEN 'quality_issue'
         ELSE 'normal' END AS batch_type,
    l_shipdate AS event_timestamp,
    CAST(o_custkey AS STRING) AS account_id,
    l_extendedprice AS amount,
    CAST(o_custkey % 1000 AS INT) AS account_age_days,
    l_linenumber AS prior_chargebacks,
    CASE WHEN year(l_shipdate) = 1998 THEN l_quantity * CAST(1.5 AS DOUBLE) ELSE l_quantity END
      AS login_velocity_24h,
    l_discount * CAST(10 AS DOUBLE) AS device_trust_score,
    CASE WHEN year(l_shipdate) = 2000 AND l_orderkey % 10 = 0 THEN NULL
         ELSE l_tax * CAST(12.5 AS DOUBLE) END AS ip_risk_score,
    p_size / CAST(50 AS DOUBLE)
      + CASE WHEN year(l_shipdate) = 1999 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      AS merchant_risk_score,
    CAST(l_partkey % 24 AS INT) AS transaction_hour,
    o_orderpriority AS channel,
    n_name AS country,
    p_type AS merchant_category,
    c_mktsegment AS payment_method,
    CASE WHEN l_returnflag = 'R' AND l_quantity >= 40 THEN 1 ELSE 0 END AS label_fraud,
    l_orderkey AS ok
  FROM lineitem
  JOIN orders   ON l_orderkey = o_orderkey
  JOIN part     ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation   ON c_nationkey = n_nationkey
), simulated AS (
  SELECT *, round(1 / (1 + exp(-(CAST(-4 AS DOUBLE)
      + CAST(0.04 AS DOUBLE) * login_velocity_24h
      + merchant_risk_score
      + CAST(0.8 AS DOUBLE) * coalesce(ip_risk_score, CAST(0 AS DOUBLE))
      - CAST(0.5 AS DOUBLE) * device_trust_score
      + amount / CAST(200000 AS DOUBLE)))), 6) AS fraud_probability_simulated
  FROM base
), dup AS (
  SELECT * FROM simulated
  UNION ALL
  SELECT * FROM simulated WHERE batch_type = 'quality_issue' AND ok % 40 = 0
), transactions AS (
  SELECT transaction_id, batch_id, batch_type, event_timestamp, account_id, amount, account_age_days,
    prior_chargebacks, login_velocity_24h, device_trust_score, ip_risk_score, merchant_risk_score,
    transaction_hour, channel, country, merchant_category, payment_method, label_fraud,
    fraud_probability_simulated,
    CASE WHEN batch_type = 'baseline' THEN 'baseline' ELSE 'production_batch' END AS data_source,
    CASE batch_id WHEN 'B1995' THEN 'train_baseline.csv' WHEN 'B1996' THEN 'train_baseline.csv'
      WHEN 'B1997' THEN 'batch_01_normal.csv' WHEN 'B1998' THEN 'batch_02_feature_drift.csv'
      WHEN 'B1999' THEN 'batch_03_prediction_drift.csv' WHEN 'B2000' THEN 'batch_04_quality_issue.csv'
      ELSE 'batch_05_recent.csv' END AS batch_file_name
  FROM dup
), production AS (SELECT * FROM transactions WHERE data_source <> 'baseline')
"""

ORIGINAL = """transaction_id batch_id batch_type event_timestamp account_id amount account_age_days
prior_chargebacks login_velocity_24h device_trust_score ip_risk_score merchant_risk_score
transaction_hour channel country merchant_category payment_method label_fraud
fraud_probability_simulated""".split()


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([TRANSACTIONS, *ctes]) + "\n" + body


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + CAST(0 AS DOUBLE)"


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ks_ctes(long_sql: str) -> list[str]:
    """Both empirical distribution functions on the union of values of each pair."""
    return [
        f"long AS ({long_sql})",
        "names AS (SELECT DISTINCT batch_name, feature, position FROM long WHERE NOT is_base)",
        """base_hist AS (SELECT feature, value, count(*) AS n FROM long
             WHERE is_base AND value IS NOT NULL GROUP BY 1, 2)""",
        """points AS (
             SELECT batch_name, feature, value, 0 AS nb, count(*) AS n FROM long
             WHERE NOT is_base AND value IS NOT NULL GROUP BY 1, 2, 3
             UNION ALL
             SELECT batch_name, b.feature, value, n, 0 FROM base_hist b JOIN names USING (feature))""",
        """merged AS (SELECT batch_name, feature, value, sum(nb) AS nb, sum(n) AS n
             FROM points GROUP BY 1, 2, 3)""",
        """steps AS (SELECT batch_name, feature,
             sum(nb) OVER w / nullif(sum(nb) OVER p, 0)::DOUBLE AS fb,
             sum(n) OVER w / nullif(sum(n) OVER p, 0)::DOUBLE AS fn
             FROM merged WINDOW w AS (PARTITION BY batch_name, feature ORDER BY value),
               p AS (PARTITION BY batch_name, feature))""",
        """ks AS (SELECT batch_name, names.feature, position,
             coalesce(max(abs(fb - fn)), CAST(0 AS DOUBLE)) AS ks
             FROM names LEFT JOIN steps USING (batch_name, feature) GROUP BY 1, 2, 3)""",
    ]


KS = ks_ctes(
    "\n UNION ALL ".join(
        f"SELECT batch_file_name AS batch_name, data_source = 'baseline' AS is_base, "
        f"{literal(c)} AS feature, {i} AS position, CAST({c} AS DOUBLE) AS value FROM transactions"
        for i, c in enumerate(NUMERIC_FEATURES)
    )
)
FLAGGED = """flagged AS (SELECT batch_name, max(ks) AS max_feature_drift_score,
    first(feature ORDER BY ks DESC, position) AS most_drifted_feature,
    max(ks) >= CAST(0.15 AS DOUBLE) AS feature_drift_detected FROM ks GROUP BY 1)"""


def auc_ctes(source: str, key: str, score: str, label: str) -> list[str]:
    """Mann-Whitney: rank sum of the positives, tied ranks averaged."""
    return [
        f"""ranked AS (SELECT {key} AS k, {label} AS y,
              rank() OVER (PARTITION BY {key} ORDER BY {score})
                + (count(*) OVER (PARTITION BY {key}, {score}) - 1) / 2.0::DOUBLE AS rk FROM {source})""",
        """counted AS (SELECT k, sum(rk) FILTER (y = 1) AS s,
              (count(*) FILTER (y = 1))::DOUBLE AS p, (count(*) FILTER (y = 0))::DOUBLE AS q
              FROM ranked GROUP BY 1)""",
        "auc AS (SELECT k, (s - p * (p + 1) / 2) / nullif(p * q, 0) AS roc_auc FROM counted)",
    ]


def counts_cte(source: str, key: str, score: str, label: str, threshold: str) -> str:
    hit = f"{score} >= CAST({threshold} AS DOUBLE)"
    return f"""confusion AS (SELECT {key},
        count(*) FILTER ({label} = 1 AND {hit}) AS tp, count(*) FILTER ({label} = 0 AND {hit}) AS fp,
        count(*) FILTER ({label} = 1 AND NOT {hit}) AS fn, count(*) FILTER ({label} = 0 AND NOT {hit}) AS tn
        FROM {source} GROUP BY 1)"""


def metrics_select(keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, tn,
        coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0) AS accuracy,
        coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision",
        coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1_score FROM confusion"""


SCORE = "fraud_probability_simulated"
CONFUSION = counts_cte("transactions", "batch_file_name", SCORE, "label_fraud", "0.30")
METRICS = f"metrics AS ({metrics_select('batch_file_name')})"
AUC = auc_ctes("transactions", "batch_file_name", SCORE, "label_fraud")
ROUNDED_METRICS = ", ".join(f'{r(c)} AS {c}' for c in ('accuracy', '"precision"', "recall", "f1_score"))

_MISSING = " + ".join(f"({c} IS NULL)::INT" for c in ORIGINAL)
QUALITY = [
    f"""distinct_rows AS (SELECT batch_file_name, count(*) AS d FROM
          (SELECT DISTINCT batch_file_name, {', '.join(ORIGINAL)} FROM production) GROUP BY 1)""",
    f"""cells AS (SELECT batch_file_name, count(*) AS n, sum({_MISSING}) AS missing
          FROM production GROUP BY 1)""",
    """quality AS (SELECT batch_file_name, missing / (n * 19)::DOUBLE AS missing_percentage,
          n - d AS duplicate_rows,
          missing / (n * 19)::DOUBLE >= CAST(0.05 AS DOUBLE) OR n > d AS data_quality_issue_detected
          FROM cells JOIN distinct_rows USING (batch_file_name))""",
]
DRIFT = """drift AS (SELECT batch_file_name AS batch_name, count(*) AS "rows",
    avg(label_fraud) AS fraud_rate_actual, avg(fraud_probability_simulated) AS avg_predicted_risk,
    (SELECT avg(fraud_probability_simulated) FROM transactions WHERE data_source = 'baseline')
      AS baseline_avg_risk
    FROM production GROUP BY 1)"""
REPORT = [
    *KS,
    FLAGGED,
    CONFUSION,
    METRICS,
    *AUC,
    *QUALITY,
    DRIFT,
    """report AS (SELECT batch_name, "rows", fraud_rate_actual, avg_predicted_risk, baseline_avg_risk,
        abs(avg_predicted_risk - baseline_avg_risk) AS prediction_drift_score,
        abs(avg_predicted_risk - baseline_avg_risk) >= CAST(0.05 AS DOUBLE) AS prediction_drift_detected,
        max_feature_drift_score, most_drifted_feature, feature_drift_detected,
        missing_percentage, duplicate_rows, data_quality_issue_detected,
        abs(avg_predicted_risk - baseline_avg_risk) >= CAST(0.05 AS DOUBLE) OR feature_drift_detected
          OR data_quality_issue_detected AS anomaly_detected,
        accuracy, roc_auc, f1_score, "precision", recall
        FROM drift JOIN flagged USING (batch_name)
        JOIN metrics m ON m.batch_file_name = batch_name JOIN auc ON k = batch_name
        JOIN quality q ON q.batch_file_name = batch_name)""",
    """severities AS (SELECT *, CASE prediction_drift_detected::INT + feature_drift_detected::INT
        + data_quality_issue_detected::INT WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END
        AS severity FROM report)""",
]
_EXACT = {
    "batch_name", "rows", "prediction_drift_detected", "most_drifted_feature", "feature_drift_detected",
    "duplicate_rows", "data_quality_issue_detected", "anomaly_detected",
}
ROUNDED_REPORT = ", ".join(f'"{c}"' if c in _EXACT else f'{r(chr(34) + c + chr(34))} AS "{c}"' for c in REPORT_COLUMNS)

WEIGHTS = {
    "login_velocity_24h": "0.04",
    "merchant_risk_score": "1.0",
    "ip_risk_score": "0.8",
    "device_trust_score": "-0.5",
    "amount": "0.000005",
}
PHI = "phi AS (" + "\n UNION ALL ".join(
    f"""SELECT transaction_id, batch_file_name, data_source, {literal(c)} AS feature,
        CAST({w} AS DOUBLE) * (coalesce({c}, CAST(0 AS DOUBLE)) - (SELECT avg(coalesce({c}, CAST(0 AS DOUBLE)))
          FROM transactions WHERE data_source = 'baseline')) AS phi FROM transactions"""
    for c, w in WEIGHTS.items()
) + ")"
IMPORTANCE = [
    PHI,
    """importance AS (SELECT batch_file_name, data_source, feature, avg(abs(phi)) AS m
        FROM phi GROUP BY 1, 2, 3)""",
    """comparison AS (SELECT b.batch_file_name, feature, a.m AS mean_abs_shap_baseline,
        b.m AS mean_abs_shap_drift_batch, b.m - a.m AS shap_impact_change
        FROM importance b JOIN importance a USING (feature)
        WHERE a.data_source = 'baseline' AND b.data_source <> 'baseline')""",
    f"""one AS (SELECT * EXCLUDE (batch_file_name) FROM comparison
        WHERE batch_file_name = {literal(EXPLAINED_BATCH)})""",
]
ROUNDED_COMPARISON = "feature, " + ", ".join(
    f"{r(c)} AS {c}" for c in ("mean_abs_shap_baseline", "mean_abs_shap_drift_batch", "shap_impact_change")
)

_TABLE = ("feature", "mean_abs_shap_baseline", "mean_abs_shap_drift_batch", "shap_impact_change")
_CELL = {c: "feature" if c == "feature" else f"format('{{:.6f}}', round({c}, 6))" for c in _TABLE}
RENDERED = [
    "cells_of_table AS (SELECT shap_impact_change AS change, "
    + ", ".join(f"{_CELL[c]} AS c{i}" for i, c in enumerate(_TABLE))
    + " FROM one ORDER BY change DESC, feature LIMIT 10)",
    "widths AS (SELECT "
    + ", ".join(f"CAST(greatest(max(length(c{i})), {len(c)}) AS INT) AS w{i}" for i, c in enumerate(_TABLE))
    + " FROM cells_of_table)",
    "body AS (SELECT change, c0, "
    + " || '  ' || ".join(f"lpad(c{i}, w{i}, ' ')" for i in range(4))
    + " AS line FROM cells_of_table, widths)",
    "rendered AS (SELECT (SELECT "
    + " || '  ' || ".join(f"lpad({literal(c)}, w{i}, ' ')" for i, c in enumerate(_TABLE))
    + " FROM widths) || chr(10) || string_agg(line, chr(10) ORDER BY change DESC, c0) AS top_changes FROM body)",
]


def template(wording: str, extra: dict[str, str]) -> str:
    """The wording with its fields as a SQL concatenation."""
    fields = dict(extra)
    for c in REPORT_DECIMALS:
        fields[c] = f"""format('{{:.4f}}', round("{c}", 4))"""
    for c in REPORT_FLAGS:
        fields[c] = f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    for c in ("batch_name", "severity", "rows", "most_drifted_feature", "duplicate_rows", "top_changes"):
        fields[c] = f'CAST("{c}" AS VARCHAR)'
    pieces = []
    for i, piece in enumerate(wording.replace("}", "{").split("{")):
        if piece:
            pieces.append(f"({fields[piece]})" if i % 2 else literal(piece))
    return " || ".join(pieces)


FINDINGS = (
    "coalesce(nullif(concat_ws('; ', "
    f"CASE WHEN prediction_drift_detected THEN {template(text.FINDING_PREDICTION, {})} END, "
    f"CASE WHEN feature_drift_detected THEN {template(text.FINDING_FEATURE, {})} END, "
    f"CASE WHEN data_quality_issue_detected THEN {template(text.FINDING_QUALITY, {})} END), ''), "
    f"{literal(text.FINDING_NONE)})"
)
INCIDENTS = [
    *REPORT,
    *IMPORTANCE,
    *RENDERED,
    f"""incidents AS (SELECT batch_name, severity,
        {template(text.INCIDENT_TEXT, {"findings": FINDINGS})} AS summary
        FROM severities, rendered WHERE anomaly_detected)""",
]

LOADED = """transaction_id, amount, ip_risk_score, CAST(transaction_hour AS DOUBLE) AS transaction_hour,
  channel, label_fraud"""

# Output names and digits of the risk profile's means.
MEANS = {
    "fraud_rate": ("label_fraud", 4),
    "avg_simulated_fraud_probability": (SCORE, 4),
    "avg_transaction_amount": ("amount", 2),
    "avg_login_velocity": ("login_velocity_24h", 2),
    "avg_device_trust_score": ("device_trust_score", 4),
    "avg_ip_risk_score": ("ip_risk_score", 4),
    "avg_merchant_risk_score": ("merchant_risk_score", 4),
}
RISK_PROFILE = (
    "SELECT batch_file_name, batch_type, count(*) AS total_transactions, "
    + ", ".join(f"round(sum({c})::DOUBLE / count({c}), {digits}) AS {name}" for name, (c, digits) in MEANS.items())
    + " FROM transactions GROUP BY ALL"
)

EVENTS = ks_ctes(
    """SELECT CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'first_week'
              ELSE strftime(ts, '%Y-%m-%d') END AS batch_name,
         ts < TIMESTAMP '2024-01-08' AS is_base, 'value' AS feature, 0 AS position, value FROM events"""
)

_FLAG = "CASE WHEN {0} THEN 'Detected' ELSE 'Not Detected' END"
_KPI = (
    "fraud_rate_actual", "avg_predicted_risk", "baseline_avg_risk", "accuracy", "roc_auc", "f1_score",
    "precision", "recall", "prediction_drift_score", "max_feature_drift_score",
)
_LOG_METRICS = (
    "accuracy", "roc_auc", "f1_score", "precision", "recall", "prediction_drift_score",
    "max_feature_drift_score", "missing_percentage", "duplicate_rows",
)

ORACLE = {
    "load_batch": sql(f"SELECT {LOADED} FROM transactions WHERE batch_file_name = 'batch_04_quality_issue.csv'"),
    "load_all_batches": sql(f"SELECT batch_file_name, {LOADED} FROM production"),
    "batch_shapes": sql(
        'SELECT batch_file_name, count(*) AS "rows", 19 AS "columns" FROM transactions GROUP BY 1'
    ),
    "transactions_table": sql(RISK_PROFILE),
    "report_roundtrip": sql(f"SELECT {ROUNDED_REPORT} FROM report", *REPORT),
    "attribution_roundtrip": sql(f"SELECT {ROUNDED_COMPARISON} FROM one", *IMPORTANCE),
    "metric_log": sql(
        " UNION ALL ".join(
            [
                f"""SELECT batch_name AS run_name, 'param' AS kind, {literal(c)} AS key,
                    CAST("{c}" AS VARCHAR) AS text_value, CAST(NULL AS DOUBLE) AS value FROM report"""
                for c in ("batch_name", "rows", "most_drifted_feature")
            ]
            + [
                f"""SELECT batch_name, 'metric', {literal(c)}, NULL, {r(f'CAST("{c}" AS DOUBLE)')} FROM report"""
                for c in _LOG_METRICS
            ]
        ),
        *REPORT,
    ),
    "incident_files": sql(
        "SELECT replace(batch_name, '.csv', '') || '_incident_summary.txt' AS incident, summary FROM incidents",
        *INCIDENTS,
    ),
    "transactions": sql(
        "SELECT * REPLACE (strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp) FROM transactions"
    ),
    "union_sources": sql(
        """SELECT data_source, batch_file_name, count(*) AS total_rows,
           count(CASE WHEN data_source = 'baseline' THEN ip_risk_score END) AS with_ip_risk_score
           FROM transactions GROUP BY 1, 2"""
    ),
    "feature_projection": sql(
        f"SELECT {', '.join(NUMERIC_FEATURES)}, {', '.join(CATEGORICAL_FEATURES)} FROM transactions"
    ),
    "high_risk": sql(
        f"""SELECT transaction_id, batch_file_name, {SCORE} FROM transactions
            WHERE {SCORE} >= CAST(0.30 AS DOUBLE)"""
    ),
    "scored": sql(
        "SELECT *, CAST(score >= CAST(0.30 AS DOUBLE) AS INT) AS predicted_label FROM s",
        "s AS (SELECT transaction_id, batch_file_name, round(1 / (1 + exp(-(CAST(-4 AS DOUBLE) + "
        + " + ".join(f"CAST({w} AS DOUBLE) * coalesce({c}, CAST(0 AS DOUBLE))" for c, w in WEIGHTS.items())
        + "))), 5) AS score FROM transactions)",
    ),
    "volume_by_source": sql("SELECT data_source, count(*) AS total_rows FROM transactions GROUP BY 1"),
    "risk_profile": sql(RISK_PROFILE),
    "missing_by_batch": sql(
        "SELECT batch_file_name, "
        + ", ".join(
            f"count(*) - count({c}) AS missing_{c.removesuffix('_24h')}"
            for c in ("amount", "login_velocity_24h", "device_trust_score", "ip_risk_score", "merchant_risk_score")
        )
        + " FROM transactions GROUP BY ALL"
    ),
    "high_risk_by_batch": sql(
        """SELECT * FROM per_batch WHERE high_risk_transactions > 0""",
        f"""per_batch AS (SELECT batch_file_name,
             count(*) FILTER (high) AS high_risk_transactions,
             round(sum(risk) FILTER (high) / count(*) FILTER (high), 4) AS avg_simulated_risk
             FROM (SELECT batch_file_name, {SCORE} AS risk, {SCORE} >= 0.3::DOUBLE AS high FROM transactions)
             GROUP BY batch_file_name)""",
    ),
    "validation_sql": sql(
        """SELECT t.data_source, t.channel, count(*) AS payments,
           count(*) FILTER (t.amount >= m.mean) AS large_payments,
           round(sum(t.amount) FILTER (t.amount >= m.mean) / sum(t.amount), 6) AS large_share
           FROM transactions t JOIN means m
           ON t.data_source = m.data_source AND t.channel IS NOT DISTINCT FROM m.channel
           WHERE t.amount IS NOT NULL GROUP BY 1, 2""",
        "means AS (SELECT data_source, channel, avg(amount) AS mean FROM transactions GROUP BY 1, 2)",
    ),
    "data_quality": sql(
        f"""SELECT batch_file_name, {r('missing_percentage', 8)} AS missing_percentage, duplicate_rows,
            data_quality_issue_detected FROM quality""",
        *QUALITY,
    ),
    "missing_share": sql(
        f"SELECT batch_file_name, {r(f'sum({_MISSING}) / (count(*) * 19)::DOUBLE', 8)} AS missing_percentage "
        "FROM transactions GROUP BY 1"
    ),
    "confusion": sql("SELECT * FROM confusion", CONFUSION),
    "confusion_table": sql(
        """SELECT batch_file_name, 'Actual_0' AS actual, tn AS Predicted_0, fp AS Predicted_1 FROM confusion
           UNION ALL SELECT batch_file_name, 'Actual_1', fn, tp FROM confusion""",
        CONFUSION,
    ),
    "classification_metrics": sql(
        f"SELECT batch_file_name, tp, fp, fn, tn, {ROUNDED_METRICS} FROM metrics", CONFUSION, METRICS
    ),
    "roc_auc": sql(f"SELECT k AS batch_file_name, {r('roc_auc', 9)} AS roc_auc FROM auc", *AUC),
    "class_balance": sql(
        f"""SELECT count(*) FILTER (label_fraud = 0) AS negative_count,
            count(*) FILTER (label_fraud = 1) AS positive_count,
            {r('count(*) FILTER (label_fraud = 0) / (count(*) FILTER (label_fraud = 1))::DOUBLE')} AS scale_pos_weight
            FROM transactions WHERE data_source = 'baseline'"""
    ),
    "feature_drift": sql(f"SELECT batch_name, feature, {r('ks', 9)} AS ks FROM ks", *KS),
    "feature_drift_flag": sql(
        f"""SELECT batch_name, {r('max_feature_drift_score', 9)} AS max_feature_drift_score,
            most_drifted_feature, feature_drift_detected FROM flagged""",
        *KS,
        FLAGGED,
    ),
    "prediction_drift": sql(
        f"""SELECT batch_name, {r('avg_predicted_risk')} AS avg_predicted_risk,
            {r('baseline_avg_risk')} AS baseline_avg_risk,
            {r('abs(avg_predicted_risk - baseline_avg_risk)')} AS prediction_drift_score,
            abs(avg_predicted_risk - baseline_avg_risk) >= CAST(0.05 AS DOUBLE) AS prediction_drift_detected
            FROM drift""",
        DRIFT,
    ),
    "monitoring_report": sql(f"SELECT {ROUNDED_REPORT} FROM report", *REPORT),
    "event_value_drift": "WITH "
    + ", ".join(EVENTS)
    + f" SELECT batch_name, feature, {r('ks', 9)} AS ks FROM ks",
    "document_duplicates": "SELECT source, count(*) - count(DISTINCT text) AS duplicate_rows FROM documents GROUP BY 1",
    "label_performance": "WITH "
    + ", ".join(
        [
            """judged AS (SELECT lang, toxic, round(1 / (1 + n_chars / CAST(2000 AS DOUBLE)), 6) AS score
               FROM documents JOIN labels USING (doc_id))""",
            counts_cte("judged", "lang", "score", "toxic", "0.5"),
            f"metrics AS ({metrics_select('lang')})",
            *auc_ctes("judged", "lang", "score", "toxic"),
            """sizes AS (SELECT lang, count(*) AS n, avg(toxic) AS rate, avg(score) AS mean FROM judged GROUP BY 1)""",
        ]
    )
    + f""" SELECT lang, n AS "rows", {r('rate')} AS fraud_rate_actual, {r('mean')} AS avg_predicted_risk,
           tp, fp, fn, tn, {r('roc_auc')} AS roc_auc, {ROUNDED_METRICS}
           FROM sizes JOIN metrics USING (lang) JOIN auc ON k = lang""",
    "risk_long": sql(
        " UNION ALL ".join(
            f"SELECT batch_name, '{c}' AS risk_type, {r(c)} AS risk_value FROM drift"
            for c in ("avg_predicted_risk", "baseline_avg_risk")
        ),
        DRIFT,
    ),
    "performance_long": sql(
        " UNION ALL ".join(
            f"""SELECT batch_name, '{c}' AS metric, {r(f'"{c}"')} AS value FROM report"""
            for c in ("accuracy", "roc_auc", "f1_score", "precision", "recall")
        ),
        *REPORT,
    ),
    "selected_batch": sql(
        f"SELECT {ROUNDED_REPORT} FROM report WHERE batch_name = 'batch_03_prediction_drift.csv'", *REPORT
    ),
    "kpi_cards": sql(
        'SELECT batch_name, "rows", '
        + ", ".join(f'round("{c}", 4) AS "{c}"' for c in _KPI)
        + ", round(missing_percentage * 100, 2) AS missing_value_percent, duplicate_rows FROM report",
        *REPORT,
    ),
    "flag_labels": sql(
        "SELECT batch_name, "
        + ", ".join(f"{_FLAG.format(c)} AS {c}" for c in REPORT_FLAGS)
        + ", CASE WHEN anomaly_detected THEN 'Anomaly Detected' ELSE 'Normal Batch' END AS status FROM report",
        *REPORT,
    ),
    "status": sql(
        """SELECT batch_name, CASE WHEN anomaly_detected THEN 'Anomaly Detected' ELSE 'Normal Batch' END AS status
           FROM report""",
        *REPORT,
    ),
    "severity": sql("SELECT batch_name, severity FROM severities", *REPORT),
    "overview": sql(
        """SELECT count(*) AS total_batches, count(*) FILTER (NOT anomaly_detected) AS normal_batches,
           count(*) FILTER (anomaly_detected) AS anomalous_batches,
           round(max(max_feature_drift_score), 4) AS highest_drift_score FROM report""",
        *REPORT,
    ),
    "anomalous": sql(
        """SELECT replace(batch_name, '.csv', '') AS batch, most_drifted_feature FROM report
           WHERE anomaly_detected""",
        *REPORT,
    ),
    "linear_attribution": sql(
        f"""SELECT transaction_id, batch_file_name, feature, {r('phi')} AS phi FROM phi
            WHERE data_source <> 'baseline'""",
        PHI,
    ),
    "mean_abs_attribution": sql(
        f"SELECT batch_file_name, feature, {r('m')} AS mean_abs_shap FROM importance", *IMPORTANCE
    ),
    "attribution_rank": sql(
        f"""SELECT feature, {r('m')} AS mean_abs_shap FROM importance WHERE data_source = 'baseline'
            ORDER BY m DESC, feature""",
        *IMPORTANCE,
    ),
    "attribution_compare": sql(f"SELECT batch_file_name, {ROUNDED_COMPARISON} FROM comparison", *IMPORTANCE),
    "top_changes": sql(
        f"SELECT {ROUNDED_COMPARISON} FROM (SELECT * FROM one ORDER BY shap_impact_change DESC, feature LIMIT 3)",
        *IMPORTANCE,
    ),
    "top_changes_text": sql("SELECT top_changes FROM rendered", *IMPORTANCE, *RENDERED),
    "incidents": sql("SELECT batch_name, severity, summary FROM incidents", *INCIDENTS),
    "incident_prompt": sql(
        f"SELECT batch_name, {template(text.PROMPT_TEXT, {})} AS prompt "
        "FROM severities, rendered WHERE anomaly_detected",
        *INCIDENTS,
    ),
    "incident_lookup": sql(
        """SELECT batch_name, i.severity, i.summary FROM report LEFT JOIN incidents i USING (batch_name)""",
        *INCIDENTS,
    ),
    "sample_sizes": sql(
        "SELECT batch_file_name, least(count(*), 500) AS sampled FROM transactions GROUP BY 1"
    ),
    "split_sizes": sql(
        """SELECT 'test' AS split, label_fraud, CAST(quota AS BIGINT) AS total_rows FROM quotas
           UNION ALL SELECT 'train', label_fraud, CAST(size - quota AS BIGINT) FROM quotas""",
        """sizes AS (SELECT label_fraud, count(*) AS size FROM transactions
             WHERE data_source = 'baseline' GROUP BY 1)""",
        """shares AS (SELECT *, size * ceil(0.25 * (SELECT sum(size) FROM sizes))
             / (SELECT sum(size) FROM sizes)::DOUBLE AS share FROM sizes)""",
        """quotas AS (SELECT label_fraud, size, floor(share) + CASE WHEN row_number() OVER
             (ORDER BY share - floor(share) DESC, label_fraud)
             <= ceil(0.25 * (SELECT sum(size) FROM sizes)) - (SELECT sum(floor(share)) FROM shares)
             THEN 1 ELSE 0 END AS quota FROM shares)""",
    ),
    "one_hot": sql(
        " UNION ALL ".join(
            f"""SELECT batch_file_name, '{c}_' || {c} AS feature, count(*) AS total_rows FROM transactions
                WHERE {c} IN (SELECT {c} FROM transactions WHERE data_source = 'baseline') GROUP BY 1, 2"""
            for c in CATEGORICAL_FEATURES
        )
    ),
}
_CUT = "(SELECT {f}({c}) FROM transactions)"
_BIN = " + ".join(
    f"(({_CUT.format(f='min', c='{c}')} + ({_CUT.format(f='max', c='{c}')} - {_CUT.format(f='min', c='{c}')}) * {k} / 8::DOUBLE) < {{c}})::INT"
    for k in range(1, 8)
)
SPLITS = [
    """weighted AS (SELECT *, CASE WHEN label_fraud = 1 THEN (SELECT count(*) FILTER (label_fraud = 0)
         / count(*) FILTER (label_fraud = 1)::DOUBLE FROM transactions) ELSE 1 END AS w FROM transactions)""",
    """sloped AS (SELECT *, round(w * (0.5::DOUBLE - label_fraud) * 1048576)::BIGINT AS g,
         round(w * 0.5::DOUBLE * 0.5::DOUBLE * 1048576)::BIGINT AS h FROM weighted)""",
    "entries AS ("
    + " UNION ALL ".join(
        [
            f"SELECT {i} AS place, '{c}' AS feature, CASE WHEN {c} IS NULL THEN -1 ELSE {_BIN.format(c=c)} END AS bin, NULL::VARCHAR AS category, g, h FROM sloped"
            for i, c in enumerate(NUMERIC_FEATURES)
        ]
        + [
            f"SELECT {i + len(NUMERIC_FEATURES)}, '{c}', 0, {c}, g, h FROM sloped" for i, c in enumerate(CATEGORICAL_FEATURES)
        ]
    )
    + ")",
    """bars AS (SELECT place, feature, bin::INT AS bin, category, count(*) AS n, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h
         FROM entries GROUP BY place, feature, bin, category)""",
]
ORACLE["split_histogram"] = sql("SELECT feature, bin, category, n, g, h FROM bars", *SPLITS)
_PART = "({0} / 1048576::DOUBLE) * ({0} / 1048576::DOUBLE) / ({1} / 1048576::DOUBLE + 1)"
ORACLE["root_split"] = sql(
    f"""SELECT feature, bin, category, missing_left, round({_PART.format('left_g', 'left_h')}
          + {_PART.format('(g - left_g)', '(h - left_h)')} - {_PART.format('g', 'h')}, 4) AS gain, left_g, left_h, g, h
        FROM tried WHERE left_h >= 1048576 AND h - left_h >= 1048576
        ORDER BY gain DESC, place, bin, category NULLS FIRST, missing_left = (left_h >= h - left_h) DESC LIMIT 1""",
    *SPLITS,
    "whole AS (SELECT sum(g)::BIGINT AS g, sum(h)::BIGINT AS h FROM sloped)",
    """tried AS (SELECT b.place, b.feature, b.bin, b.category, missing_left,
         (SELECT coalesce(sum(o.g), 0) FROM bars o WHERE o.place = b.place AND (b.category IS NULL AND (o.bin BETWEEN 0 AND b.bin
           OR o.bin = -1 AND missing_left) OR b.category IS NOT NULL AND o.category IS DISTINCT FROM b.category))::BIGINT AS left_g,
         (SELECT coalesce(sum(o.h), 0) FROM bars o WHERE o.place = b.place AND (b.category IS NULL AND (o.bin BETWEEN 0 AND b.bin
           OR o.bin = -1 AND missing_left) OR b.category IS NOT NULL AND o.category IS DISTINCT FROM b.category))::BIGINT AS left_h,
         whole.g, whole.h
       FROM bars b, whole, (VALUES (true), (false)) AS d(missing_left)
       WHERE b.bin >= 0 AND (b.category IS NULL OR NOT missing_left))""",
)
ORACLE["explained_amounts"] = sql(
    " UNION ALL ".join(
        f"SELECT batch_file_name, '{c}' AS feature, count(*) AS total_rows, round(sum({c})::DOUBLE, 2) AS sum_value FROM transactions GROUP BY 1"
        for c in NUMERIC_FEATURES
        if c != "ip_risk_score"
    )
)
_SHORT = "batch_file_name >= 'batch_03'"
ORACLE["mixed_headers"] = sql(
    f"SELECT batch_file_name, * EXCLUDE (batch_file_name) REPLACE (CASE WHEN {_SHORT} THEN NULL ELSE ip_risk_score END AS ip_risk_score) "
    f"FROM (SELECT batch_file_name, {LOADED} FROM production)"
)
ORACLE["mixed_shapes"] = sql(
    f"""SELECT batch_file_name, count(*) AS "rows", CASE WHEN {_SHORT} THEN {len(SHORT_HEADER)} ELSE 19 END AS "columns" FROM production GROUP BY 1"""
)
_LISTED = ", ".join(map(literal, ORIGINAL))
ORACLE["column_listing"] = sql(
    f"""SELECT batch_file_name, (unnest(range(len(names))))::INT AS position, unnest(names) AS column_name FROM (
          SELECT DISTINCT batch_file_name, CASE WHEN {_SHORT} THEN [{", ".join(literal(c) for c in SHORT_HEADER)}] ELSE [{_LISTED}] END AS names FROM production)"""
)
ORACLE["snapshot_table"] = ORACLE["transactions_table"]
ORACLE["run_log"] = ORACLE["metric_log"]
ORACLE["sample_total"] = sql("SELECT least(count(*), 500) AS sampled FROM transactions")
ORACLE["category_dictionary"] = sql(
    "SELECT column_name, value, dense_rank() OVER (PARTITION BY place ORDER BY value) - 1 AS number, "
    "dense_rank() OVER (ORDER BY place, value) - 1 AS slot, column_name || '_' || value AS feature FROM seen",
    "seen AS ("
    + " UNION ".join(
        f"SELECT {i} AS place, '{c}' AS column_name, {c} AS value FROM transactions WHERE data_source = 'baseline' AND {c} IS NOT NULL"
        for i, c in enumerate(CATEGORICAL_FEATURES)
    )
    + ")",
)
_OWN = [
    "own_ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_file_name ORDER BY shap_impact_change DESC, feature) AS place FROM comparison)",
    "own_cells AS (SELECT batch_file_name, place, " + ", ".join(f"{_CELL[c]} AS c{i}" for i, c in enumerate(_TABLE)) + " FROM own_ranked WHERE place <= 10)",
    "own_widths AS (SELECT batch_file_name, "
    + ", ".join(f"CAST(greatest(max(length(c{i})), {len(c)}) AS INT) AS w{i}" for i, c in enumerate(_TABLE))
    + " FROM own_cells GROUP BY 1)",
    "own_tables AS (SELECT batch_file_name AS batch_name, any_value("
    + " || '  ' || ".join(f"lpad({literal(c)}, w{i}, ' ')" for i, c in enumerate(_TABLE))
    + ") || chr(10) || string_agg("
    + " || '  ' || ".join(f"lpad(c{i}, w{i}, ' ')" for i in range(4))
    + ", chr(10) ORDER BY place) AS top_changes FROM own_cells JOIN own_widths USING (batch_file_name) GROUP BY 1)",
]
ORACLE["batch_incidents"] = sql(
    f"""SELECT batch_name, severity, {template(text.INCIDENT_TEXT, {"findings": FINDINGS})} AS summary
        FROM severities JOIN own_tables USING (batch_name) WHERE anomaly_detected""",
    *REPORT,
    *IMPORTANCE,
    *_OWN,
)
ORACLE["feature_drift_ranges"] = ORACLE["feature_drift"]
ORACLE["roc_auc_ranges"] = ORACLE["roc_auc"]
ORACLE["profile_report"] = ORACLE["monitoring_report"]
ORACLE["stream_report"] = ORACLE["monitoring_report"]
ORACLE["split_rows"] = sql(
    "SELECT transaction_id, amount, label_fraud FROM transactions WHERE data_source = 'baseline'"
)
ORACLE["gbt_report_facts"] = sql(
    f"""SELECT batch_name, "rows", {r('fraud_rate_actual')} AS fraud_rate_actual,
        {r('max_feature_drift_score')} AS max_feature_drift_score, most_drifted_feature,
        {r('missing_percentage')} AS missing_percentage, duplicate_rows FROM report""",
    *REPORT,
)
ORACLE["shap_additivity"] = sql(
    """SELECT batch_file_name, count(*) AS total_rows, CAST(0 AS DOUBLE) AS largest_gap
       FROM transactions GROUP BY 1"""
)
ORACLE["shap_columns_additivity"] = ORACLE["shap_additivity"]
ORACLE["load_baseline"] = sql(f"SELECT {LOADED} FROM transactions WHERE data_source = 'baseline'")
ORACLE["feature_label"] = sql(
    "SELECT channel, label_fraud::DOUBLE AS label_fraud, count(*) AS total_rows FROM transactions GROUP BY ALL"
)
ORACLE["column_roles"] = sql(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{role}' AS role, count({c}) AS known FROM transactions"
        for role, names in (("categorical", CATEGORICAL_FEATURES), ("numeric", NUMERIC_FEATURES))
        for c in names
    )
)
ORACLE["encoded_features"] = sql(
    "SELECT batch_file_name, feature, round(total, 3) + 0::DOUBLE AS total, nonzero FROM cells",
    "batches AS (SELECT DISTINCT batch_file_name FROM transactions)",
    "cells AS ("
    + " UNION ALL ".join(
        [
            f"""SELECT b.batch_file_name, '{c}_' || v.{c} AS feature, count(t.{c})::DOUBLE AS total, count(t.{c}) AS nonzero
                FROM batches b CROSS JOIN (SELECT DISTINCT {c} FROM transactions WHERE data_source = 'baseline' AND {c} IS NOT NULL) v
                LEFT JOIN transactions t ON t.batch_file_name = b.batch_file_name AND t.{c} = v.{c} GROUP BY 1, 2"""
            for c in CATEGORICAL_FEATURES
        ]
        + [
            f"""SELECT batch_file_name, '{c}', sum(x)::DOUBLE, count(*) FILTER (x <> 0) FROM (SELECT batch_file_name, coalesce({c}::DOUBLE,
                (SELECT avg({c}) FROM transactions WHERE data_source = 'baseline')) AS x FROM transactions) GROUP BY 1"""
            for c in NUMERIC_FEATURES
        ]
    )
    + ")",
)
ORACLE["train_facts"] = sql(
    f"""SELECT 10 AS n_estimators, 4 AS max_depth, 0.05::DOUBLE AS learning_rate, 0.3::DOUBLE AS fraud_threshold,
        {r("sum(train) FILTER (label_fraud = 0) / sum(train) FILTER (label_fraud = 1)::DOUBLE")} AS scale_pos_weight,
        sum(train)::BIGINT AS train_rows, sum(test)::BIGINT AS test_rows,
        {literal(", ".join(CATEGORICAL_FEATURES))} AS categorical_features, {literal(", ".join(NUMERIC_FEATURES))} AS numeric_features,
        sum(test) FILTER (label_fraud = 1)::BIGINT AS test_positives, sum(test) FILTER (label_fraud = 0)::BIGINT AS test_negatives
        FROM parts""",
    f"""parts AS (SELECT label_fraud, coalesce(sum(total_rows) FILTER (split = 'test'), 0) AS test,
        coalesce(sum(total_rows) FILTER (split = 'train'), 0) AS train FROM ({ORACLE["split_sizes"]}) GROUP BY 1)""",
)
ORACLE["model_roundtrip"] = sql(
    "SELECT batch_file_name, count(*) AS total_rows, 0::BIGINT AS changed FROM transactions GROUP BY 1"
)
