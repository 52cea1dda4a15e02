"""Text columns: names, fixed-point numbers, flags, severity and incident wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schema import REPORT_DECIMALS, REPORT_FLAGS


def clean_batch_name(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(name, F.lit(".csv"), F.lit(""))


def clean_feature_name(name: str | Column) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.replace(F.replace(name, F.lit("cat__"), F.lit("")), F.lit("num__"), F.lit(""))


def fixed(column: str | Column, digits: int = 4) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.format_string(f"%.{digits}f", column)


def flag_label(flag: str | Column) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.when(flag, F.lit("Detected")).otherwise(F.lit("Not Detected"))


def status_label(anomaly: str | Column) -> Column:
    anomaly = F.col(anomaly) if isinstance(anomaly, str) else anomaly
    return F.when(anomaly, F.lit("Anomaly Detected")).otherwise(F.lit("Normal Batch"))


ISSUE_FLAGS = REPORT_FLAGS[:-1]


def severity() -> Column:
    """High for two or more raised flags, Medium for one, Low for none."""
    raised = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ISSUE_FLAGS), F.lit(0))
    return F.when(raised >= 2, F.lit("High")).when(raised == 1, F.lit("Medium")).otherwise(F.lit("Low"))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """Concatenate the template's literal pieces with the columns named in braces."""
    pieces: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            pieces.append(fields[piece] if i % 2 else F.lit(piece))
    return F.concat(*pieces)


# Wording of the findings.
FINDING_PREDICTION = "prediction drift detected with score {prediction_drift_score}"
FINDING_FEATURE = "feature drift detected, strongest in {most_drifted_feature}"
FINDING_QUALITY = (
    "data quality issue detected with {missing_percentage} missing percentage "
    "and {duplicate_rows} duplicate rows"
)
FINDING_NONE = "no major monitoring issue detected"

# The incident text.
INCIDENT_TEXT = """\
Incident Summary:
Batch {batch_name} was flagged with {severity} severity. The monitoring checks found {findings}.

Root Cause Hypothesis:
The batch may differ from the baseline production pattern due to changes in transaction behavior, \
risk-score movement, feature distribution shift, or data quality issues. \
The most drifted feature was {most_drifted_feature}.

Impacted Features:
Primary monitored feature impact: {most_drifted_feature}.
Top SHAP impact changes:
{top_changes}

Business / Model Risk:
The model may produce less stable fraud-risk predictions on this batch compared with the baseline. \
Current batch performance was ROC-AUC {roc_auc}, F1-score {f1_score}, precision {precision}, \
and recall {recall}.

Recommended Action:
Review the drifted feature distributions, validate missing and duplicate records, compare batch \
predictions with known fraud patterns, and monitor whether the same issue repeats in future batches.

Retraining Recommendation:
Retraining is recommended if similar drift or performance degradation continues across future \
batches. If the issue is caused by data quality, fix upstream data validation before retraining."""

# The prompt text.
PROMPT_TEXT = """
You are an ML monitoring analyst.

Create a concise incident summary for the following production batch.

Batch Name:
{batch_name}

Severity:
{severity}

Monitoring Results:
- Rows: {rows}
- Actual fraud rate: {fraud_rate_actual}
- Average predicted risk: {avg_predicted_risk}
- Baseline average risk: {baseline_avg_risk}
- Prediction drift score: {prediction_drift_score}
- Prediction drift detected: {prediction_drift_detected}
- Max feature drift score: {max_feature_drift_score}
- Most drifted feature: {most_drifted_feature}
- Feature drift detected: {feature_drift_detected}
- Missing percentage: {missing_percentage}
- Duplicate rows: {duplicate_rows}
- Data quality issue detected: {data_quality_issue_detected}
- Anomaly detected: {anomaly_detected}

Model Performance:
- Accuracy: {accuracy}
- ROC-AUC: {roc_auc}
- F1-score: {f1_score}
- Precision: {precision}
- Recall: {recall}

Top SHAP Impact Changes:
{top_changes}

Write the output in this exact structure:

Incident Summary:
Root Cause Hypothesis:
Impacted Features:
Business / Model Risk:
Recommended Action:
Retraining Recommendation:
"""

def report_fields() -> dict[str, Column]:
    """Report columns as text: four decimals, True/False flags, plain counts and names.

    A value that is undefined (ROC-AUC of a one-class batch) reads "nan".
    """
    decimals = {c: F.coalesce(fixed(c), F.lit("nan")) for c in REPORT_DECIMALS}
    flags = {c: F.when(F.col(c), F.lit("True")).otherwise(F.lit("False")) for c in REPORT_FLAGS}
    plain = {
        c: F.col(c).cast("string")
        for c in ("batch_name", "severity", "rows", "most_drifted_feature", "duplicate_rows", "top_changes")
    }
    return {**decimals, **flags, **plain}


def findings() -> Column:
    """The raised issues joined by "; ", or the default wording when there are none."""
    fields = report_fields()
    raised = F.concat_ws(
        "; ",
        F.when(F.col("prediction_drift_detected"), filled(FINDING_PREDICTION, fields)),
        F.when(F.col("feature_drift_detected"), filled(FINDING_FEATURE, fields)),
        F.when(F.col("data_quality_issue_detected"), filled(FINDING_QUALITY, fields)),
    )
    return F.when(raised == "", F.lit(FINDING_NONE)).otherwise(raised)


def incident_text() -> Column:
    return filled(INCIDENT_TEXT, {**report_fields(), "findings": findings()})


def incident_prompt() -> Column:
    return filled(PROMPT_TEXT, report_fields())
