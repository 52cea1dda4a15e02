"""Incident texts and the attribution changes they quote."""

from pyspark.sql import functions as F

from tidewatch.catalog import queries
from tidewatch.plans.incident import incident_lookup, incidents
from tidewatch.schema import BATCH_COLUMN


def test_every_incident_quotes_its_own_batch(spark, sf_dir, tmp_path):
    queries.report(spark, sf_dir).write.parquet(str(tmp_path / "report"))
    queries.comparison(spark, sf_dir).write.parquet(str(tmp_path / "changes"))
    report, changes = (spark.read.parquet(str(tmp_path / name)) for name in ("report", "changes"))
    got = {r.batch_name: r.summary for r in incidents(report, changes).collect()}
    assert len(got) > 1 and len({t.split("feature ", 1)[-1] for t in got.values()}) > 1
    for name, text in got.items():
        one = changes.where(F.col(BATCH_COLUMN) == name).drop(BATCH_COLUMN)
        assert text == incidents(report, one).where(F.col("batch_name") == name).first().summary
    # A batch without changes still has its incident, and no row is lost or repeated.
    less = changes.where(F.col(BATCH_COLUMN) != min(got))
    assert {r.batch_name for r in incidents(report, less).where("summary IS NOT NULL").collect()} == set(got)
    assert incident_lookup(report, changes).count() == report.count()
