"""A text of a backslash and an N is text, not NULL."""

from revspan.sources import tables as io
from revspan.sources.schemas import TABLES


def test_backslash_n_is_kept_as_text(spark, tmp_path):
    spec = TABLES["churn_events"]
    rows = [("1", "a", None, r"\N", None, None, None, None, r"\N"), ("2", "a", None, "", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, spec.schema)
    io.write_csv(frame, str(tmp_path / "csv"))
    got = {r.churn_event_id: r for r in io.read_table_csv(spark, str(tmp_path / "csv"), spec).collect()}
    assert (got["1"].reason_code, got["1"].feedback_text) == (r"\N", r"\N")
    assert (got["2"].reason_code, got["2"].feedback_text) == ("", None)
