"""CSV in, reports out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators.columns import profile_columns
from plumbline.operators.dataset import profile
from plumbline.plans.lines import chunk_columns, context_chunks
from plumbline.plans.report import statistical_report
from plumbline.sources.files import NULL_TOKENS, read_csv, report_path, write_report


@pytest.fixture()
def people(tmp_path):
    """Twenty people, four of them without an address."""
    path = tmp_path / "people.csv"
    lines = ["customer_id,name,age,email,salary,join_date,department"]
    for i in range(1, 21):
        mail = "" if i in (2, 6, 10, 16) else f"p{i}@example.com"
        lines.append(f'{i},"Person, {i}",{25 + i},{mail},{40000 + 100 * (i % 17)},2022-01-{i:02d},{"ABCD"[i % 4]}')
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_profile(spark, people):
    df = read_csv(spark, people)
    assert dict(df.dtypes)["customer_id"] == "bigint" and dict(df.dtypes)["join_date"] == "string"
    got = {r.name: r for r in profile_columns(df).collect()}
    assert got["email"].non_null_pct == 80.0 and "high_missing" not in got["email"].quality_issues
    assert (got["name"].inferred_type, got["name"].quality_issues) == ("categorical", ["likely_id"])
    assert (got["join_date"].inferred_type, got["join_date"].coverage_days) == ("datetime", 19)


def test_null_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("k,x\n" + "".join(f"{i},{t}\n" for i, t in enumerate((*NULL_TOKENS, "7"))))
    df = read_csv(spark, str(path))
    assert dict(df.dtypes)["x"] == "bigint"
    assert df.where("x IS NULL").count() == len(NULL_TOKENS)


def test_report_sink(spark, people, tmp_path):
    p = profile(read_csv(spark, people), "people")
    at = F.lit(dt.datetime(2024, 5, 6, 7, 8)).cast("timestamp")
    report = statistical_report(p.dataset, p.columns, "Data Quality Report", at)
    out = str(tmp_path / report_path("data/people.csv"))
    write_report(report, out)
    assert out.endswith("people_report.md")
    back = "\n".join(r.value for r in spark.read.text(f"{out}/dataset=people").collect())
    assert back.startswith("# Data Quality Report\n\n*Generated on 06 May 2024 at 07:08")
    assert "- **email** (categorical): 20.0% empty" in back
    assert "1. Fill or explain the gaps in: email" in back


def test_chunks_and_limit(spark, people):
    p = profile(read_csv(spark, people).drop("name", "email"), "people")
    sizes = chunk_columns(p.columns, 3).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r.chunk, r["count"]) for r in sizes] == [(1, 3), (2, 2)]
    c = context_chunks(p.dataset, p.columns, "Look:\n{statistics}\nDone", size=3, limit=10).orderBy("chunk").collect()
    assert len(c) == 2 and all(r.over_limit and r.tokens == len(r.context) // 4 for r in c)
    assert c[0].context.startswith("Look:\nDataset Overview:\n• 20 rows and 5 columns")


def test_context_of_an_empty_table(spark):
    p = profile(spark.createDataFrame([], "a int"), "none")
    r = context_chunks(p.dataset, p.columns).first()
    assert (r.chunk, r.context.split("\n")[1]) == (1, "• 0 rows and 0 columns")
