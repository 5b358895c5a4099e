"""From a table and the texts written about it to checked reports, in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.claims import annotate, extract_claims, verification_summary, verify_claims
from ..operators.dataset import Profile, profile
from ..operators.sections import choose_report
from ..session import settle
from ..sources.files import write_report
from .lines import context_chunks
from .report import statistical_report


@dataclass(frozen=True)
class Checked:
    """Reports of all datasets of a profile, and what their claims came to."""

    reports: DataFrame  # dataset, markdown, generated
    claims: DataFrame  # dataset, claim_no, type, ..., verified, actual_value, discrepancy, column_name
    summary: DataFrame  # dataset, claims, failures, success_pct, warning; datasets without claims have no row


def contexts(df: DataFrame, dataset: str = "data", by: Sequence[str] = (), template: str = "{statistics}") -> tuple[Profile, DataFrame]:
    """The profile of a table and (dataset, chunk, context, ...), what a writer of texts needs to know."""
    p = profile(df, dataset, by)
    return p, context_chunks(p.dataset, p.columns, template)


def checked_reports(p: Profile, texts: DataFrame, title: str, at: Column, path: str | None = None) -> Checked:
    """Texts (dataset, chunk, text) to one report per dataset: merged, checked claim by claim, annotated, written to ``path``.

    A dataset without a usable text gets its statistical report. Claims are checked against the
    profile of the dataset they are about; notes on those that fail follow the text.
    """
    statistics = statistical_report(p.dataset, p.columns, title, at).withColumnRenamed("markdown", "report")
    chosen = settle(choose_report(texts, statistics, title, at, "dataset"))
    found = extract_claims(chosen, ["dataset"], "report")
    verified = settle(verify_claims(found, p.dataset, p.columns))
    noted = annotate(chosen, verified, "dataset", "report").withColumnRenamed("report", "markdown")
    reports = noted.join(chosen.select("dataset", "generated"), "dataset")
    if path is not None:
        write_report(reports, path)
    return Checked(reports, verified, verification_summary(verified, ["dataset"]))
