"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plumbline.operators import claims, columns, correlation, dataset, distribution, frequency, selection  # noqa: E402
from plumbline.operators.textquality import low_quality  # noqa: E402
from plumbline.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="plumbline-bench")
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lineitem, events, documents, orders = map(table, ("lineitem", "events", "documents", "orders"))

    # A claim before every line of every fourth document.
    lead = F.concat(F.lit("\nRange: 1.5 to "), F.col("n_chars").cast("string"), F.lit(", 7 outliers, "))
    claimed = documents.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.replace("text", F.lit("\n"), lead)).otherwise(F.col("text")))
    runs = {
        "profile_lineitem": lambda: columns.profile_columns(lineitem),
        "profile_by_returnflag": lambda: columns.profile_by(lineitem, ["l_returnflag"]),
        "profile_documents": lambda: columns.profile_columns(documents),
        "moments_lineitem": lambda: columns.numeric_moments(lineitem),
        "quartiles_lineitem": lambda: columns.quartiles(lineitem),
        "outliers_lineitem": lambda: columns.iqr_outliers(lineitem),
        "n_unique_events": lambda: frequency.n_unique(events),
        "top_values_events": lambda: frequency.top_values(events),
        "correlations_lineitem": lambda: correlation.correlations(lineitem),
        "duplicates_lineitem": lambda: dataset.duplicate_rows(lineitem),
        "missing_lineitem": lambda: dataset.missing_by_column(lineitem),
        "histogram_events": lambda: distribution.histogram(events, "value"),
        "sample_orders": lambda: selection.sample_rows(orders, 10_000, "o_orderkey"),
        "low_quality_documents": lambda: low_quality(documents),
        "claims_documents": lambda: claims.extract_claims(claimed),
    }
    # Start-up of the session and of the code generator is not part of any query.
    lineitem.agg(F.count(F.lit(1)), F.max("l_tax")).collect()
    seconds = {}
    for name, make in runs.items():
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
