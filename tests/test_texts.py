"""Text operators against plain Python on small fixtures."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from plumbline.functions.markdown import clean_markdown, collapse_lines, format_profiles, sections
from plumbline.functions.values import strip, words
from plumbline.operators import claims as V
from plumbline.operators import plaintext
from plumbline.operators import sections as X
from plumbline.operators.textquality import low_quality, low_quality_flags, repetitive
from plumbline.plans.checked import checked_reports, contexts


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id int, text string")


def brute_repetitive(text):
    w = text.split()
    if len(w) <= 10:
        return False
    return any(text.count(" ".join(w[i : i + 4])) > 2 for i in range(len(w) - 6))


def test_repetition_equals_counting_every_phrase(spark):
    rng = random.Random(7)
    made = []
    for n in range(400):
        pool = ["a", "ab", "b", "ba", "aa", "é"][: rng.randint(2, 6)]
        sep = [" "] * 8 + ["\n", "  ", " ", "\x1c"]
        made.append("".join(rng.choice(pool) + rng.choice(sep) for _ in range(rng.randint(5, 60))))
    made.append("the cat sat on x the cat sat once y bathe cat sat on z and more words follow here")
    got = {r.doc_id: r.x for r in texts(spark, made).select("doc_id", repetitive(F.col("text")).alias("x")).collect()}
    want = {i: brute_repetitive(t) for i, t in enumerate(made)}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_white_space_is_pythons(spark):
    odd = " \x1c\x85 a b　c ​\x0b"
    r = texts(spark, [odd]).select(words(F.col("text")).alias("w"), strip(F.col("text")).alias("s")).first()
    assert r.w == odd.split() and r.s == odd.strip()


def test_low_quality_reasons(spark):
    good = "The first part is long enough to read. The second says something else entirely. A third one closes the text well."
    values = [None, "", good, good + " Analysis FAILED here.", "# a\n# b\n# c\n# d\n# e\n# f" + " pad" * 30, "x" * 120]
    got = {r.doc_id: r for r in low_quality(texts(spark, values)).collect()}
    assert [got[i].is_low for i in range(6)] == [True, True, False, True, True, True]
    assert got[0].too_short and not got[0].few_sentences
    assert got[3].failure_phrase and got[4].mostly_headers and got[5].few_sentences


def python_clean(t):
    t = re.sub(r"\n\s*\n\s*\n", "\n\n", t).strip()
    return re.sub(r"(^#+.*$)\n([^#\n])", r"\1\n\n\2", t, flags=re.M)


def test_clean_markdown(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice(["#", "# h", "\n", "\n", " ", "x", "\t", "y z"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    got = {r.doc_id: r.x for r in texts(spark, made).select("doc_id", clean_markdown(F.col("text")).alias("x")).collect()}
    assert got == {i: python_clean(t) for i, t in enumerate(made)}


def test_sections(spark):
    text = "lead\n# A b\none\n\ntwo \n###  c\n# A b\nlast\n#\n#   \nlost"
    got = {(r.section, r.content) for r in X.extract_sections(texts(spark, [text])).collect()}
    assert got == {("a_b", "last\n#"), ("c", "")}


def test_merge_rules(spark):
    rows = [
        (1, 0, "dataset_overview", "first"), (1, 1, "dataset_overview", "second"), (1, 0, "column_profiles", "x"),
        (1, 2, "column_profiles", "y"), (1, 0, "data_quality_summary", "a\nb\n\na"), (1, 1, "data_quality_summary", "b\nc\n\nc"),
        (1, 2, "data_quality_summary", "c\nd"), (1, 0, "recommendations", " "), (1, 1, "recommendations", "r"), (1, 2, "recommendations", "s"),
    ]
    parts = spark.createDataFrame(rows, "doc_id int, chunk bigint, section string, content string")
    got = {r.section: r.content for r in X.merge_sections(parts).collect()}
    assert got == {
        "dataset_overview": "first",
        "column_profiles": "x\n\ny",
        "data_quality_summary": "a\nb\n\na\nc\nc\nd",
        "recommendations": "r",
    }


def test_chunks_without_sections_go_in_whole(spark):
    body = "The first part is long enough to read. The second says something else entirely. A third one closes the text well."
    rows = [(1, 0, body), (1, 1, body + "\n# Key Findings\n"), (2, 0, body), (2, 1, "# Key Findings\n" + body), (3, 0, "short")]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk bigint, text string")
    plain = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "doc_id int, report string")
    got = {r.doc_id: r for r in X.choose_report(chunks, plain, "T", F.lit("2024-01-02 03:04:00").cast("timestamp")).collect()}
    assert got[1].report.endswith(f"---\n\n## AI Analysis\n\n{body}\n\n{body}\n# Key Findings")
    assert got[2].report.endswith(f"---\n\n## Key Findings\n\n{body}")
    assert (got[3].report, got[3].generated) == ("s3", False)


def test_profile_blocks(spark):
    text = "lead\n### a\nfine\n### b\nmissing outlier. x\n### c\nrare"
    r = texts(spark, [text, "no blocks", "  "]).select(format_profiles(F.col("text")).alias("x")).collect()
    assert r[0].x == "### b\nmissing outlier\nb\nmissing outlier. x\n\n### c\nrare\nc\nrare\n\n### a\nfine\na\nfine"
    assert (r[1].x, r[2].x) == ("no blocks", "")


def test_collapse_lines(spark):
    long = "word " * 30
    text = f" {long}\n\n{long.strip()} \nResponse: b\n\nResponse: b\n"
    r = texts(spark, [text, "short"]).select(collapse_lines(F.col("text")).alias("x")).collect()
    assert r[0].x == f"{long.strip()}\n b"
    assert r[1].x.startswith("**Unable to generate detailed analysis.**")


def python_claims(t):
    out = []
    for kind, p in V.PATTERNS:
        rx = p.replace("(?U:[\\s\\x{1C}-\\x{1F}])", r"\s")
        for m in re.finditer(rx, t, re.I):
            s, e = m.span()
            a, b = max(0, s - 50), min(len(t), e + 50)
            context = t[a:s] + "**" + t[s:e] + "**" + t[e:b]
            nums = tuple(float(g.replace(",", "")) for g in m.groups()[: 2 if kind == "range" else 1])
            out.append((kind, m.group(0), s, e, context, nums))
    return out


def test_claims_equal_python(spark):
    rng = random.Random(5)
    bits = ["12", "1,234", "3.5", "%", " ", "\n", "missing", "Zero", "rows", "records", "range", "min", "MAX", ":", "to", "-", "days",
            "é😀", "outliers", "MB", "unique values", "columns", "average", "duplicated", "\u0001", "xxxxxxxxxx"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    got: dict[int, list] = {}
    for r in V.extract_claims(texts(spark, made)).orderBy("doc_id", "claim_no").collect():
        nums = (r.min_value, r.max_value) if r.type == "range" else (r.value,)
        got.setdefault(r.doc_id, []).append((r.type, r.text, r.start, r.end, r.context, nums))
    want = {i: python_claims(t) for i, t in enumerate(made)}
    assert got == {i: c for i, c in want.items() if c}


@pytest.fixture()
def facts(spark):
    dataset = spark.createDataFrame([("d", 1000, 5, 2.5, 5.0)], "dataset string, n_rows bigint, n_cols bigint, size_mb double, duplicate_rows_pct double")
    columns = spark.createDataFrame(
        [("d", 0, "employee_id", "numeric", 100.0, 0.0), ("d", 1, "email", "text", 80.0, None), ("d", 2, "salary", "numeric", 95.0, 2.0)],
        "dataset string, ordinal int, name string, inferred_type string, non_null_pct double, zeros_pct double",
    )
    return dataset, columns


@pytest.mark.parametrize(
    "text,verified,actual,discrepancy",
    [
        ("The table has 999 rows.", True, 1000.0, None),
        ("The table has 900 rows.", False, 1000.0, "10.0% difference"),
        ("5 columns in all", True, 5.0, None),
        ("4 columns in all", False, 5.0, "20.0% difference"),
        ("2.4 MB", True, 2.5, None),
        ("20% missing values in the email column", True, 20.0, None),
        ("21% missing values in email", True, 20.0, None),
        ("30% missing values in email", False, 20.0, "10.0 percentage points"),
        ("5% duplicate records", True, 5.0, None),
        ("2% zero values in salary", True, 2.0, None),
        ("80% non-null email", True, 80.0, None),
        ("20% missing values somewhere", False, None, None),
        ("25 outliers", False, None, None),
    ],
)
def test_verification(spark, facts, text, verified, actual, discrepancy):
    found = V.extract_claims(texts(spark, [text])).withColumn("dataset", F.lit("d"))
    r = V.verify_claims(found, *facts).first()
    assert (r.verified, r.actual_value, r.discrepancy) == (verified, actual, discrepancy)


def test_notes_and_summary(spark, facts):
    df = texts(spark, ["900 rows and 25 outliers", "1,000 rows", "no claim"]).withColumn("dataset", F.lit("d"))
    v = V.verify_claims(V.extract_claims(df, ("doc_id", "dataset")), *facts)
    out = {r.doc_id: r.text for r in V.annotate(df, v).collect()}
    assert out[1] == "1,000 rows" and out[2] == "no claim"
    assert out[0].startswith("900 rows and 25 outliers\n\n---\n\n## Verification Notes\n\n*The following")
    assert "1. ****900 rows** and 25 outliers**  \n   ⚠️ *Auto-corrected: actual value is 1000.0 (10.0% difference)*\n" in out[0]
    assert "\n2. **900 rows and **25 outliers****  \n   ⚠️ *Could not verify this claim against source data*\n" in out[0]
    s = V.verification_summary(v).first()
    assert (s.claims, s.failures, round(s.success_pct, 2), s.warning) == (3, 2, 33.33, True)
    assert V.verification_summary(v.where("false")).first().success_pct == 100.0


def test_from_table_to_checked_reports(spark, tmp_path):
    df = spark.createDataFrame([(s, i, float(i % 7)) for s in ("a", "b") for i in range(60)], "s string, k long, v double")
    p, told = contexts(df, by=["s"])
    assert {r.dataset for r in told.collect()} == {"a", "b"}
    body = " ".join(f"Point{k} speaks{k} of item{k} with thing{k}." for k in "abcdefgh")
    rows = [
        ("a", 1, f"# Dataset Overview\nIt has 60 rows and 9 columns. {body}"),
        ("a", 2, "cannot process"),
        ("b", 1, "cannot process"),
        ("c", 1, "cannot process"),
    ]
    texts = spark.createDataFrame(rows, "dataset string, chunk int, text string")
    at = F.lit("2024-05-06 07:08:00").cast("timestamp")
    out = checked_reports(p, texts, "Report", at, str(tmp_path / "out"))
    reports = {r.dataset: r for r in out.reports.collect()}
    assert {d: r.generated for d, r in reports.items()} == {"a": True, "b": False, "c": False}
    assert "Verification Notes" in reports["a"].markdown and "actual value is 2.0" in reports["a"].markdown
    assert "Rows: **60**" in reports["b"].markdown and "no profile" in reports["c"].markdown
    a = {r.type: r.verified for r in out.claims.where("dataset = 'a'").collect()}
    assert a == {"row_count": True, "column_count": False}
    assert out.summary.where("dataset = 'a'").first().failures == 1
    assert spark.read.text(str(tmp_path / "out")).where("dataset = 'a'").count() > 5


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    for t in ("1" * 200_000, "1." * 100_000, "1,2." * 50_000, "min " * 50_000, ("min" + " " * 100) * 2_000):
        assert V.find_claims(t) == []
    assert V.find_claims("1,234.5% missing, 1.2,3 rows, 1,2.3 days, range 1.5 - 2")[0][3:] == (234.5, None, None)
    assert time.perf_counter() - start < 10


def test_reports_of_one_row_group_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """A table that one task reads is worked on by many."""
    from checks import texts as Q

    spark.range(900).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(Q, "REPORTS_A_TASK", 100)
    made = Q.reports(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == 10 and made.select("doc_id").distinct().count() == 900


def test_claims_are_found_once(spark):
    plan = V.extract_claims(spark.range(5).select(F.col("id").alias("doc_id"), F.concat(F.col("id"), F.lit(" rows")).alias("text")))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and plan.count() == 5


@pytest.mark.parametrize("few", [0, 200])
def test_names_sent_or_looked_up_give_the_same_columns(spark, monkeypatch, few):
    monkeypatch.setattr(V, "FEW_COLUMNS", few)
    dataset = spark.createDataFrame([("d", 10, 2, 1.0, 0.0), ("e", 10, 1, 1.0, 0.0)], "dataset string, n_rows int, n_cols int, size_mb double, duplicate_rows_pct double")
    columns = spark.createDataFrame(
        [("d", 1, "age", "numeric", 90.0, 3.0), ("d", 0, "Page", "text", 80.0, None)],
        "dataset string, ordinal int, name string, inferred_type string, non_null_pct double, zeros_pct double",
    )
    rows = [(0, "d", "20% missing in PAGE"), (1, "d", "10% missing of age"), (2, "d", "3% zero by age, 2 rows"), (3, "e", "5% missing in age"), (4, None, "5% null age")]
    df = spark.createDataFrame(rows, "doc_id int, dataset string, text string")
    v = V.verify_claims(V.extract_claims(df, ("doc_id", "dataset")), dataset, columns)
    got = {r.doc_id: (r.column_name, r.verified) for r in v.where("type = 'percentage'").collect()}
    assert got == {0: ("Page", True), 1: ("age", True), 2: ("age", True), 3: (None, False), 4: (None, False)}
    if few:
        # Claims stay where they are: no join moves them by their contexts.
        assert "SortMergeJoin" not in v._jdf.queryExecution().executedPlan().toString()


def test_merging_reads_texts_twice_at_most(spark, tmp_path):
    rows = [(1, 1, "# Key Findings\na\n# Column Profiles\nx\n# Data Quality Summary\nl\nm"), (1, 2, "# Column Profiles\ny\n# Data Quality Summary\nm\nn")]
    spark.createDataFrame(rows, "doc_id long, chunk long, text string").write.parquet(str(tmp_path / "t"))
    parts = X.extract_sections(spark.read.parquet(str(tmp_path / "t")), ("doc_id", "chunk"))
    out = X.assemble(X.merge_sections(parts), "T", F.lit("2024-05-06 07:08:00").cast("timestamp"))
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
    text = out.first().report
    assert [text.index(x) for x in ("l\nm\nn", "## Key Findings\n\na", "x\n\ny")] == sorted(text.index(x) for x in ("l\nm\nn", "## Key Findings\n\na", "x\n\ny"))


def test_columns_are_found_among_ten_thousand(spark):
    """Names that contain each other, short and empty ones: the first in table order that the context holds."""
    names = [f"measure_{k:05d}" for k in range(10_000)] + ["measure", "Age", "x", "id", "é"]
    rows = [("a", k, n, "numeric", 90.0, 1.0) for k, n in enumerate(names)] + [("b", 0, "age", "numeric", 50.0, 0.0), ("c", 0, "", "numeric", 1.0, 0.0)]
    columns = spark.createDataFrame(rows, "dataset string, ordinal int, name string, inferred_type string, non_null_pct double, zeros_pct double")
    contexts = ["10% missing in measure_00420 and measure_00007", "the measure", "AGE of all", "no such", "an x", "x", "its id", "", "caf\u00c9", "measure_1"]
    asked = [(d, c) for d in "abcd" for c in contexts] + [(None, "age")]
    found = spark.createDataFrame(asked, "dataset string, context string")
    got = {(r.dataset, r.context): r.column.name for r in V.named_columns(found, columns).collect()}
    want = {}
    for d, c in asked:
        hit = [r[2] for r in rows if r[0] == d and r[2].lower() in c.lower()]
        if hit:
            want[d, c] = hit[0]
    assert got == want


def test_plain_rules_equal_column_rules(spark):
    rng = random.Random(11)
    bits = ["# ", "## ", "#", " #", "a b ", "a b c d ", "it. ", "one two three four. ", "End", ".", "\n", "\n\n", "\n \n\n", "\x1c", "\u3000", "\t", "é ", "İ", "Missing ", "rare",
            "\n# A b\n", "\n# a B\n", "\n###  \n", "Analysis FAILED"]
    made = ["".join(rng.choice(bits[: rng.randint(8, 24)]) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    words_ = ["w%d" % k for k in range(400)]
    made += [". ".join(" ".join(rng.choice(words_[:k]) for _ in range(6)) for _ in range(12)) for k in (4, 6, 8, 12, 20, 400) for _ in range(15)]
    made += ["x" * 120, "the cat sat on. a the cat sat once, bathe cat sat on" + " pad. more of. the rest" * 2 + "x" * 40]
    low = F.lit(False)
    for flag in low_quality_flags(F.col("text")).values():
        low = low | flag
    got = texts(spark, made).select(
        "doc_id", low.alias("low"), repetitive(F.col("text")).alias("repeats"), clean_markdown(F.col("text")).alias("clean"),
        sections(F.col("text")).alias("cut"), format_profiles(F.col("text")).alias("blocks"),
    ).collect()
    for r in got:
        t = made[r.doc_id]
        assert (plaintext.is_low(t), plaintext.repetitive(t), plaintext.clean_markdown(t)) == (r.low, r.repeats, r.clean), repr(t)
        assert plaintext.filled_sections(t) == {p.section: p.content for p in r.cut if p.content}, repr(t)
        assert plaintext.format_profiles(t) == r.blocks, repr(t)
    assert plaintext.is_low(None) and {r.low for r in got} == {r.repeats for r in got} == {True, False}


def chosen_as_tables(chunks, plain, title, at):
    """The same by the operators that merge tables of sections."""
    low = F.lit(False)
    for flag in low_quality_flags(F.col("text")).values():
        low = low | flag
    good = chunks.where(~low).select("doc_id", "chunk", clean_markdown(F.col("text")).alias("text"))
    good = good.withColumn("s", F.filter(sections(F.col("text")), lambda p: strip(p["content"]) != ""))
    merged = X.merge_sections(good.select("doc_id", "chunk", F.inline("s")))
    cut = good.where(F.size("s") > 0).select("doc_id").distinct()
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "\n\n")
    raw = good.join(cut, "doc_id", "left_anti").groupBy("doc_id").agg(whole.alias("content")).withColumn("section", F.lit(X.RAW))
    made = X.assemble(merged.unionByName(raw), title, at)
    every = chunks.select("doc_id").union(plain.select("doc_id")).distinct()
    found = every.join(made, "doc_id", "left").join(plain.select("doc_id", F.col("report").alias("_s")), "doc_id", "left")
    nothing = F.concat(X.report_header(F.lit(title), at), F.lit(X.NO_REPORT))
    return found.select("doc_id", F.coalesce("report", "_s", nothing).alias("report"), F.col("report").isNotNull().alias("generated"))


@pytest.mark.parametrize("batch", [10_000, 3])
def test_chunks_that_pass_by_equal_merged_tables(spark, batch):
    """Repeated and missing chunks, keys on one side only, repeated and missing keys, batches that end within a key."""
    rng = random.Random(13)
    heads = ["# Dataset Overview", "## Key Findings", "# Data Quality Summary", "# Data quality assessment", "## Column Profiles", "# Other things", "# AI Analysis", "#", "# Recommendations"]
    lines_ = ["", " ", "- a line", "- b line", "c line", "## not a known one", "### n_chars", "skewed outlier. x", "fine"]
    sure = lambda: ". ".join(f"Point{rng.random()} speaks of item{rng.random()} here" for _ in range(5)) + "."

    def text():
        if rng.random() < 0.2:
            return rng.choice([None, "short", "cannot process " + sure()])
        if rng.random() < 0.3:
            return sure()
        return "\n".join([sure(), *(x for _ in range(rng.randint(1, 5)) for x in (rng.choice(heads), *(rng.choice(lines_) for _ in range(rng.randint(0, 4)))))])

    rows = [(k, c, text()) for k in [None, *range(60)] for c in rng.sample([None, 0, 1, 2, 3, 10], rng.randint(1, 6))]
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "doc_id int, chunk bigint, text string").repartition(5)
    plain = spark.createDataFrame([(k, f"s{k}") for k in [None, None, *range(0, 80, 2), 4, 4, 70]] + [(6, None), (8, None)], "doc_id int, report string")
    at = F.lit("2024-01-02 03:04:00").cast("timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = X.choose_report(chunks, plain, "T", at)
        want = chosen_as_tables(chunks, plain, "T", at)
        assert got.schema.names == want.schema.names and got.schema["doc_id"].dataType == want.schema["doc_id"].dataType
        order = lambda df: sorted(map(repr, df.collect()))
        assert order(got) == order(want)
        assert {r.generated for r in got.collect()} == {True, False}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = X.choose_report(chunks.where("false"), plain.where("false"), "T", at)
    assert none.count() == 0


def test_texts_are_judged_once_and_by_the_tasks_they_are_dealt_to(spark):
    """A filter ahead of the dealing made each text again for every reason, in the one task that reads the table."""
    asked = [spark.sparkContext.accumulator(0) for _ in range(6)]

    @F.udf("string")
    def told(k):
        asked[TaskContext.get().partitionId()].add(1)
        return f"Point{k} speaks of item{k} here. It has more to say of thing{k}. Then it ends after some{k} words that nobody counts."

    keys = spark.range(0, 300, 1, 1).repartition(6)
    chunks = keys.select((F.col("id") % 100).alias("doc_id"), F.col("id").alias("chunk"), told("id").alias("text"))
    plain = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("none").alias("report"))
    out = X.choose_report(chunks, plain, "T", F.lit("2024-01-02 03:04:00").cast("timestamp"))
    assert out.where("generated").count() == 100
    assert sum(a.value for a in asked) == 300 and all(a.value for a in asked)


def test_reports_stream_in_batches_of_any_size(monkeypatch):
    body = "Point speaks of item. More is said of it here. "
    rows = [(k, 0, c, f"{body}\n# Key Findings\n{k} of {c}\n# Column Profiles\np{c}", "H") for k in "abcdefg" for c in range(3)]
    rows = sorted(rows + [(k, 1, None, f"other {k}", "H") for k in "aagh"], key=lambda r: r[:2])
    table = pa.Table.from_pylist([dict(zip(("_k", "_kind", "_chunk", "_text", "_head"), r)) for r in rows])
    whole = pa.Table.from_batches(X._reports_of_batches(iter(table.to_batches()))).to_pylist()
    assert [(r["_k"], r["_other"]) for r in whole] == [*[("a", "other a")] * 2, *[(k, None) for k in "bcdef"], ("g", "other g"), ("h", "other h")]
    assert whole[2]["_made"] == "H\n\n## Key Findings\n\nb of 0\n\n## Column Profiles\n\np0\n\np1\n\np2" and whole[-1]["_made"] is None
    monkeypatch.setattr(X, "BATCH_ROWS", 2)
    out = list(X._reports_of_batches(iter(table.to_batches(max_chunksize=4))))
    assert pa.Table.from_batches(out).to_pylist() == whole and [b.num_rows for b in out] == [2, 2, 2, 2, 1]
    monkeypatch.setattr(X, "BATCH_BYTES", 1)
    assert {b.num_rows for b in X._reports_of_batches(iter(table.to_batches()))} == {1}
