"""Report structure: sections of generated texts, merged across chunks and put in a fixed order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.markdown import clean_markdown, format_profiles, ranked_blocks, sections
from ..functions.values import col, lines, strip
from . import plaintext

# Section keys and titles in report order.
SECTION_ORDER = (
    ("dataset_overview", "Dataset Overview"),
    ("executive_summary", "Executive Summary"),
    ("data_quality_assessment", "Data Quality Assessment"),
    ("data_quality_summary", "Data Quality Summary"),
    ("key_findings", "Key Findings"),
    ("key_insights", "Key Insights"),
    ("ai_analysis", "AI Analysis"),
    ("column_profiles", "Column Profiles"),
    ("column_by_column_analysis", "Column-by-Column Analysis"),
    ("recommendations", "Recommendations"),
)
APPENDED = ("column_profiles",)
MERGED_BY_LINE = ("data_quality_summary", "data_quality_assessment")
RAW = "ai_analysis"
NO_REPORT = "\n## Error\n\nNo text of this report was usable and there is no profile to report on.\n"


def extract_sections(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, section, section_no, content), one row per named section of each text."""
    return df.select(*[col(k) for k in keys], F.inline(sections(col(text))))


def rank_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rank, issue_words, block): header blocks of each text, most troubled first."""
    blocks = F.posexplode(ranked_blocks(col(text))).alias("p", "b")
    return df.select(col(key), blocks).select(
        col(key), (F.col("p") + 1).alias("rank"), (-F.col("b.rank_key")).alias("issue_words"), F.col("b.block").alias("block")
    )


def merge_sections(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, content) from (key, chunk, section, content), chunks in order.

    Blank sections are skipped. Column profiles are appended; quality summaries
    gain the lines no earlier chunk had; of any other section the first stays.
    A merged section is one text, so collecting its pieces is the result itself;
    repeated lines shrink to one row before they are collected.
    """
    parts = parts.where(strip(F.col("content")) != "")
    k = col(key)
    by_line = F.col("section").isin(*MERGED_BY_LINE)
    appended = F.col("section").isin(*APPENDED)

    ordered = lambda item: F.array_sort(F.collect_list(item))
    chain = ordered(F.when(appended, F.struct("chunk", "content")))
    # One pass for the sections that stay and those that are appended; the lines of the others take a second.
    found = parts.groupBy(k, "section").agg(
        F.min_by(F.struct("chunk", "content"), F.when(~appended, F.col("chunk"))).alias("head"),
        F.array_join(F.transform(chain, lambda p: p["content"]), "\n\n").alias("chain"),
    )
    # Repeats of a line within a chunk become one row with their places, then the first chunk is kept.
    seen = (
        parts.where(by_line)
        .select(k, "section", "chunk", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
        .groupBy(k, "section", "line", "chunk")
        .agg(F.collect_list("pos").alias("at"))
        .groupBy(k, "section", "line")
        .agg(F.min_by(F.struct("chunk", "at"), "chunk").alias("f"))
    )
    later = seen.where(strip(F.col("line")) != "").select(
        k, "section", F.col("f.chunk").alias("chunk"), "line", F.explode("f.at").alias("pos")
    )
    added = later.groupBy(k, "section").agg(F.array_sort(F.collect_list(F.struct("chunk", "pos", "line"))).alias("rest"))
    later_lines = F.transform(
        F.filter(
            F.coalesce("rest", F.array().cast("array<struct<chunk:bigint,pos:int,line:string>>")),
            lambda r: r["chunk"] > F.col("head.chunk"),
        ),
        lambda r: r["line"],
    )
    joined = F.array_join(F.concat(F.array("head.content"), later_lines), "\n")
    return found.join(added, [key, "section"], "left").select(
        k, "section", F.when(appended, F.col("chain")).when(by_line, joined).otherwise(F.col("head.content")).alias("content")
    )


def report_header(title: Column, at: Column) -> Column:
    """Title block; the time is an argument so that a report can be made again."""
    stamp = F.date_format(at, "dd MMMM yyyy 'at' HH:mm")
    return F.concat(F.lit("# "), title, F.lit("\n\n*Generated on "), stamp, F.lit(" using Plumbline*\n\n---\n"))


def assemble(merged: DataFrame, title: str, at: Column, key: str = "doc_id") -> DataFrame:
    """(key, report): known sections in their order, each under a title unless it has one; others dropped."""
    place = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(SECTION_ORDER) for x in (s, i)])
    name = F.create_map(*[F.lit(x) for s, t in SECTION_ORDER for x in (s, t)])
    content = F.when(F.col("section") == "column_profiles", format_profiles(F.col("content"))).otherwise(F.col("content"))
    known = F.col("section").isin([s for s, _ in SECTION_ORDER]) & col(key).isNotNull()
    titled = F.when(F.startswith(strip(F.col("t")), F.lit("#")), F.col("t")).otherwise(
        F.concat(F.lit("## "), name[F.col("section")], F.lit("\n\n"), F.col("t"))
    )
    # At most one row per known section and text.
    part = F.when(strip(F.col("t")) != "", F.struct(place[F.col("section")].alias("i"), titled.alias("t")))
    shaped = merged.select(col(key), "section", F.when(known, content).alias("t"))
    body = shaped.groupBy(col(key)).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    texts = F.coalesce(F.transform("parts", lambda p: p["t"]), F.array().cast("array<string>"))
    full = F.array_join(F.concat(F.array(report_header(F.lit(title), at)), texts), "\n\n")
    return body.select(col(key), clean_markdown(full).alias("report"))


def _texts(column: pa.Array) -> list[str | None]:
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _usable_of_batch(texts: pa.Array) -> pa.Array:
    return pa.array([None if plaintext.is_low(t) else plaintext.clean_markdown(t) for t in _texts(texts)], pa.string())


def usable_text(text: Column) -> Column:
    """The text cleaned, or NULL if it is of low quality."""
    return F.arrow_udf(_usable_of_batch, "string")(text)


class _Merged:
    """What the usable texts of one key come to; they are added in order of their chunks.

    The rules are those of ``merge_sections`` and ``assemble``. Only what may stand in the report is held.
    """

    def __init__(self) -> None:
        self.usable = self.cut = False
        self.chunk: object = None
        self.raw: list[str] = []
        self.kept: dict[str, list[str]] = {}
        self.first: dict[str, object] = {}  # chunk that a section stands in first
        self.seen: dict[str, set[str]] = {}
        self.new: dict[str, list] = {}  # what the chunk at hand adds; several texts may call themselves the same chunk

    def add(self, chunk: object, text: str) -> None:
        if _differs(chunk, self.chunk):
            self.end_chunk()
            self.chunk = chunk
        self.usable = True
        sections = plaintext.filled_sections(text)
        if sections and not self.cut:
            self.cut, self.raw = True, []
        if not self.cut:
            self.raw.append(text)
        for section, content in sections.items():
            if section in APPENDED:
                self.new.setdefault(section, []).append(content)
            elif section not in _JOINED or chunk is None:
                continue
            elif self.first.setdefault(section, chunk) == chunk:
                self.kept[section] = [min(content, *self.kept.get(section, [content]))]
                if section in MERGED_BY_LINE:
                    self.seen.setdefault(section, set()).update(content.split("\n"))
            elif section in MERGED_BY_LINE:
                seen = self.seen[section]
                found = [(i, line) for i, line in enumerate(content.split("\n")) if line not in seen and line.strip()]
                self.new.setdefault(section, []).extend(found)

    def end_chunk(self) -> None:
        for section, new in self.new.items():
            new.sort()
            if section in APPENDED:
                self.kept.setdefault(section, []).extend(new)
            else:
                lines = [line for _, line in new]
                self.kept[section] += lines
                self.seen[section].update(lines)
        self.new = {}

    def report(self, header: str) -> str | None:
        if not self.usable:
            return None
        self.end_chunk()
        parts = [header]
        kept = self.kept if self.cut else {RAW: self.raw}
        for section, title in SECTION_ORDER:
            if section in kept:
                text = _JOINED[section].join(kept[section])
                if section == "column_profiles":
                    text = plaintext.format_profiles(text)
                if start := text.strip():
                    parts.append(text if start.startswith("#") else f"## {title}\n\n{text}")
        return plaintext.clean_markdown("\n\n".join(parts))


# What stands between the pieces of a section that the report knows.
_JOINED = {section: "\n" if section in MERGED_BY_LINE else "\n\n" for section, _ in SECTION_ORDER}
# A batch of reports ends at so many rows, or after the one that makes it so large.
BATCH_ROWS, BATCH_BYTES = 10_000, 32 << 20


def _values(column: pa.Array) -> list:
    """Strings as bytes, so that any goes in and out."""
    return (column.cast(pa.binary()) if pa.types.is_string(column.type) else column).to_pylist()


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.binary()).view(kind) if pa.types.is_string(kind) else pa.array(values, kind)


def _differs(a: object, b: object) -> bool:
    """Not the same key; NaN is one."""
    return a != b and (a == a or b == b)


def _reports_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by key, each key's chunks in order before its other reports, to (key, report, other).

    A key gives a row for each of its other reports, one at least, and a NULL key a single one without reports.
    """
    rows: list[tuple] = []
    size = 0
    key = merged = kind = None
    report, header, alone = None, "", False  # alone: the key has no row yet

    def full() -> pa.RecordBatch:
        nonlocal size
        keys, *texts = zip(*rows)
        rows.clear()
        size = 0
        return pa.RecordBatch.from_arrays([_array(keys, kind), *(_array(t, pa.string()) for t in texts)], ["_k", "_made", "_other"])

    def put(other: bytes | None) -> Iterator[pa.RecordBatch]:
        nonlocal size, merged, report, alone
        if merged is not None:
            made, merged = merged.report(header), None
            report = None if made is None else made.encode()
        alone = False
        rows.append((key, report, other))
        size += len(report or b"") + len(other or b"")
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield full()

    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        column = dict(zip(batch.schema.names, batch.columns))
        header, kind = column["_head"][0].as_py(), column["_k"].type
        for k, other, chunk, text in zip(*(_values(column[c]) for c in ("_k", "_kind", "_chunk", "_text"))):
            if not begun or _differs(k, key):
                if alone:
                    yield from put(None)
                begun, key, merged, alone = True, k, _Merged(), True
            if key is None:
                continue
            if other:
                yield from put(text)
            elif text is not None:
                merged.add(chunk, text.decode())
    if alone:
        yield from put(None)
    if rows:
        yield full()


def assemble_chunks(chunks: DataFrame, title: str, at: Column, key: str = "doc_id", others: DataFrame | None = None) -> DataFrame:
    """(key, report, other) from (key, chunk, text): low-quality chunks dropped, the rest cleaned, cut, merged and ordered.

    A text without any section goes in whole as the analysis section. A key without
    usable chunks has no report, and ``other`` is its report in ``others`` (key, report).
    Every key of either side has a row, two only if ``others`` has; the NULL key has one, without reports.

    Each text is worked through once, where it lies, before any row moves. Then a key's chunks pass by in order,
    and of them only what may stand in the report is held: many chunks of one key need no more memory than their report.
    """
    parts = chunks.select(col(key).alias("_k"), F.lit(0).alias("_kind"), F.col("chunk").alias("_chunk"), usable_text(F.col("text")).alias("_text"))
    if others is not None:
        kind = parts.schema["_chunk"].dataType
        parts = parts.union(others.select(col(key), F.lit(1), F.lit(None).cast(kind), F.col("report").cast("string")))
    dealt = parts.repartition("_k").sortWithinPartitions("_k", "_kind", "_chunk", "_text")
    dealt = dealt.withColumn("_head", report_header(F.lit(title), at))
    out = StructType([StructField("_k", parts.schema["_k"].dataType), StructField("_made", StringType()), StructField("_other", StringType())])
    made = dealt.mapInArrow(_reports_of_batches, out)
    return made.select(F.col("_k").alias(key), F.col("_made").alias("report"), F.col("_other").alias("other"))


def choose_report(chunks: DataFrame, statistical: DataFrame, title: str, at: Column, key: str = "doc_id") -> DataFrame:
    """(key, report, generated): the assembled report, or the statistical one where no chunk is usable.

    Every key of either side has a row: one with neither gets a report that says so.
    """
    made = assemble_chunks(chunks, title, at, key, statistical)
    nothing = F.concat(report_header(F.lit(title), at), F.lit(NO_REPORT))
    return made.select(col(key), F.coalesce("report", "other", nothing).alias("report"), F.col("report").isNotNull().alias("generated"))
