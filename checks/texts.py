"""Queries over texts: quality filter, report structure, rendering, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.markdown import clean_markdown, collapse_lines, estimate_tokens, format_profiles
from plumbline.operators import claims as V
from plumbline.operators import dataset as D
from plumbline.operators import sections as X
from plumbline.operators.textquality import FAILURE_PHRASES, low_quality
from plumbline.plans import lines as L
from plumbline.plans import report as R
from plumbline.sources.files import report_path, write_report

from .base import SOURCES, register, scratch, source, table
from .profile_sql import SPACE, big, columns_sql, fixed, pick, rnd, strip, value_rows, with_columns
from .tables import DUPLICATE_PCT, SIZE_MB, pairs_sql, recommendations_sql

# One Markdown report per order, in pieces: literal text, and SQL for the numbers in it.
# Their claims are about the labelled documents; some are wrong.
REPORT = (
    "Intro line of order ", "o_orderkey", ".\n#  Dataset Overview\nThe table has 1,0", "10 + (o_orderkey % 7) * 5", " rows and ",
    "7 + o_orderkey % 2", " columns, ", "2 + o_orderkey % 2", ".4 MB.   \n \t\n\n\nIt has ", "o_orderkey % 4",
    "% duplicate rows.\n## Data Quality Assessment\n- ", "60 + o_orderkey % 5",
    " % Missing values of quality, out of all é values there are\n- order ", "o_orderkey % 3",
    " problem line\n\n- the average 12.5 and Range: 1.5 to ", "o_orderkey % 9", " or so, then max ", "o_orderkey % 50",
    ", that is 1,234 distinct values with 25 outliers in ", "o_orderkey % 400",
    " days\n## Column Profiles\n### n_chars\nskewed outlier issue. It is 39.9% non-null in toxic. ", "o_orderkey % 4",
    "% zero for n_chars\n### lang\nfine rare\n# Dataset overview\n  Check it. \nCheck it.\n\nCheck it.\n## Recommendations\n",
    "o_orderkey % 11", " of them. Then do it.\n",
)


def _report_sql(cast: str) -> str:
    parts = []
    for i, p in enumerate(REPORT):
        literal = p.replace("\\", "\\\\") if cast == "STRING" else p
        parts.append(f"CAST({p} AS {cast})" if i % 2 else "'" + literal.replace("'", "''") + "'")
    return "concat(" + ", ".join(parts) + ")"


KEYS = "o_orderkey AS doc_id, CAST(floor(o_orderkey / 3) AS BIGINT) AS report_id, o_orderkey % 3 AS chunk"
REPORTS = f"SELECT {KEYS}, {_report_sql('VARCHAR')} AS text FROM orders"


REPORTS_A_TASK = 20_000


def reports(spark, sf_dir):
    """(doc_id, report_id, chunk, text): a report per order, three orders to a report with chunks.

    The keys are dealt to tasks first: a table of one row group would be read, and all its texts worked on, by one.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    o = o.repartition(o.count() // REPORTS_A_TASK + 1)
    pieces = [F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(REPORT)]
    return o.selectExpr("o_orderkey AS doc_id", "CAST(floor(o_orderkey / 3) AS BIGINT) AS report_id", "o_orderkey % 3 AS chunk", "*").select(
        "doc_id", "report_id", "chunk", F.concat(*pieces).alias("text")
    )


# -- G: text quality and structure ---------------------------------------------

def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{SPACE}+'), lambda w: w <> '')"


def low_sql(texts: str) -> str:
    """(doc_id, flags, is_low) by brute force: every four-word phrase is counted in its whole text."""
    phrase = "array_to_string(w[i + 1:i + 4], ' ')"
    fails = " OR ".join(f"contains(lower(text), '{p}')" for p in FAILURE_PHRASES)
    heads = "len(list_filter(ls, lambda s: starts_with(s, '#')))"
    body = "len(list_filter(ls, lambda s: s <> '' AND NOT starts_with(s, '#')))"
    return f"""WITH t AS ({texts}), a AS (SELECT doc_id, text, {words('text')} AS w,
      list_transform(string_split({strip('text')}, chr(10)), lambda s: {strip('s')}) AS ls,
      list_transform(list_filter(string_split(text, '.'), lambda s: {strip('s')} <> ''), lambda s: len({words('s')})) AS ss FROM t),
      p AS (SELECT doc_id, text, list_distinct(list_transform(range(0, greatest(len(w) - 6, 0)), lambda i: {phrase})) AS ps, len(w) AS n FROM a),
      f AS (SELECT a.doc_id, length({strip('a.text')}) < 100 AS too_short, ({fails.replace('text', 'a.text')}) AS failure_phrase,
        p.n > 10 AND len(list_filter(p.ps, lambda x: length(p.text) - length(replace(p.text, x, '')) > 2 * length(x))) > 0 AS repetitive,
        {heads} > {body} AND len(ls) > 5 AS mostly_headers, len(ss) < 3 AS few_sentences,
        len(ss) > 2 AND list_sum(ss) < 3 * len(ss) AS fragmented FROM a JOIN p ON p.doc_id = a.doc_id)
      SELECT *, too_short OR failure_phrase OR repetitive OR mostly_headers OR few_sentences OR fragmented AS is_low FROM f"""


@register("g1_low_quality_documents", low_sql("SELECT doc_id, text FROM documents"))
def g1_low_quality_documents(spark, sf_dir):
    return low_quality(table(spark, sf_dir, "documents"))


SHORT = (
    "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN concat('# h', repeat(concat(chr(10), '# h'), 8), repeat(' pad', 30)) "
    "WHEN doc_id % 6 = 1 THEN concat('Sadly it was unable to Generate this. ', text) WHEN doc_id % 6 = 2 THEN repeat('a b. ', 30) "
    "WHEN doc_id % 6 = 3 THEN concat('the cat sat on. a the cat sat once, bathe cat sat on', text, '. x. yes') ELSE concat(text, '. End') END AS text FROM documents"
)


@register("g1_low_quality_edges", low_sql(SHORT))
def g1_low_quality_edges(spark, sf_dir):
    """Texts bent so that each reason fires, partial-word repeats included."""
    df = spark.sql(SHORT.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return low_quality(df)


def clean_sql(x: str) -> str:
    collapsed = strip(rf"regexp_replace({x}, '\n{SPACE}*\n{SPACE}*\n', chr(10) || chr(10), 'g')")
    return rf"replace(regexp_replace({collapsed}, '(^|\n)(#[^\n]*)\n([^#\n])', '\1\2' || chr(1) || '\3', 'g'), chr(1), chr(10) || chr(10))"


@register("g2_clean_markdown", f"SELECT doc_id, {clean_sql('text')} AS text FROM ({REPORTS})")
def g2_clean_markdown(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", clean_markdown(F.col("text")).alias("text"))


HEADER = rf"^#{{1,6}}{SPACE}+(.+)$"


def sections_sql(texts: str, keys: str = "doc_id") -> str:
    """CTEs ending in sec(keys, section, section_no, content); needs no WITH of its own."""
    return f"""t AS ({texts}), l AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
      h AS (SELECT *, regexp_matches(line, '{HEADER}') AS head FROM l),
      n AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY {keys} ORDER BY pos) AS BIGINT) - 1 AS section_no FROM h),
      s AS (SELECT {keys}, section_no, replace(lower({strip(f"regexp_extract(max(line) FILTER (head), '{HEADER}', 1)")}), ' ', '_') AS section,
        {strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')")} AS content FROM n WHERE section_no >= 0 GROUP BY {keys}, section_no),
      sec AS (SELECT * FROM s WHERE section <> '' QUALIFY row_number() OVER (PARTITION BY {keys}, section ORDER BY section_no DESC) = 1)"""


@register("g3_extract_sections", f"WITH {sections_sql(REPORTS)} SELECT * FROM sec")
def g3_extract_sections(spark, sf_dir):
    return X.extract_sections(reports(spark, sf_dir))


CHUNKED = "SELECT report_id, chunk, text FROM (" + REPORTS + ")"


def merged_sql(texts: str) -> str:
    """CTEs ending in merged(report_id, section, content)."""
    quality = "section IN ('data_quality_summary', 'data_quality_assessment')"
    return f"""{sections_sql(texts, 'report_id, chunk')}, parts AS (SELECT * FROM sec WHERE {strip('content')} <> ''),
      pl AS (SELECT report_id, chunk, section, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM parts WHERE {quality}),
      pk AS (SELECT *, min(chunk) OVER (PARTITION BY report_id, section) AS head, min(chunk) OVER (PARTITION BY report_id, section, line) AS seen FROM pl),
      merged AS (SELECT report_id, section, string_agg(content, chr(10) || chr(10) ORDER BY chunk) AS content FROM parts WHERE section = 'column_profiles' GROUP BY 1, 2
        UNION ALL SELECT report_id, section, arg_min(content, chunk) FROM parts WHERE section <> 'column_profiles' AND NOT {quality} GROUP BY 1, 2
        UNION ALL SELECT report_id, section, string_agg(line, chr(10) ORDER BY chunk, pos) FROM pk WHERE chunk = head OR ({strip('line')} <> '' AND chunk = seen) GROUP BY 1, 2)"""


@register("g4_merge_sections", f"WITH {merged_sql(CHUNKED)} SELECT * FROM merged")
def g4_merge_sections(spark, sf_dir):
    parts = X.extract_sections(reports(spark, sf_dir), ("report_id", "chunk"))
    return X.merge_sections(parts, "report_id")


WHEN = "2024-05-06 07:08:00"
HEAD = "concat('# Quality', chr(10), chr(10), '*Generated on 06 May 2024 at 07:08 using Plumbline*', chr(10), chr(10), '---', chr(10))"


def assembled_sql(merged: str = "merged") -> str:
    rows = ", ".join(f"({i}, '{s}', '{t}')" for i, (s, t) in enumerate(X.SECTION_ORDER))
    part = f"CASE WHEN starts_with({strip('content')}, '#') THEN content ELSE concat('## ', title, chr(10), chr(10), content) END"
    text = f"concat({HEAD}, coalesce(string_agg(chr(10) || chr(10) || {part}, '' ORDER BY i) FILTER (title IS NOT NULL), ''))"
    return (
        f"SELECT m.report_id, {clean_sql(text)} AS report FROM {merged} m LEFT JOIN (VALUES {rows}) o(i, section, title) ON o.section = m.section GROUP BY 1"
    )


@register("g5_assemble", f"WITH {merged_sql(CHUNKED)} {assembled_sql()}")
def g5_assemble(spark, sf_dir):
    parts = X.extract_sections(reports(spark, sf_dir), ("report_id", "chunk"))
    at = F.lit(WHEN).cast("timestamp")
    return X.assemble(X.merge_sections(parts, "report_id"), "Quality", at, "report_id")


ISSUES = " + ".join(f"CAST(contains(lower(b), '{w}') AS INT)" for w in ("issue", "problem", "concern", "missing", "outlier", "skewed", "empty", "rare", "duplicate"))
BLOCKS = rf"""WITH t AS ({REPORTS}), p AS (SELECT doc_id, string_split_regex(text, '\n#+{SPACE}+') AS bs FROM t),
  u AS (SELECT doc_id, unnest(bs[2:]) AS b, generate_subscripts(bs[2:], 1) AS pos FROM p), f AS (SELECT *, {ISSUES} AS n FROM u WHERE {strip('b')} <> '')
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank, {big('n')} AS issue_words,
  CASE WHEN starts_with({strip('b')}, '#') THEN {strip('b')}
  ELSE {strip(f"concat('### ', {strip("string_split(b, '.')[1]")}, chr(10), b)")} END AS block FROM f"""


@register("g6_rank_blocks", BLOCKS)
def g6_rank_blocks(spark, sf_dir):
    return X.rank_blocks(reports(spark, sf_dir))


@register(
    "g6_format_profiles",
    f"SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS text FROM ({BLOCKS}) GROUP BY doc_id",
)
def g6_format_profiles(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", format_profiles(F.col("text")).alias("text"))


def collapsed_sql(texts: str) -> str:
    return f"""WITH t AS ({texts}), k AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS ls FROM t),
  c AS (SELECT doc_id, replace(replace(array_to_string(list_filter(ls, lambda s, i: i = 1 OR s <> ls[i - 1]), chr(10)), '**Error generating response**:', ''), 'Response:', '') AS x FROM k)
  SELECT doc_id, CASE WHEN length({strip('x')}) < 100 THEN '**Unable to generate detailed analysis.** The model output was too brief or incomplete.' ELSE x END AS text FROM c"""


MARKED = "SELECT doc_id, concat('Response: ', text, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), chr(10), 'End.', chr(10), 'End.') ELSE '' END) AS text FROM documents"


@register("g7_collapse_lines", collapsed_sql(REPORTS))
def g7_collapse_lines(spark, sf_dir):
    return reports(spark, sf_dir).select("doc_id", collapse_lines(F.col("text")).alias("text"))


@register("g7_collapse_lines_documents", collapsed_sql(MARKED))
def g7_collapse_lines_documents(spark, sf_dir):
    df = spark.sql(MARKED.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return df.select("doc_id", collapse_lines(F.col("text")).alias("text"))


@register("g8_estimate_tokens", "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations")
def g8_estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))


# Every fifth report has only unusable chunks; some have no sections at all.
USABLE = (
    "SELECT report_id, chunk, CASE WHEN report_id % 5 = 0 THEN 'cannot process' WHEN report_id % 5 = 1 THEN replace(text, '#', '*') ELSE text END AS text FROM (" + REPORTS + ")"
)


def usable(spark, sf_dir):
    text = F.when(F.col("report_id") % 5 == 0, "cannot process").when(
        F.col("report_id") % 5 == 1, F.replace("text", F.lit("#"), F.lit("*"))
    )
    return reports(spark, sf_dir).select("report_id", "chunk", text.otherwise(F.col("text")).alias("text"))


LOW_KEYED = low_sql(f"SELECT report_id * 10 + chunk AS doc_id, text FROM ({USABLE})")
GOOD = f"SELECT u.report_id, u.chunk, {clean_sql('u.text')} AS text FROM ({USABLE}) u JOIN ({LOW_KEYED}) q ON q.doc_id = u.report_id * 10 + u.chunk WHERE NOT q.is_low"


@register(
    "g9_choose_report",
    f"""WITH good AS MATERIALIZED ({GOOD}), {merged_sql('SELECT * FROM good')},
      every AS (SELECT * FROM merged UNION ALL SELECT report_id, 'ai_analysis', string_agg(text, chr(10) || chr(10) ORDER BY chunk) FROM good
        WHERE report_id NOT IN (SELECT report_id FROM merged) GROUP BY 1), made AS ({assembled_sql('every')})
      SELECT ids.report_id, coalesce(made.report, 'Report ' || CAST(ids.report_id AS VARCHAR)) AS report, made.report IS NOT NULL AS generated
      FROM (SELECT DISTINCT report_id FROM ({USABLE})) ids LEFT JOIN made ON made.report_id = ids.report_id""",
)
def g9_choose_report(spark, sf_dir):
    chunks = usable(spark, sf_dir)
    fallback = chunks.select("report_id").distinct().select("report_id", F.concat(F.lit("Report "), F.col("report_id").cast("string")).alias("report"))
    return X.choose_report(chunks, fallback, "Quality", F.lit(WHEN).cast("timestamp"), "report_id")


# -- R: rendering --------------------------------------------------------------


def _profile(spark, sf_dir, name: str) -> D.Profile:
    return D.profile(source(spark, sf_dir, name), name)


AVERAGE = "avg(non_null_pct)"


def first_names(where: str) -> str:
    return f"(SELECT string_agg(name, ', ' ORDER BY ordinal) FROM (SELECT * FROM cp WHERE {where} ORDER BY ordinal LIMIT 3))"


LABELS = "CASE issue " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.ISSUE_LABELS.items()) + " END"
ISSUE_ROWS = "i AS (SELECT ordinal, name, unnest(string_split(quality_issues, ',')) AS issue, generate_subscripts(string_split(quality_issues, ','), 1) AS pos FROM cp WHERE quality_issues <> '')"


def report_sql(name: str, title: str, size: str, n_cols: int) -> str:
    """CTEs ending in rep(report), the whole report over one table."""
    nl, f1, f2 = "chr(10)", (lambda x: fixed(x, 1)), (lambda x: fixed(x, 2))
    num, cat, dat, txt = (f"inferred_type = '{t}'" for t in ("numeric", "categorical", "datetime", "text"))
    freq = value_rows(name, ("string", "bool"))
    freq = freq[len(f"WITH src AS ({SOURCES[name][1]}), ") :]
    many = lambda x: f"format('{{:,}}', {x})"
    block = " || ".join(
        f"coalesce({x}, '')"
        for x in (
            f"'### ' || cp.name || {nl} || {nl} || '- Filled: ' || {f1('non_null_pct')} || '%, distinct values: ' || {many('n_unique')} || {nl}",
            f"CASE WHEN {num} THEN '- From ' || {f2('min')} || ' to ' || {f2('max')} || ', mean ' || {f2('mean')} || {nl} END",
            f"CASE WHEN {num} AND outliers_count > 0 THEN '- Unusual values: ' || outliers_count || {nl} END",
            f"CASE WHEN {cat} THEN '- Most frequent: ''' || top.value || ''' (' || {f1('top.cnt * 100.0 / non_null')} || '%)' || {nl} END",
            f"CASE WHEN {cat} AND rare_values > 0 THEN '- Rare values: ' || rare_values || {nl} END",
            f"CASE WHEN {dat} THEN '- From ' || left(min_date, 10) || ' to ' || left(max_date, 10) || ', days: ' || coverage_days || {nl} END",
            f"CASE WHEN {txt} THEN '- Mean length in characters: ' || {f1('avg_length')} || {nl} END",
            f"CASE WHEN quality_issues <> '' THEN '- Flags: ' || replace(replace(quality_issues, ',', ', '), '_', ' ') || {nl} END",
        )
    )
    listed = lambda lead, item, order, clear, rows: (
        f"(SELECT CASE WHEN count(*) > 0 THEN {lead} || {nl} || string_agg({item}, {nl} ORDER BY {order}) ELSE '{clear}' END FROM {rows})"
    )
    gaps = listed(
        "'- Columns with gaps: ' || count(*)", f"'  - **' || name || '** (' || inferred_type || '): ' || {f1('100 - non_null_pct')} || '% empty'",
        "non_null_pct, ordinal", "- No column has notable gaps", "(SELECT * FROM cp WHERE non_null_pct < 95)",
    )
    odd = listed(
        "'- Columns with values far outside the quartiles: ' || count(*)",
        f"'  - **' || name || '**: ' || outliers_count || ' values, ' || {f1('outliers_count * 100.0 / n_rows')} || '% of the rows'",
        "ordinal", "- No value lies far outside the quartiles", "(SELECT * FROM cp WHERE outliers_count > 0)",
    )
    flags = listed(
        "'- Flags and the number of columns that have them:'", "'  - ' || replace(issue, '_', ' ') || ': ' || n", "issue",
        "- No column is flagged", "(SELECT issue, count(*) AS n FROM i GROUP BY issue)",
    )
    types = "(SELECT string_agg(n || ' ' || inferred_type, ', ' ORDER BY inferred_type) FROM (SELECT inferred_type, count(*) AS n FROM cp GROUP BY 1))"
    return f"""{with_columns(name)}, {freq}, {ISSUE_ROWS},
      top AS (SELECT * FROM freq QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY cnt DESC, k0, value) = 1),
      blk AS (SELECT cp.ordinal, inferred_type, {block} AS block, row_number() OVER (PARTITION BY inferred_type ORDER BY cp.ordinal) AS r
        FROM cp LEFT JOIN top ON top.ordinal = cp.ordinal),
      prof AS (SELECT string_agg(t, '' ORDER BY o) AS t FROM (SELECT min(ordinal) AS o, '**' || upper(left(inferred_type, 1)) || substr(inferred_type, 2) || ': ' || count(*)
        || '**' || {nl} || {nl} || string_agg(block || {nl}, '' ORDER BY ordinal) FILTER (r <= 10) || CASE WHEN count(*) > 10 THEN '*' || (count(*) - 10)
        || ' further ' || inferred_type || ' columns are not shown*' || {nl} || {nl} ELSE '' END AS t FROM blk GROUP BY inferred_type)),
      dd AS (SELECT count(*) AS n, {size} AS mb, {DUPLICATE_PCT} AS dup, (SELECT {AVERAGE} FROM cp) AS filled FROM src),
      a AS (SELECT 1 AS o, 'Drop repeated rows (' || {f1('dup')} || '% of all)' AS action FROM dd WHERE dup > 5
        UNION ALL SELECT 2, 'Fill or explain the gaps in: ' || {first_names('non_null_pct < 90')}
        UNION ALL SELECT 3, 'Look into unusual values in: ' || {first_names('outliers_count > 0')}),
      b AS (SELECT * FROM a WHERE action IS NOT NULL UNION ALL SELECT 4, 'Nothing stands out; the table can be used as it is' WHERE NOT EXISTS (SELECT 1 FROM a WHERE action IS NOT NULL)),
      rep AS (SELECT concat('# {title}', {nl}, {nl}, '*Generated on 06 May 2024 at 07:08 using Plumbline*', {nl}, {nl}, '---', {nl},
        '## Dataset Overview', {nl}, {nl}, 'Rows: **', {many('n')}, '**', {nl}, 'Columns: **{n_cols}** (', {types}, ')', {nl}, 'Size: **', {f1('mb')}, ' MB**, ',
        {f2('mb / n * 1024')}, ' KB a row', {nl}, 'Repeated rows: ', {f1('dup')}, '%', {nl}, 'Filled cells: ', {f1('filled')}, '%', {nl}, {nl},
        '## Data Quality Assessment', {nl}, {nl}, '**Gaps**', {nl}, {gaps}, {nl}, {nl}, '**Unusual values and repeats**', {nl}, {odd}, {nl},
        CASE WHEN dup > 0 THEN '- Rows that repeat another: ' || {f1('dup')} || '%' ELSE '- No row repeats another' END, {nl}, {nl}, '**Flags**', {nl}, {flags}, {nl},
        {nl}, {nl}, '## Key Insights', {nl}, {nl}, '- **Size**: ', {many('n')}, ' rows, ',
        CASE WHEN n > 10000 THEN 'enough for detail' WHEN n < 100 THEN 'too few for firm conclusions' ELSE 'enough for overall figures' END, {nl},
        '- **Filled**: ', {f1('filled')}, '%, ', CASE WHEN filled > 95 THEN 'hardly any gaps' WHEN filled > 80 THEN 'some gaps' ELSE 'many gaps' END, {nl},
        CASE WHEN (SELECT count(DISTINCT inferred_type) FROM cp) > 3 THEN '- **Variety**: columns of every type' || {nl} ELSE '' END,
        (SELECT CASE WHEN count(*) > 0 THEN '- **To check**: unusual values in ' || count(*) || ' columns' || {nl} ELSE '' END FROM cp WHERE outliers_count > 0),
        {nl}, {nl}, '## Column Profiles', {nl}, {nl}, prof.t, '## Recommendations', {nl}, {nl},
        (SELECT string_agg(k || '. ' || action || {nl}, '' ORDER BY k) FROM (SELECT row_number() OVER (ORDER BY o) AS k, action FROM b)), '{R.CLOSING}') AS report FROM dd, prof)"""


@register("r1_statistical_report", f"{report_sql('labelled', 'Data Quality Report', SIZE_MB, 7)} SELECT 'labelled' AS dataset, report AS markdown FROM rep")
def r1_statistical_report(spark, sf_dir):
    p = _profile(spark, sf_dir, "labelled")
    return R.statistical_report(p.dataset, p.columns, "Data Quality Report", F.lit(WHEN).cast("timestamp"))


def _reports_by_lang() -> str:
    """The report over the rows of each language, without that column."""
    kinds = {c: k for c, k in SOURCES["labelled"][0].items() if c != "lang"}
    size = SIZE_MB.replace(" + sum(strlen(lang))", "")
    parts = []
    for v in ("de", "en", "es", "fr"):
        SOURCES["_segment"] = (kinds, f"SELECT {', '.join(kinds)} FROM ({SOURCES['labelled'][1]}) WHERE lang = '{v}'")
        parts.append(f"SELECT '{v}' AS dataset, report AS markdown FROM ({report_sql('_segment', 'Data Quality Report', size, 6)} SELECT * FROM rep)")
    del SOURCES["_segment"]
    return " UNION ALL ".join(parts)


@register("r1_statistical_report_by_segment", _reports_by_lang())
def r1_statistical_report_by_segment(spark, sf_dir):
    """One report per language."""
    p = D.profile(source(spark, sf_dir, "labelled"), by=["lang"])
    return R.statistical_report(p.dataset, p.columns, "Data Quality Report", F.lit(WHEN).cast("timestamp"))


ORDERS_MB = "(32 * count(*) + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))) / 1048576.0"


@register(
    "a6_write_report",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dataset, unnest(string_split(report, chr(10))) AS value FROM ({report_sql(t, 'Orders', size, n)} SELECT * FROM rep)"
        for d, t, size, n in (
            ("orders", "orders", ORDERS_MB, 6),
            ("status", "status_priority", "sum(strlen(o_orderstatus) + strlen(o_orderpriority)) / 1048576.0", 2),
        )
    ),
)
def a6_write_report(spark, sf_dir):
    """Write two reports, one after the other, to one place as text, and read both back line by line."""
    path = f"{scratch(spark)}/{report_path('orders.csv')}"
    for name, src in (("orders", "orders"), ("status", "status_priority")):
        p = D.profile(source(spark, sf_dir, src), name)
        write_report(R.statistical_report(p.dataset, p.columns, "Orders", F.lit(WHEN).cast("timestamp")), path)
    return spark.read.text(path)


@register(
    "r2_insight_tiers",
    f"{with_columns('labelled')} SELECT 'labelled' AS dataset, CASE WHEN max(n_rows) > 10000 THEN 'large' WHEN max(n_rows) < 100 THEN 'small' ELSE 'moderate' END AS volume,"
    f" {rnd(AVERAGE)} AS completeness_pct, CASE WHEN {AVERAGE} > 95 THEN 'high' WHEN {AVERAGE} > 80 THEN 'good' ELSE 'concern' END AS completeness,"
    " count(DISTINCT inferred_type) AS n_types, count(DISTINCT inferred_type) > 3 AS rich FROM cp",
)
def r2_insight_tiers(spark, sf_dir):
    p = _profile(spark, sf_dir, "labelled")
    return R.insight_tiers(p.dataset, p.columns)


@register(
    "r3_report_actions",
    f"{with_columns('labelled')}, a AS (SELECT 1 AS o, 'Drop repeated rows (' || {fixed('pct', 1)} || '% of all)' AS action"
    f" FROM (SELECT {DUPLICATE_PCT} AS pct FROM src) WHERE pct > 5"
    f" UNION ALL SELECT 2, 'Fill or explain the gaps in: ' || {first_names('non_null_pct < 90')}"
    f" UNION ALL SELECT 3, 'Look into unusual values in: ' || {first_names('outliers_count > 0')}),"
    " b AS (SELECT * FROM a WHERE action IS NOT NULL UNION ALL SELECT 4, 'Nothing stands out; the table can be used as it is'"
    " WHERE NOT EXISTS (SELECT 1 FROM a WHERE action IS NOT NULL))"
    " SELECT 'labelled' AS dataset, row_number() OVER (ORDER BY o) AS action_no, action FROM b",
)
def r3_report_actions(spark, sf_dir):
    p = _profile(spark, sf_dir, "labelled")
    return R.report_actions(p.dataset, p.columns)


@register(
    "r4_columns_by_type",
    columns_sql(
        "troubled",
        "'troubled' AS dataset, inferred_type, row_number() OVER (PARTITION BY inferred_type ORDER BY ordinal) AS rank, name,"
        " count(*) OVER (PARTITION BY inferred_type) AS n_columns, greatest(count(*) OVER (PARTITION BY inferred_type) - 2, 0) AS not_shown",
    )
    + " QUALIFY row_number() OVER (PARTITION BY inferred_type ORDER BY ordinal) <= 2",
)
def r4_columns_by_type(spark, sf_dir):
    return R.columns_by_type(_profile(spark, sf_dir, "troubled").columns, shown=2)


@register(
    "r5_issue_summary",
    f"{with_columns('troubled')}, {ISSUE_ROWS} SELECT 'troubled' AS dataset, issue, count(*) AS n_columns, {LABELS} AS label FROM i GROUP BY issue",
)
def r5_issue_summary(spark, sf_dir):
    return L.issue_summary(_profile(spark, sf_dir, "troubled").columns)


def overview_sql(size: str, n_cols: int) -> str:
    """CTE ov(overview) over src."""
    dup = f"CASE WHEN dup > 5 THEN '• Many rows repeat others' END"
    return (
        f"dd AS (SELECT count(*) AS n, {size} AS mb, {DUPLICATE_PCT} AS dup FROM src), ov AS (SELECT concat_ws(chr(10), 'Dataset Overview:',"
        f" '• ' || format('{{:,}}', n) || ' rows and {n_cols} columns', '• Logical size: ' || {fixed('mb', 1)} || ' MB',"
        f" '• ' || {fixed('dup', 1)} || '% of the rows repeat an earlier one', '• ' || {fixed('mb / n * 1024', 2)} || ' KB a row', {dup}) AS overview FROM dd)"
    )


@register("r6_overview_lines", f"WITH src AS ({SOURCES['labelled'][1]}), {overview_sql(SIZE_MB, 7)} SELECT 'labelled' AS dataset, overview FROM ov")
def r6_overview_lines(spark, sf_dir):
    return L.overview_lines(_profile(spark, sf_dir, "labelled").dataset)


@register(
    "r6_overview_lines_duplicates",
    f"WITH src AS ({SOURCES['status_priority'][1]}), {overview_sql('sum(strlen(o_orderstatus) + strlen(o_orderpriority)) / 1048576.0', 2)}"
    " SELECT 'status_priority' AS dataset, overview FROM ov",
)
def r6_overview_lines_duplicates(spark, sf_dir):
    return L.overview_lines(_profile(spark, sf_dir, "status_priority").dataset)


def blocks_sql(name: str) -> str:
    """WITH clause ending in blk(ordinal, name, flags, block)."""
    freq = value_rows(name, ("string", "bool"))
    freq = freq[len(f"WITH src AS ({SOURCES[name][1]}), ") :].replace("CAST(is_long AS VARCHAR)", "CASE WHEN is_long THEN 'True' ELSE 'False' END")
    f1 = lambda x: fixed(x, 1)
    f2 = lambda x: fixed(x, 2)
    num, cat, dat, txt = (f"inferred_type = '{t}'" for t in ("numeric", "categorical", "datetime", "text"))
    lines = [
        f"'• ' || cp.name || ' (' || inferred_type || '): ' || {f1('non_null_pct')} || '% non-null, ' || format('{{:,}}', n_unique) || ' unique values'",
        f"CASE WHEN {num} THEN '  Range: ' || {f2('min')} || ' to ' || {f2('max')} END",
        f"CASE WHEN {num} THEN '  Mean: ' || {f2('mean')} END",
        f"CASE WHEN {num} AND outliers_count > 0 THEN '  Outliers: ' || CAST(outliers_count AS VARCHAR) || ' values' END",
        f"CASE WHEN {num} AND zeros_pct > 5 THEN '  Zeros: ' || {f1('zeros_pct')} || '%' END",
        f"CASE WHEN {cat} THEN '  Most common: ''' || top.value || ''' (' || {f1('top.cnt * 100.0 / non_null')} || '%)' END",
        f"CASE WHEN {cat} AND rare_values > 0 THEN '  Rare values: ' || CAST(rare_values AS VARCHAR) || ' categories' END",
        f"CASE WHEN {dat} THEN '  Date range: ' || left(min_date, 10) || ' to ' || left(max_date, 10) END",
        f"CASE WHEN {dat} THEN '  Coverage: ' || CAST(coverage_days AS VARCHAR) || ' days' END",
        f"CASE WHEN {txt} THEN '  Average length: ' || {f1('avg_length')} || ' characters' END",
        f"CASE WHEN {txt} AND pct_empty > 5 THEN '  Empty: ' || {f1('pct_empty')} || '%' END",
        "'  Flags: ' || iss.labels",
    ]
    return (
        f"{with_columns(name)}, {freq}, {ISSUE_ROWS}, iss AS (SELECT ordinal, string_agg({LABELS}, ', ' ORDER BY pos) AS labels, count(*) AS flags FROM i GROUP BY ordinal),"
        " top AS (SELECT * FROM freq QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY cnt DESC, k0, value) = 1),"
        f" blk AS (SELECT cp.ordinal, cp.name, coalesce(iss.flags, 0) AS flags, concat_ws(chr(10), {', '.join(lines)}) AS block"
        " FROM cp LEFT JOIN iss ON iss.ordinal = cp.ordinal LEFT JOIN top ON top.ordinal = cp.ordinal)"
    )


@register("r7_column_lines", f"{blocks_sql('troubled')} SELECT 'troubled' AS dataset, {big('ordinal')} AS ordinal, name, block FROM blk")
def r7_column_lines(spark, sf_dir):
    return L.column_lines(_profile(spark, sf_dir, "troubled").columns)


@register("r7_column_lines_text", f"{blocks_sql('orders_text')} SELECT 'orders_text' AS dataset, {big('ordinal')} AS ordinal, name, block FROM blk")
def r7_column_lines_text(spark, sf_dir):
    return L.column_lines(_profile(spark, sf_dir, "orders_text").columns)


PRIORITY = "row_number() OVER (ORDER BY flags DESC, name DESC)"


@register(
    "r8_chunk_columns",
    f"{blocks_sql('troubled')} SELECT 'troubled' AS dataset, name, {PRIORITY} AS priority, ({PRIORITY} - 1) // 6 + 1 AS chunk FROM blk",
)
def r8_chunk_columns(spark, sf_dir):
    return L.chunk_columns(_profile(spark, sf_dir, "troubled").columns, 6)


@register(
    "r9_context_chunks",
    f"{blocks_sql('labelled')}, {overview_sql(SIZE_MB, 7)}, ch AS (SELECT *, {PRIORITY} AS p FROM blk),"
    " ctx AS (SELECT (p - 1) // 3 + 1 AS chunk, 'Look: ' || any_value(overview) || chr(10) || chr(10) || 'Column Details:' || chr(10) || string_agg(block, chr(10) ORDER BY p) || '!' AS context"
    " FROM ch, ov GROUP BY 1) SELECT 'labelled' AS dataset, chunk, context, length(context) // 4 AS tokens, length(context) // 4 > 90 AS over_limit FROM ctx",
)
def r9_context_chunks(spark, sf_dir):
    p = _profile(spark, sf_dir, "labelled")
    return L.context_chunks(p.dataset, p.columns, "Look: {statistics}!", size=3, limit=90)


@register(
    "r10_summary_context",
    f"{blocks_sql('labelled')}, {overview_sql(SIZE_MB, 7)}, x AS (SELECT 1 AS o, 0 AS q, overview || chr(10) || chr(10) || 'Columns by type:' AS line FROM ov"
    " UNION ALL SELECT 2, row_number() OVER (ORDER BY inferred_type), '• ' || CAST(count(*) AS VARCHAR) || ' ' || inferred_type || ' columns' FROM cp GROUP BY inferred_type"
    " UNION ALL SELECT 3, 0, chr(10) || 'Flags of the columns:'"
    f" UNION ALL SELECT 4, row_number() OVER (ORDER BY issue), '• ' || CAST(count(*) AS VARCHAR) || ' columns with ' || {LABELS} FROM i GROUP BY issue"
    " UNION ALL SELECT 5, 0, chr(10) || 'Columns with the most flags:'"
    " UNION ALL SELECT 6, rk, block FROM (SELECT *, row_number() OVER (ORDER BY flags DESC, ordinal) AS rk FROM blk) WHERE rk <= 3)"
    " SELECT 'labelled' AS dataset, string_agg(line, chr(10) ORDER BY o, q) AS context FROM x",
)
def r10_summary_context(spark, sf_dir):
    p = _profile(spark, sf_dir, "labelled")
    return L.summary_context(p.dataset, p.columns)


PAIR_TEXT = f"column1 || '-' || column2 || ' (' || {fixed('r', 2)} || ')'"


@register(
    "r11_exploration_digest",
    recommendations_sql("measured")
    + f""", hc AS (SELECT *, row_number() OVER (ORDER BY ordinal1, ordinal2) AS k, count(*) OVER () AS m FROM pairs WHERE abs(r) > 0.7),
    x AS (SELECT 1 AS o, '• Number columns: 5' AS line
    UNION ALL SELECT 2, '• Skewed: ' || string_agg(name, ', ' ORDER BY ordinal) FROM cp WHERE abs(skewness) > 1
    UNION ALL SELECT 3, '• Text columns: 3'
    UNION ALL SELECT 4, '• Many distinct values: ' || string_agg(name, ', ' ORDER BY ordinal) FROM cp WHERE name IN ('text', 'lang', 'source') AND n_unique > 50
    UNION ALL SELECT 5, '• Correlated: ' || string_agg({PAIR_TEXT}, ', ' ORDER BY k) FILTER (k <= 3) || CASE WHEN any_value(m) > 3 THEN ' and ' || CAST(any_value(m) - 3 AS VARCHAR) || ' more' ELSE '' END FROM hc
    UNION ALL SELECT 6, '• Outliers: ' || CAST(sum(outliers_count) AS VARCHAR) || ' in ' || CAST(count(*) AS VARCHAR) || ' columns' FROM cp WHERE outliers_count > 0
    UNION ALL SELECT 7, '• Missing values: ' || CAST(sum(n_rows - non_null) AS VARCHAR) || ' in ' || CAST(count(*) AS VARCHAR) || ' columns' FROM cp WHERE n_rows > non_null
    UNION ALL SELECT 8, '• Recommendations: ' || CAST(count(*) AS VARCHAR) FROM rec)
    SELECT chr(10) || '## Exploration' || chr(10) || string_agg(chr(10) || line, '' ORDER BY o) AS digest FROM x WHERE line IS NOT NULL""",
)
def r11_exploration_digest(spark, sf_dir):
    return R.exploration_digest(source(spark, sf_dir, "measured"))


@register(
    "r12_report_header",
    "SELECT o_orderkey, concat('# Order ', CAST(o_orderkey AS VARCHAR), chr(10), chr(10), '*Generated on ', strftime(o_orderdate, '%d %B %Y at %H:%M'),"
    " ' using Plumbline*', chr(10), chr(10), '---', chr(10)) AS header FROM orders",
)
def r12_report_header(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", X.report_header(title, F.col("o_orderdate").cast("timestamp")).alias("header"))


# -- V: claims -----------------------------------------------------------------

_NUM, _CNT, _SP = r"(\d+(?:\.\d+)?)", r"(\d+(?:,\d+)*)", SPACE + "*"
# What counts as a claim.
CLAIM_PATTERNS = (
    ("percentage", rf"{_NUM}{_SP}%{_SP}(missing|null|empty|complete|non-null)"),
    ("percentage", rf"{_NUM}{_SP}%{_SP}(duplicate|duplicated)"),
    ("percentage", rf"{_NUM}{_SP}%{_SP}(zero|zeros)"),
    ("range", rf"(?:range|ranges?){_SP}:?{_SP}{_NUM}{_SP}(?:to|-){_SP}{_NUM}"),
    ("min_value", rf"(?:min|minimum){_SP}:?{_SP}{_NUM}"),
    ("max_value", rf"(?:max|maximum){_SP}:?{_SP}{_NUM}"),
    ("mean_value", rf"(?:mean|average){_SP}:?{_SP}{_NUM}"),
    ("row_count", rf"{_CNT}{_SP}(?:rows?|records?)"),
    ("column_count", rf"{_CNT}{_SP}(?:columns?)"),
    ("unique_count", rf"{_CNT}{_SP}(?:unique|distinct){_SP}(?:values?)"),
    ("outlier_count", rf"{_CNT}{_SP}(?:outliers?)"),
    ("memory_mb", rf"{_NUM}{_SP}(?:MB|mb|megabytes?)"),
    ("days_count", rf"(\d+){_SP}days?"),
)


def claims_sql(texts: str) -> str:
    """CTEs ending in claims(doc_id, claim_no, type, text, start, end, context, value, min_value, max_value)."""
    parts = []
    for j, (kind, rx) in enumerate(CLAIM_PATTERNS):
        rx = "(?i)" + rx
        value = lambda g: f"CAST(replace(regexp_extract(m, '{rx}', {g}), ',', '') AS DOUBLE)"  # noqa: B023, E731
        ranged = kind == "range"
        parts.append(
            f"SELECT doc_id, {j} AS pat, '{kind}' AS type, m, body, {'NULL' if ranged else value(1)} AS value,"
            f" {value(1) if ranged else 'NULL'} AS min_value, {value(2) if ranged else 'NULL'} AS max_value,"
            " CAST(list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM"
            f" (SELECT doc_id, body, ms, gs, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT doc_id, text AS body, regexp_extract_all(text, '{rx}') AS ms, string_split_regex(text, '{rx}') AS gs FROM ct))"
        )
    context = "substr(body, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0)) || '**' || m || '**' || substr(body, start + length(m) + 1, 50)"
    return (
        f"ct AS ({texts}), cm AS ({' UNION ALL '.join(parts)}), claims AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pat, start) AS claim_no,"
        f' type, m AS text, {big("start")} AS start, {big("start + length(m)")} AS "end", {context} AS context, value, min_value, max_value FROM cm)'
    )


DOCS = "SELECT doc_id, text FROM (" + REPORTS + ")"


@register("v1_extract_claims", f'WITH {claims_sql(DOCS)} SELECT doc_id, claim_no, type, text, start, "end", value, min_value, max_value FROM claims')
def v1_extract_claims(spark, sf_dir):
    return V.extract_claims(reports(spark, sf_dir)).drop("context")


# Claims set into real texts: at their start, at their end, and before every line, numbers varying.
CLAIMED = (
    "SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN concat(CAST(doc_id AS VARCHAR(20)), ' rows, ') ELSE '' END,"
    " CASE WHEN doc_id % 4 = 1 THEN replace(text, chr(10), concat(chr(10), 'Range: 1.5 to ', CAST(n_chars AS VARCHAR(20)), ', 7,', CAST(100 + doc_id % 900 AS VARCHAR(3)), ' outliers, '))"
    " ELSE text END, CASE WHEN doc_id % 5 = 2 THEN concat(' ', CAST(doc_id % 100 AS VARCHAR(3)), '% missing, mean ', CAST(doc_id % 7 AS VARCHAR(3)), '.25 and 3days') ELSE '' END) AS text FROM documents"
)


@register("v1_extract_claims_documents", f"WITH {claims_sql(CLAIMED)} SELECT doc_id, claim_no, type, text, start, context FROM claims")
def v1_extract_claims_documents(spark, sf_dir):
    df = spark.sql(CLAIMED.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
    return V.extract_claims(df).select("doc_id", "claim_no", "type", "text", "start", "context")


@register("v2_claim_context", f"WITH {claims_sql(DOCS)} SELECT doc_id, claim_no, context FROM claims")
def v2_claim_context(spark, sf_dir):
    return V.extract_claims(reports(spark, sf_dir)).select("doc_id", "claim_no", "context")


@register("v3_claim_values", f"WITH {claims_sql(DOCS)} SELECT type, value, min_value, max_value, count(*) AS n FROM claims GROUP BY ALL")
def v3_claim_values(spark, sf_dir):
    found = V.extract_claims(reports(spark, sf_dir))
    return found.groupBy("type", "value", "min_value", "max_value").agg(F.count(F.lit(1)).alias("n"))


def verified_sql() -> str:
    """WITH clause ending in ver(doc_id, claim_no, type, ..., verified, actual_value, discrepancy, column_name)."""
    has = lambda w: f"contains(low, '{w}')"
    missing = f"({has('missing')} OR {has('null')})"
    return f"""{with_columns('labelled')}, {claims_sql(DOCS)},
      dd AS (SELECT count(*) AS n, {SIZE_MB} AS mb, {DUPLICATE_PCT} AS dup FROM src),
      cl AS (SELECT *, lower(context) AS low FROM claims),
      hit AS (SELECT doc_id, claim_no, arg_min(name, ordinal) AS name FROM cl JOIN cp ON contains(low, lower(name)) WHERE type = 'percentage' GROUP BY 1, 2),
      act AS (SELECT cl.*, hit.name AS hit_name, CASE WHEN type = 'row_count' THEN dd.n WHEN type = 'column_count' THEN 7 WHEN type = 'memory_mb' THEN dd.mb
        WHEN type = 'percentage' AND {has('duplicate')} THEN dd.dup
        WHEN type = 'percentage' AND hit.name IS NOT NULL THEN CASE WHEN {missing} AND ({has('non-null')} OR {has('complete')}) THEN cp.non_null_pct
          WHEN {missing} THEN 100 - cp.non_null_pct WHEN {has('zero')} AND cp.inferred_type = 'numeric' THEN cp.zeros_pct END END AS a
        FROM cl CROSS JOIN dd LEFT JOIN hit ON hit.doc_id = cl.doc_id AND hit.claim_no = cl.claim_no LEFT JOIN cp ON cp.name = hit.name),
      jud AS (SELECT *, coalesce(abs(a - value) <= CASE WHEN type = 'row_count' THEN greatest(1, a * 0.01) WHEN type = 'column_count' THEN 0
        WHEN type = 'memory_mb' THEN greatest(0.1, a * 0.1) WHEN {has('duplicate')} THEN 1.0 ELSE 2.0 END, false) AS verified FROM act),
      ver AS MATERIALIZED (SELECT *, CASE WHEN NOT verified AND a IS NOT NULL THEN CASE WHEN type = 'percentage' THEN {fixed('abs(a - value)', 1)} || ' percentage points'
        ELSE {fixed('abs(a - value) / a * 100', 1)} || '% difference' END END AS discrepancy,
        CASE WHEN type = 'percentage' AND NOT {has('duplicate')} AND a IS NOT NULL THEN hit_name END AS column_name FROM jud)"""


def verified(spark, sf_dir):
    p = _profile(spark, sf_dir, "labelled")
    found = V.extract_claims(reports(spark, sf_dir)).withColumn("dataset", F.lit("labelled"))
    return V.verify_claims(found, p.dataset, p.columns)


@register("v4_verify_claims", f"{verified_sql()} SELECT doc_id, claim_no, type, verified, {rnd('a')} AS actual_value FROM ver WHERE type <> 'percentage' OR contains(low, 'duplicate')")
def v4_verify_claims(spark, sf_dir):
    v = verified(spark, sf_dir).where((F.col("type") != "percentage") | F.contains(F.lower("context"), F.lit("duplicate")))
    return v.select("doc_id", "claim_no", "type", "verified", "actual_value")


@register(
    "v5_verify_column_claims",
    f"{verified_sql()} SELECT doc_id, claim_no, verified, {rnd('a')} AS actual_value, column_name FROM ver WHERE type = 'percentage' AND NOT contains(low, 'duplicate')",
)
def v5_verify_column_claims(spark, sf_dir):
    v = verified(spark, sf_dir).where((F.col("type") == "percentage") & ~F.contains(F.lower("context"), F.lit("duplicate")))
    return v.select("doc_id", "claim_no", "verified", "actual_value", "column_name")


@register("v6_discrepancy", f"{verified_sql()} SELECT type, discrepancy, verified, count(*) AS n FROM ver GROUP BY ALL")
def v6_discrepancy(spark, sf_dir):
    return verified(spark, sf_dir).groupBy("type", "discrepancy", "verified").agg(F.count(F.lit(1)).alias("n"))


NOTE = (
    "CAST(i AS VARCHAR) || '. **' || context || '**  ' || chr(10) || '   ⚠️ ' || CASE WHEN a IS NOT NULL THEN '*Auto-corrected: actual value is ' || "
    + fixed("a", 1)
    + " || ' (' || discrepancy || ')*' ELSE '*Could not verify this claim against source data*' END || chr(10)"
)
NOTES = (
    f"{verified_sql()}, fl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY claim_no) AS i FROM ver WHERE NOT verified),"
    " nt AS (SELECT doc_id, '## Verification Notes' || chr(10) || chr(10) || '*The following numeric claims in this report have been automatically cross-checked against the source data:*'"
    f" || chr(10) || chr(10) || string_agg({NOTE}, chr(10) ORDER BY i) AS notes FROM fl GROUP BY doc_id)"
)


@register("v7_claim_notes", f"{NOTES} SELECT * FROM nt")
def v7_claim_notes(spark, sf_dir):
    return V.claim_notes(verified(spark, sf_dir))


@register(
    "v8_annotate",
    f"{NOTES} SELECT ct.doc_id, ct.text || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || nt.notes, '') AS text FROM ct LEFT JOIN nt ON nt.doc_id = ct.doc_id",
)
def v8_annotate(spark, sf_dir):
    return V.annotate(reports(spark, sf_dir), verified(spark, sf_dir))


BAD = "count(*) FILTER (NOT verified)"


@register(
    "v9_verification_summary",
    f"{verified_sql()} SELECT type, count(*) AS claims, {BAD} AS failures, {rnd(f'100 - {BAD} * 100.0 / count(*)')} AS success_pct, 100 - {BAD} * 100.0 / count(*) < 90 AS warning FROM ver GROUP BY type",
)
def v9_verification_summary(spark, sf_dir):
    return V.verification_summary(verified(spark, sf_dir), ["type"])
