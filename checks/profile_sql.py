"""The column profile in plain SQL, written independently of the Spark plan: one aggregate per column."""

from __future__ import annotations

from .base import SOURCES

SPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
NUMBER = rf"^{SPACE}*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?{SPACE}*$"

MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?"
)
# Shape, rewrite to ISO order, and what else the rewrite needs: a month by name, a zone.
DATES = (
    (r"^(\d{4})-(\d{2})-(\d{2})$", r"\1-\2-\3", ""),
    (r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}(\.\d{1,6})?)$", r"\1 \2", ""),
    (r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}(\.\d{1,6})?)$", r"\1 \2", ""),
    (r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(Z|[+-]\d{2}:\d{2})$", r"\1 \2\3", "zone"),
    (r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})$", r"\1 \2:00", ""),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"\3-\1-\2", ""),
    (r"^(\d{4})/(\d{2})/(\d{2})$", r"\1-\2-\3", ""),
    (r"^(\d{4})(\d{2})(\d{2})$", r"\1-\2-\3", ""),
    (r"^(\d{4})-(\d{2})$", r"\1-\2-01", ""),
    (r"^(\d{4})$", r"\1-01-01", ""),
    (rf"(?i)^({MONTHS}) (\d{{1,2}}),? (\d{{4}})$", r"\3-\1-\2", "month"),
    (rf"(?i)^(\d{{1,2}})[ -]({MONTHS})[ -](\d{{4}})$", r"\3-\2-\1", "month"),
)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def rnd(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 4) + 0.0"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN try_cast({strip(x)} AS DOUBLE) END"


def date(x: str, i: int) -> str:
    shape, rewrite, extra = DATES[i]
    iso = f"regexp_replace({x}, '{shape}', '{rewrite}')"
    if extra == "month":
        name = f"left(regexp_extract({iso}, '[A-Za-z]+'), 3)"
        number = f"CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower({name})) + 2) // 3 AS VARCHAR)"
        iso = f"regexp_replace({iso}, '[A-Za-z]+', {number})"
    parsed = f"try_cast({iso} AS TIMESTAMP)"
    if extra == "zone":
        parsed = f"make_timestamp(epoch_us(try_cast({iso} AS TIMESTAMPTZ)))"
    ts = f"CASE WHEN regexp_matches({x}, '{shape}') THEN {parsed} END"
    return f"CASE WHEN year({ts}) BETWEEN 1678 AND 2261 THEN {ts} END"


def isoformat(x: str) -> str:
    return (
        f"CASE WHEN date_trunc('second', {x}) = {x} THEN strftime({x}, '%Y-%m-%dT%H:%M:%S')"
        f" ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def fixed(x: str, places: int) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(30,8)), {places}) AS DECIMAL(30,{places})) AS VARCHAR)"


def _column(i: int, name: str, kind: str, src: str) -> str:
    label = f"CASE WHEN {name} THEN 'True' WHEN NOT {name} THEN 'False' END" if kind == "bool" else f"CAST({name} AS VARCHAR)"
    number = f"CAST({name} AS DOUBLE)" if kind == "number" else num(name) if kind == "string" else "CAST(NULL AS DOUBLE)"
    none = "CAST(NULL AS TIMESTAMP)"
    dates = [date(name, j) if kind == "string" else none for j in range(len(DATES))]
    stamps = ", ".join(f"{d} AS d{j}" for j, d in enumerate(dates))
    physical = {"number": "'numeric'", "bool": "'categorical'", "time": "'datetime'"}.get(kind)
    n_dates = "greatest(" + ", ".join(f"count(d{j})" for j in range(len(DATES))) + ")"
    first = "coalesce(" + ", ".join(f"CASE WHEN count(d{j}) = count(x) THEN min(d{j}) END" for j in range(len(DATES))) + ")"
    last = first.replace("min(", "max(")
    if kind == "time":
        first, last = "min(x)", "max(x)"
    inferred = physical or (
        "CASE WHEN non_null > 0 AND n_dates = non_null THEN 'datetime' WHEN n_num = non_null THEN 'numeric'"
        " WHEN n_unique < 0.2 * non_null OR n_unique <= 50 THEN 'categorical' ELSE 'text' END"
    )
    text = kind == "string"
    return f"""
SELECT {i} AS ordinal, '{name}' AS name, {inferred} AS inferred_type, a.*,
  (SELECT count(*) FROM e WHERE num < q1 - 1.5 * (q3 - q1) OR num > q3 + 1.5 * (q3 - q1)) AS outliers,
  (SELECT count(*) FROM (SELECT count(*) AS c FROM e WHERE x IS NOT NULL GROUP BY x) g WHERE g.c < greatest(1, a.n_rows * 0.01)) AS rare
FROM (WITH e AS (SELECT {name} AS x, {label} AS label, {number} AS num, {stamps} FROM {src}) SELECT
  count(*) AS n_rows, count(x) AS non_null, count(DISTINCT x) AS n_unique, count(num) AS n_num, {n_dates} AS n_dates,
  avg(num) AS mean, stddev_samp(num) AS std, min(num) AS lo, max(num) AS hi,
  quantile_cont(num, 0.25) AS q1, quantile_cont(num, 0.5) AS median, quantile_cont(num, 0.75) AS q3,
  count(*) FILTER (num < 0) AS negative, count(*) FILTER (num = 0) AS zeros,
  skewness(num) AS skew, kurtosis(num) AS kurt, {first} AS first, {last} AS last,
  {"avg(length(x))" if text else "CAST(NULL AS DOUBLE)"} AS avg_length,
  {"count(*) FILTER (x = '')" if text else "CAST(NULL AS BIGINT)"} AS empties,
  {"coalesce(sum(strlen(x)), 0)" if text else "0"} AS text_bytes
  FROM e) a, (SELECT 1) one""".replace(
        "FROM e WHERE", f"FROM (SELECT {name} AS x, {number} AS num FROM {src}) e WHERE"
    )


def raw_columns(name: str, src: str = "src") -> str:
    """A row per column with everything counted, types not yet applied."""
    kinds = SOURCES[name][0]
    return " UNION ALL ".join(_column(i, c, k, src) for i, (c, k) in enumerate(kinds.items()))


def with_columns(name: str) -> str:
    """WITH clause: src, then cp, the column profile."""
    n = "non_null"
    numeric = lambda x: f"CASE WHEN inferred_type = 'numeric' THEN {x} END"
    number = lambda x: numeric(f"coalesce({x}, 0.0)")
    share = lambda x: f"coalesce({x} * 100.0 / nullif({n}, 0), 0.0)"
    when = lambda t, x: f"CASE WHEN inferred_type = '{t}' AND {n} > 0 THEN {x} END"
    flags = [
        ("high_missing", f"{n} * 100.0 / n_rows < 80"),
        ("likely_id", "n_unique * 1.0 / n_rows > 0.95"),
        ("extreme_outliers", "inferred_type = 'numeric' AND outliers > n_rows * 0.05"),
        ("skewed", "inferred_type = 'numeric' AND abs(mean - (q1 + q3) / 2) > abs(q3 - q1)"),
        ("many_rare_categories", "inferred_type = 'categorical' AND rare > 10"),
        ("mostly_empty", f"inferred_type = 'text' AND empties * 100.0 / nullif({n}, 0) > 50"),
    ]
    issues = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in flags) + ")"
    return f"""WITH src AS ({SOURCES[name][1]}), raw AS MATERIALIZED ({raw_columns(name)}), cp AS MATERIALIZED (SELECT
  ordinal, name, inferred_type, n_rows, non_null, {n} * 100.0 / n_rows AS non_null_pct, n_unique,
  {number("mean")} AS mean, CASE WHEN inferred_type = 'numeric' THEN CASE WHEN {n} = 0 THEN 0.0 ELSE std END END AS std,
  {number("lo")} AS min, {number("hi")} AS max, {number("q1")} AS q1, {number("median")} AS median, {number("q3")} AS q3,
  {numeric("outliers")} AS outliers_count, {numeric(share("outliers"))} AS outliers_pct,
  {numeric("negative")} AS negative_count, {numeric(share("negative"))} AS negative_pct,
  {numeric("zeros")} AS zeros_count, {numeric(share("zeros"))} AS zeros_pct,
  {number("skew")} AS skewness, {number("kurt")} AS kurtosis, {when("categorical", "rare")} AS rare_values,
  {when("datetime", isoformat("first"))} AS min_date, {when("datetime", isoformat("last"))} AS max_date,
  {when("datetime", "date_sub('day', first, last)")} AS coverage_days, {when("text", "avg_length")} AS avg_length,
  {when("text", share("empties"))} AS pct_empty, text_bytes, {issues} AS quality_issues FROM raw WHERE n_rows > 0)"""


COLUMNS = {
    "ordinal": "int", "name": "str", "inferred_type": "str", "n_rows": "int", "non_null": "int", "non_null_pct": "dbl",
    "n_unique": "int", "mean": "dbl", "std": "dbl", "min": "dbl", "max": "dbl", "q1": "dbl", "median": "dbl", "q3": "dbl",
    "outliers_count": "int", "outliers_pct": "dbl", "negative_count": "int", "negative_pct": "dbl", "zeros_count": "int",
    "zeros_pct": "dbl", "skewness": "dbl", "kurtosis": "dbl", "rare_values": "int", "min_date": "str", "max_date": "str",
    "coverage_days": "int", "avg_length": "dbl", "pct_empty": "dbl", "quality_issues": "str",
}


def pick(*names: str, **renamed: str) -> str:
    """Select list over cp with result types; keywords rename."""
    out = []
    for alias, n in [*((n, n) for n in names), *renamed.items()]:
        kind = COLUMNS[n]
        out.append((big(n) if kind == "int" else rnd(n) if kind == "dbl" else n) + f" AS {alias}")
    return ", ".join(out)


def columns_sql(name: str, select: str, where: str = "TRUE") -> str:
    return f"{with_columns(name)} SELECT {select} FROM cp WHERE {where}"


def per_column(name: str, kinds: tuple[str, ...], select: str) -> str:
    """One simple aggregate per column of the given kinds; ``select`` uses {c}."""
    cols = [(i, c) for i, (c, k) in enumerate(SOURCES[name][0].items()) if k in kinds]
    parts = [f"SELECT {big(str(i))} AS ordinal, '{c}' AS name, {select.format(c=c)} FROM src" for i, c in cols]
    return f"WITH src AS ({SOURCES[name][1]}) " + " UNION ALL ".join(parts)


def value_rows(name: str, kinds: tuple[str, ...] = ("number", "string", "time", "bool")) -> str:
    """WITH clause: src, then freq(ordinal, name, value, cnt, k1, k2) over text values; k1, k2 order ties."""
    parts = []
    for i, (c, k) in enumerate(SOURCES[name][0].items()):
        if k not in kinds:
            continue
        order = f"CAST({c} AS DOUBLE)" if k == "number" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS ordinal, '{c}' AS name, CAST({c} AS VARCHAR) AS value, {order} AS k0, count(*) AS cnt"
            f" FROM src WHERE {c} IS NOT NULL GROUP BY {c}"
        )
    body = " UNION ALL ".join(parts)
    return f"WITH src AS ({SOURCES[name][1]}), freq AS (SELECT *, left(value, 64) AS k1, md5(value) AS k2 FROM ({body}))"
