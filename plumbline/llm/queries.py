"""The registered queries: each applies one operator to its whole table and derives the columns to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    backoff,
    decontaminate,
    divergence,
    html,
    infill,
    language,
    mixing,
    partenum,
    quality,
    repeats,
    sharding,
    simhash,
    toxicity,
)
from plumbline.llm.registry import register, table


@register("op2_simhash_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
item_at AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized),
item_windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM item_at),
doc_at AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM d, (SELECT DISTINCT size FROM sized) s WHERE len(w) >= size),
found AS (SELECT rid, i, a.size, item_id FROM doc_at a
    JOIN item_windows x ON a.size = x.size AND array_to_string(a.w[i:i + a.size - 1], ' ') = x.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


@register("op8_benchmark_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )



@register("op5_external_shuffle_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


OP7_SQL = """
WITH d AS (SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
weighed AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM named),
levels AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    AS level FROM weighed),
goals AS (SELECT *, least(cap, max(level) OVER () * w) AS target FROM levels),
wanted AS (SELECT *, CAST(round(target) AS HUGEINT) AS want FROM goals),
ends AS (SELECT *, CAST(sum(want) OVER (ORDER BY place) AS HUGEINT) AS upto, CAST(sum(want) OVER () AS HUGEINT) AS every FROM wanted),
grid AS (SELECT *, CAST(CASE WHEN every <= 64 THEN 1 ELSE pow(2, length(bin(CAST((every + 63) // 64 - 1 AS BIGINT)))) END AS HUGEINT) AS slots FROM ends),
shares AS (SELECT *, CASE WHEN every = 0 THEN 0 ELSE (upto * slots + every - 1) // every - ((upto - want) * slots + every - 1) // every END AS n,
    greatest(1, (every + slots - 1) // slots) AS block FROM grid),
limits AS (SELECT source, source_size, target, CAST(least(want, n * block) AS BIGINT) AS take FROM shares),
placed AS (SELECT doc_id, size, source, coalesce(CAST(sum(size) OVER
    (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target, CAST(
    greatest(0, least(pos + size, take) - pos) + greatest(0, least(source_size + pos + size, take) - source_size - pos) AS BIGINT) AS taken
FROM placed p JOIN limits l ON p.source IS NOT DISTINCT FROM l.source
"""


@register("op7_low_discrepancy_mix", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op10_subsequence_kernel_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@register("op1_composite_text_density")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op3_string_kernel_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1) GROUP BY rid),
line AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM line GROUP BY rid),
parted AS (SELECT rid, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w FROM (SELECT DISTINCT rid, x FROM line)),
judged AS (SELECT rid, x, 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > 10 * len(w)
    OR len(w) >= 5 AND 100 * (len(regexp_extract_all(x, '!!')) + len(regexp_extract_all(x, '\\?\\?')) + len(regexp_extract_all(x, '[.]{4}'))) > 10 * len(w)
    OR len(w) >= 5 AND 100 * len(list_filter(w, lambda y: regexp_matches(y, '\\p{Lu}.*\\p{Lu}') AND NOT regexp_matches(y, '\\p{Ll}'))) > 50 * len(w)
    OR len(w) >= 4 AND 100 * len(list_filter(w, lambda y: regexp_matches(y, '^[|»›•·>/]$'))) > 30 * len(w)
    OR {boilerplate} AS failed FROM parted),
good AS (SELECT rid, coalesce(sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (WHERE NOT failed), 0) AS chars,
    count(*) FILTER (WHERE failed) AS failed FROM judged GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(good.failed, 0) AS n_failed_lines, length(array_to_string(w, '')) - coalesce(good.chars, 0) AS lost_chars
    FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN good USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept,
    n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars FROM f
""".replace("{boilerplate}", " OR ".join(f"contains(lower(x), '{m}')" for m in quality.BOILERPLATE))


@register("op4_line_first_cleaning", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.clean(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_failed_lines", "lost_chars",
    )


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tok AS (SELECT rid, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS p FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
uni AS (SELECT x, count(*) AS c FROM tok GROUP BY x),
bi AS (SELECT p, x, count(*) AS c FROM tok WHERE p IS NOT NULL GROUP BY p, x),
every AS (SELECT count(*) AS n FROM tok),
each AS (SELECT rid, CASE WHEN bi.c >= 2 THEN ln(bi.c / ctx.c::DOUBLE)
    WHEN t.p IS NOT NULL THEN ln(uni.c / every.n::DOUBLE) + ln(0.4::DOUBLE) ELSE ln(uni.c / every.n::DOUBLE) END AS s
    FROM tok t JOIN uni ON t.x = uni.x CROSS JOIN every
    LEFT JOIN bi ON bi.p = t.p AND bi.x = t.x LEFT JOIN uni ctx ON ctx.x = t.p),
total AS (SELECT rid, count(*) AS n_words, sum(s) AS s FROM each GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(s, 0.0), 3) AS log_score,
    round(s / n_words, 4) AS per_word FROM d LEFT JOIN total USING (rid)
"""


@register("op6_stupid_backoff", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_word(backoff.scored(table(spark, sf_dir, "documents"), order=2, min_count=2))


def per_word(rows: DataFrame) -> DataFrame:
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return rows.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round(mean, 4).alias("per_word"))


#: Order 3, every n-gram counted: each word has a longest n-gram that was seen at least here, in its own text.
OP6_TRIGRAMS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tok AS (SELECT rid, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q
    FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
uni AS (SELECT x, count(*) AS c FROM tok GROUP BY x),
bi AS (SELECT p, x, count(*) AS c FROM tok WHERE p IS NOT NULL GROUP BY p, x),
tri AS (SELECT q, p, x, count(*) AS c FROM tok WHERE q IS NOT NULL GROUP BY q, p, x),
every AS (SELECT count(*) AS n FROM tok),
each AS (SELECT rid, CASE WHEN t.q IS NOT NULL THEN ln(tri.c / pair.c::DOUBLE)
    WHEN t.p IS NOT NULL THEN ln(bi.c / ctx.c::DOUBLE) ELSE ln(uni.c / every.n::DOUBLE) END AS s
    FROM tok t JOIN uni ON t.x = uni.x CROSS JOIN every
    LEFT JOIN bi ON bi.p = t.p AND bi.x = t.x LEFT JOIN uni ctx ON ctx.x = t.p
    LEFT JOIN tri ON tri.q = t.q AND tri.p = t.p AND tri.x = t.x LEFT JOIN bi pair ON pair.p = t.q AND pair.x = t.p),
total AS (SELECT rid, count(*) AS n_words, sum(s) AS s FROM each GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(s, 0.0), 3) AS log_score,
    round(s / n_words, 4) AS per_word FROM d LEFT JOIN total USING (rid)
"""


@register("op6_stupid_backoff_trigrams", OP6_TRIGRAMS_SQL)
def op6_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_word(backoff.scored(table(spark, sf_dir, "documents")))


@register("op9_sparse_suffix_repeats")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tok,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, tok, CAST(len(tok) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(tok[1:a], '') AS p, array_to_string(tok[a + 1:b], '') AS m, array_to_string(tok[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM parts
"""


@register("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tok AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
lt AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS cnt FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, sum(cnt) AS N, CAST(count(*) AS HUGEINT) AS V FROM lt GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gt AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS cnt FROM tok SEMI JOIN lt USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(cnt), 0) AS N FROM g LEFT JOIN gt USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(gt.cnt, 0) AS cnt,
    CAST(1 + 1000000000 * (coalesce(gt.cnt, 0) + 2) // (gn.N + 2 * l.V) AS HUGEINT) AS p,
    CAST(1 + 1000000000 * (lt.cnt + 2) // (l.N + 2 * l.V) AS HUGEINT) AS q
    FROM gn JOIN lt USING (lang) JOIN l USING (lang) LEFT JOIN gt USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE cnt > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


@register("op11_source_divergence", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
n AS MATERIALIZED (SELECT rid, doc_id, len(sh) AS n FROM s),
x AS MATERIALIZED (SELECT rid, len(sh) AS n, unnest(sh) AS g FROM s),
links AS MATERIALIZED (SELECT a.rid AS u, b.rid AS v FROM x a JOIN x b ON a.g = b.g AND a.rid <> b.rid
    AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT rid, rid AS seen FROM n UNION SELECT r.rid, l.v FROM reach r JOIN links l ON r.seen = l.u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(m.doc_id) AS component_id
FROM n JOIN reach r ON n.rid = r.rid JOIN n m ON m.rid = r.seen GROUP BY n.rid, n.doc_id, n.n
"""


@register("op12_partenum_jaccard", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_groups(table(spark, sf_dir, "documents"))
