"""The corpus operators as named queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog.llm import conversation_trie, decontaminate, fingerprints, html_extract, licenses, line_dedup, mixing, near_dedup, quality, quality_rules, spelling, substring_dedup, toxicity
from cedarlog.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _scored(docs: DataFrame, held_out, score, threshold: float) -> DataFrame:
    out = docs.select("doc_id", held_out.alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"


_LINE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS k,
             CASE WHEN coalesce(text, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS ls,
             coalesce(text, '') AS text FROM documents),
  l AS (SELECT k, generate_subscripts(ls, 1) AS p, unnest(ls) AS line FROM d),
  w1 AS (SELECT k, p, 1 AS n, line AS h FROM l WHERE length(line) >= {line_dedup.MIN_CHARS}
    UNION ALL SELECT k, p, n, array_to_string(ls[p : p + n - 1], chr(10)) FROM (
      SELECT k, ls, n, unnest(generate_series(1, len(ls) - n + 1)) AS p FROM d, (SELECT unnest(generate_series(2, {line_dedup.MIN_LINES} - 1)) AS n))
    WHERE list_sum(list_transform(ls[p : p + n - 1], lambda x: length(x))) >= {line_dedup.MIN_CHARS}),
  wm AS (SELECT k, p, {line_dedup.MIN_LINES} AS n,
           array_to_string(ls[p : p + {line_dedup.MIN_LINES} - 1], chr(10)) AS h
         FROM (SELECT k, ls, unnest(generate_series(1, len(ls) - {line_dedup.MIN_LINES} + 1)) AS p FROM d)),
  later AS (SELECT k, p, n FROM (SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY k, p) AS i
            FROM (SELECT * FROM w1 UNION ALL SELECT * FROM wm)) WHERE i > 1),
  gone AS (SELECT DISTINCT k, unnest(generate_series(p, p + n - 1)) AS p FROM later),
  kept AS (SELECT k, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed,
             string_agg(line, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL) AS t
           FROM l LEFT JOIN gone g USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)"""


@query("op1_line_dedup", _LINE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select(
        "row.doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


_MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS BIGINT) AS size,
             substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))), 1, 15) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s,
          CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS w
        FROM d GROUP BY source),
  o AS (SELECT *, sum(s) OVER () AS t, coalesce(sum(s) OVER before, 0) AS sb,
          sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS wf
        FROM s WINDOW before AS (ORDER BY s * 10 // w, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c AS (SELECT *, (t - 3 * sb) * w > 3 * s * wf AS capped FROM o),
  f AS (SELECT *, t - 3 * coalesce(sum(s) FILTER (WHERE capped) OVER (), 0) AS free,
          sum(w) FILTER (WHERE NOT capped) OVER () AS wu FROM c),
  g AS (SELECT source, CAST(s AS BIGINT) AS source_size,
          CASE WHEN capped THEN CAST(3 * s AS DOUBLE) ELSE CAST(free AS DOUBLE) * CAST(w AS DOUBLE) / CAST(wu AS DOUBLE) END AS target
        FROM f),
  b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM g),
  q AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base, target - base * source_size AS rest,
          sum(size) OVER (PARTITION BY b.source ORDER BY h) AS until,
          sum(size) OVER (PARTITION BY b.source, h) AS tied
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (base + CASE WHEN rest > 0 AND (until + until - tied) / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q"""


@query("op2_mixing", _MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "license.*").drop("detections")


_NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT min(k) AS k, ws, CASE WHEN len(ws) = 0 THEN t END AS bare FROM (
    SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k, coalesce(text, '') AS t,
      regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents) GROUP BY 2, 3),
  own AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, coalesce(text, '') AS t,
      regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
  sh AS (SELECT k, s, count(*) AS c FROM (
      SELECT k, array_to_string(ws[p : p + 4], ' ') AS s
      FROM (SELECT k, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS p FROM d WHERE len(ws) > 0)) GROUP BY 1, 2),
  n AS (SELECT k, sum(c) AS n FROM sh GROUP BY 1),
  pr AS (SELECT a.k AS u, b.k AS v, sum(least(a.c, b.c)) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
  ln AS (SELECT u, v FROM pr JOIN n x ON x.k = u JOIN n y ON y.k = v WHERE i >= 0.8 * (x.n + y.n - i)),
  e AS (SELECT u, v FROM ln UNION SELECT v, u FROM ln),
  walk AS (SELECT k, k AS root FROM d UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.k),
  comp AS (SELECT k, min(root) AS root FROM walk GROUP BY 1),
  placed AS (SELECT own.doc_id, own.t, comp.root FROM own
    JOIN d ON d.ws = own.ws AND (len(own.ws) > 0 OR d.bare = own.t) JOIN comp ON comp.k = d.k),
  named AS (SELECT root, count(DISTINCT (doc_id, t)) AS class_size FROM placed GROUP BY 1)
SELECT placed.doc_id, own.doc_id AS class_id, class_size
FROM placed JOIN named USING (root) JOIN own ON own.r = placed.root"""


@query("op4_near_dedup", _NEAR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.label(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return _scored(docs, quality.held_out(), quality.scorer(docs, model), quality.THRESHOLD)


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return fingerprints.with_next(docs, fingerprints.lexicon(docs)).withColumnRenamed("id", "doc_id")


@query("op7_html_extract")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.held_out(), toxicity.scorer(docs, model), toxicity.THRESHOLD)


_LEAK_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS k,
             regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
  b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
  w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, ws[p : p + least(len(ws), 10) - 1] AS h
        FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS p FROM b WHERE len(ws) > 0)),
  sizes AS (SELECT DISTINCT n FROM w),
  dw AS (SELECT k, p, n, ws[p : p + n - 1] AS h
         FROM (SELECT k, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, sizes)),
  hit AS (SELECT k, p, dw.n, item_id FROM dw JOIN w ON dw.n = w.n AND dw.h = w.h),
  pos AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY k),
  its AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)"""


@query("op10_decontaminate", _LEAK_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


_SPAN_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS k,
             regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws FROM documents),
  w AS (SELECT k, p, md5(array_to_string(ws[p : p + 19], ' ')) AS h
        FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 19)) AS p FROM d)),
  later AS (SELECT k, p FROM (SELECT k, p, row_number() OVER (PARTITION BY h ORDER BY k, p) AS i FROM w) WHERE i > 1),
  gone AS (SELECT DISTINCT k, unnest(generate_series(p, p + 19)) AS p FROM later),
  l AS (SELECT k, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM d),
  kept AS (SELECT k, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY l.p) FILTER (WHERE g.p IS NULL) AS t
           FROM l LEFT JOIN gone g USING (k, p) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)"""


@query("op9_substring_dedup", _SPAN_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"))
    return out.select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def _em_sql() -> str:
    """The rules, counts and rounds of ``quality_rules`` as one statement, a round after the other."""
    q = quality_rules
    rules, k, up, down = q.RULES, q.PRIOR_SHARE, "c * p", "c * (1 - p)"

    def part(weight: str, j: int, vote: str) -> str:
        return f"coalesce(sum({weight}) FILTER (WHERE v{j} {vote}), 0)"

    white = "translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '      ')"
    count = "length(regexp_replace(t, '[^{}]', '', 'g'))".format
    ends = " + ".join(f"length(flat) - length(replace(flat, '{m} ', '{m}'))" for m in ".!?")
    common = ", ".join(f"'{w}'" for w in q.COMMON)
    cast = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in q.COUNTS)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{j}" for j, r in enumerate(rules))
    names = ", ".join(f"v{j}" for j in range(len(rules)))
    odds = " + ".join(
        f"CASE v{j} WHEN 1 THEN ln(a{j} / (1 - b{j})) WHEN -1 THEN ln((1 - a{j}) / b{j}) ELSE 0 END" for j in range(len(rules))
    )
    steps = [f"m0 AS (SELECT CAST({q.PRIOR_BALANCE} AS DOUBLE) AS balance, "
             + ", ".join(f"CAST({q.PRIOR_GOOD} AS DOUBLE) AS a{j}, CAST({q.PRIOR_BAD} AS DOUBLE) AS b{j}" for j in range(len(rules))) + ")"]
    posterior = f"1 / (1 + exp(-(ln(balance / (1 - balance)) + {odds})))"
    for i in range(q.ROUNDS):
        new = ", ".join(
            f"({part(up, j, '= 1')} + {k * q.PRIOR_GOOD} * sum(c)) / ({part(up, j, '<> 0')} + {k} * sum(c)) AS a{j}, "
            f"({part(down, j, '= -1')} + {k * q.PRIOR_BAD} * sum(c)) / ({part(down, j, '<> 0')} + {k} * sum(c)) AS b{j}"
            for j in range(len(rules))
        )
        steps.append(f"e{i} AS MATERIALIZED (SELECT pat.*, {posterior} AS p FROM pat, m{i})")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT (sum(c * p) + {k * q.PRIOR_BALANCE} * sum(c)) / (sum(c) + {k} * sum(c)) AS balance, {new} FROM e{i})")
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS k, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS ws FROM documents),
  f AS (SELECT *, {white} || ' ' AS flat, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
  w AS (SELECT k, p, ws[p : p + 2] AS h FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM d)),
  rep AS (SELECT k, count(DISTINCT q) AS n_repeat_words FROM (
            SELECT k, unnest([p, p + 1, p + 2]) AS q FROM (SELECT k, p, count(*) OVER (PARTITION BY k, h) AS n FROM w) WHERE n > 1)
          GROUP BY k),
  g AS (SELECT doc_id, k, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
          {count(q.SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
          len(ls) AS n_lines, {count(q.MARKS)} AS n_marks, {ends} AS n_ends,
          len(list_filter(ws, lambda x: x IN ({common}))) AS n_common, len(list_distinct(ws)) AS n_distinct,
          {count("0-9")} AS n_digits, {count("A-Z")} AS n_capitals
        FROM f LEFT JOIN rep USING (k)),
  v AS MATERIALIZED (SELECT *, {votes} FROM (SELECT doc_id, k, {cast} FROM g)),
  pat AS MATERIALIZED (SELECT {names}, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY ALL),
  {", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {q.BASE_FAILED} AS base_failed,
  NOT ({q.BASE_FAILED}) AND {posterior} >= {q.THRESHOLD} AS kept
FROM v, m{q.ROUNDS}"""


@query("op13_quality_rules", _em_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: CRC-32 of a text: its table from the polynomial, then one step a byte.
_CRC_TABLE_SQL = """SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda x: CAST(0 AS BIGINT))),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)"""


def _crc_sql(blob: str) -> str:
    codes = f"list_transform(range(octet_length({blob})), lambda i: CAST(('0x' || substr(hex({blob}), 2 * i + 1, 2)) AS BIGINT))"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"
    )


_TRIE_SQL = f"""
WITH crc AS ({_CRC_TABLE_SQL}),
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
          {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
  o AS (SELECT conv_id, list(x ORDER BY pos) AS xs, conv_id - conv_id % 5 AS base,
          {_crc_sql("encode(CAST(conv_id AS VARCHAR))")} % 9 AS h FROM t, (SELECT tab FROM crc) GROUP BY conv_id, tab),
  s AS (SELECT o.conv_id, list_concat(coalesce(b.xs[1 : o.h], []), o.xs[o.h + 1 :]) AS xs
        FROM o LEFT JOIN o b ON b.conv_id = o.base),
  p AS (SELECT conv_id, xs, len(xs) AS n, unnest(generate_series(0, len(xs))) AS depth FROM s),
  nd AS (SELECT xs[1 : depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM p GROUP BY 1, 2),
  kids AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY 1),
  f AS (SELECT nd.*, coalesce(n_children, 0) AS n_children,
          CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[-1].t) END AS own FROM nd LEFT JOIN kids USING (path)),
  up AS (SELECT path[1 : d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved
         FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN up USING (path) LEFT JOIN nd q ON f.depth > 0 AND q.path = f.path[1 : f.depth - 1]"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


_SPELL_SQL = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE_SQL}),
  u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all({_LOWER}, '[{spelling.LETTERS}]{{{spelling.MIN_CHARS},}}')) AS run
        FROM documents),
  h AS (SELECT run, {_crc_sql("encode(id || run)")} AS h FROM u, crc),
  w AS (SELECT CASE WHEN h % {spelling.EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
          ELSE run END AS word FROM h),
  v AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= {spelling.MIN_CHARS} GROUP BY 1 HAVING count(*) >= {spelling.MIN_COUNT}),
  dl AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM v)),
  nr AS (SELECT a.word, b.word AS near FROM dl a JOIN dl b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT dl.word, v.word FROM dl JOIN v ON v.word = dl.rest UNION SELECT v.word, dl.word FROM dl JOIN v ON v.word = dl.rest),
  b AS (SELECT nr.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS form, max(v.n) AS form_n FROM nr JOIN v ON v.word = nr.near GROUP BY 1),
  f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.TIMES} * n THEN form END AS form,
          CASE WHEN form_n >= {spelling.TIMES} * n THEN form_n END AS form_n FROM v LEFT JOIN b USING (word)),
  walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f g ON g.word = walk.at AND g.form IS NULL"""


@query("op12_spelling_variants", _SPELL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
