"""Extraction rules: check patterns on samples, choose one per service, apply, watch for drift.

Rules are configuration: a rule table is read once to the driver, behind a size check, because
its patterns must be compiled and checked there (a bad pattern would fail the whole job). In
the plan each pattern is then a literal, compiled once per task. Rule tables above the bound
take the join form, in which the pattern is a column; it tries patterns on the executors and gives the same results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.functions.parse import TYPE_COERCED
from cedarlog.operators.joins import broadcast_if_small
from cedarlog.session import materialise

MAX_LITERAL_RULES = 500
MAX_ATTEMPTS = 3
SAMPLES_PER_SERVICE = 10


@dataclass(frozen=True)
class Rule:
    service_name: str
    attempt: int
    pattern: str
    java: str | None
    fields: tuple[str, ...] = field(default=())

    @property
    def usable(self) -> bool:
        return self.java is not None


def _as_java(pattern: str) -> str:
    """Spell out what the two dialects write differently; named groups become plain ones.

    In Python ``[`` and ``&&`` mean themselves inside a class, a repetition may lack its lower bound, and
    ``\\Z`` is the very end.
    """
    numbers = re.compile(pattern).groupindex
    out, i, first = [], 0, -1
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            out.append("\\z" if rest.startswith("\\Z") else rest[:2])
            i += 2
        elif first >= 0:
            if c == "]" and i > first:
                first = -1
                out.append(c)
            else:
                out.append("\\" + c if c in "[&]" else c)
            i += 1
        elif c == "[":
            start = "[^" if rest.startswith("[^") else "["
            out.append(start)
            i += len(start)
            first = i
        elif m := re.match(r"\(\?P<\w+>", rest):
            out.append("(")
            i += m.end()
        elif m := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"\\{numbers[m[1]]}")
            i += m.end()
        elif m := re.match(r"\{,(\d+)\}", rest):
            out.append(f"{{0,{m[1]}}}")
            i += m.end()
        else:
            out.append(c)
            i += 1
    return "".join(out)


def translate(pattern: str) -> tuple[str | None, tuple[str, ...]]:
    """The pattern with plain numbered groups, and the field name of each group.

    Patterns that do not compile give None.
    """
    try:
        compiled = re.compile(pattern)
    except re.error:
        return None, ()
    names = {i: n for n, i in compiled.groupindex.items()}
    fields = tuple(names.get(i, f"group_{i}") for i in range(1, compiled.groups + 1))
    return "(?U)^(?:" + _as_java(pattern) + ")", fields


def _compiles(rules: DataFrame, java: str | None) -> bool:
    """Whether the engine that will run the pattern takes it."""
    if java is None:
        return False
    try:
        rules.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def load_rules(rules: DataFrame, limit: int = MAX_LITERAL_RULES) -> list[Rule] | None:
    """The rule table on the driver, or None when it has more than ``limit`` rows."""
    rows = rules.select("service_name", "attempt", "pattern").take(limit + 1)
    if len(rows) > limit:
        return None
    out = []
    for row in sorted(rows, key=lambda r: (r.service_name, r.attempt, r.pattern)):
        java, fields = translate(row.pattern)
        if not _compiles(rules, java):
            java, fields = None, ()
        out.append(Rule(row.service_name, row.attempt, row.pattern, java, fields))
    return out


def named_groups(pattern: str) -> bool:
    try:
        return bool(re.compile(pattern).groupindex)
    except re.error:
        return False


def validate_rules(
    samples: DataFrame, rules: DataFrame, line: str = "line", need_names: bool = True
) -> DataFrame:
    """``service_name, attempt, pattern, ok``: does a rule match every sample of its service?

    With ``need_names`` a pattern without named groups is refused as too broad. All rules are
    tested in one pass over the samples: one boolean aggregate per rule.
    """
    spark = samples.sparkSession
    known = load_rules(rules)
    if known is None:
        return _validate_by_join(samples, rules, line, need_names)
    usable = [r for r in known if r.usable and (not need_names or named_groups(r.pattern))]
    shape = "rule int, service_name string, attempt int, pattern string, usable boolean"
    listed = spark.createDataFrame(
        [(i, r.service_name, r.attempt, r.pattern, r in usable) for i, r in enumerate(known)], shape
    )
    if not usable:
        return listed.select("service_name", "attempt", "pattern", F.lit(False).alias("ok"))
    hits = {
        i: F.bool_and(
            F.when(F.col("service_name") == r.service_name, F.col(line).rlike(r.java))
        ).alias(f"r{i}")
        for i, r in enumerate(known)
        if r in usable
    }
    verdicts = samples.agg(*hits.values()).select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"r{i}").alias("ok")) for i in hits])
        ).alias("v")
    ).select("v.rule", "v.ok")
    return listed.join(verdicts, "rule", "left").select(
        "service_name",
        "attempt",
        "pattern",
        F.when(F.col("usable"), F.coalesce("ok", F.lit(True))).otherwise(False).alias("ok"),
    )


def _taken(rules: DataFrame) -> DataFrame:
    """``java`` becomes NULL where the engine that will run the pattern refuses it; tried on the executors."""
    compiled = F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("java"))
    return rules.withColumn("java", F.when(F.col("java").isNotNull() & compiled.isNotNull(), F.col("java")))


def _checked(rules: DataFrame, need_names: bool) -> DataFrame:
    """Rules with their checked Java form, computed on the executors in Arrow batches."""

    def check(pdfs):
        for pdf in pdfs:
            pdf["java"] = [
                translate(p)[0] if (named_groups(p) or not need_names) else None
                for p in pdf["pattern"]
            ]
            yield pdf

    found = rules.select("service_name", "attempt", "pattern").mapInPandas(
        check, "service_name string, attempt int, pattern string, java string"
    )
    return materialise(_taken(found), "rules")


def _validate_by_join(
    samples: DataFrame, rules: DataFrame, line: str, need_names: bool
) -> DataFrame:
    checked = _checked(rules, need_names)
    tested = (
        samples.select("service_name", F.col(line).alias("_line"))
        .join(broadcast_if_small(checked.filter(F.col("java").isNotNull())), "service_name")
        .groupBy("service_name", "attempt", "pattern")
        .agg(F.bool_and(F.regexp_like("_line", F.col("java"))).alias("ok"))
    )
    return checked.join(tested, ["service_name", "attempt", "pattern"], "left").select(
        "service_name",
        "attempt",
        "pattern",
        F.when(F.col("java").isNotNull(), F.coalesce("ok", F.lit(True))).otherwise(False).alias("ok"),
    )


def select_rules(
    samples: DataFrame, rules: DataFrame, line: str = "line", max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """``service_name, pattern, attempt``: the first attempt that passes, NULL if none does."""
    tried = rules.filter(F.col("attempt") <= max_attempts)
    passed = validate_rules(samples, tried, line).filter("ok")
    best = passed.groupBy("service_name").agg(
        F.min_by("pattern", F.struct("attempt", "pattern")).alias("pattern"), F.min("attempt").alias("attempt")
    )
    services = samples.select("service_name").distinct()
    return services.join(best, "service_name", "left")


def sample_lines(lines: DataFrame, line: str = "line", n: int = SAMPLES_PER_SERVICE) -> DataFrame:
    """``n`` distinct lines of every service, or all if it has fewer, chosen by hash.

    Repeatable and independent of arrival order. Ranks are limited before the rows are shuffled, so a
    task hands on at most ``n`` rows for each service.
    """
    order = Window.partitionBy("service_name").orderBy(F.md5(line), line)
    return (
        lines.select("service_name", line)
        .distinct()
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def apply_rules(lines: DataFrame, rules: DataFrame, line: str = "line") -> DataFrame:
    """Add ``fields``, a map read by the first rule of the row's service that matches.

    NULL where no rule matches; those rows go on to the general parser.
    """
    known = load_rules(rules)
    if known is None:
        return _apply_by_join(lines, rules, line)
    out: Column = F.lit(None).cast("map<string,string>")
    for r in reversed([r for r in known if r.usable and r.fields]):
        groups = F.create_map(
            *[
                x
                for i, name in enumerate(r.fields, 1)
                for x in (F.lit(name), F.regexp_extract(line, r.java, i))
            ]
        )
        out = F.when(
            (F.col("service_name") == r.service_name) & F.col(line).rlike(r.java), groups
        ).otherwise(out)
    return lines.withColumn("fields", out)


def _apply_by_join(lines: DataFrame, rules: DataFrame, line: str) -> DataFrame:
    """Column patterns: each line meets an array of its service's rules in attempt order."""

    def expand(pdfs):
        for pdf in pdfs:
            both = [translate(p) for p in pdf["pattern"]]
            pdf["java"] = [b[0] for b in both]
            pdf["names"] = [list(b[1]) for b in both]
            yield pdf

    translated = rules.select("service_name", "attempt", "pattern").mapInPandas(
        expand, "service_name string, attempt int, pattern string, java string, names array<string>"
    )
    ready = (
        materialise(_taken(translated), "rules")
        .filter(F.col("java").isNotNull() & (F.size("names") > 0))
        .groupBy("service_name")
        .agg(F.array_sort(F.collect_list(F.struct("attempt", "pattern", "java", "names"))).alias("_rules"))
    )
    first = F.get(F.filter("_rules", lambda r: F.regexp_like(F.col(line), r["java"])), F.lit(0))
    return (
        lines.join(broadcast_if_small(ready), "service_name", "left")
        .withColumn("_rule", first)
        .withColumn(
            "fields",
            F.when(
                F.col("_rule").isNotNull(),
                F.map_from_entries(
                    F.transform(
                        F.col("_rule.names"),
                        lambda n, i: F.struct(
                            n,
                            F.call_function(
                                "regexp_extract", F.col(line), F.col("_rule.java"), i + 1
                            ),
                        ),
                    )
                ),
            ),
        )
        .drop("_rules", "_rule")
    )


def drift(
    records: DataFrame,
    threshold: float,
    by: str = "source_file",
    every: str = "1 hour",
    at: str = "timestamp",
) -> DataFrame:
    """Periods in which the share of unreadable lines of a source exceeds ``threshold``.

    An unreadable line has no service and no time of its own, so lines are grouped by where they
    came from, and ``at`` should name their arrival. Values taken over as text were read.
    """
    bad = (F.coalesce(F.col("parse_error"), F.lit(TYPE_COERCED)) != TYPE_COERCED).cast("int")
    return (
        records.groupBy(by, F.window(at, every).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(bad).alias("failed"))
        .select(by, F.col("w.start").alias("period"), "n", "failed",
                (F.col("failed") / F.col("n")).alias("rate"))
        .filter(F.col("rate") > threshold)
    )
