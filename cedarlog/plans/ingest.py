"""From raw lines to the ``logs`` table. Batch and stream share this chain."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cedarlog import schema
from cedarlog.functions.context import json_with, json_without, kv_context, promote_attributes
from cedarlog.functions.mask import mask_json, mask_string_map, mask_text, suspect_json
from cedarlog.functions.parse import TYPE_COERCED, parse_lines
from cedarlog.functions.text import compute, let
from cedarlog.functions.variants import (
    PROMOTED,
    PROMOTED_KEYS,
    fields_of,
    first_in,
    texts_of,
    worthwhile,
)
from cedarlog.operators.rules import apply_rules
from cedarlog.operators.stitch import is_head, stitch
from cedarlog.operators.templates import (
    assign_signatures,
    assign_templates,
    save_templates,
    templates_of,
    with_signature_template,
)
from cedarlog.session import materialise, scratch_scope
from cedarlog.sources.lines import CURRENT_LOGS, ROTATED_LOGS, path_exists, read_lines, spread
from cedarlog.sources.rotation import load_ledger, read_new_lines, save_ledger
from cedarlog.sources.tables import write_logs

# A time this far from the load is a guessed year or a wrong clock.
MAX_SKEW_DAYS = 180


def structure(
    lines: DataFrame, default_year: int | Column, ingest_ts: str | Column, line: str = "value"
) -> DataFrame:
    """Parse, mask, extract context and promote attributes; no templates yet.

    Masking comes before everything that stores or compares text. Words like ``k=v`` are read
    from the masked message only where the layout itself gave no context.
    """
    parsed = parse_lines(lines, default_year, ingest_ts, line)
    given, js, context = F.col("context"), F.col("json"), F.col("_context")
    odd, raw, texts, fields = (F.col(c) for c in ("odd_keys", "_raw", "_texts", "_fields"))

    masked = parsed.withColumns({"message": mask_text(F.col("body")), "_raw": F.to_json(js)})
    looked = masked.withColumns({"_texts": F.when(suspect_json(raw), texts_of(raw))})
    nothing = (js.isNull() & given.isNull()) | (raw == "{}")
    contexts = looked.withColumns(
        {
            "_context": F.when(nothing, F.to_json(kv_context(F.col("message"))))
            .when(js.isNull(), F.to_json(mask_string_map(given)))
            .when(texts.isNotNull(), mask_json(js, texts))
            .otherwise(raw)
        },
    )
    usable = let(
        context, lambda c: F.to_json(let(texts_of(c), lambda t: worthwhile(F.parse_json(c), t)))
    )
    # Predicates on what is read from the context stay above this step, see :func:`compute`.
    cleaned = compute(
        contexts,
        {
            "_clean": F.when(odd.isNotNull(), usable).otherwise(context),
            "_base": json_without(context, "source_file"),
        },
    )
    read = cleaned.withColumns({"_fields": fields_of(F.col("_clean"), PROMOTED_KEYS)})
    coerced = F.lit(False)
    for keys in PROMOTED.values():
        coerced = coerced | first_in(fields, keys, odd)
    source = F.col("source_file") if "source_file" in lines.columns else F.lit(None).cast("string")
    stored = read.withColumns(
        {
            **promote_attributes(fields),
            "parse_error": F.coalesce(
                "parse_error", F.when(odd.isNotNull() & coerced, TYPE_COERCED)
            ),
            "context": json_with(F.col("_base"), "source_file", source),
            "source_file": source,
            "trace_id": F.nullif(F.get_json_object("_base", "$.trace_id"), F.lit("")),
            "log_date": F.to_date("timestamp"),
        },
    )
    return stored.drop(
        "body", "json", "odd_keys", "_raw", "_texts", "_context", "_clean", "_base", "_fields", line
    )


def as_log_table(df: DataFrame) -> DataFrame:
    """Columns of the stored table; ``body`` is the template."""
    return df.withColumn("body", F.col("template")).select(schema.LOG_TABLE.fieldNames())


def with_signatures(structured: DataFrame) -> DataFrame:
    return as_log_table(with_signature_template(structured))


def with_mined_templates(
    structured: DataFrame, seeds: DataFrame | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Log rows with mined templates, and the template set. Two passes over the lines."""
    assignment = assign_signatures(structured, "message", seeds=seeds, **options)
    return as_log_table(assign_templates(structured, assignment)), templates_of(assignment)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and the others; a value taken over as text was read.

    Each is a query of its own, so rows that are still to be parsed should be stored before.
    """
    bad = F.coalesce(F.col("parse_error"), F.lit(TYPE_COERCED)) != TYPE_COERCED
    return df.filter(~bad), df.filter(bad)


def suspicious_time(ingest_ts: str | Column, days: int = MAX_SKEW_DAYS) -> Column:
    now = (F.lit(ingest_ts) if isinstance(ingest_ts, str) else ingest_ts).cast("timestamp")
    return F.abs(F.datediff("timestamp", now)) > days


def with_rule_fields(lines: DataFrame, rules: DataFrame, service: Column, line: str = "value") -> DataFrame:
    """Lines that a registered rule of their service reads become JSON lines of its fields; others stay.

    So rules come before the general parser, which then finds the fields like those of any JSON line.
    The service is kept as a field where the rule names none.
    """
    known = apply_rules(lines.withColumn("service_name", service), rules, line)
    given = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    named = F.when(
        F.map_contains_key(given, "service") | F.map_contains_key(given, "app"), given
    ).otherwise(F.map_concat(given, F.create_map(F.lit("service"), F.col("service_name"))))
    read = F.when(F.col("fields").isNotNull(), F.to_json(named)).otherwise(F.col(line))
    return known.withColumn(line, read).drop("fields", "service_name")


def bulk_load(
    spark: SparkSession,
    landing_zone: str,
    logs_path: str,
    templates_path: str,
    default_year: int,
    ingest_ts: str,
    glob: str | None = None,
    multiline: bool = False,
    rules: DataFrame | None = None,
    service: Column | None = None,
    quarantine_path: str | None = None,
    ledger_path: str | None = None,
    **options,
) -> bool:
    """Load all log files of a folder; False when there is nothing to load.

    Saved templates seed the run and the new set takes their place, under a new version
    folder so that readers and a repeated run never see a half-written set.

    ``multiline`` joins lines that begin no record to the record before. ``rules`` are tried before the general
    parser on the lines of their service, which ``service`` tells (by default the file name up to ``.log``). With
    ``quarantine_path`` rows that could not be read go there, by load, in place of ``logs``. With ``ledger_path``
    only lines that no earlier load consumed are read, also from files that were rotated since, and a
    load that is repeated after a failure replaces what it wrote. Lines are parsed once.
    """
    version, after, load_id = -1, None, None
    with scratch_scope(spark):
        if ledger_path is not None:
            before, version = load_ledger(spark, ledger_path)
            new, after = read_new_lines(spark, landing_zone, before, glob or ROTATED_LOGS)
            found = materialise(new.select("value", "source_file", "nth"), "new-lines")
            found = found.withColumns({"block": F.lit(0), "line_id": F.col("nth")}).drop("nth")
            load_id = f"zone-{version + 1}"
        else:
            found = read_lines(spark, landing_zone, glob or CURRENT_LOGS, positions=multiline)
        if found.isEmpty():
            return False
        if multiline:
            found = stitch(found, is_head(F.col("value"))).select("value", "source_file")
        found = found.select("value", "source_file")
        if rules is not None:
            named = F.regexp_replace("source_file", r"[-_.]?\d*\.log.*$", "") if service is None else service
            found = with_rule_fields(found, rules, named)
        structured = materialise(structure(spread(found), default_year, ingest_ts), "structured")
        if quarantine_path is not None:
            structured, bad = quarantine(structured)
            folder = load_id or uuid.uuid4().hex
            bad.select("source_file", "message", "parse_error", "timestamp").write.mode("overwrite").parquet(
                f"{quarantine_path}/load_id={folder}"
            )
            load_id = load_id or folder
        rows, templates = with_mined_templates(
            structured, seeds=load_templates(spark, templates_path), **options
        )
        write_logs(rows, logs_path, load_id)
        save_next(templates, templates_path)
        if after is not None:
            save_ledger(after, ledger_path, version + 1)
    return True


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def load_templates(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest saved template set, None before the first."""
    stored = _versions(spark, path)
    if stored is None:
        return None
    newest = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == newest).drop("version")


def save_next(templates: DataFrame, path: str, version: int | None = None) -> None:
    if version is None:
        stored = _versions(templates.sparkSession, path)
        version = 0 if stored is None else stored.agg(F.max("version")).first()[0] + 1
    save_templates(templates, f"{path}/version={version}")
