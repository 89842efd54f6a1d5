"""One text line in, one structured record out, without Python in the row path.

The format of a line is decided once in its own projection; each branch then runs a single
regular expression that yields all its groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.text import collapse_space, compute, strip
from cedarlog.functions.variants import (
    FIELD_KEYS,
    MESSAGE_KEYS,
    ODD_MEMBER,
    SERVICE_KEYS,
    SEVERITY_KEYS,
    TIME_KEYS,
    boxed_json,
    fields_of,
    first_in,
    first_of,
    not_texts,
    texts_of,
    unboxed,
    worthwhile,
)
from cedarlog.session import allow_repeated_keys, require_utc

# The three line layouts, their time formats and the defaults for missing fields.
STANDARD = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+(\w+)\s+([\w-]+)(?::)?\s+(.*)"
SYSLOG = r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w.-]+)\s+([\w\.-]+)(?:\[\d+\])?:\s+(.*)"
ACCESS = r"([\d.]+)\s+-\s+-\s+\[(.*?)\]\s+\"(.*?)\"\s+(\d+)\s+(\d+)"
STANDARD_TIME = "yyyy-MM-dd HH:mm:ss"
SYSLOG_TIME = "yyyy MMM d H:m:s"
ACCESS_TIME = "d/MMM/yyyy:H:m:s Z"
ACCESS_TIME_COLON = "d/MMM/yyyy:H:m:s XXX"
DEFAULT_SEVERITY = "INFO"
DEFAULT_SERVICE = "unknown"
ACCESS_SERVICE = "nginx"
UNKNOWN_SEVERITY = "UNKNOWN"
UNKNOWN_FORMAT = "format_unknown"

# Our own marks for lines that the strict JSON reader refuses and for non-text JSON fields.
JSON_STRICT = "json_strict"
TYPE_COERCED = "type_coerced"

_FLAGS = "(?sU)^"
_SEP = "\x01"  # cannot occur inside any group but the last one

_LINE, _JSON, _FORMAT, _GROUPS, _TEXTS = "_line", "json", "format", "_groups", "_texts"
_CLEAN, _ODD, _KNOWN, _MOMENT = "_clean", "odd_keys", "_known", "_moment"

def with_format(df: DataFrame, line: str = "value") -> DataFrame:
    """Strip lines, drop blank ones and decide each line's format; the first match wins."""
    filled = df.filter(F.col(line).rlike(r"(?U)\S"))
    text = F.col(_LINE)
    stripped = compute(filled, {_LINE: strip(F.col(line))})
    boxed = compute(stripped, {"_box": boxed_json(text)})
    parsed = compute(boxed, {_JSON: unboxed(F.col("_box"))}).drop("_box")
    layout = (
        F.when(F.col(_JSON).isNotNull(), "json")
        .when(text.rlike(_FLAGS + STANDARD), "standard")
        .when(text.rlike(_FLAGS + SYSLOG), "syslog")
        .when(text.rlike(_FLAGS + ACCESS), "nginx")
        .otherwise("fallback")
    )
    return compute(parsed, {_FORMAT: layout})


def _groups(pattern: str, order: str, n: int) -> Column:
    joined = _SEP.join(f"${i}" for i in order)
    return F.split(F.regexp_replace(F.col(_LINE), _FLAGS + pattern, joined), _SEP, n)


def iso_time(c: Column) -> Column:
    """ISO-8601 text to an instant; anything else, a bare year too, gives NULL.

    Fractions may follow a comma, and the basic form without separators is read as well.
    """
    dotted = lambda t: F.regexp_replace(t, r"(:\d{2}),(\d)", "$1.$2")
    basic = F.regexp_replace(
        c, r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)([.,]\d+)?(.*)$", "$1-$2-$3T$4:$5:$6$7$8"
    )
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), dotted(c).try_cast("timestamp"))
        .when(c.rlike(r"^\d{8}T\d{6}([.,]\d+)?(Z|[+-]\d\d:?(\d\d)?)?$"), dotted(basic).try_cast("timestamp"))
        .otherwise(F.try_to_timestamp(F.when(c.rlike(r"^\d{8}$"), c), F.lit("yyyyMMdd")))
    )


def parse_lines(
    df: DataFrame,
    default_year: int | Column,
    ingest_ts: str | Column,
    line: str = "value",
) -> DataFrame:
    """Add ``format, timestamp, ts_ok, severity, service_name, body, context, json, odd_keys,
    parse_error``.

    ``default_year`` completes times without a year; ``ingest_ts`` stands in for times that
    cannot be read (then ``ts_ok`` is false). ``context`` is a string map. JSON lines have
    ``json``, the object with its types, instead; ``odd_keys`` lists its keys that hold no text
    where that could matter.

    The layout of a line is decided once, above :func:`compute`; what follows are plain projections, so
    of the other columns only those are computed that are read.
    """
    require_utc(df.sparkSession)
    allow_repeated_keys(df.sparkSession)
    year = default_year if isinstance(default_year, Column) else F.lit(default_year)
    now = ingest_ts if isinstance(ingest_ts, Column) else F.lit(ingest_ts)
    text, fmt, js, g = F.col(_LINE), F.col(_FORMAT), F.col(_JSON), F.col(_GROUPS)
    texts, known = F.col(_TEXTS), F.col(_KNOWN)

    split = with_format(df, line).withColumns(
        {
            _GROUPS: F.when(fmt == "standard", _groups(STANDARD, "1234", 4))
            .when(fmt == "syslog", _groups(SYSLOG, "1234", 4))
            .when(fmt == "nginx", _groups(ACCESS + ".*", "1452", 4)),
            _TEXTS: F.when((fmt == "json") & text.rlike(ODD_MEMBER), texts_of(text)),
        },
    )
    cleaned = split.withColumns(
        {
            _CLEAN: F.when(texts.isNotNull(), F.to_json(worthwhile(js, texts))),
            _ODD: F.when(texts.isNotNull(), not_texts(js)),
        },
    )
    fields = cleaned.withColumns(
        {_KNOWN: F.when(fmt == "json", fields_of(F.coalesce(F.col(_CLEAN), text), FIELD_KEYS))},
    )
    moment = (
        F.when(fmt == "json", iso_time(first_of(known, TIME_KEYS)))
        .when(fmt == "standard", F.try_to_timestamp(g[0], F.lit(STANDARD_TIME)))
        .when(
            fmt == "syslog",
            F.try_to_timestamp(
                F.concat_ws(" ", year.cast("string"), collapse_space(g[0])), F.lit(SYSLOG_TIME)
            ),
        )
        .when(
            fmt == "nginx",
            F.coalesce(
                F.try_to_timestamp(g[3], F.lit(ACCESS_TIME)),
                F.try_to_timestamp(g[3], F.lit(ACCESS_TIME_COLON)),
            ),
        )
    )
    coerced = F.lit(False)
    for keys in (SEVERITY_KEYS, SERVICE_KEYS, MESSAGE_KEYS):
        coerced = coerced | first_in(known, keys, F.col(_ODD))
    failed = F.when(
        fmt == "fallback",
        F.when(text.rlike(r"(?s)^\{.*\}$"), JSON_STRICT).otherwise(UNKNOWN_FORMAT),
    ).when(F.col(_ODD).isNotNull() & coerced, TYPE_COERCED)
    plain = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    or_else = lambda keys, value: F.coalesce(first_of(known, keys), value)

    timed = fields.withColumns({_MOMENT: moment, "parse_error": failed})
    named = timed.withColumns(
        {
            "timestamp": F.coalesce(F.col(_MOMENT), now.cast("timestamp")),
            "ts_ok": F.col(_MOMENT).isNotNull(),
            "severity": F.when(fmt == "json", or_else(SEVERITY_KEYS, F.lit(DEFAULT_SEVERITY)))
            .when(fmt == "standard", g[1])
            .when(fmt == "fallback", UNKNOWN_SEVERITY)
            .otherwise(DEFAULT_SEVERITY),
            "service_name": F.when(fmt == "json", or_else(SERVICE_KEYS, F.lit(DEFAULT_SERVICE)))
            .when(fmt.isin("standard", "syslog"), g[2])
            .when(fmt == "nginx", ACCESS_SERVICE)
            .otherwise(DEFAULT_SERVICE),
        },
    )
    out = named.withColumns(
        {
            "body": F.when(fmt == "json", or_else(MESSAGE_KEYS, text))
            .when(fmt.isin("standard", "syslog"), g[3])
            .when(
                fmt == "nginx",
                F.concat_ws(" ", F.regexp_extract(_LINE, _FLAGS + ACCESS, 3), g[1]),
            )
            .otherwise(text),
            "context": F.when(fmt == "syslog", plain(host=g[1]))
            .when(fmt == "nginx", plain(client_ip=g[0], status=g[1], bytes=g[2]))
            .when(fmt == "fallback", plain(parse_error=F.col("parse_error"))),
        },
    )
    return out.drop(_LINE, _GROUPS, _TEXTS, _CLEAN, _KNOWN, _MOMENT)
