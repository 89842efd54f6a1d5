"""Table schemas, stated once and used by every reader, writer and transform."""

from pyspark.sql import types as T


def _fields(*pairs):
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S = T.StringType()

# The eleven columns of a log event, in stored order.
LOG_EVENT = _fields(
    ("timestamp", T.TimestampType()),
    ("severity", _S),
    ("service_name", _S),
    ("trace_id", _S),
    ("body", _S),
    ("environment", _S),
    ("app_id", _S),
    ("department", _S),
    ("host", _S),
    ("region", _S),
    ("context", _S),
)

# Columns this engine adds: the masked message before templating and how the row was read.
LOG_EXTRA = _fields(
    ("message", _S),
    ("template_id", _S),
    ("params", T.ArrayType(_S)),
    ("format", _S),
    ("ts_ok", T.BooleanType()),
    ("parse_error", _S),
    ("source_file", _S),
    ("log_date", T.DateType()),
)

LOG_TABLE = T.StructType(LOG_EVENT.fields + LOG_EXTRA.fields)

CATALOG = _fields(
    ("system_name", _S),
    ("department", _S),
    ("owner_email", _S),
    ("criticality", _S),
)

CHAT = _fields(
    ("id", _S),
    ("timestamp", T.TimestampType()),
    ("session_id", _S),
    ("role", _S),
    ("content", _S),
)

DOCUMENT = _fields(
    ("doc_key", _S),
    ("text", _S),
    ("metadata", T.MapType(_S, _S)),
    ("embedding", T.ArrayType(T.FloatType())),
)

TEMPLATE = _fields(
    ("template_id", _S),
    ("n_tokens", T.IntegerType()),
    ("template", _S),
    ("size", T.LongType()),
)

RULES = _fields(
    ("service_name", _S),
    ("attempt", T.IntegerType()),
    ("pattern", _S),
)

GOLDEN_DISCOVERY = _fields(
    ("id", _S), ("logs", T.ArrayType(_S)), ("expected_regex", _S)
)
GOLDEN_SQL = _fields(("id", _S), ("query", _S), ("expected_sql", _S))
GOLDEN_ANSWER = _fields(("id", _S), ("query", _S), ("expected_answer", _S))

LOG_COLUMNS = LOG_EVENT.fieldNames()
