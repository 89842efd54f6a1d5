"""JSON objects: a variant for types, a string map for texts, a struct for the known keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON keys of each field, in the order they are tried.
TIME_KEYS = ("timestamp", "time", "date")
SEVERITY_KEYS = ("severity", "level")
SERVICE_KEYS = ("service", "app")
MESSAGE_KEYS = ("message", "msg")
PROMOTED = {
    "environment": ("environment", "env"),
    "app_id": ("app_id",),
    "department": ("department", "dept"),
    "host": ("host",),
    "region": ("region",),
}

FIELD_KEYS = TIME_KEYS + SEVERITY_KEYS + SERVICE_KEYS + MESSAGE_KEYS
PROMOTED_KEYS = tuple(k for keys in PROMOTED.values() for k in keys)

# A known key with a value that is not a text, or an empty one; or a key spelt with escapes.
ODD_MEMBER = r'"(?:' + "|".join(FIELD_KEYS + PROMOTED_KEYS) + r')"\s*:\s*(?:[^"\s]|"")|\\u'


def boxed_json(line: Column) -> Column:
    """Variant of a one-element array around a line that looks like a JSON object, else NULL.

    The box is needed because the parser ignores text that follows a complete value.
    """
    shaped = line.startswith("{") & line.endswith("}")
    return F.when(shaped, F.try_parse_json(F.concat(F.lit("["), lenient_json(line), F.lit("]"))))


#: A number that JSON does not know, where the rest of the line is whole strings and what stands between them.
NO_NUMBER = r'(?<=[:\[,\s])(-?Infinity|NaN)(?=\s*[,}\]](?:[^"\\]++|\\.|"(?:[^"\\]++|\\.)*+")*+$)'


def lenient_json(line: Column) -> Column:
    """The line with ``NaN`` and ``Infinity`` as texts, for the strict parser; texts that hold these words stay."""
    return F.when(line.rlike("NaN|Infinity"), F.regexp_replace(line, NO_NUMBER, '"$1"')).otherwise(line)


def unboxed(box: Column) -> Column:
    """The object of :func:`boxed_json` when the line was exactly one."""
    alone = F.try_variant_get(box, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(box, "$[0]", "variant"))


def texts_of(json_text: Column) -> Column:
    """``map<string,string>`` of a JSON object; nested values as JSON text."""
    return F.from_json(json_text, "map<string,string>")


def fields_of(json_text: Column, keys: tuple[str, ...]) -> Column:
    """Struct of texts of the given keys."""
    return F.from_json(json_text, ", ".join(f"`{k}` string" for k in keys))


def members(json: Column) -> Column:
    return json.try_cast("map<string,variant>")


def is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def as_text(v: Column) -> Column:
    return v.cast("string")


def as_variant(c: Column) -> Column:
    return c.cast("variant")


def _nothing(kind: Column, text: Column) -> Column:
    """Null, an empty text, zero, false, or an empty container."""
    return (
        F.when(kind == "STRING", text == "")
        .when((kind == "VOID") | text.isNull(), True)
        .otherwise(
            text.rlike(r"^(?:false|\[\s*\]|\{\s*\})$")
            | F.coalesce(text.try_cast("double") == 0, F.lit(False))
        )
    )


def worthwhile(json: Column, texts: Column) -> Column:
    """Members of an object that hold a value worth using."""
    return F.map_filter(
        members(json), lambda k, v: ~_nothing(F.schema_of_variant(v), F.try_element_at(texts, k))
    )


def not_texts(json: Column) -> Column:
    """Keys of the members whose value is not a text."""
    return F.map_keys(F.map_filter(members(json), lambda _, v: ~is_string(v)))


def first_of(fields: Column, keys: tuple[str, ...]) -> Column:
    """The first of several keys that holds a text that is not empty."""
    return F.coalesce(*[F.nullif(fields[k], F.lit("")) for k in keys])


def first_in(fields: Column, keys: tuple[str, ...], odd_keys: Column) -> Column:
    """True where the key :func:`first_of` picks is one of ``odd_keys``."""
    used = F.coalesce(
        *[F.when(F.length(fields[k]) > 0, F.lit(k)) for k in keys]
    )
    return F.coalesce(F.array_contains(odd_keys, used), F.lit(False))
