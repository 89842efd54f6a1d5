"""Context extraction and attribute promotion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cedarlog.functions.text import let
from cedarlog.functions.variants import PROMOTED, first_of, members

def kv_context(body: Column) -> Column:
    """``k=v`` words of a text as ``map<string,string>``; the last of equal keys wins.

    Entries are sorted by key and position, so equal keys are neighbours and one pass drops
    all but the last, whatever the session's map key policy is.
    """
    words = F.filter(F.split(body, " ", -1), lambda w: F.contains(w, F.lit("=")))
    entries = F.transform(
        words,
        lambda w, i: F.struct(
            F.substring_index(w, "=", 1).alias("k"),
            i.alias("i"),
            F.substr(w, F.instr(w, "=") + 1).alias("v"),
        ),
    )
    last = let(
        F.array_sort(entries),
        lambda s: F.filter(
            s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["k"] != x["k"])
        ),
    )
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def json_without(json_text: Column, key: str) -> Column:
    """JSON text of an object without one member; texts that lack the name are not parsed."""
    rest = F.map_filter(members(F.parse_json(json_text)), lambda k, _: k != key)
    return F.when(F.contains(json_text, F.lit(f'"{key}"')), F.to_json(rest)).otherwise(json_text)


def json_with(json_text: Column, key: str, value: Column) -> Column:
    """Compact JSON text of an object with one more member at its end; NULL adds none."""
    member = F.to_json(F.struct(value.alias(key)))
    head = F.left(json_text, F.length(json_text) - 1)
    more = F.concat(head, F.lit(","), F.substring(member, 2, 1 << 30))
    return (
        F.when(value.isNull(), json_text).when(json_text == "{}", member).otherwise(more)
    )


def promote_attributes(fields: Column) -> dict[str, Column]:
    """Columns read from the context, each from its first key that holds a value."""
    return {name: first_of(fields, keys) for name, keys in PROMOTED.items()}
