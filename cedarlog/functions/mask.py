"""Masking of personal data in texts and in nested context values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cedarlog.functions.variants import as_text, as_variant, is_string, members

# What is masked, in this order, and by what.
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
IPV4 = (
    r"(?<!\d)(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?!\d)"
)
CARD = r"\b(?:\d[ -]*?){13,16}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL_MARK = "<EMAIL_REDACTED>"
IPV4_MARK = "<IP_REDACTED>"
CARD_MARK = "<CC_REDACTED>"
SSN_MARK = "<SSN_REDACTED>"

# How the patterns are run. Each pair finds the same texts as the pattern above it, in linear
# time: a match of EMAIL starts where its run of characters starts, or right after the match
# before; the others start at a digit. (?U) means digits and word bounds of every script,
# whatever the JVM's own default is.
_RUN = "[a-zA-Z0-9_.+-]"
_FAST_EMAIL = rf"(?:(?<!{_RUN})|\G){_RUN}++@[a-zA-Z0-9-]++\.[a-zA-Z0-9-.]++"
_FAST_IPV4 = r"(?U)(?=[0-9]{1,3}[.][0-9])" + IPV4

MASKS = (
    (_FAST_EMAIL, EMAIL_MARK),
    (_FAST_IPV4, IPV4_MARK),
    (r"(?U)(?=\d)" + CARD, CARD_MARK),
    (r"(?U)(?=\d)" + SSN, SSN_MARK),
)

# What every text with something else than an address with "@" to mask contains. Most texts do
# not, and one look settles it; letters fail at the first test.
SUSPECT = (
    r"(?U)(?=[.0-9\x80-\uffff])"
    r"(?:\.[0-9]{1,3}\.[0-9]|\d(?:\d\d-\d\d-\d{4}|(?:[ -]*\d){12}))"
)

# Objects nested deeper than this are masked in their JSON text: in the texts that are values, and nowhere else.
MAX_DEPTH = 8
_JSON_PIECE = r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?|[^"]++'


def mask_text(c: Column) -> Column:
    """Replace e-mail addresses, IPv4 addresses, card and social security numbers."""
    (email, mark), *others = MASKS
    first = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, email, mark)).otherwise(c)
    return F.when(c.rlike(SUSPECT), _replace(first, others)).otherwise(first)


def _replace(c: Column, masks) -> Column:
    for pattern, mark in masks:
        c = F.regexp_replace(c, pattern, mark)
    return c


def suspect_json(json_text: Column) -> Column:
    """True for JSON text that may hold something to mask; an escape may hide a character."""
    found = F.contains(json_text, F.lit("@")) | F.contains(json_text, F.lit("\\"))
    return found | json_text.rlike(SUSPECT)


def leaks(c: Column) -> Column:
    """True where any masked kind still occurs."""
    found = F.lit(False)
    for pattern, _ in MASKS:
        found = found | c.rlike(pattern)
    return found


def _masked(v: Column) -> Column:
    return as_variant(_replace(as_text(v), MASKS))


def _mask_value(v: Column, depth: int) -> Column:
    kind = F.schema_of_variant(v)
    items = F.transform(
        v.try_cast("array<variant>"), lambda x: F.when(is_string(x), _masked(x)).otherwise(x)
    )
    if depth == 0:
        pieces = F.regexp_extract_all(F.to_json(v), F.lit(_JSON_PIECE), F.lit(0))
        is_value = lambda p: p.startswith('"') & ~p.endswith(":")
        whole = F.array_join(F.transform(pieces, lambda p: F.when(is_value(p), _replace(p, MASKS)).otherwise(p)), "")
        return (
            F.when(kind == "STRING", _masked(v))
            .when(kind.startswith("OBJECT"), F.coalesce(F.try_parse_json(whole), as_variant(whole)))
            .otherwise(v)
        )
    inner = F.transform_values(members(v), lambda _, x: _mask_value(x, depth - 1))
    return (
        F.when(kind == "STRING", _masked(v))
        .when(kind.startswith("ARRAY"), as_variant(items))
        .when(kind.startswith("OBJECT"), F.to_variant_object(inner))
        .otherwise(v)
    )


def mask_json(json: Column, texts: Column, depth: int = MAX_DEPTH) -> Column:
    """Mask a JSON object (variant) to JSON text; ``texts`` is its string map.

    Masks texts, texts in lists, and the same inside objects. Numbers, booleans and objects
    inside lists stay as they are, and so do keys. Only values whose text is suspect are
    taken apart.
    """
    return F.to_json(
        F.transform_values(
            members(json),
            lambda k, v: F.when(
                suspect_json(F.try_element_at(texts, k)), _mask_value(v, depth)
            ).otherwise(v),
        )
    )


def mask_string_map(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: mask_text(v))
