"""Extraction patterns from the lines themselves, with no model and no hand.

The lines of a service are mined for templates first; what remains are a few token sequences with slots. For
every slot the values tell its type (number, decimal, address, path, word) and, where all are ``key=value``, its
name. The templates of a service are then aligned one after the other, the most frequent first: tokens that
agree stay, aligned tokens that differ become a slot, and tokens that one side lacks become a stretch of any text. The
result is one pattern with named groups that every line of the service matches from its start.

Templates meet by service, and a service has few of them; lines never do. Of more than ``MAX_TEMPLATES`` the rest are
covered by stretches of text, so the pattern matches them too. Services without a line get no pattern; null and
blank lines tell nothing.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.operators.templates import WILDCARD, assign_signatures, assign_templates

MAX_TEMPLATES = 200
#: Types of slots, the narrowest first: what all values must match, in both dialects.
TYPES = (
    ("number", r"\d+"), ("decimal", r"-?\d+(?:\.\d+)?"), ("time", r"\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?"),
    ("date", r"\d{4}-\d\d-\d\d"), ("address", r"\d{1,3}(?:\.\d{1,3}){3}"), ("path", r"/\S*"), ("word", r"\S+"),
)
_PATTERNS = dict(TYPES)
TEXT = "text"


def _service_word(service: Column) -> Column:
    """A first word that keeps services apart when templates are mined; it holds no digit."""
    return F.translate(F.md5(service), "0123456789", "ghijklmnop")


def slot_table(lines: DataFrame, line: str = "line", service: str = "service_name") -> DataFrame:
    """``service, template, n, slots``: the templates of each service, with name and type of their slots in order."""
    rows = lines.filter(F.col(line).rlike(r"\S")).select(F.col(service).alias("service_name"), F.concat_ws(" ", _service_word(F.col(service)), F.col(line)).alias("message"))
    done = assign_templates(rows, assign_signatures(rows)).select("service_name", "template", "params")
    each = done.select("service_name", "template", F.posexplode_outer("params").alias("pos", "value"))
    key = F.regexp_extract("value", r"^([A-Za-z_][\w.-]*)=", 1)
    bare = F.when(F.col("value").contains("="), F.substring_index("value", "=", -1)).otherwise(F.col("value"))
    stats = each.select("service_name", "template", "pos", key.alias("key"), "value", bare.alias("bare")).groupBy("service_name", "template", "pos").agg(
        F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"),
        *[F.bool_and(F.col("value").rlike(f"^(?:{p})$")).alias(f"whole_{t}") for t, p in TYPES],
        *[F.bool_and(F.expr(f"substr(value, length(key) + 2) rlike '^(?:{p})$'".replace("\\", "\\\\"))).alias(f"bare_{t}") for t, p in TYPES],
    )
    named = (F.col("low") == F.col("high")) & (F.col("low") != "")

    def narrowest(prefix: str) -> Column:
        out = F.lit("word")
        for t, _ in reversed(TYPES):
            out = F.when(F.col(f"{prefix}_{t}"), t).otherwise(out)
        return out

    slot = F.struct("pos", F.when(named, F.col("low")).alias("key"), F.when(named & F.col("bare_word"), narrowest("bare")).when(named, TEXT).otherwise(narrowest("whole")).alias("type"))
    return stats.groupBy("service_name", "template").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), slot))).alias("slots")
    )


def typed_tokens(template: str, slots: list[tuple[str | None, str]]) -> list[tuple]:
    """Tokens of a template: ``("is", text)`` or ``("slot", key, type)``; the service word is left out."""
    rest = iter(slots)
    return [("slot", *next(rest)) if t == WILDCARD else ("is", t) for t in template.split(" ")[1:]]


def _common(a: tuple, b: tuple) -> tuple:
    """What stands for both of two aligned tokens."""
    if a == b:
        return a
    kinds = {t[2] if t[0] == "slot" else "word" for t in (a, b)}
    keys = {t[1] if t[0] == "slot" else None for t in (a, b)}
    if keys == {None} or len(keys) > 1:
        # A key on one side only is part of the value.
        return ("slot", None, "decimal" if kinds == {"number", "decimal"} and keys == {None} else kinds.pop() if len(kinds) == 1 and keys == {None} else "word")
    return ("slot", keys.pop(), "decimal" if kinds == {"number", "decimal"} else kinds.pop() if len(kinds) == 1 else TEXT if TEXT in kinds else "word")


def align(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Two token sequences as one; ``("gap",)`` is a stretch that one of them lacks."""
    def worth(x, y):
        if x == y:
            return 4 if x[0] == "is" else 3
        if x[0] == y[0] == "slot":
            return 2 if x[1] == y[1] else 1
        return 0

    m, n = len(a), len(b)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            fit = worth(a[i], b[j]) if ("gap",) not in (a[i], b[j]) else -1
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + fit if fit > 0 else -1)
    out, i, j = [], 0, 0
    while i < m and j < n:
        fit = worth(a[i], b[j]) if ("gap",) not in (a[i], b[j]) else -1
        if fit > 0 and best[i][j] == best[i + 1][j + 1] + fit:
            out.append(_common(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            out.append(("gap",))
            i, j = (i + 1, j) if best[i][j] == best[i + 1][j] else (i, j + 1)
    out += [("gap",)] * (m - i + n - j)
    return [t for k, t in enumerate(out) if t != ("gap",) or k == 0 or out[k - 1] != ("gap",)]


def to_pattern(tokens: list[tuple]) -> str:
    """The pattern of a token sequence; every slot and stretch is a group with a name of its own."""
    used: dict[str, int] = {}

    def name(wish: str) -> str:
        wish = re.sub(r"\W", "_", wish, flags=re.ASCII)
        used[wish] = used.get(wish, 0) + 1
        return wish if used[wish] == 1 else f"{wish}_{used[wish]}"

    if all(t[0] == "is" for t in tokens):
        return rf"\s*(?P<{name('message')}>" + r"\s+".join(re.escape(t[1]) for t in tokens) + r")\s*$"
    out = r"\s*"
    for k, t in enumerate(tokens):
        if t[0] == "gap":
            out += f"(?P<{name(TEXT)}>.*?)" if k + 1 < len(tokens) else f"(?P<{name(TEXT)}>.*)"
            continue
        # A stretch may be empty or end in blanks, so beside it blanks need not stand.
        if k:
            out += r"\s*" if tokens[k - 1] == ("gap",) else r"\s+"
        if t[0] == "is":
            out += re.escape(t[1])
        elif t[1] is not None:
            out += re.escape(t[1]) + f"=(?P<{name(t[1])}>{r'\S*' if t[2] == TEXT else _PATTERNS[t[2]]})"
        else:
            out += f"(?P<{name(t[2])}>{_PATTERNS[t[2]]})"
    return out + r"\s*$"


def induce_rules(lines: DataFrame, line: str = "line", service: str = "service_name") -> DataFrame:
    """``service_name, attempt, pattern``: candidates for :func:`select_rules`, the narrowest first.

    The first holds all templates of the service; the second keeps only its most frequent template, for services
    whose lines have nothing in common.
    """
    kind = lines.schema[service].dataType.simpleString()

    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "template"], ascending=[False, True])
        found = [typed_tokens(t, [(s["key"], s["type"]) for s in slots]) for t, slots in zip(pdf["template"], pdf["slots"], strict=True)]
        whole = found[0]
        for tokens in found[1:MAX_TEMPLATES]:
            whole = align(whole, tokens)
        if len(found) > MAX_TEMPLATES:
            whole = [("gap",)]
        patterns = dict.fromkeys([to_pattern(whole), to_pattern(found[0])])
        return pd.DataFrame({"service_name": keys[0], "attempt": range(1, len(patterns) + 1), "pattern": list(patterns)})

    return slot_table(lines, line, service).groupBy("service_name").applyInPandas(run, f"service_name {kind}, attempt int, pattern string")
