"""Quality rules under weak supervision, with DataFrame and SQL functions only.

Each rule looks at counts of one text and votes good, votes bad or abstains. No rule decides alone.
Documents with the same votes are one row of a table of vote patterns (at most 3 to the number of
rules), which one aggregation with map-side combine makes. Expectation-maximisation runs on that
table: the E-step gives each pattern its probability of good quality, the M-step estimates from
those, for every rule, how often it votes good on good documents and bad on bad ones when it votes.
Rules are taken as independent given the quality. Pseudo-documents (a share ``PRIOR_SHARE`` of all)
keep every rule better than chance, so that the two classes cannot change places. The posterior of its pattern is the quality
of a document; a document is kept from ``threshold`` on unless it fails the base rules.

Words are runs without blank and TAB to CR. Null and empty texts have no word: all counts are 0, the
base rules fail, nothing is kept. Texts of any length are counted whole, inside their own row, in
n log n steps: words and three-word windows are compared by 64-bit hashes within one text. Rows that agree in
everything are judged each on its own and alike; ties cannot arise, a posterior at the threshold is
kept. An empty table gives an empty result (the estimates are then the prior's). Other columns are carried in the struct ``row``,
whatever their names.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarlog.functions.text import compute
from cedarlog.llm.common import materialise

ROUNDS = 20
THRESHOLD = 0.5
#: Pseudo-documents of each class, as a share of all documents, and the accuracy they show.
PRIOR_SHARE, PRIOR_GOOD, PRIOR_BAD, PRIOR_BALANCE = 0.02, 0.95, 0.6, 0.9
WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: ASCII characters that are neither letters, digits nor white space, as a class.
MARKS = r"!-/:-@\[-`{-~"
#: Frequent small words of English, German, French and Spanish; here and capitalised.
_COMMON = (
    "the and of to in is that for with as was be by it on are this from or at an not "
    "der die und das von mit den ist nicht ein eine auf für sich dem "
    "le la les et des un une du est que dans pour pas qui en "
    "el los las y que del se por con una su al como"
).split()
COMMON = sorted({*_COMMON, *(w.capitalize() for w in _COMMON)})


@dataclasses.dataclass(frozen=True)
class Rule:
    """Conditions over the counts, as SQL that any engine reads; neither holds: the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("symbols", "100 * n_symbols > 10 * n_words", "100 * n_symbols <= 2 * n_words"),
    Rule("marks", "100 * n_marks > 12 * word_chars", "100 * n_marks <= 8 * word_chars AND n_words > 0"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words",
         "2 * word_chars >= 7 * n_words AND word_chars <= 9 * n_words AND n_words > 0"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words AND n_words >= 50"),
    Rule("lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("sentences", "n_words >= 50 AND (200 * n_ends < n_words OR 100 * n_ends > 45 * n_words)",
         "100 * n_ends >= 2 * n_words AND 100 * n_ends <= 25 * n_words AND n_words > 0"),
    Rule("common_words", "n_words >= 50 AND 100 * n_common < 2 * n_words", "100 * n_common >= 8 * n_words AND n_words > 0"),
    Rule("variety", "n_words >= 50 AND 100 * n_distinct < 12 * n_words",
         "n_words >= 50 AND 100 * n_distinct >= 30 * n_words"),
    Rule("digits", "100 * n_digits > 20 * word_chars", "100 * n_digits <= 5 * word_chars AND n_words > 0"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars", "100 * n_capitals <= 15 * word_chars AND n_words > 0"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_marks", "n_ends", "n_common", "n_distinct", "n_digits", "n_capitals")


@dataclasses.dataclass(frozen=True)
class Estimates:
    """``balance``: share of good documents; per rule how often a vote is right on good and on bad ones."""

    balance: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def prior() -> Estimates:
    return Estimates(PRIOR_BALANCE, (PRIOR_GOOD,) * len(RULES), (PRIOR_BAD,) * len(RULES))


def _matches(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def _ends(flat: Column, mark: str) -> Column:
    return F.length(flat) - F.length(F.replace(flat, F.lit(mark + " "), F.lit(mark)))


def counts(documents: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``carry``, or all) and the counts of its text as longs."""
    text, flat, words, lines = F.col("_text"), F.col("_flat"), F.col("_words"), F.col("_lines")
    row = F.struct(*[F.col(f"`{c}`") for c in carry or documents.columns])
    df = documents.select(row.alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    blanks = text
    for c in WHITE:
        blanks = F.replace(blanks, F.lit(c), F.lit(" "))
    df = compute(df, {"_flat": F.concat(blanks, F.lit(" "))})
    df = compute(df, {
        "_words": F.array_remove(F.split("_flat", " "), ""),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" " + WHITE)) != ""),
    })
    df = compute(df, {
        "_hashes": F.transform(words, lambda w: F.xxhash64(w)),
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": _matches(text, SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_marks": _matches(text, MARKS),
        "n_ends": _ends(flat, ".") + _ends(flat, "!") + _ends(flat, "?"),
        "n_common": F.size(F.filter(words, lambda w: w.isin(COMMON))),
        "n_digits": _matches(text, "0-9"),
        "n_capitals": _matches(text, "A-Z"),
    }).drop("_text", "_flat", "_words", "_lines")
    at, size = F.col("_hashes"), F.col("n_words")
    # The hash of each window with its place in the low bits: equal windows stand side by side once sorted.
    df = compute(df, {"n_distinct": F.size(F.array_distinct(at)), "_bits": F.length(F.bin(size.cast("long"))), "_windows": F.transform(
        F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(at, i), F.get(at, i + 1), F.get(at, i + 2)),
    )}).drop("_hashes")
    df = compute(df, {"_sorted": F.sort_array(F.transform("_windows", lambda h, i: F.call_function("shiftleft", h, F.col("_bits")).bitwiseOR(i.cast("long"))))})
    key, bits, whole = F.col("_sorted"), F.col("_bits"), F.col("_windows")

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

    df = compute(df, {"_order": F.transform(key, place)}).drop("_sorted")
    order = F.col("_order")

    def repeated(p: Column, k: Column) -> Column:
        h = F.get(whole, p)
        return F.when((h == F.get(whole, F.get(order, k - 1))) | (h == F.get(whole, F.get(order, k + 1))), p)

    df = compute(df, {"_places": F.sort_array(F.filter(F.transform(order, repeated), lambda x: x.isNotNull()))}).drop("_order", "_windows", "_bits")
    places = F.col("_places")
    covered = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x)).drop("_places")
    return df.select("row", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def votes(counted: DataFrame) -> DataFrame:
    """``counted`` with ``votes``, a string with ``+``, ``-`` or ``0`` for each rule."""
    each = [F.when(F.expr(r.bad), "-").when(F.expr(r.good), "+").otherwise("0") for r in RULES]
    return compute(counted, {"votes": F.concat(*each)})


def _vote(j: int) -> Column:
    return F.substring("votes", j + 1, 1)


def posterior(est: Estimates) -> Column:
    """Probability of good quality, from the column ``votes``."""
    odds = F.lit(math.log(est.balance / (1 - est.balance)))
    for j, (a, b) in enumerate(zip(est.on_good, est.on_bad, strict=True)):
        odds = odds + F.when(_vote(j) == "+", math.log(a / (1 - b))).when(_vote(j) == "-", math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Estimates:
    """EM over ``votes, n``; each round brings one row of sums to the driver."""
    est = prior()
    for _ in range(rounds):
        good = F.col("n") * F.col("p")
        bad = F.col("n") * (1 - F.col("p"))
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good")]
        for j in range(len(RULES)):
            up, down = _vote(j) == "+", _vote(j) == "-"
            sums += [
                F.sum(F.when(up, good).otherwise(0.0)).alias(f"gu{j}"), F.sum(F.when(down, good).otherwise(0.0)).alias(f"gd{j}"),
                F.sum(F.when(up, bad).otherwise(0.0)).alias(f"bu{j}"), F.sum(F.when(down, bad).otherwise(0.0)).alias(f"bd{j}"),
            ]
        s = patterns.withColumn("p", posterior(est)).agg(*sums).first()
        if not s["n"]:
            break
        k = PRIOR_SHARE * s["n"]
        est = Estimates(
            (s["good"] + k * PRIOR_BALANCE) / (s["n"] + k),
            tuple((s[f"gu{j}"] + k * PRIOR_GOOD) / (s[f"gu{j}"] + s[f"gd{j}"] + k) for j in range(len(RULES))),
            tuple((s[f"bd{j}"] + k * PRIOR_BAD) / (s[f"bu{j}"] + s[f"bd{j}"] + k) for j in range(len(RULES))),
        )
    return est


def judge(documents: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, rounds: int = ROUNDS,
          carry: list[str] | None = None) -> DataFrame:
    """``row``, the counts, ``votes``, ``quality`` (the posterior), ``base_failed`` and ``kept`` for each input row.

    Each text is looked at once: the counts, beside the columns ``carry`` (all if not given), are written
    to the shared folder and read for the patterns and for the result.
    """
    voted = materialise(votes(counts(documents, text_col, carry)), "quality-votes")
    # Every round reads the patterns: one file of them, whatever the number of shuffle partitions.
    patterns = materialise(voted.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "quality-patterns")
    est = estimate(patterns, rounds)
    failed = F.expr(BASE_FAILED)
    out = compute(voted, {"quality": posterior(est)})
    return out.select("*", failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"))


def drop_low_quality(documents: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, in their own columns."""
    return judge(documents, text_col, threshold).filter("kept").select("row.*")
