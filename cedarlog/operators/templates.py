"""Message templates: digit signatures, clustering by similarity, statistics, new patterns.

Clustering follows the published fixed-depth-tree idea (He et al., ICWS 2017): messages are
only compared inside a leaf, that is with equal word count and equal leading words. Here it is
a two-pass plan that gives the same result for every order and partitioning of the rows:

1. Messages collapse to digit signatures with map-side combine; for each digit position the
   smallest and largest word tell whether it is constant, so constants are kept.
2. Leaves hold signatures, not messages. A big leaf is clustered in rounds: its rows are dealt into parts by
   hash, each part is clustered, and the templates found, with their weights, are the rows of the next round,
   dealt anew, until a leaf fits one part. Where two rounds in a row merge nothing, templates that can still merge are
   brought together by an exact join: two that agree in the words the threshold asks for share a pair of their rarer
   words at their places (prefix filter). It ends when no two templates of a leaf can merge, which is also what one part
   ends with; only among texts that fit several templates may the parts decide which one they join.
3. Inside a part, rows are taken by falling count and text, saved templates first, and join the most similar
   cluster at or above the threshold; differing words become the wildcard.

A template keeps its id when later messages make it more general: a cluster has the id of the largest saved
template in it, and lists the ids of others it took in as ``former``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cedarlog.functions.text import collapse_space, compute, strip
from cedarlog.operators.joins import is_small, join_by_weight
from cedarlog.session import materialise, materialise_lean

# Wildcard mark and default similarity threshold.
WILDCARD = "<*>"
SIMILARITY = 0.5

DIGIT_WORD = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"
PREFIX_TOKENS = 1
#: Rows and words of one clustering task.
PART_ROWS = 5_000
PART_TOKENS = 2_000_000
#: Rounds without a merge after which the templates that can still merge are looked for.
QUIET_ROUNDS = 2
#: Words that rows must share to be compared, and up to how many rarer words of a row all pairs of them are
#: taken; rows of more words go by single ones, as many words at their places are seldom shared by chance.
TOGETHER, PAIRED = 2, 24
#: Cells of one comparison of rows with rows.
CELLS = 16_000_000


def signature(message: Column) -> Column:
    """Every blank-separated word that holds a digit becomes the wildcard."""
    return F.regexp_replace(message, DIGIT_WORD, WILDCARD)


def normal_message(message: Column) -> Column:
    return collapse_space(strip(message))


def template_id(template: Column) -> Column:
    return F.md5(template)


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def _signatures(messages: DataFrame, col: str) -> DataFrame:
    """``sig, text, weight``: signatures and their texts, which have constant digit words put back.

    Only the row of the signature itself carries it through the shuffle, those of its digit words have a digest;
    and only signatures with a wildcard can have words to put back, so the others are not moved again.
    """
    message = normal_message(F.col(col))
    base = messages.select(signature(message).alias("sig"), message.alias("m"))
    slots = F.filter(
        F.transform(
            F.split("m", " "), lambda t, i: F.struct(i.alias("pos"), t.alias("tok"))
        ),
        lambda x: has_digit(x["tok"]),
    )
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("tok")))
    digest = F.unhex(F.md5("sig"))
    per_slot = (
        base.select("sig", F.explode(F.concat(whole, slots)).alias("s"))
        .select(
            F.when(F.col("s.pos") < 0, F.col("sig")).alias("sig"),
            F.when(F.col("s.pos") >= 0, digest).alias("key"),
            "s.pos",
            "s.tok",
        )
        .groupBy("sig", "key", "pos")
        .agg(
            F.count("*").alias("n"),
            F.min("tok").alias("low"),
            F.max("tok").alias("high"),
        )
    )
    found = materialise_lean(messages.sparkSession, "signatures", lambda: per_slot.filter("pos < 0 OR low = high").drop("high"))
    # One row per word position at most, so the collected list is as long as one message.
    constants = found.filter("pos >= 0").groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "low"))).alias("c")
    )
    sigs = found.filter("pos < 0").select("sig", F.col("n").alias("weight"))
    open_ = F.contains("sig", F.lit(WILDCARD))
    text = F.concat_ws(
        " ", F.transform(F.split("sig", " "), lambda t, i: F.coalesce(F.try_element_at(F.col("c"), i), t))
    )
    put_back = sigs.filter(open_).withColumn("key", digest).join(constants, "key", "left").select("sig", text.alias("text"), "weight")
    return sigs.filter(~open_).select("sig", F.col("sig").alias("text"), "weight").unionByName(put_back)


def _saved_ids(templates: DataFrame) -> Column:
    """All ids that stand for a saved template, its own first."""
    own = F.array("template_id")
    return F.concat(own, "former") if "former" in templates.columns else own


def _seed_rows(templates: DataFrame) -> DataFrame:
    """Saved templates in the shape of signatures, with no message behind them."""
    words = F.split("template", " ")
    return templates.select(
        F.lit(None).cast("string").alias("sig"),
        F.concat_ws(" ", F.transform(words, lambda t: F.when(has_digit(t), WILDCARD).otherwise(t))).alias("sig_text"),
        F.col("template").alias("text"),
        F.col("size").alias("weight"),
        _saved_ids(templates).alias("ids"),
    )


def _with_groups(rows: DataFrame, keys: list[str], order: list[Column], name: str, kind: T.DataType, look) -> DataFrame:
    """Add ``name``: what ``look`` gives for the texts of each group, in the given order.

    Rows come sorted by group, so a task goes through groups as they come and holds one Arrow batch and
    one group; most groups are far smaller than a batch, and a call for each would cost more than the work.
    """

    def of(table: pa.Table, starts: list[int], end: int) -> Iterator[pa.RecordBatch]:
        texts = table["text"].slice(0, end).to_pylist()
        found = [x for a, b in zip(starts, [*starts[1:], end], strict=True) for x in look(texts[a:b])]
        done = table.slice(0, end).append_column(name, pa.array(found, to_arrow_type(kind)))
        yield from done.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key = list(zip(*(held[k].to_pylist() for k in keys), strict=True))
            starts = [i for i in range(len(key)) if not i or key[i] != key[i - 1]]
            if len(starts) > 1:  # the last group may go on
                yield from of(held, starts[:-1], starts[-1])
                held = held.slice(starts[-1])
        if held is not None and len(held):
            yield from of(held, [0], len(held))

    shape = T.StructType([*rows.schema.fields, T.StructField(name, kind)])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)


def _cluster_part(threshold: float):
    """Function that clusters one part of a leaf, which the caller keeps below a bound: the template of each text."""

    def cluster(texts: list[str]) -> list[str]:
        if len(texts) == 1:
            return texts
        # The wildcard is -2 in rows and -1, the last of the vocabulary, in clusters: it equals nothing.
        number = {WILDCARD: -2}
        codes = np.array([[number.setdefault(w, len(number) - 1) for w in t.split(" ")] for t in texts], np.int32)
        vocab = [*number][1:] + [WILDCARD]
        m, n = codes.shape
        fixed = np.count_nonzero(codes >= 0, axis=1)

        clusters = np.empty((min(m, 16), n), dtype=np.int32)
        left = np.empty(m, dtype=np.int64)  # words of a cluster that are no wildcards
        used = 0
        owner = np.empty(m, dtype=np.int64)
        for row, code in enumerate(codes):
            best = -1
            if used:
                same = np.count_nonzero(clusters[:used] == code, axis=1)
                exact = (same == fixed[row]) & (left[:used] == same)
                score = np.where(exact, n, same)
                top = score.max()
                if exact.any() or top >= threshold * n:
                    ties = np.flatnonzero(score == top)
                    best = int(ties[np.argmin(left[ties])])
            if best < 0:
                if used == len(clusters):
                    clusters = np.concatenate([clusters, np.empty_like(clusters)])
                clusters[used], left[used] = np.maximum(code, -1), fixed[row]
                best = used
                used += 1
            else:
                clusters[best] = np.where(clusters[best] == code, code, -1)
                left[best] = np.count_nonzero(clusters[best] >= 0)
            owner[row] = best
        found = [" ".join(vocab[i] for i in c) for c in clusters[:used]]
        return [found[o] for o in owner]

    return cluster


def _clustered(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows that also have their ``part`` with their ``template`` in its place."""
    order = [(F.size("ids") > 0).desc(), F.desc("weight"), F.col("text")]
    found = _with_groups(rows, ["leaf", "part"], order, "template", T.StringType(), _cluster_part(threshold))
    return found.select("leaf", "text", "template", "weight", "ids", "parts", *[c for c in rows.columns if c == "members"])


def _merged(rows: DataFrame, text: str, *more: Column) -> DataFrame:
    """One row per leaf and text; ids go by falling weight of the rows they come with."""
    ranked = F.array_sort(
        F.collect_list(F.when(F.size("ids") > 0, F.struct((-F.col("weight")).alias("w"), "ids")))
    )
    return rows.groupBy("leaf", F.col(text).alias("text")).agg(
        F.sum("weight").alias("weight"),
        F.array_distinct(F.flatten(F.transform(ranked, lambda r: r["ids"]))).alias("ids"),
        *more,
    )


def _with_partner(threshold: float):
    """Function that tells which texts of a group can merge with another of it."""

    def partners(texts: list[str]) -> list[bool]:
        number = {WILDCARD: -1}
        codes = np.array([[number.setdefault(w, len(number) - 1) for w in t.split(" ")] for t in texts], np.int32)
        m, n = codes.shape
        fixed = codes >= 0
        found = np.zeros(m, dtype=bool)
        step = max(1, CELLS // m)
        for a in range(0, m, step):
            same = np.zeros((min(step, m - a), m), dtype=np.int32)
            for p in range(n):
                same += (codes[a : a + step, p, None] == codes[None, :, p]) & fixed[a : a + step, p, None]
            same[np.arange(len(same)), np.arange(a, a + len(same))] = -1
            found[a : a + step] = (same >= threshold * n).any(axis=1)
        return found.tolist()

    return partners


def _meetings(rows: DataFrame, threshold: float, part_rows: int, part_tokens: int, turn: int) -> DataFrame:
    """The rows that can merge with another of their leaf, each with a ``part`` in which it meets one.

    Two rows that can merge share ``need`` words at their places. With the words of a row in order of rarity, two such rows
    share ``many`` of them among all but the last ``need - many``. So rows are grouped by
    combinations of that many of their rarer words, and only groups of two rows or more are looked at; a word that a large
    part of a leaf has at a place makes no large group by itself. Big groups are compared in blocks, every block with every
    other. Of its groups with a partner a row takes the first by hash, so the rows of the first group of all do meet.
    """
    width = F.size(F.split("text", " "))
    key = F.md5(F.concat_ws(" ", F.length("leaf"), "leaf", "text"))
    rows = materialise(rows.withColumn("key", key), "open")
    place = ["leaf", "pos", "word"]
    # Equal for all rows of a leaf.
    need = F.ceil(width * threshold).cast("int")
    many = F.when((need >= TOGETHER) & (width - need + TOGETHER <= PAIRED), TOGETHER).otherwise(1)
    words = rows.select("key", "leaf", need.alias("need"), many.alias("many"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    words = materialise(words.filter(F.col("word") != WILDCARD), "words")
    known = materialise(words.groupBy(*place).agg(F.count("*").alias("n")), "places")
    ranked = (
        join_by_weight(words, known.withColumn("weight", F.col("n")), place, "weight")
        .groupBy("key", "leaf", "need", "many")
        .agg(F.array_sort(F.collect_list(F.struct("n", "pos", "word"))).alias("w"))
    )
    # Words that no other row of the leaf has at that place join nothing, but count for the order.
    first = F.slice("w", F.lit(1), F.greatest(F.size("w") - F.greatest("need", F.lit(1)) + F.col("many"), F.lit(0)).cast("int"))
    shared = F.filter(first, lambda x: x["n"] > 1)
    prefix = ranked.select("key", "leaf", "many", F.transform(shared, lambda x: F.struct(x["pos"], x["word"])).alias("p"))
    one = F.transform("p", lambda x: F.array(x))
    two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.greatest(F.size("p") - i - 1, F.lit(0))), lambda y: F.array(x, y))))
    combined = F.transform(F.when(F.col("many") == 1, one).otherwise(two), lambda c: F.array_sort(c))
    marked = prefix.select("key", "leaf", F.explode(combined).alias("c")).select("key", "leaf", F.md5(F.to_json("c")).alias("mark"))
    rare = materialise(marked, "rare")
    by = ["leaf", "mark"]
    groups = materialise(rare.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    blocks = F.greatest(F.ceil(F.col("n") / part_rows), F.ceil(F.col("n") * width / part_tokens))
    # The weighted join keeps rows that have no match; those groups have one row.
    grouped = join_by_weight(rare, groups.withColumn("weight", F.col("n")), by, "weight").filter("n > 1").join(rows.select("key", "text"), "key")
    own = F.pmod(F.xxhash64("key", F.lit(turn)), F.col("blocks")).alias("own")
    dealt = (
        grouped.withColumn("blocks", blocks)
        .select("key", *by, "text", own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
        .select("key", *by, "text", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    meets = _with_groups(dealt, [*by, "low", "high"], [], "meets", T.BooleanType(), _with_partner(threshold))
    found = meets.filter("meets")
    at = F.struct(F.xxhash64("mark", "low", "high", F.lit(turn)).alias("h"), "mark", "low", "high")
    chosen = found.groupBy("key").agg(F.min(at).alias("part"))
    return rows.join(chosen, "key").select("leaf", "part", "text", "weight", "ids", F.lit(1).cast("bigint").alias("parts"))


def _bring_together(rows: DataFrame, threshold: float, part_rows: int, part_tokens: int) -> DataFrame:
    """``leaf, text, template`` of every row, when no two templates of a leaf can merge any more.

    A merge only takes words away, so rows without a partner never get one.
    """
    trail, turn = rows.select("leaf", "text", F.col("text").alias("template")), 0
    while True:
        now, at = rows, turn
        meeting = materialise_lean(
            rows.sparkSession, "meeting", lambda: _meetings(now, threshold, part_rows, part_tokens, at)  # noqa: B023
        )
        if meeting.isEmpty():
            return trail
        out = materialise(_clustered(meeting, threshold), "met")
        step = out.select("leaf", F.col("text").alias("template"), F.col("template").alias("now"))
        trail = materialise(
            trail.join(step, ["leaf", "template"], "left").select("leaf", "text", F.coalesce("now", "template").alias("template")),
            "trail",
        )
        rows = materialise(_merged(out, "template"), "pending")
        turn += 1


def _round(pending: DataFrame, threshold: float, part_rows: int, part_tokens: int, turn: int) -> DataFrame:
    """The rows clustered in parts of their leaves; a template that is the text itself is null."""
    width = F.size(F.split("text", " "))
    parts = F.greatest(
        F.ceil(F.count("*") / part_rows),
        F.when(F.count("*") > 1, F.ceil(F.count("*") * F.first(width) / part_tokens)).otherwise(1),
    )
    # A leaf of several parts has a part's worth of rows at least, so they are few and the rows are not shuffled for this join.
    big = pending.groupBy("leaf").agg(parts.alias("parts")).filter("parts > 1")
    counted = pending.join(F.broadcast(big), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    part = F.pmod(F.xxhash64("text", F.lit(turn)), F.col("parts"))
    out = _clustered(counted.withColumn("part", part), threshold)
    return out.withColumn("template", F.nullif("template", "text"))


def _cluster_leaves(rows: DataFrame, threshold: float, part_rows: int, part_tokens: int) -> DataFrame:
    """``leaf, text, template, weight, members``: the final template of every row of ``leaf, text, weight, ids, members``."""
    spark, pending, trail, settled, quiet, turn = rows.sparkSession, rows, None, None, 0, 0
    kept = ["text", "weight", "members"]
    while True:
        now, at = pending, turn
        out = materialise_lean(spark, "round", lambda: _round(now, threshold, part_rows, part_tokens, at))  # noqa: B023
        out = out.withColumn("template", F.coalesce("template", "text"))
        big = out.filter("parts > 1")
        before = big.count()
        if before:
            pending = materialise(_merged(big, "template"), "pending")
            quiet = 0 if pending.count() < before else quiet + 1
        if trail is None:
            step = out
        else:
            step = trail.join(out.select("leaf", F.col("text").alias("now"), "template", "parts"), ["leaf", "now"])
        final = step.filter("parts = 1").select("leaf", "template", *kept)
        settled = final if settled is None else settled.union(final)
        if not before:
            return settled
        trail = materialise(
            step.filter("parts > 1").select("leaf", F.col("template").alias("now"), *kept), "trail"
        )
        if quiet == QUIET_ROUNDS:
            met = _bring_together(pending, threshold, part_rows, part_tokens).withColumnRenamed("text", "now")
            return settled.union(trail.join(met, ["leaf", "now"]).select("leaf", "template", *kept))
        turn += 1


def assign_signatures(
    messages: DataFrame,
    col: str = "message",
    similarity: float = SIMILARITY,
    prefix_tokens: int = PREFIX_TOKENS,
    seeds: DataFrame | None = None,
    part_rows: int = PART_ROWS,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """``sig, template, template_id, former, weight``: the template of every signature, written to the
    shared folder.

    Rows without ``sig`` are saved templates that were passed as ``seeds``.
    """
    return _assigned(lambda: _signatures(messages, col), messages.sparkSession, similarity, prefix_tokens, seeds, part_rows, part_tokens)


def assign_known(
    signatures: DataFrame,
    similarity: float = SIMILARITY,
    prefix_tokens: int = PREFIX_TOKENS,
    seeds: DataFrame | None = None,
    part_rows: int = PART_ROWS,
    part_tokens: int = PART_TOKENS,
) -> DataFrame:
    """:func:`assign_signatures` for messages that are already collapsed to ``sig, n_tokens, sig_tokens, tokens, weight``,
    a row for each ``sig``."""
    sigs = signatures.select("sig", F.concat_ws(" ", "tokens").alias("text"), "weight")
    return _assigned(lambda: materialise(sigs, "signatures"), signatures.sparkSession, similarity, prefix_tokens, seeds, part_rows, part_tokens)


def _assigned(
    signatures: Callable[[], DataFrame], spark: SparkSession, similarity: float, prefix_tokens: int, seeds: DataFrame | None,
    part_rows: int, part_tokens: int,
) -> DataFrame:
    """``sig, template, template_id, former, weight`` of ``sig, text, weight``.

    A text goes through one shuffle to its leaf and is not joined again: its row takes along its ``members``, which are the
    signature and the saved template it stands for, or null if it is itself the only signature. What can be computed
    from other columns is not stored, and the tables on the way are removed.
    """
    no_ids = F.array().cast("array<string>")

    def make() -> DataFrame:
        rows = signatures().select("sig", F.col("sig").alias("sig_text"), "text", "weight", no_ids.alias("ids"))
        if seeds is not None:
            rows = rows.unionByName(_seed_rows(seeds))
        words = F.split("sig_text", " ")
        leaf = F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, prefix_tokens))
        texts = rows.select("sig", leaf.alias("leaf"), "text", "weight", "ids")
        member = F.struct("sig", "weight", "ids")
        if seeds is None:  # a text has one signature
            only = texts.withColumn("members", F.when(F.col("sig") != F.col("text"), F.array(member))).drop("sig")
        else:
            only = materialise(_merged(texts, "text", F.collect_list(member).alias("members")), "texts")
        found = _cluster_leaves(only, similarity, part_rows, part_tokens)
        itself = F.array(F.struct(F.col("text").alias("sig"), "weight", no_ids.alias("ids")))
        placed = found.select("leaf", "template", F.inline(F.coalesce("members", itself)))
        if seeds is None:
            done = placed.withColumn("known", F.lit(None).cast("array<string>"))
        else:
            named = _merged(placed.filter(F.size("ids") > 0), "template").select(
                "leaf", F.col("text").alias("template"), F.col("ids").alias("known")
            )
            done = placed.join(named, ["leaf", "template"], "left")
        return done.select("sig", F.when(F.col("sig").eqNullSafe(F.col("template")), None).otherwise(F.col("template")).alias("template"), "known", "weight")

    stored = materialise_lean(spark, "assignment", make).withColumn("template", F.coalesce("template", "sig"))
    return stored.select(
        "sig",
        "template",
        F.coalesce(F.get("known", F.lit(0)), template_id(F.col("template"))).alias("template_id"),
        F.coalesce(F.slice("known", 2, F.greatest(F.size("known") - 1, F.lit(0))), no_ids).alias("former"),
        "weight",
    )


def templates_of(assignment: DataFrame) -> DataFrame:
    """``template_id, n_tokens, template, size, former`` from signature assignments."""
    return (
        assignment.groupBy("template_id", "template")
        .agg(F.sum("weight").alias("size"), F.first("former").alias("former"))
        .select("template_id", F.size(F.split("template", " ")).alias("n_tokens"), "template", "size", "former")
    )


def mine_templates(messages: DataFrame, col: str = "message", **options) -> DataFrame:
    """The templates of all messages with their sizes; options as :func:`assign_signatures`."""
    return templates_of(assign_signatures(messages, col, **options))


def assign_templates(messages: DataFrame, assignment: DataFrame, col: str = "message") -> DataFrame:
    """Add ``template``, ``template_id`` and ``params`` to every message."""
    known = assignment.filter(F.col("sig").isNotNull()).withColumnRenamed("sig", "_sig").drop("former")
    keyed = messages.withColumn("_sig", signature(normal_message(F.col(col))))
    if is_small(known):
        joined = keyed.join(F.broadcast(known.drop("weight")), "_sig", "left")
    else:
        joined = join_by_weight(keyed, known, ["_sig"], "weight")
    return joined.drop("_sig").withColumn("params", params(F.col(col), F.col("template")))


def params(message: Column, template: Column) -> Column:
    """Words of the message at the wildcard positions of its template."""
    pairs = F.arrays_zip(
        F.split(normal_message(message), " ").alias("w"), F.split(template, " ").alias("t")
    )
    return F.transform(F.filter(pairs, lambda p: p["t"] == WILDCARD), lambda p: p["w"])


def with_signature_template(df: DataFrame, col: str = "message") -> DataFrame:
    """The stateless form: the signature itself is the template, no second pass."""
    norm = compute(df, {"_norm": normal_message(F.col(col))})
    return (
        compute(norm, {"template": signature(F.col("_norm"))})
        .withColumn("template_id", template_id(F.col("template")))
        .withColumn("params", F.regexp_extract_all("_norm", F.lit(DIGIT_WORD), F.lit(0)))
        .drop("_norm")
    )


def cluster_count(templates: DataFrame) -> int:
    return templates.count()


def save_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").parquet(path)


def current_ids(templates: DataFrame) -> DataFrame:
    """``template_id, current_id``: every id ever given to a template of the set, and the one it has now."""
    return templates.select(
        F.explode(_saved_ids(templates)).alias("template_id"), F.col("template_id").alias("current_id")
    )


def _template_column(logs: DataFrame) -> Column:
    """Stored rows hold their template as ``body``."""
    return F.col("template" if "template" in logs.columns else "body").alias("template")


def template_stats(logs: DataFrame) -> DataFrame:
    """One row per template in place of its lines."""
    return logs.groupBy("template_id", _template_column(logs)).agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count_distinct("service_name").alias("services"),
    )


def new_patterns(logs: DataFrame, known: DataFrame) -> DataFrame:
    """Templates of ``logs`` that are not in ``known`` by any of their ids, with their row counts.

    Counting comes first, so the anti join sees one row per template.
    """
    seen = logs.groupBy("template_id", _template_column(logs)).agg(F.count("*").alias("n"))
    ids = known.select(F.explode(_saved_ids(known)).alias("template_id")).distinct()
    return seen.join(ids, "template_id", "left_anti")
