"""Prefix trie of conversations by padded matrices of turn ids.

Turns get the MD5 of role and text as id. Conversations, one row each with their first ``width`` ids,
are dealt by range of their id sequence. A task turns its range into a matrix of dense turn ids, -1 where
a conversation is over, and sorts it with one lexsort. Column change masks, OR-accumulated from the
left, mark at every depth where a node starts; reduceat sums over the nodes of a depth, from the deepest
to the root. A node that touches the first or the last row of a range may go on in the next one: at
most two paths per task. These are recombined by their prefix key.

Conversations longer than ``width`` go on in a further round with the node they have reached as their
group, but only while the node has two or more of them; the rest of a conversation alone is a chain that
needs no matrix. So a task never holds more than ``width`` turns of a conversation, and neither positions
nor chains gather the turns of one conversation anywhere.

Definitions. A turn without conversation id belongs to no conversation and is left out. Turns come by
number, null first; equal numbers in the order of the MD5 of ``<characters of role>:<role><text>``;
repeated rows are turns of their own. Null role or text is empty. Empty texts are turns of 0 bytes. A conversation without
turns cannot occur in the table, but rebuilding may leave none: it is a member of the root only.
The result of an empty table is empty (there is no root without a member). Only the four named
columns are looked at, so others may have any name or nulls.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cedarlog.llm.common import materialise
from cedarlog.operators.joins import join_by_weight

#: Turns of a conversation that one matrix holds.
WIDTH = 32
#: Conversations rebuilt from one of their ``FAMILY`` take at most ``HEAD`` of its turns.
FAMILY, HEAD = 5, 8
#: Bytes of ids that a range aims at; more input makes more ranges.
RANGE_BYTES = 16 << 20
#: Conversation ids in one piece of a member list.
PIECE = 512
ID = 16
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, last_bytes long, path array<binary>, "
    "pieces array<struct<first: long, ids: string>>"
)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, shard, seq, id, size``: every turn in order; ``seq`` grows within a conversation and shard,
    shards follow each other. A conversation of any length is spread over as many shards as it fills."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("id"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "id", "nth"]
    # The row number only splits equal rows between ranges; it has no part in the result.
    spread = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(
        spread.select("conv", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("seq"), "id", "size"),
        "trie-turns",
    )


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cells`` (``conv, pos, id, size``) and ``convs`` (``conv, len``) of the rebuilt conversations:
    the first h turns of the family's first conversation, then the own ones after the first h."""
    parts = ordered.groupBy("conv", "shard").agg(F.min("seq").alias("start"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-parts")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    own = parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    sizes = materialise(
        own.join(own.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select(
            "conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")
        ),
        "trie-sizes",
    )
    # Joined by conversation and shard, so a long conversation is no hot key.
    placed = ordered.join(parts.join(sizes, "conv"), ["conv", "shard"]).withColumn("pos", F.col("seq") - F.col("start") + F.col("before") + 1)
    after = placed.filter(F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "size"
    )
    heads = placed.filter((F.col("pos") <= HEAD) & (F.col("conv") == F.col("base"))).select("base", "pos", "id", "size")
    before = heads.join(sizes.select("conv", "base", "h"), "base").filter("pos <= h").select("conv", "pos", "id", "size")
    return materialise(after.unionByName(before), "trie-cells"), sizes.select("conv", "len")


def _blocks(cells: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """``conv, block, ids, sizes, len``: the turns of each conversation, ``width`` to a row."""
    groups = cells.withColumn("block", F.floor((F.col("pos") - 1) / width).cast("int")).groupBy("conv", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("t")
    )
    rows = groups.select(
        "conv", "block", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), "")).alias("ids"),
        F.transform("t", lambda x: x["size"]).alias("sizes"),
    ).join(convs, "conv")
    bare = convs.filter("len = 0").select(
        "conv", F.lit(0).alias("block"), F.lit(b"").alias("ids"), F.array().cast("array<long>").alias("sizes"), "len"
    )
    return rows.unionByName(bare)


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def _hash_members(convs: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest()


def _dense(raw: bytes) -> np.ndarray:
    """Numbers in the byte order of the 16-byte values."""
    two = np.frombuffer(raw, dtype=">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((two[:, 1], two[:, 0]))
    ranked = two[order]
    new = np.any(ranked[1:] != ranked[:-1], axis=1)
    out = np.empty(len(two), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(new)]) if len(two) else []
    return out


def _trie(table: pa.Table, width: int, depth0: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one range; those on the path of its first or last row as parts with a key."""
    groups, ids = table["grp"].to_pylist(), table["ids"].to_pylist()
    conv, length, more, top = (np.asarray(table[c].to_numpy()) for c in ("conv", "len", "more", "top"))
    add = [np.asarray(table[c].to_numpy()) for c in ("add_children", "add_leaves", "add_saved")]
    alone = np.asarray(table["alone"].to_numpy(zero_copy_only=False))
    rows = len(conv)
    held = np.array([len(x) // ID for x in ids], dtype=np.int64)
    nth = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    row = np.repeat(np.arange(rows), held)
    matrix = np.full((rows, width + 1), -1, dtype=np.int64)
    matrix[:, 0] = _dense(b"".join(g or bytes(ID) for g in groups))
    matrix[row, nth + 1] = _dense(b"".join(ids))
    sizes = np.zeros((rows, width + 1), dtype=np.int64)
    sizes[row, nth + 1] = np.concatenate([np.asarray(x, np.int64) for x in table["sizes"].to_pylist()] or [[]])

    order = np.lexsort((conv, *(matrix[:, c] for c in range(width, -1, -1))))
    matrix, sizes, held, conv, length, more, top, alone = (x[order] for x in (matrix, sizes, held, conv, length, more, top, alone))
    add = [x[order] for x in add]
    changed = np.ones((rows, width + 1), dtype=bool)
    changed[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    deepest = int(held.max(initial=0))

    def keys(r: int) -> list[bytes]:
        g, seq = groups[order[r]] or b"", ids[order[r]]
        return [hashlib.blake2b(g + b"|" + seq[: ID * j], digest_size=ID).digest() for j in range(held[r] + 1)]

    edge = (keys(0), keys(rows - 1))
    levels = []
    below = None
    for j in range(deepest, -1, -1):
        starts = np.flatnonzero(changed[:, j])
        ends = np.append(starts[1:], rows)
        valid = held[starts] >= j
        on_edge = valid & ((starts == 0) | (ends == rows))
        own = more & (held == j)
        children, leaves, saved = (np.add.reduceat(np.where(own, x, 0), starts) for x in add)
        if below is not None:
            at = np.searchsorted(starts, below.starts, "right") - 1
            inner = below.valid & ~below.on_edge
            for total, part in ((children, inner), (leaves, below.leaves * inner), (saved, below.saved * inner)):
                np.add.at(total, at, part.astype(np.int64))
        n = ends - starts
        # What an edge node is itself is known only when its parts have met.
        leaves += ~on_edge & (children == 0)
        size = sizes[starts, j] if j else np.zeros(len(starts), np.int64)
        saved += np.where(on_edge, 0, (n - 1) * size)
        low = np.minimum.reduceat(conv, starts)
        below = _Level(j, starts, ends, valid, on_edge, low, n, children, leaves, saved, size)
        levels.append(below)
    levels.reverse()

    def parents(j: int, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Of nodes at depth ``j`` that start at rows ``at``: the parent's key if it is on an edge, and its smallest member if known."""
        if not j:
            return pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64())
        up = levels[j - 1]
        k = np.searchsorted(up.starts, at, "right") - 1
        which = np.where(up.starts[k] == 0, 0, 1)
        names = pa.array([e[j - 1] if len(e) >= j else None for e in edge], pa.binary())
        keyed = names.take(pa.array(which, mask=~up.on_edge[k]))
        if j == 1 and depth0:
            return keyed, pa.array(top[at])
        return keyed, pa.array(up.low[k], mask=up.on_edge[k])

    over = ~more
    for x in levels:
        ended = over & (held == x.j)
        so_far = np.concatenate([[0], np.cumsum(ended)])
        n_ended = so_far[x.ends] - so_far[x.starts]
        plain = np.flatnonzero(x.valid & ~x.on_edge)
        digests = np.full(len(plain), NO_MEMBERS, dtype=object)
        for i in np.flatnonzero(n_ended[plain]):
            s, e = x.starts[plain[i]], x.ends[plain[i]]
            digests[i] = _hash_members(conv[s:e][ended[s:e]])
        up_key, up = parents(x.j, x.starts[plain])
        yield _batch(len(plain), parent_key=up_key, conv_id=x.low[plain], depth=np.full(len(plain), depth0 + x.j), parent_conv_id=up,
                     n_convs=x.n[plain], n_children=x.children[plain], n_leaves=x.leaves[plain], saved_tokens=x.saved[plain],
                     ends_sha256=pa.array(digests, pa.string()))
        for k in np.flatnonzero(x.on_edge):
            s, e = x.starts[k], x.ends[k]
            path = edge[0] if s == 0 else edge[1]
            members = conv[s:e][ended[s:e]]
            lists = [members[i : i + PIECE].tolist() for i in range(0, len(members), PIECE)]
            up_key, up = parents(x.j, x.starts[k : k + 1])
            yield _batch(1, key=[path[x.j]], parent_key=up_key, conv_id=[int(x.low[k])], depth=[depth0 + x.j], parent_conv_id=up,
                         n_convs=[int(x.n[k])], n_children=[int(x.children[k])], n_leaves=[int(x.leaves[k])],
                         saved_tokens=[int(x.saved[k])], last_bytes=[int(x.size[k])], path=[path[: x.j + 1]],
                         pieces=[[{"first": m[0], "ids": ",".join(map(str, m))} for m in lists]])
    # The first node of each chain below this matrix: one conversation, alone from here on.
    rest = np.flatnonzero(alone)
    if len(rest):
        last = length[rest] == depth0 + width + 1
        up_key, up = parents(width + 1, rest)
        digests = [_hash_members(conv[r : r + 1]) if end else NO_MEMBERS for r, end in zip(rest, last, strict=True)]
        one = np.ones(len(rest), np.int64)
        yield _batch(len(rest), parent_key=up_key, conv_id=conv[rest], depth=one * (depth0 + width + 1), parent_conv_id=up,
                     n_convs=one, n_children=one - last, n_leaves=one, saved_tokens=one * 0, ends_sha256=digests)


_ARROW = pa.schema([
    ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("last_bytes", pa.int64()),
    ("path", pa.list_(pa.binary())), ("pieces", pa.list_(pa.struct([("first", pa.int64()), ("ids", pa.string())]))),
])


class _Level(NamedTuple):
    """The nodes of one depth in a range: arrays by node."""

    j: int
    starts: np.ndarray
    ends: np.ndarray
    valid: np.ndarray
    on_edge: np.ndarray
    low: np.ndarray
    n: np.ndarray
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    size: np.ndarray


def _batch(rows: int, **columns) -> pa.RecordBatch:
    """Nodes by column; columns not given are null."""
    arrays = [
        columns[f.name] if isinstance(columns.get(f.name), pa.Array)
        else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type)
        for f in _ARROW
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _members_hash(pieces: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of member lists in pieces; a list is read as a stream, never held whole."""

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append({"key": key, "ends_sha256": digest.hexdigest()})
                key, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": digest.hexdigest()}], schema=schema)

    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    dealt = pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids")
    return dealt.mapInArrow(run, "key binary, ends_sha256 string")


def _recombine(parts: DataFrame) -> DataFrame:
    """The nodes that ranges share, from their parts; ``key`` stays for the children that look for them."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    nodes = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("path").alias("path"),
        F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("own_parent"),
        F.max("last_bytes").alias("last_bytes"), *[F.sum(c).alias(c) for c in sums],
    )
    nodes = materialise(nodes, "trie-shared")
    children = nodes.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more_children", F.lit(0)))
    nodes = nodes.drop("more_children")
    up = nodes.select(
        F.explode("path").alias("key"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("last_bytes")).alias("s"),
    )
    totals = up.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = _members_hash(parts.select("key", F.inline("pieces")))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    done = (
        nodes.drop("n_leaves", "saved_tokens", "path", "last_bytes").join(totals, "key").join(ends, "key", "left")
        .join(parents, "parent_key", "left")
    )
    return done.select(
        "key", "conv_id", "depth", F.coalesce("own_parent", "up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(rows: DataFrame, width: int, depth0: int) -> DataFrame:
    """All nodes of one round, with the group ``grp`` of those at its top."""
    size = rows.agg(F.sum(F.length("ids") + 64)).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))

    def run(batches):
        table = _gather(batches)
        if table is not None:
            yield from _trie(table, width, depth0)

    dealt = rows.repartitionByRange(n, "grp", "ids", "conv")
    found = materialise(dealt.mapInArrow(run, _NODE), "trie-nodes")
    shared = materialise(_recombine(found.filter("key IS NOT NULL")), "trie-recombined")
    whole = found.filter("key IS NULL")
    weights = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"), F.col("n_children").alias("weight"))
    unknown = F.col("parent_key").isNotNull() & F.col("parent_conv_id").isNull()
    waiting = join_by_weight(whole.filter(unknown), weights, ["parent_key"], "weight")
    return (
        whole.filter(~unknown).select(*_RESULT)
        .unionByName(waiting.withColumn("parent_conv_id", F.col("up")).select(*_RESULT))
        .unionByName(shared.select(*_RESULT))
    )


def trie(cells: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every node of the trie of ``cells`` (``conv, pos, id, size``; ``pos`` from 1) over the members ``convs`` (``conv, len``)."""
    blocks = materialise(_blocks(cells, convs, width), "trie-blocks")
    rounds: list[DataFrame] = []
    rows = blocks.filter("block = 0").withColumn("grp", F.lit(b"")).withColumn("top", F.lit(None).cast("long"))
    tails = []
    while True:
        end = (len(rounds) + 1) * width
        rows = rows.drop("block").withColumn("more", F.col("len") > end)
        rows = rows.withColumn("next", F.when(F.col("len") >= end, F.unhex(F.md5(F.concat("grp", "ids")))))
        reached = rows.filter("next IS NOT NULL").groupBy("next").agg(
            F.min("conv").alias("next_top"), F.sum(F.col("more").cast("long")).alias("n_more"),
            F.min(F.when(F.col("more"), F.col("conv"))).alias("rep"),
        ).filter("n_more > 0")
        reached = materialise(reached, "trie-reached")
        # A node with very many members is one key: the few heavy ones are broadcast.
        rows = materialise(join_by_weight(rows, reached.withColumn("weight", F.col("n_more")), ["next"], "weight"), "trie-rows")
        rounds.append(rows)
        tails.append(rows.filter("more AND n_more = 1").select("conv", F.lit(end + 1).alias("from")))
        going = rows.filter("more AND n_more > 1").select("conv", F.col("next").alias("grp"), F.col("next_top").alias("top"))
        if going.isEmpty():
            break
        rows = blocks.filter(F.col("block") == len(rounds)).join(going, "conv")

    out, lower = None, None
    for k in range(len(rounds) - 1, -1, -1):
        rows = rounds[k].withColumn("alone", F.coalesce(F.col("more") & (F.col("n_more") == 1), F.lit(False)))
        if lower is None:
            rows = rows.withColumns({"add_children": F.lit(0), "add_leaves": F.lit(0), "add_saved": F.lit(0)})
        else:
            rows = rows.join(lower, (F.col("conv") == F.col("rep")) & (F.col("next") == F.col("low_grp")), "left")
        given = {c: F.when(F.col("alone"), v).otherwise(F.coalesce(c, F.lit(0))).cast("long")
                 for c, v in (("add_children", 1), ("add_leaves", 1), ("add_saved", 0))}
        rows = rows.withColumns(given).select(
            "grp", "ids", "conv", "sizes", "len", F.coalesce("more", F.lit(False)).alias("more"), F.coalesce("top", F.lit(0)).alias("top"),
            "alone", "add_children", "add_leaves", "add_saved",
        )
        nodes = _nodes(rows, width, k * width)
        if k:
            nodes = materialise(nodes, "trie-round")
            # The top of each group is a node of the round before; here it only sums what is below it.
            tops = rounds[k].groupBy("grp").agg(F.min("conv").alias("first"))
            lower = tops.join(nodes.filter(F.col("depth") == k * width), F.col("first") == F.col("conv_id")).select(
                F.col("grp").alias("low_grp"), F.col("n_children").alias("add_children"), F.col("n_leaves").alias("add_leaves"),
                F.col("saved_tokens").alias("add_saved"),
            )
            nodes = nodes.filter(F.col("depth") > k * width)
        out = nodes if out is None else out.unionByName(nodes)
    for k, tail in enumerate(tails):
        first = (k + 1) * width + 1
        chain = cells.filter(F.col("pos") > first).join(tail.join(convs, "conv"), "conv")
        last = F.col("pos") == F.col("len")
        out = out.unionByName(chain.select(
            F.col("conv").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.col("conv").alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_MEMBERS)).alias("ends_sha256"),
        ))
    return out


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie(*rebuilt(turns(conversations, conv_col, turn_col, role_col, text_col)), width)
