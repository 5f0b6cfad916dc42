"""A trie of conversation prefixes with totals of all subtrees, rolled up in bands of depth.

A node is a sequence of turns; its members are the conversations that start with it.  The
smallest member and the depth name a node, and the smallest member of a node also passes
through all its ancestors.  So the path of one conversation through a band of ``height``
levels (at most ``height + 1`` narrow values) shows the ancestors, within the band, of every
node named by that conversation: nothing is joined to find them.

Totals of subtrees come in three steps.  The nodes strictly inside a band are summed to the
band's top without exploding anything.  The tops are a trie of their own, ``height`` times
shallower, whose totals are completed first and by the same steps.  Then every node adds its
value to its ancestors inside its band, and the completed tops that close a band from below
add theirs to the nodes above them.  A node explodes to at most ``height`` ancestors, and the
number of rounds is the logarithm of the greatest depth to the base ``height``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import discard, stored
from clauseloom.operators.ordered import group_rank

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Options:
    """``height``: levels of a band.  ``hot_share``: a node that more than this share of all turns
    pass through is joined by broadcast (there are at most 1 / hot_share of them).
    ``piece``: ids that are joined into one text while the members that end in a node are hashed."""

    height: int = 16
    hot_share: float = 0.001
    piece: int = 4096


SEGMENT = 256  # turns of a conversation that one window orders or one join row stands for


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place from 1, role, text) by turn, nulls first; equal turns by role, then text.

    Rows without conv_id belong to no conversation and are left out; a null role or text is empty.
    A long conversation is ordered by ranges of its turns, not in one task.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    return group_rank(rows, ["conv_id"], order, "place").select("conv_id", F.col("place").cast("long"), "role", "text")


def _segment() -> Column:
    return F.expr(f"(place - 1) div {SEGMENT}")


def with_borrowed_heads(turns: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """Every conversation with its first h turns taken from the first one of its group.

    c gives way to the first h turns of c - c % group (all if fewer, none if absent), then its
    own after the first h; h = CRC-32 of decimal c, modulo ``modulus``.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % modulus
    leader = F.col("conv_id") - F.col("conv_id") % group
    segments = turns.groupBy("conv_id", _segment().alias("segment")).agg(F.count("*").alias("turns"))
    sizes = segments.groupBy("conv_id").agg(F.sum("turns").alias("turns"))
    lengths = sizes.select(F.col("conv_id").alias("leader"), F.least("turns", F.lit(modulus - 1)).alias("lendable"))
    who = sizes.withColumn("head", head).withColumn("leader", leader).join(lengths, "leader", "left")
    who = stored(
        who.select("conv_id", "leader", "head", F.least("head", F.coalesce("lendable", F.lit(0))).alias("lent"))
    )
    # Heads are short, and a leader lends to fewer than ``group`` others.
    heads = (
        who.where("lent > 0")
        .select(F.col("conv_id").alias("to"), F.col("leader").alias("conv_id"), "head")
        .join(turns.where(F.col("place") < modulus), "conv_id")
        .where("place <= head")
        .select(F.col("to").alias("conv_id"), "place", "role", "text")
    )
    moved = segments.select("conv_id", "segment").join(who.select("conv_id", "head", "lent"), "conv_id")
    tails = (
        turns.withColumn("segment", _segment())
        .join(moved, ["conv_id", "segment"])
        .where("place > head")
        .select("conv_id", (F.col("place") - F.col("head") + F.col("lent")).alias("place"), "role", "text")
    )
    return heads.unionByName(tails)


def _lane(salt: str) -> Column:
    return F.xxhash64(F.lit(salt), "place", "role", "text")


def _members(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, a, b, bytes, ends): each conversation in each node it passes through.

    a and b combine the hashes of the turns so far (each with its place); 128 bits name a prefix.
    They are combined over segments of turns and then inside them, so that a long conversation
    is no group of all its turns.
    """
    hashed = stored(
        turns.select(
            "conv_id", "place", _segment().alias("segment"), _lane("a").alias("x"), _lane("b").alias("y"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )
    segments = hashed.groupBy("conv_id", "segment").agg(
        F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"), F.count("*").alias("turns")
    )
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select(
        "conv_id", "segment",
        F.coalesce(F.expr("bit_xor(x)").over(before), F.lit(0)).alias("x0"),
        F.coalesce(F.expr("bit_xor(y)").over(before), F.lit(0)).alias("y0"),
    )
    lengths = segments.groupBy("conv_id").agg(F.sum("turns").alias("turns"))
    so_far = Window.partitionBy("conv_id", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inner = hashed.select(
        "conv_id", "segment", "place", "bytes",
        F.expr("bit_xor(x)").over(so_far).alias("x"), F.expr("bit_xor(y)").over(so_far).alias("y"),
    )
    nodes = inner.join(starts.join(lengths, "conv_id"), ["conv_id", "segment"]).select(
        "conv_id",
        F.col("place").alias("depth"),
        F.expr("x ^ x0").alias("a"),
        F.expr("y ^ y0").alias("b"),
        "bytes",
        (F.col("place") == F.col("turns")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    roots = everyone.join(lengths, "conv_id", "left").select(
        "conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"), F.col("turns").isNull().alias("ends")
    )
    members = stored(nodes.unionByName(roots))
    discard(hashed)
    return members


def _named(members: DataFrame, options: Options) -> DataFrame:
    """``members`` with ``node`` (the smallest conversation in it), ``n_convs`` and ``n_ends``.

    Nodes are counted with partial sums.  Of the rows that look their node up, those of hot
    nodes meet a broadcast table of a proven size; any other node has a small share of the rows.
    """
    keys = ["depth", "a", "b"]
    nodes = stored(
        members.groupBy(*keys).agg(
            F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends")
        )
    )
    most = nodes.agg(F.sum("n_convs")).first()[0] or 0
    hot = F.broadcast(nodes.where(F.col("n_convs") > most * options.hot_share))
    common = members.join(hot, keys)
    rare = members.join(hot.select(*keys), keys, "left_anti").join(
        nodes.where(F.col("n_convs") <= most * options.hot_share), keys
    )
    return stored(common.unionByName(rare).select("conv_id", "depth", "node", "bytes", "ends", "n_convs", "n_ends"))


def _paths(steps: DataFrame, height: int, stride: int) -> DataFrame:
    """Nodes of the trie of every ``stride``-th level, with their ancestors inside their band.

    Rows (node, depth, path): ``path`` holds the names of the nodes from the band's top down to
    the parent.  A band is ``height`` levels of this trie below its top; its last level is the
    next bands' tops.  The root has no row.
    """
    level = F.col("depth") / stride
    own = steps.where(F.col("depth") % stride == 0).select("conv_id", "node", level.cast("long").alias("level"))
    # A top closes the band above it and opens its own.
    bands = F.array_distinct(F.array(F.expr(f"greatest(level - 1, 0) div {height}"), F.expr(f"level div {height}")))
    spread = own.select("conv_id", "node", "level", F.explode(bands).alias("band"))
    grouped = spread.groupBy("conv_id", "band").agg(
        F.sort_array(F.collect_list(F.struct("level", "node"))).alias("items")
    )  # at most height + 1 items
    grouped = grouped.where(F.exists("items", lambda item: item["node"] == F.col("conv_id")))
    nodes = F.transform("items", lambda item: item["node"])
    return (
        grouped.select("conv_id", "band", nodes.alias("nodes"), F.posexplode("items").alias("at", "item"))
        .where((F.col("item.node") == F.col("conv_id")) & (F.col("at") > 0))
        .select(
            F.col("conv_id").alias("node"),
            (F.col("item.level") * stride).alias("depth"),
            F.expr("slice(nodes, 1, at)").alias("path"),
        )
    )


def roll_up(
    steps: DataFrame, paths: DataFrame, values: DataFrame, sums: list[str], deepest: int, height: int, stride: int = 1
) -> DataFrame:
    """Totals of ``sums`` over the subtree of every node of the trie of every ``stride``-th level.

    ``steps`` (conv_id, depth, node) are the conversations' ways through the trie, ``paths`` the
    nodes' ancestors inside their bands, ``values`` (node, depth, ``sums``) the nodes' own values.
    """
    if deepest < stride:  # the root alone
        return values
    width = height * stride  # between tops
    named = stored(values.join(paths, ["node", "depth"], "left"))  # the root has no path
    totals = [F.sum(name).alias(name) for name in sums]
    inside = F.col("depth") % width != 0
    top_depth = F.floor(F.col("depth") / width) * width
    below = named.where(inside).select(F.col("path")[0].alias("node"), top_depth.alias("depth"), *sums)
    tops = named.where(~inside).select("node", "depth", *sums).unionByName(below).groupBy("node", "depth").agg(*totals)
    tops = roll_up(steps, _paths(steps, height, width), stored(tops), sums, deepest, height, width)
    # Inner nodes bring their own value, the tops that close the band their completed total.
    closing = tops.join(named.where(~inside).where("path is not null").select("node", "depth", "path"), ["node", "depth"])
    rising = named.where(inside).unionByName(closing.select(*named.columns))
    start = F.expr(f"((depth - 1) div {width}) * {width}")
    ancestors = rising.select(start.alias("start"), *sums, F.posexplode("path").alias("at", "node")).where("at > 0")
    ancestors = ancestors.select("node", (F.col("start") + F.col("at") * stride).alias("depth"), *sums)
    inner = named.where(inside).select("node", "depth", *sums).unionByName(ancestors).groupBy("node", "depth").agg(*totals)
    return inner.unionByName(tops.select(*inner.columns))


def _hashed_ends(ends: DataFrame, options: Options) -> DataFrame:
    """(node, depth, ends_sha256): checksum of the ascending, comma-joined ids of the members that end there.

    Sorted ranges of ids become pieces of text in parallel; the pieces of one node, a few
    thousandths of its rows, are hashed in order by one task that keeps one piece in memory.
    """
    ranged = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    pieces = ranged.mapInArrow(_pieces(options.piece), "node long, depth long, first long, ids string")
    together = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return together.mapInArrow(_hashes, "node long, depth long, ends_sha256 string")


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        rows: list[tuple] = []
        for batch in batches:
            for node, depth, conv in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "conv_id")), strict=True):
                if ids and (key != (node, depth) or len(ids) >= size):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = node, depth
                ids.append(conv)
            if len(rows) >= 1000:
                yield _rows(rows, ("node", "depth", "first", "ids"))
                rows = []
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))
        yield _rows(rows, ("node", "depth", "first", "ids"))

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        rows = []
        for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "ids")), strict=True):
            if key == (node, depth):
                digest.update(b",")
            else:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield _rows(rows, ("node", "depth", "ends_sha256"))
    if key is not None:
        yield _rows([(*key, digest.hexdigest())], ("node", "depth", "ends_sha256"))


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    text = ("ids", "ends_sha256")
    kinds = [pa.string() if name in text else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def prefix_trie(turns: DataFrame, everyone: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (see the parts of this module for how each is counted).

    ``turns`` (conv_id, place from 1 without gaps, role, text), ``everyone`` (conv_id): all
    conversations, those without turns included.  ``saved_tokens`` are bytes of the last text of
    a node times the members beyond the first, summed over the subtree.  Without conversations
    there is no row.
    """
    members = _members(turns, everyone.distinct())
    steps = _named(members, options)
    discard(members)
    own = stored(
        steps.where("conv_id = node").select(
            "node", "depth", "n_convs",
            (F.col("n_convs") == F.col("n_ends")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        )
    )
    deepest = own.agg(F.max("depth")).first()[0] or 0
    sums, key = ["n_leaves", "saved_tokens"], ["node", "depth"]
    paths = stored(_paths(steps, options.height, 1))
    totals = roll_up(steps, paths, own.select(*key, *sums), sums, deepest, options.height)
    parents = paths.select(*key, F.element_at("path", -1).alias("parent"))
    families = parents.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    ends = _hashed_ends(steps.where("ends").select(*key, "conv_id"), options)
    return (
        own.select(*key, "n_convs")
        .join(totals, key)
        .join(parents, key, "left")
        .join(families, key, "left")
        .join(ends, key, "left")
        .select(
            F.col("node").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )


def _crc32(value: str) -> str:
    """DuckDB expression: CRC-32 of the decimal digits of a number, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))"
    digits = f"list_transform(string_split({value}::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {step}), 4294967295)"


def oracle_sql() -> str:
    """DuckDB twin of the trie over ``conversations`` with borrowed heads: nodes are whole lists of turns."""
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(t ORDER BY place) AS own, {_crc32("conv_id")} % 9 AS h FROM turns GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS seq
  FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 5),
steps AS (SELECT conv_id, d, seq[1:d] AS node, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, node[1:d - 1] AS above,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(node[d].text) END AS saved FROM steps GROUP BY node, d),
families AS (SELECT above AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN families USING (node, d)),
totals AS (SELECT node[1:k] AS node, k AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(c.ended) AS ends_sha256
FROM counted c JOIN totals USING (node, d) LEFT JOIN nodes p ON p.d = c.d - 1 AND p.node = c.above AND c.d > 0"""
