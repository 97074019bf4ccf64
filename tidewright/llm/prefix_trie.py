"""Prefix trie of conversations from chained digests of their prefixes.

A node is a distinct sequence of first turns.  Conversations that share a node share all nodes above it, so the nodes
whose least member is one conversation lie next to one another on that conversation's path, down to its end: a chain.
Subtree sums explode each chain to all chains above it and then sum each chain from its end upwards, which takes as many
rows as there are turns; exploding node by node would take half the square of a long conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import ranged
from .common import saved

#: Elements that one group chains, sums or joins at once.
BLOCK, IDS = 64, 4096
GROUP, SHARED = 100, 6


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def chained(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows(key, i, x, ...)``, i = 1, 2, ... within a key, with ``prefix``: a digest of x at 1 .. i.

    Digests are chained inside blocks of ``block`` elements; the digests of whole blocks are chained the same way, level
    by level, so no task follows one long key.
    """
    rest = [c for c in rows.columns if c not in ("key", "i", "x")]
    cut = rows.groupBy("key", F.floor((F.col("i") - 1) / block).alias("j")).agg(F.array_sort(F.collect_list(F.struct("i", "x", *rest))).alias("a"))
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(b""))
    run = F.aggregate("a", F.array().cast("array<binary>"), lambda acc, e: F.concat(acc, F.array(_digest(last(acc), e["x"]))))
    cut = cut.withColumn("run", run)
    if (rows.agg(F.max("i")).first()[0] or 0) > block:
        cut = saved(cut, "blocks")
        whole = cut.filter(F.size("a") == block).select("key", (F.col("j") + 1).alias("i"), F.element_at("run", -1).alias("x"))
        above = chained(saved(whole, "whole"), block).select("key", F.col("i").alias("j"), F.col("prefix").alias("above"))
        cut = cut.join(above, ["key", "j"], "left")
        cut = cut.withColumn("run", F.when(F.col("above").isNull(), F.col("run")).otherwise(F.transform("run", lambda r: _digest(F.col("above"), r))))
    each = cut.select("key", F.explode(F.arrays_zip("a", "run")).alias("e"))
    return each.select("key", "e.a.i", "e.a.x", *[f"e.a.{c}" for c in rest], F.col("e.run").alias("prefix"))


def _placed(turns: DataFrame) -> DataFrame:
    """(conv_id, at, x, chars): every turn's place in its conversation, from 1; long conversations spread over ranges."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = _digest(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = turns.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.col("turn").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    rows = rows.filter("conv_id is not null").select("conv_id", "turn", "role", x.alias("x"), F.char_length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("x"), F.col("row")]
    rows = ranged(rows, F.col("conv_id"), *order)
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    start = rows.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_b").orderBy(*order))
    return rows.withColumn("in", inside).join(start, ["conv_id", "_b"]).select("conv_id", (F.col("start") + F.col("in")).alias("at"), "x", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) and (key, i, x, chars, last) of the rebuilt conversations: the first h turns of the conversation that
    opens the hundred, then the own turns after the first h; h is the conv_id's CRC-32 modulo 6."""
    rows = saved(_placed(turns), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    opening = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("opening")
    heads = rows.filter((F.col("conv_id") % GROUP == 0) & (F.col("at") < SHARED)).select(F.col("conv_id").alias("opening"), "at", "x", "chars")
    heads = saved(heads, "heads")
    known = heads.groupBy("opening").agg(F.count(F.lit(1)).alias("there"))
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", h.alias("h"), opening).join(known, "opening", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0))).alias("taken")
    convs = convs.select("conv_id", "h", "opening", taken, (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + taken).alias("size"))
    convs = saved(convs, "convs")
    lent = convs.join(heads, "opening").filter(F.col("at") <= F.col("h")).select("conv_id", F.col("at").alias("i"), "x", "chars", "size")
    tail = rows.filter(F.col("at") > h).join(convs, "conv_id").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("i"), "x", "chars", "size")
    both = lent.unionByName(tail).select(F.col("conv_id").alias("key"), "i", "x", "chars", (F.col("i") == F.col("size")).alias("last"))
    return convs.select("conv_id", "size"), saved(both, "rebuilt")


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's texts, joined by commas; rows come sorted, and only the state of one node is held."""
    node, state = None, None
    for b in batches:
        out = []
        for owner, depth, ids in zip(b["owner"].tolist(), b["depth"].tolist(), b["ids"].tolist(), strict=True):
            if node != (owner, depth):
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])


def _ends(path: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where conversations end.  Ids of one stretch of ``IDS`` numbers become one
    text before they meet; a hash has to read its texts in order, so a node's texts stream through one task."""
    part = F.floor(F.col("conv_id") / IDS)
    texts = path.filter("last").groupBy("owner", "depth", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    texts = texts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part").select("owner", "depth", "ids")
    return texts.mapInPandas(_hashes, "conv_id long, depth long, ends_sha256 string")


def _from_below(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``nodes(conv_id, depth, ...)`` with ``sums`` replaced by their totals from this depth of the chain downwards, in
    blocks of depths, so a long chain is no single task's work."""
    x = nodes.withColumn("_j", F.floor(F.col("depth") / 1024))
    inside = Window.partitionBy("conv_id", "_j").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("conv_id").orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, -1)
    total = x.groupBy("conv_id", "_j").agg(*[F.sum(c).alias(c) for c in sums])
    total = total.select("conv_id", "_j", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"_{c}") for c in sums])
    x = x.withColumns({c: F.sum(c).over(inside) for c in sums}).join(total, ["conv_id", "_j"])
    return x.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_j", *[f"_{c}" for c in sums])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of ``turns(conv_id, turn, role, text)``: conv_id (its least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; equal turns by role and then by the digest of role and text, so repeated rows
    all count and their order does not matter.  Null role or text is empty.  Rows without a whole number as conv_id belong
    to no conversation.  An empty table has no node.  Columns other than the four are ignored.
    """
    convs, rows = rebuilt(turns)
    path = saved(chained(rows).select(F.col("key").alias("conv_id"), F.col("i").cast("long").alias("depth"), "prefix", "chars", "last"), "prefixes")
    found = path.groupBy("depth", "prefix").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
    path = path.join(found, ["depth", "prefix"]).drop("prefix")
    root = F.broadcast(convs.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")))  # one row
    roots = convs.crossJoin(root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), (F.col("size") == 0).alias("last"), "owner", "n_convs")
    path = saved(path.unionByName(roots), "paths")

    nodes = path.filter("owner = conv_id").withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars"))
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved_tokens").alias("saved_tokens"))
    above = path.filter("owner <> conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("at"))
    above = saved(above.join(chains, "conv_id"), "above")
    link = F.col("at") == F.col("top") - 1
    kids = above.filter(link).groupBy(F.col("owner").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("kids"))
    parent = above.filter(link).select("conv_id", F.col("top").alias("depth"), F.col("owner").alias("up"))
    nodes = nodes.join(kids, ["conv_id", "depth"], "left").join(parent, ["conv_id", "depth"], "left")
    n_children = F.coalesce("kids", F.lit(0)) + F.when(F.col("last"), 0).otherwise(1)
    nodes = nodes.withColumn("n_children", n_children).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    nodes = saved(nodes, "nodes")

    leaf = nodes.filter("n_leaves = 1").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    hung = above.join(leaf, "conv_id", "left").groupBy(F.col("owner").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved_tokens").alias("_s"), F.sum("leaf").alias("_l"))
    all_ = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"saved_tokens": F.col("saved_tokens") + F.coalesce("_s", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("_l", F.lit(0))})
    out = _from_below(all_, ["saved_tokens", "n_leaves"]).join(_ends(path), ["conv_id", "depth"], "left")
    up = F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", up, "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
