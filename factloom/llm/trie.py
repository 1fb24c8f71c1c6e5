"""Prefix tries of conversations by vertical bitmaps.

A conversation is cut into units of DEPTH turns. Units are kept in order of conversation; a shard is a run of at most
SHARD_UNITS of them. Each shard indexes (position, turn) to the bitset of its units that have this turn there, and walks
depth first: the intersection of a parent's bitset with a posting is a child, its popcount the child's members here.
A node is known in all shards by the sums of two hashes of its (position, turn) pairs, so that a unit that starts deep
in a conversation continues from the node it starts at, and shards meet by adding up counts of the same node.

Subtrees are summed without walking up: every node's smallest member is its owner. A conversation owns its nodes from
some depth on, so what it owns below counts, once, for each of its prefixes above: a second walk adds up, by bitmaps of
the bits of those weights, what the members of a node own below it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table, tune

#: Turns of one unit, and units and turns of one shard.
DEPTH, SHARD_UNITS, SHARD_TURNS = 64, 4096, 65536
#: Node ids are sums modulo 2**BITS of two hashes.
BITS = 60
MASK = (1 << BITS) - 1
WORD = "[^\\x20\\x09-\\x0D]+"


# the turns


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, p, n, key, words) of all turns: position from 0, turns of the conversation, digest of role and text, words of the text.

    Turns come in order of ``turn``, null first, then role and text; a null role or text is empty. Repeated rows are
    turns of their own. Rows without a conversation are left out.
    """
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    of = Window.partitionBy("conv_id")
    p = (F.row_number().over(of.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1).cast("long")
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256), 1, 32))
    return rows.select("conv_id", p.alias("p"), F.count("*").over(of).alias("n"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: (conv_id, p, n, key, words) of all turns, and (conv_id, n) of all conversations.

    Conversation c starts with the first h turns of conversation c - c % 20, h being crc32 of c as text modulo 4, all
    if these are fewer, and goes on with its own turns after its first h. It may end up without any turn.
    """
    every = turns.where("p = 0").select("conv_id", F.col("n").alias("own"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    bases = turns.where("conv_id % 20 = 0 and p = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    c = every.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    c = c.withColumn("all", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    heads = turns.where("conv_id % 20 = 0 and p < 3").select(F.col("conv_id").alias("base"), "p", "key", "words")
    first = c.join(heads, "base").where("p < h").select("conv_id", "p", F.col("all").alias("n"), "key", "words")
    rest = turns.drop("n").join(c, "conv_id").where("p >= h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), F.col("all").alias("n"), "key", "words")
    return first.unionByName(rest), c.select("conv_id", F.col("all").alias("n"))


def units(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The index's rows, stored in order of conversation: (at, conv_id, block, n, a0, b0, a, b, words).

    a and b hold the hashes of DEPTH turns at most, a0 and b0 the id of the node the unit starts at; ``at`` counts up by
    one within each stored partition. Conversations without turns have one empty unit.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), "p", "key").bitwiseAND(F.lit(MASK))
    t = turns.select("conv_id", "n", F.floor(F.col("p") / DEPTH).cast("long").alias("block"), F.struct("p", h(1).alias("a"), h(2).alias("b"), "words").alias("t"))
    u = t.groupBy("conv_id", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("t")).alias("t"))  # DEPTH turns at most
    empty = convs.where("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), "n", F.array().cast(u.schema["t"].dataType).alias("t"))
    u = u.unionByName(empty)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.aggregate(c, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    start = lambda c: F.coalesce(F.sum(total(F.col("t")[c])).over(before) % F.lit(1 << BITS).cast("decimal(20,0)"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    deep = u.where(F.col("n") > DEPTH).select("*", start("a").alias("a0"), start("b").alias("b0"))
    u = deep.unionByName(u.where(F.col("n") <= DEPTH).select("*", zero.alias("a0"), zero.alias("b0")))
    u = u.repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "block")
    return stash(u.select(F.monotonically_increasing_id().alias("at"), "conv_id", "block", "n", "a0", "b0", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.words").alias("words")))


# a shard's walk


class Shard:
    """Vertical bitmaps of units: postings of (position, turn), the units that end at each depth, and the start nodes."""

    def __init__(self, rows: list[dict]):
        self.rows, self.turns = rows, [list(zip(r["a"], r["b"], r["words"])) for r in rows]
        self.postings: dict[tuple, int] = {}
        self.ending: dict[int, int] = {}
        self.starts: dict[tuple, int] = {}
        for k, (r, turns) in enumerate(zip(rows, self.turns)):
            bit, first = 1 << k, r["block"] * DEPTH
            for i, (a, b, _) in enumerate(turns):
                at = (first + i, a, b)
                self.postings[at] = self.postings.get(at, 0) | bit
            start = (first, r["a0"], r["b0"])
            self.starts[start] = self.starts.get(start, 0) | bit
            if first + len(turns) == r["n"]:
                self.ending[r["n"]] = self.ending.get(r["n"], 0) | bit

    def nodes(self) -> Iterator[tuple]:
        """(depth, a, b, parent's a, parent's b, words, members, ends), depth first; a start is a node only at depth 0."""
        for (first, a, b), members in self.starts.items():
            if first == 0:
                yield 0, a, b, None, None, 0, members, members & self.ending.get(0, 0)
            stack = [(first, a, b, members)]
            while stack:
                depth, a, b, members = stack.pop()
                rest = members & ~self.ending.get(depth, 0) if depth > first or depth == 0 else members
                while rest:
                    unit = (rest & -rest).bit_length() - 1
                    turns = self.turns[unit]
                    if depth - first >= len(turns):  # goes on in the next unit
                        rest ^= 1 << unit
                        continue
                    x, y, words = turns[depth - first]
                    child = rest & self.postings[depth, x, y]
                    rest &= ~child
                    node = (a + x) & MASK, (b + y) & MASK
                    yield depth + 1, *node, a, b, words, child, child & self.ending.get(depth + 1, 0)
                    stack.append((depth + 1, *node, child))


def bits(x: int) -> np.ndarray:
    """The places of the set bits, rising."""
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _shards(batches) -> Iterator[Shard]:
    """Shards of the units, across batches: bounded in units and turns, cut where units that are numbered have a gap."""
    have, turns = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            gap = have and "at" in r and r["at"] != have[-1]["at"] + 1
            if have and (len(have) >= SHARD_UNITS or turns + len(r["a"]) > SHARD_TURNS or gap):
                yield Shard(have)
                have, turns = [], 0
            have.append(r)
            turns += len(r["a"])
    if have:
        yield Shard(have)


_LOCAL = "a long, b long, pa long, pb long, depth long, conv_id long, members long, words long, ends string"
_BELOW = "a long, b long, leaves long, saved decimal(38,0)"
_HASHED = "a long, b long, ends_sha256 string"


def _walk(batches):
    """Each shard's nodes, with the smallest member, the number of members, and the ends' ids in decimal, joined."""
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    for shard in _shards(batches):
        ids, out = [r["conv_id"] for r in shard.rows], []
        for depth, a, b, pa_, pb, words, members, ends in shard.nodes():
            low = (members & -members).bit_length() - 1  # units are in order of conversation
            out.append((a, b, pa_, pb, depth, ids[low], members.bit_count(), words, ",".join(str(ids[k]) for k in bits(ends)) if ends else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends" else pa.int64()) for n, c in zip(names, zip(*out))], names)


def _below(batches):
    """What the members of each node own below it: leaves, and saved words by bitmaps of the bits of each weight."""
    for shard in _shards(batches):
        owned = [(k, r) for k, r in enumerate(shard.rows) if r["top"] is not None and r["top"] > 0]
        slices = [sum(1 << k for k, r in owned if int(r["weight"]) >> j & 1) for j in range(max((int(r["weight"]).bit_length() for _, r in owned), default=0))]
        leaf = sum(1 << k for k, r in owned if r["leaf"])
        tops: dict[int, int] = {}
        for k, r in owned:
            tops[r["top"]] = tops.get(r["top"], 0) | 1 << k
        steps, deeper = sorted(tops), [0]  # deeper[k]: the units whose top is at steps[k] or below
        for t in reversed(steps):
            deeper.append(deeper[-1] | tops[t])
        deeper.reverse()
        out = []
        for depth, a, b, _, _, _, members, _ in shard.nodes():
            inside = members & deeper[bisect_right(steps, depth)]
            if inside:
                out.append((a, b, (inside & leaf).bit_count(), sum((inside & s).bit_count() << j for j, s in enumerate(slices))))
        if out:
            a, b, leaves, saved = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(leaves, pa.int64()), pa.array([Decimal(x) for x in saved], pa.decimal128(38, 0))], ["a", "b", "leaves", "saved"])


def _hash(batches):
    """SHA-256 of each node's ends, whose pieces come in order of id; one node's state is held at a time."""
    now, state, done = None, None, []
    for batch in batches:
        for a, b, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if (a, b) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if len(done) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), d)) for d in done])
            done = []
    if now is not None:
        done.append((*now, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), d)) for d in done])


# the trie of all conversations


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, p, n, key, words) with p from 0 to n - 1; convs: (conv_id, n), those without turns included. Without
    conversations there are no nodes. A node that ends very many conversations is hashed by one task, as SHA-256 goes
    through its list in order: it reads pieces of up to SHARD_UNITS ids and holds none. Node ids are two hashes of BITS
    bits; two nodes of a billion share one with a probability below 10**-18.
    """
    tune(turns.sparkSession)
    index = units(turns, convs)
    local = stash(index.select("at", "conv_id", "block", "n", "a0", "b0", "a", "b", "words").mapInArrow(_walk, _LOCAL))
    nodes = stash(
        local.groupBy("a", "b", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("words").alias("words"), F.max(F.struct("pa", "pb")).alias("parent"))
        .select("a", "b", "depth", "conv_id", "n_convs", "words", "parent.pa", "parent.pb")
    )
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = ((F.col("n_convs") - 1) * F.col("words")).cast("decimal(38,0)")
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = stash(nodes.select("*", F.sum(own).over(deeper).alias("own_saved"), F.max((F.col("n_children") == 0).cast("long")).over(deeper).alias("own_leaf")))
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("own_saved").alias("weight"), F.max("own_leaf").alias("leaf"))
    weighted = index.drop("at").join(tops.where("top > 0"), "conv_id", "left").select("conv_id", "block", "n", "a0", "b0", "a", "b", "words", "top", "weight", "leaf")
    below = weighted.mapInArrow(_below, _BELOW).groupBy("a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ends = local.where("ends is not null").select("a", "b", F.substring_index("ends", ",", 1).cast("long").alias("first"), "ends")
    ends = ends.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ends").mapInArrow(_hash, _HASHED)
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, ["a", "b"], "left").join(ends, ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    zero = F.lit(0)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("own_leaf") + F.coalesce("leaves", zero)).cast("long").alias("n_leaves"),
        (F.col("own_saved") + F.coalesce("saved", zero)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared beginnings; odd rows as in ordered(), rebuilt() and prefix_trie()."""
    return prefix_trie(*(stash(x) for x in rebuilt(stash(ordered(table(spark, sf_dir, "conversations"))))))


OP12_SQL = """
WITH o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda crc, x: list_reduce(list_value(xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))),
    4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c.conv_id, 0 AS part, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.p < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p >= c.h
), t AS (
  SELECT conv_id, row_number() OVER w AS d, list({'role': role, 'text': text}) OVER w AS path, text,
    count(*) OVER (PARTITION BY conv_id) AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
), m AS (
  SELECT conv_id, d, sha256(CAST(path AS VARCHAR) || CAST(list_transform(path, lambda x: length(x.role)) AS VARCHAR)) AS node,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, n FROM t
  UNION ALL
  SELECT conv_id, 0, 'root', 0, coalesce((SELECT max(n) FROM t WHERE t.conv_id = c.conv_id), 0) FROM c
), nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM m GROUP BY node, d
), up AS (
  SELECT x.node, x.depth, p.node AS parent, p.conv_id AS parent_conv_id
  FROM nodes x JOIN m ON m.conv_id = x.conv_id AND m.d = x.depth - 1 JOIN nodes p ON p.node = m.node AND p.depth = m.d
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL
), sub AS (
  SELECT a.node, a.d AS depth, count(CASE WHEN k.n_children IS NULL THEN 1 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM nodes x JOIN m a ON a.conv_id = x.conv_id AND a.d <= x.depth LEFT JOIN children k ON k.node = x.node AND k.depth = x.depth GROUP BY ALL
)
SELECT CAST(n.conv_id AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(up.parent_conv_id AS BIGINT) AS parent_conv_id,
  CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sub s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN up ON up.node = n.node AND up.depth = n.depth LEFT JOIN children k ON k.node = n.node AND k.depth = n.depth
"""
