"""A trie of conversation prefixes, peeled from its deepest turns towards the root.

A conversation is the list of its turns (role, text). Every distinct list of first
``d`` turns is a node of depth ``d``; the textless root has depth 0. Peeling starts
at the greatest depth: the conversations that end there are the first survivors;
stripping their last turns regroups them under shorter prefixes, where they merge
with each other and with conversations that end at that depth, and each group's
counts are final the moment its node is met. Between two depths at which anything
merges, a node has the same members as the node below it, so the turns in between are
stripped in one step: there is one round per depth at which conversations part (a few
where prompts are shared; as many as turns where logs hold every prefix of a long
conversation), each a pre-aggregated grouping of what survives, cut by a written table.

Prefixes are named by 128 bits: the exclusive or of a hash of (depth, role, text) per
turn, so that the parent's name needs no second look. Ranks and names of a long
conversation are running totals over its pieces (``ordered.running``), and the ids that
end at one node pass through a digest one by one: no conversation and no group of
copies is held by one task.

Defined results: rows without ``conv_id`` belong to no conversation; null roles and
texts are empty; null turns come first; rows of one turn follow their role, then a
hash of their content; repeated rows are turns like others; an empty table has no
nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.ordered import batched, grouped, running, streamed
from sparkprep.session import materialise

NAME = ["depth", "k1", "k2"]


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("long"))


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, nth`` (from 1), ``t1, t2`` (content), ``bytes`` (UTF-8 length of the text) of every turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    narrow = rows.where("conv_id is not null").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    one = F.lit(1).cast("long")
    ranked = running(narrow, ["conv_id"], ["turn", "role", "t1", "t2"], {"before": ("sum", one)})
    return ranked.select("conv_id", (_or_zero("before") + 1).alias("nth"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame, shared: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one.

    A conversation takes the first ``shared`` turns (at most ``most``) of conversation
    ``base`` (fewer if it has fewer, none if it is absent), then its own turns after
    its first ``shared``; both are expressions over ``conv_id``. Returns the turns
    (``conv_id, depth, t1, t2, bytes``) and the conversations (``conv_id, length``).
    """
    sizes = turns.groupBy("conv_id").agg(F.max("nth").alias("n")).withColumns({"shared": shared.cast("long"), "base": base})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.join(bases, "base", "left").withColumn("head", F.least("shared", _or_zero("n_base")))
    plan = plan.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    plan = materialise(plan.select("conv_id", "base", "shared", "head", "length"), "trie-plan")
    first = turns.where(F.col("nth") <= most).withColumnRenamed("conv_id", "base")
    heads = plan.where("head > 0").join(first, "base").where("nth <= head").select("conv_id", F.col("nth").alias("depth"), "t1", "t2", "bytes")
    tails = turns.where(F.col("nth") > shared).join(plan.where("length > head"), "conv_id")
    tails = tails.select("conv_id", (F.col("nth") - F.col("shared") + F.col("head")).alias("depth"), "t1", "t2", "bytes")
    return heads.union(tails), plan.select("conv_id", "length")


def _named(turns: DataFrame) -> DataFrame:
    """Every turn with the name ``k1, k2`` of the prefix that it ends and that of its parent, ``p1, p2``."""
    marks = {"g1": F.xxhash64("depth", "t1", "t2"), "g2": F.xxhash64(F.lit("second"), "t2", "t1", "depth")}
    marked = turns.withColumns(marks).select("conv_id", "depth", "g1", "g2", "bytes")
    named = running(marked, ["conv_id"], ["depth"], {"x1": ("bit_xor", F.col("g1")), "x2": ("bit_xor", F.col("g2"))})
    named = named.withColumns({"p1": _or_zero("x1"), "p2": _or_zero("x2")})
    return named.select(
        "conv_id", "depth", F.col("p1").bitwiseXOR(F.col("g1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("g2")).alias("k2"), "p1", "p2", "bytes"
    )


def _ends(named: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node at which conversations end: the digest of their ids, ascending, joined by commas."""
    last = named.groupBy("conv_id").agg(F.max_by(F.struct(*NAME), "depth").alias("end"))
    root = F.struct(*[F.lit(0).cast("long").alias(c) for c in NAME])
    ends = convs.select("conv_id").join(last, "conv_id", "left").select(F.coalesce("end", root).alias("end"), "conv_id").select("end.*", "conv_id")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in NAME] + [T.StructField("ends_sha256", T.StringType())])

    def digest(key: tuple, rows: Iterator[tuple]) -> tuple:
        found = hashlib.sha256()
        for i, row in enumerate(rows):
            found.update(("," if i else "").encode() + str(row[-1]).encode())
        return key + (found.hexdigest(),)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((digest(key, rows) for key, rows in grouped(batches, len(NAME))), schema)

    return streamed(ends, NAME, ["conv_id"]).mapInArrow(read, schema)


def _linked(nodes: DataFrame) -> DataFrame:
    """Stretches of nodes with the same members, each with the node above it that has more.

    The least member and the number of members tell a stretch: on one conversation's
    path, equal numbers mean equal members.
    """
    stretches = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("foot"),
        F.sum("saving").alias("own"),
        F.min_by(F.struct("p1", "p2"), "depth").alias("above"),
    )
    # a stretch's parent is met by name; the root's stretch has none
    child = stretches.select("conv_id", "n_convs", "top", "foot", "own", (F.col("top") - 1).alias("up_depth"), "above.*")
    up = nodes.select(F.col("depth").alias("up_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    return child.join(up, ["up_depth", "p1", "p2"], "left").select("conv_id", "n_convs", "top", "foot", "own", "up_conv", "up_n", "up_depth")


def _peeled(linked: DataFrame) -> DataFrame:
    """Per stretch: children and leaves below it and what its subtree below the stretch saves."""
    parting = linked.where("up_conv is not null").select(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).distinct()
    inner = materialise(linked.join(parting, ["conv_id", "n_convs"]), "trie-parting")
    depths = sorted((r["foot"] for r in inner.select("foot").distinct().toLocalIterator()), reverse=True)
    state = ["conv_id", "n_convs", "top", "foot", "n_children", "n_leaves", "below", "own", "up_conv", "up_n", "up_depth"]
    ended = linked.join(inner.select("conv_id", "n_convs"), ["conv_id", "n_convs"], "left_anti")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ended = ended.withColumns({"n_children": zero, "n_leaves": one, "below": zero}).select(*state)
    survivors = materialise(ended.sortWithinPartitions("up_depth"), "trie-ended")
    for depth in depths:
        met = survivors.where(F.col("up_depth") == depth).groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"))
        met = met.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum(F.col("below") + F.col("own")).alias("below"))
        merged = inner.where(F.col("foot") == depth).join(met, ["conv_id", "n_convs"]).select(*state)
        survivors = survivors.union(materialise(merged, "trie-merged"))
    return survivors


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (``conv_id, depth, t1, t2, bytes``) of the conversations ``convs``.

    Columns: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``, and the node's name
    ``k1, k2``. Subtrees include their top.
    """
    named = materialise(_named(turns), "trie-named")
    zero = F.lit(0).cast("long")
    at_root = convs.select("conv_id", *[zero.alias(c) for c in (*NAME, "p1", "p2", "bytes")])
    members = named.select(*at_root.columns).union(at_root).groupBy(*NAME)
    nodes = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("p1", "p2", "bytes")])
    nodes = materialise(nodes.withColumn("saving", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")
    peeled = _peeled(materialise(_linked(nodes), "trie-linked"))
    # within a stretch, the savings of the nodes below are a running total from its foot
    rising = nodes.where("n_convs > 1").select("conv_id", "n_convs", "depth", (-F.col("depth")).alias("height"), "saving")
    rising = running(rising, ["conv_id", "n_convs"], ["height"], {"under": ("sum", F.col("saving"))})
    stretches = peeled.select("conv_id", "n_convs", "top", "foot", "n_children", "n_leaves", "below", "up_conv")
    placed = nodes.join(stretches, ["conv_id", "n_convs"]).join(rising.select("conv_id", "depth", "under"), ["conv_id", "depth"], "left")
    at_foot, at_top = F.col("depth") == F.col("foot"), F.col("depth") == F.col("top")
    facts = placed.select(
        "conv_id",
        *NAME,
        F.when(at_top, F.col("up_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(at_foot, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + _or_zero("under") + F.col("saving")).alias("saved_tokens"),
    )
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return facts.join(_ends(named, convs), NAME, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
