"""Prefix trie of conversations: blocks of several turns are told apart by digests first, turns only where blocks differ.

A conversation's prefix of d turns has an id of 128 bits: the exclusive or, over its turns, of hashes of each turn's
place and content.  Ids at the ends of blocks of `block` turns come first.  Conversations with equal ids at both ends
of a block hold the same turns there, so a block is kept once with the number of its conversations.  Where all blocks
that follow a prefix are the same one, its turns are nodes as they stand; where siblings diverge, the turns of the
distinct blocks are counted by their ids.

What concerns a node's whole subtree needs no walk down the trie.  Of each conversation the nodes of which it is the
smallest member are a tail of its path; q is the number of words before that tail.  The tokens that a node's subtree
saves are the sum of q over its members but the smallest, less the words before the node for each of these; its leaves
are its members that are the smallest of a childless node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwood.llm.exchange import join_evenly, staged
from driftwood.operators.scans import Scan

#: Members of a list that are written as one piece of text.
PIECE = 1 << 16
_NODE = ["x", "y"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.unhex(digest).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return rows.where("conv is not null")


def _placed(turns: DataFrame) -> DataFrame:
    """The rebuilt conversations' turns with their place (pos, from 1), the id of the prefix that they end (x, y) and the words up to them (upto)."""
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    # the three first turns of a conversation at most: combined before rows are shuffled
    first = F.slice(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))), 1, 3)
    ranked = turns.where("conv % 20 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "digest"))).where("rank <= 3")
    heads = ranked.groupBy("conv").agg(first.alias("head")).select(F.col("conv").alias("base"), "head")
    convs = turns.select("conv").distinct()
    lent = convs.withColumn("base", F.col("conv") - F.col("conv") % 20).withColumn("h", taken).where("h > 0").join(heads, "base")
    lent = lent.select("conv", F.lit(0).alias("src"), F.posexplode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("rank", "t")).select("conv", "src", F.col("t.turn").alias("turn"), F.col("t.digest").alias("digest"), F.col("t.words").alias("words"))
    own = turns.select("conv", F.lit(1).alias("src"), "turn", "digest", "words")
    scan = Scan(own.unionByName(lent), ["conv"], ["src", "turn", "digest"])
    scan.running(lent=("sum", F.when(F.col("src") == 0, 1).otherwise(0)), rank=("sum", F.col("src")))
    scan.where((F.col("src") == 0) | (F.col("rank") > taken))
    scan.with_columns(pos=F.when(F.col("src") == 0, F.col("lent")).otherwise(F.col("lent") + F.col("rank") - taken))
    scan.with_columns(a=F.xxhash64("pos", "digest"), b=F.xxhash64("digest", "pos", F.lit(1)))
    scan.running(x=("bit_xor", F.col("a")), y=("bit_xor", F.col("b")), upto=("sum", F.col("words")))
    return scan.result().select("conv", "pos", "a", "b", "x", "y", "words", "upto")


def _ends(convs: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the numbers of the conversations that end there, ascending; read piece by piece, never held whole."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        node: tuple | None = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"x": [node[0]], "y": [node[1]], "first": [held[0]], "piece": [",".join(map(str, held)).encode()]})

        for batch in batches:
            for x, y, conv in zip(*(batch[c].to_pylist() for c in ("x", "y", "conv"))):
                if held and (node != (x, y) or len(held) >= PIECE):
                    yield out()
                    held = []
                node = (x, y)
                held.append(conv)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            for x, y, piece in zip(*(batch[c].to_pylist() for c in ("x", "y", "piece"))):
                if node == (x, y):
                    sha.update(b",")
                else:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (x, y), hashlib.sha256()
                sha.update(piece)
            yield pa.RecordBatch.from_pydict({"x": [d[0] for d in done], "y": [d[1] for d in done], "ends_sha256": [d[2] for d in done]}, pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())]))
        if node:
            yield pa.RecordBatch.from_pydict({"x": [node[0]], "y": [node[1]], "ends_sha256": [sha.hexdigest()]})

    ranged = convs.select(*_NODE, "conv").repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    cut = ranged.mapInArrow(pieces, "x long, y long, first long, piece binary")
    return cut.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "x long, y long, ends_sha256 string")


def _block_nodes(blocks: DataFrame) -> DataFrame:
    """One row for each turn of distinct blocks."""
    return blocks.select("start", "conv", "n_convs", F.explode("turns").alias("t")).select("start", "conv", "n_convs", "t.*")


def prefix_trie(conversations: DataFrame, block: int = 4) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are ordered by turn (null first; equal turns by the digest of role and text), a null role or text is
    empty, and each is rebuilt: its first h turns, h = crc32(id) % 4, are those of conversation id - id % 20, if there
    is one.  Rows without a conv_id belong to no conversation; repeated rows are turns of their own.  Other columns are
    ignored.  An empty table has no node.  Prefixes are told apart by 128 bits.
    """
    turns = staged(_turns(conversations), "turns")
    if turns.isEmpty():
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rows = staged(_placed(turns), "rows")
    whole = rows.groupBy("conv").agg(F.max(F.struct("pos", "x", "y", "upto")).alias("end"))
    convs = turns.select("conv").distinct().join(whole, "conv", "left")
    convs = staged(convs.select("conv", *[F.coalesce(f"end.{c}", F.lit(0)).alias(c) for c in ("x", "y", "upto")]), "convs")

    # blocks of turns, each distinct one once
    turn = F.struct("pos", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"), "words", (F.col("upto") - F.col("words")).alias("before"))
    cut = rows.groupBy("conv", F.floor((F.col("pos") - 1) / block).alias("blk")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at_end = F.element_at("turns", -1)
    cut = cut.select("conv", "turns", F.struct(F.col("turns")[0]["px"].alias("x"), F.col("turns")[0]["py"].alias("y")).alias("start"), F.struct(at_end["x"].alias("x"), at_end["y"].alias("y")).alias("stop"))
    cut = staged(cut, "blocks")
    kinds = cut.groupBy("stop").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    kinds = staged(kinds.join(cut, ["stop", "conv"]), "kinds")
    total = kinds.count()
    after = staged(kinds.groupBy("start").agg(F.count("*").alias("kinds")), "after")
    kinds = staged(join_evenly(kinds, after.select("start", "kinds", (F.col("kinds") > 1).alias("diverge")), "start", "kinds", total), "told")

    # nodes: turns of blocks without siblings as they are, others by their ids
    same = [F.min(c).alias(c) for c in ("pos", "px", "py", "words", "before")]
    columns = ["x", "y", "conv", "n_convs", "pos", "px", "py", "words", "before"]
    alone = _block_nodes(kinds.where("not diverge")).select(*columns)
    apart = _block_nodes(kinds.where("diverge")).groupBy(*_NODE).agg(F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), *same).select(*columns)
    nodes = staged(alone.unionByName(apart), "nodes")
    kids = staged(nodes.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children")), "kids")

    # per conversation the words before its own nodes, and whether it is the smallest of a leaf
    owner = nodes.join(kids, _NODE, "left").groupBy("conv").agg(F.min_by("before", "pos").alias("q"), F.max(F.when(F.col("n_children").isNull(), 1).otherwise(0)).cast("long").alias("leaf"), F.count("*").alias("owned"))
    facts = staged(convs.join(owner, "conv", "left").select("conv", F.coalesce("q", "upto").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "owned"), "facts")
    n_blocks = cut.groupBy("conv").agg(F.count("*").alias("n_blocks"))
    spread = join_evenly(cut.select("conv", "stop"), staged(facts.drop("owned").join(n_blocks, "conv"), "weighed"), "conv", "n_blocks", cut.count())
    sums = spread.groupBy("stop").agg(F.sum("q").alias("q"), F.sum("leaf").alias("leaf"))
    each = kinds.drop("conv", "n_convs").join(sums, "stop").select("q", "leaf", F.explode("turns").alias("t"))
    below = each.groupBy(F.col("t.x").alias("x"), F.col("t.y").alias("y")).agg(F.sum("q").alias("q"), F.sum("leaf").alias("n_leaves"))
    nodes = join_evenly(nodes.join(below, _NODE), facts.where("owned > 0").select("conv", F.col("q").alias("own"), "owned"), "conv", "owned", nodes.count())
    nodes = nodes.withColumn("saved", F.col("q") - F.col("own") - (F.col("n_convs") - 1) * F.col("before"))

    # the root, above all conversations; one row
    own = facts.orderBy("conv").first()["q"]
    root = facts.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum("q").alias("q"), F.sum("leaf").alias("n_leaves"))
    root = root.select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv", "n_convs", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "q")
    root = root.withColumn("saved", F.col("q") - F.lit(own)).drop("q")
    every = nodes.select("x", "y", "conv", "n_convs", "pos", "px", "py", "n_leaves", "saved").unionByName(root)
    every = staged(every.join(kids, _NODE, "left").join(_ends(convs), _NODE, "left"), "every")

    # a parent of very many children is sent to all tasks
    above = every.where("n_children is not null").select(F.struct(*_NODE).alias("above"), F.col("conv").alias("parent_conv_id"), "n_children")
    out = every.withColumn("above", F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).withColumnRenamed("n_children", "children")
    top, rest = out.where("pos = 0").withColumn("parent_conv_id", F.lit(None).cast("long")), join_evenly(out.where("pos > 0"), above, "above", "n_children", every.count())
    none = hashlib.sha256(b"").hexdigest()
    return rest.unionByName(top).select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
