"""The trie of conversations by shared beginnings, with subtree totals by parallel tree contraction.

A node is a different sequence of first turns.  Its key is the exclusive or of two 64-bit hashes of
(place, turn) over its turns, so a key can be made from any cut of a conversation: rows are dealt by
range, so that a conversation of any length is spread over tasks, and what stands before a task's part
is added afterwards.  A parent's key is the node's without its last turn.

The nodes of one conv_id (their smallest member) are a chain: who is the smallest at a node is the smallest at each
of its own nodes below.  So totals over subtrees are taken over the tree of chains, which is small and flat, and then added
up along each chain from its end.  Totals over the tree of chains come from contraction rounds, each a few joins on unique keys: `rake` takes all
leaves off and adds their totals to their parents (grouped, so a node may have any number of
children); `compress` takes nodes with one child out of their chain, an independent set of them by
hash, and leaves what they hold on the edge to that child.  Rounds are logarithmic in the tree's size, however
deep it is.  What was compressed comes back by following its edges, twice as far in each join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import cut, join_hot, small_batches, tidy

#: A conversation takes its first turns from the one at the last multiple of GROUP, at most TURNS - 1 of them.
GROUP, TURNS = 5, 9
#: Conversations whose ids are joined to one text before those texts meet: ids that differ in the last ID_BITS bits.
ID_BITS = 12
#: Depths of a chain that are added up in one task.
RUN = 4096
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, pid, i, digest, bytes: the rows of each conversation in order of turn (null first, then by digest).

    i counts the rows of a conversation in its part pid, from 1; parts are in order.  A conversation may
    span any number of parts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = cut(turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")))
    # equal rows may be told apart at will; a number splits very many of them
    keys = ["conv_id", "turn", "digest", "tie"]
    n = partitions or max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = narrow.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).withColumn("pid", F.spark_partition_id()).sortWithinPartitions(*keys)

    def run(batches):
        last, count = None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            i = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv)))) + 1
            if conv[0] == last:
                i[: first[1] if len(first) > 1 else len(conv)] += count
            last, count = int(conv[-1]), int(i[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("pid"), pa.array(i), batch.column("digest"), batch.column("bytes")], names=["conv_id", "pid", "i", "digest", "bytes"])

    return cut(small_batches(dealt.select("conv_id", "pid", "digest", "bytes")).mapInArrow(tidy(run), "conv_id long, pid int, i long, digest string, bytes long"))


def rebuilt(rows: DataFrame, group: int = GROUP, turns: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): conv_id, part, depth, digest, bytes, is_end of rebuilt conversations; conv_id, length of all of them.

    The first h turns of the conversation at the last multiple of group (h: crc32 of the id modulo
    turns), then the conversation's own after its first h.
    """
    counts = rows.groupBy("conv_id", "pid").agg(F.max("i").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    total = parts.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % turns, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = total.select(F.col("conv_id").alias("of"), F.col("own").alias("base_n"))
    convs = total.join(bases, F.col("base") == F.col("of"), "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")))
    placed = rows.join(parts.join(convs, "conv_id").select("conv_id", "pid", "before", "h", "taken", "length"), ["conv_id", "pid"]).withColumn("place", F.col("before") + F.col("i"))
    placed = cut(placed)
    depth = F.col("taken") + F.col("place") - F.col("h")
    own = placed.where(F.col("place") > F.col("h")).select("conv_id", "pid", depth.alias("depth"), "digest", "bytes", (depth == F.col("length")).alias("is_end"))
    lent = placed.where(F.col("place") < turns).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "bytes")
    asks = convs.select("conv_id", "base", "h", "length")
    taken = asks.join(lent, "base").where("depth <= h").select("conv_id", F.lit(-1).alias("pid"), "depth", "digest", "bytes", (F.col("depth") == F.col("length")).alias("is_end"))
    return own.unionByName(taken), convs.select("conv_id", "length")


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, p1, p2, bytes, is_end: each row with the keys of its node and of the node above."""
    hashed = rows.withColumns({"z1": F.xxhash64("depth", "digest"), "z2": F.xxhash64(F.lit("second"), "digest", "depth")})
    here = Window.partitionBy("conv_id", "pid").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = cut(hashed.withColumns({"r1": F.bit_xor("z1").over(here), "r2": F.bit_xor("z2").over(here)}))
    above = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = running.groupBy("conv_id", "pid").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    sums = sums.select("conv_id", "pid", *(F.coalesce(F.bit_xor(f"s{i}").over(above), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)))
    out = running.join(sums, ["conv_id", "pid"])
    key = {f"k{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)}
    return out.withColumns(key).select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "bytes", "is_end")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of ends(depth, k1, k2, conv_id): SHA-256 of the ids in order, comma-joined.

    Ids of one range of 2**ID_BITS become one text first; a node's texts then pass one after the other
    through a running digest, which holds one of them at a time.
    """
    near = ends.groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = near.select(*NODE, "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = texts.repartition(*NODE).sortWithinPartitions(*NODE, "range")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node != now:
                    done += [(*now, digest.hexdigest())] if now else []
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield table(done)
        if now:
            yield table([(*now, digest.hexdigest())])

    def table(done):
        return pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], [*NODE, "ends_sha256"])

    return small_batches(dealt).mapInArrow(tidy(run), "depth long, k1 long, k2 long, ends_sha256 string")


def _plus(a: str, b: str) -> Column:
    return F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("long"))


def subtree_totals(tree: DataFrame) -> DataFrame:
    """id, leaves, saved: sums over the subtree of each node of tree(id, parent, kids, leaves, saved), by contraction.

    The root has a null parent; kids is the number of children; leaves and saved are a node's own.
    id and parent may be of any type that can be joined and hashed.
    """
    zero = F.lit(0).cast("long")
    active = cut(tree.select("id", "parent", F.col("kids").cast("long").alias("kids"), "leaves", "saved", zero.alias("edge_leaves"), zero.alias("edge_saved")))
    done, contracted, rounds = [], [], 0
    while True:
        rounds += 1
        leaf = F.col("kids") == 0
        done.append(active.where(leaf).select("id", "leaves", "saved"))
        # rake: the leaves' totals go to their parents
        raked = active.where(leaf & F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("leaves") + F.col("edge_leaves")).alias("more_leaves"), F.sum(F.col("saved") + F.col("edge_saved")).alias("more_saved"))
        rest = active.where(~leaf).join(raked.withColumnRenamed("parent", "of"), F.col("id") == F.col("of"), "left")
        rest = cut(rest.select("id", "parent", (F.col("kids") - F.coalesce("n", zero)).alias("kids"), _plus("leaves", "more_leaves").alias("leaves"), _plus("saved", "more_saved").alias("saved"), "edge_leaves", "edge_saved"))
        if rest.isEmpty():
            break
        # compress: of nodes with one child, those that come first by hash among their neighbours in the chain
        unary = (F.col("kids") == 1) & F.col("parent").isNotNull()
        draw = F.xxhash64("id", F.lit(rounds))
        child = rest.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("id", "edge_leaves", "edge_saved", unary.alias("unary"), draw.alias("draw"))).alias("child")).where("m = 1")
        pairs = cut(rest.where(unary).withColumn("draw", draw).join(child, F.col("id") == F.col("of")).drop("of", "m"))
        later = pairs.where("child.unary").select(F.when((F.col("draw") < F.col("child.draw")) | ((F.col("draw") == F.col("child.draw")) & (F.col("id") < F.col("child.id"))), F.col("child.id")).otherwise(F.col("id")).alias("id")).distinct()
        out = pairs.join(later, "id", "left_anti")
        out = cut(out.select("id", "parent", F.col("child.id").alias("to"), (F.col("leaves") + F.col("child.edge_leaves")).alias("leaves"), (F.col("saved") + F.col("child.edge_saved")).alias("saved"), "edge_leaves", "edge_saved"))
        contracted.append(out.select("id", "to", "leaves", "saved"))
        # one row for each node that goes, one for each child that moves up
        gone = out.select(F.col("id").alias("of"), F.lit(True).alias("gone"), F.lit(None).cast(out.schema["parent"].dataType).alias("up"), zero.alias("up_leaves"), zero.alias("up_saved"))
        moved = out.select(F.col("to").alias("of"), F.lit(False).alias("gone"), F.col("parent").alias("up"), (F.col("edge_leaves") + F.col("leaves")).alias("up_leaves"), (F.col("edge_saved") + F.col("saved")).alias("up_saved"))
        change = rest.join(gone.unionByName(moved), F.col("id") == F.col("of"), "left").where(~F.coalesce("gone", F.lit(False)))
        at = F.col("up").isNotNull()
        active = cut(change.select("id", F.when(at, F.col("up")).otherwise(F.col("parent")).alias("parent"), "kids", "leaves", "saved", F.when(at, F.col("up_leaves")).otherwise(F.col("edge_leaves")).alias("edge_leaves"), F.when(at, F.col("up_saved")).otherwise(F.col("edge_saved")).alias("edge_saved")))
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    if not contracted:
        return totals
    links = contracted[0]
    for more in contracted[1:]:
        links = links.unionByName(more)
    links = cut(links)
    # a link leads to a node that went in a later round: so many doublings reach one that was raked
    for _ in range(max(rounds - 1, 1).bit_length()):
        on = links.select(F.col("id").alias("of"), F.col("to").alias("on"), F.col("leaves").alias("on_leaves"), F.col("saved").alias("on_saved"))
        step = links.join(on, F.col("to") == F.col("of"), "left")
        links = cut(step.select("id", F.coalesce("on", "to").alias("to"), _plus("leaves", "on_leaves").alias("leaves"), _plus("saved", "on_saved").alias("saved")))
    ends = totals.select(F.col("id").alias("of"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved"))
    back = links.join(ends, F.col("to") == F.col("of")).select("id", (F.col("leaves") + F.col("end_leaves")).alias("leaves"), (F.col("saved") + F.col("end_saved")).alias("saved"))
    return totals.unionByName(back)


def node_totals(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, leaves, saved: sums over the subtree of each of nodes(conv_id, depth, parent_conv_id, leaves, saved), which is read several times.

    Chains are added up in runs of RUN depths, and the runs after one another, so a chain of any length is spread over tasks.
    """
    zero = F.lit(0).cast("long")
    tops = nodes.where("parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("under"), (F.col("depth") - 1).alias("at"))
    chains = nodes.groupBy(F.col("conv_id").alias("id")).agg(F.max(F.when(F.col("parent_conv_id") != F.col("conv_id"), F.col("parent_conv_id"))).alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    kids = tops.groupBy("under").agg(F.count(F.lit(1)).alias("kids"))
    tree = chains.join(kids, F.col("id") == F.col("under"), "left").select("id", "parent", F.coalesce("kids", zero).alias("kids"), "leaves", "saved")
    totals = cut(subtree_totals(tree)).withColumnsRenamed({"leaves": "chain_leaves", "saved": "chain_saved"})
    hanging = tops.join(totals, F.col("conv_id") == F.col("id")).groupBy(F.col("under").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("chain_leaves").alias("more_leaves"), F.sum("chain_saved").alias("more_saved"))
    own = nodes.join(hanging, ["conv_id", "depth"], "left").select("conv_id", "depth", F.expr(f"depth div {RUN}").alias("run"), _plus("leaves", "more_leaves").alias("leaves"), _plus("saved", "more_saved").alias("saved"))
    below = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut(own.select("conv_id", "depth", "run", F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved")))
    after = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    # a run's first depth has the sum of the run
    runs = own.groupBy("conv_id", "run").agg(F.max(F.struct(-F.col("depth"), "leaves", "saved")).alias("sum"))
    runs = runs.select("conv_id", "run", F.sum("sum.leaves").over(after).alias("more_leaves"), F.sum("sum.saved").over(after).alias("more_saved"))
    return own.join(runs, ["conv_id", "run"]).select("conv_id", "depth", _plus("leaves", "more_leaves").alias("leaves"), _plus("saved", "more_saved").alias("saved"))


def prefix_trie(turns: DataFrame, group: int = GROUP, lent: int = TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    turns: conv_id, turn, role, text.  A null role or text is empty, a null turn comes first, rows of one turn
    are in order of a digest of role and text, repeated rows are turns of their own, rows without conv_id
    belong to no conversation, other columns are not looked at.  An empty table gives no rows.
    """
    rows, convs = rebuilt(ordered_turns(turns.select("conv_id", "turn", "role", "text")), group, lent)
    members = cut(keyed(rows))
    zero = F.lit(0).cast("long")
    made = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"))
    nodes = cut(made.unionByName(root).withColumn("above", F.col("depth") - 1))
    names = nodes.select(F.col("depth").alias("above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    placed = join_hot(nodes, names, ["above", "p1", "p2"]).select(*nodes.columns, "parent_conv_id").unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    placed = cut(placed)
    children = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("of"), F.col("above").alias("at")).agg(F.count(F.lit(1)).alias("n_children"))
    full = placed.join(children, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("at")), "left").withColumn("n_children", F.coalesce("n_children", zero)).drop("of", "at")
    ends = members.where("is_end").select(*NODE, "conv_id").unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    full = cut(full.join(end_digests(ends), NODE, "left"))
    totals = node_totals(full.select("conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    out = full.join(totals, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
