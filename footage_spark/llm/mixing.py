"""Mixing sources to target weights by pivotal dependent rounding, in SQL expressions only.

Every document of a source starts with the same expected number of copies, target / size of the
source.  Whole copies are given at once; the fractions are settled by pairing documents: the pair
moves expected words from one to the other, so that the words expected of both together stay the
same, until one of the two has a whole copy or none.  The other one goes on.  Documents of a source
are dealt by hash into blocks of about BLOCK rows; each block leaves one fraction, and the fractions
of the blocks meet in blocks of the next level, down to one document per source, which is rounded to
the nearer whole.  A block takes its longest documents first, so that a short one tends to be left.
So a source's taken words differ from its target by half a document at most, and no step gathers
more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import cut, join_hot, number_equals

#: The weights of sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CEILING, BLOCK = 1.5, 2.0, 64
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, share: float = SHARE, ceiling: float = CEILING, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target of each source; one row per source goes through the window.

    Water filling: sources are full in order of ceiling * size / weight; with the full ones taken
    out, the rest shares what is left by weight.
    """
    name = F.hex(F.encode(F.col("source"), "UTF-8"))  # bytes of UTF-8 sort as code points do
    order = Window.orderBy(F.col("source").isNull(), name)
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    ranked = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(ceiling))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", level)
    )
    # the level rises with the order until the first source that is not full; from there it holds
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place_cap", "level"))).over(every)
    ranked = ranked.withColumn("place_cap", F.row_number().over(by_cap)).withColumn("open", open_level)
    full = F.col("open").isNull() | (F.col("place_cap") < F.col("open.place_cap"))
    return ranked.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("open.level") * F.col("weight")).alias("target"))


def _draw(*parts: Column) -> Column:
    """A uniform number in [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _settle(a: Column, b: Column) -> Column:
    """The pair after the move: struct(done, go): done has p of 0 or 1.  s is the size, p the fraction."""
    x, y = a["p"] * a["s"], b["p"] * b["s"]  # expected words of each
    up = F.least(a["s"] - x, y)  # words a can take from b
    down = F.least(x, b["s"] - y)  # words b can take from a
    rise = _draw(a["tie"], b["tie"], F.lit("move")) * (up + down) < down
    gain = F.when(rise, up).otherwise(-down)
    b_whole = F.when(rise, y <= a["s"] - x).otherwise(b["s"] - y <= x)  # b ends with 0 (rise) or 1
    new_a = F.struct(a["row"].alias("row"), a["tie"].alias("tie"), a["s"].alias("s"), ((x + gain) / a["s"]).alias("p"))
    new_b = F.struct(b["row"].alias("row"), b["tie"].alias("tie"), b["s"].alias("s"), ((y - gain) / b["s"]).alias("p"))
    whole = lambda v: F.struct(v["row"].alias("row"), v["tie"].alias("tie"), v["s"].alias("s"), F.round(v["p"]).alias("p"))
    return F.when(b_whole, F.struct(whole(new_b).alias("done"), new_a.alias("go"))).otherwise(F.struct(whole(new_a).alias("done"), new_b.alias("go")))


def _round_blocks(rows: DataFrame) -> DataFrame:
    """One level: rows (source, block, row, tie, s, p) -> (source, done array, go)."""
    item = f"struct<row:{rows.schema['row'].dataType.simpleString()},tie:bigint,s:double,p:double>"
    grouped = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "tie", "row", "s", "p"))).alias("items"))
    zero = F.struct(F.expr(f"cast(array() as array<{item}>)").alias("done"), F.expr(f"cast(null as {item})").alias("go"))

    def step(state: Column, x: Column) -> Column:
        pair = _settle(state["go"], x)
        whole = (x["p"] < 1e-9) | (x["p"] > 1 - 1e-9)
        here = F.struct(x["row"].alias("row"), x["tie"].alias("tie"), x["s"].alias("s"), x["p"].alias("p"))
        fresh = F.struct(x["row"].alias("row"), x["tie"].alias("tie"), x["s"].alias("s"), F.round(x["p"]).alias("p"))
        keep = lambda d, g: F.struct(d.alias("done"), g.alias("go"))
        spent = (state["go"]["p"] < 1e-9) | (state["go"]["p"] > 1 - 1e-9)
        ended = F.struct(state["go"]["row"].alias("row"), state["go"]["tie"].alias("tie"), state["go"]["s"].alias("s"), F.round(state["go"]["p"]).alias("p"))
        return (
            F.when(whole, keep(F.array_append(state["done"], fresh), state["go"]))
            .when(state["go"].isNull(), keep(state["done"], here))
            .when(spent, keep(F.array_append(state["done"], ended), here))
            .otherwise(keep(F.array_append(state["done"], pair["done"]), pair["go"]))
        )

    return grouped.select("source", F.aggregate("items", zero, step).alias("r")).select("source", "r.done", "r.go")


#: Most sources whose plan is sent to every task (some 100 bytes each).
MOST_SOURCES = 100_000


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows(source, ...) with the other columns of plan; one source may have any share of the rows."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("__of")
    small = plan.select(key, *(c for c in plan.columns if c != "source"))
    named = rows.select("*", key)
    return (named.join(F.broadcast(small), "__of") if few else join_hot(cut(named), small, ["__of"])).drop("__of")


def mix_sources(docs: DataFrame, share: float = SHARE, ceiling: float = CEILING, block: int = BLOCK, weights=WEIGHTS, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, row of every row of docs(doc_id, text, source).

    row is a number of its own for each row: the column of that name (unique and stable), or a new
    one.  A null text has size 0; rows without words get no copies.  A null source is a source of its
    own, the last one.  Rows are settled one by one.  A row's draws depend on its doc_id, text and source
    alone, and on its number among rows that are equal in them (which of those has which number makes no
    difference), so reruns agree however the table is stored or split.  An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    content = F.xxhash64("doc_id", "text", "source").alias("content")
    sized = cut(docs.select("doc_id", "source", size, content, F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row")))
    by_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, ceiling, weights)
    counts = sized.where("size > 0").groupBy(F.col("source").alias("of_source")).agg(F.count(F.lit(1)).alias("n"))
    plan = cut(by_source.join(counts, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    few = plan.count() <= MOST_SOURCES
    joined = _with_plan(sized, plan, few)
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    numbered = number_equals(sized.where("size > 0"), "content", "among")
    tied = numbered.select("source", "row", F.xxhash64("content", "among").alias("tie"), F.col("size").cast("double").alias("s"))
    level = _with_plan(tied, plan, few).select("source", "row", "tie", "s", part.alias("p"), "n").where("p > 1e-9")
    level = level.withColumn("blocks", F.ceil(F.col("n") / block))
    settled = None
    most = plan.agg(F.max("n")).first()[0] or 0
    depth = 0
    while True:
        depth += 1
        last = most <= 1
        out = cut(_with_plan(_round_blocks(level.withColumn("block", F.pmod(F.xxhash64("tie", F.lit(depth)), F.greatest("blocks", F.lit(1))))), plan.select("source", "n"), few))
        done = out.select(F.explode("done").alias("x"), "source").select("source", "x.*")
        settled = done if settled is None else settled.unionByName(done)
        level = out.where("go is not null").select("source", "go.*", "n").withColumn("blocks", F.ceil(F.col("n") / float(block) ** (depth + 1)))
        if last or most <= float(block) ** depth:  # that level had one block for each source
            rounded = level.select("source", "row", "tie", "s", F.round("p").alias("p"))
            settled = settled.unionByName(rounded)
            break
    extra = settled.select(F.col("row").alias("of"), F.col("p").cast("long").alias("extra"))
    joined = joined.withColumn("whole", whole.cast("long"))
    out = joined.join(extra, F.col("row") == F.col("of"), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "row")
