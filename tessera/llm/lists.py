"""Similar items from inverted lists, without all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, cut, release
from .components import components


def differ(x: Column, y: Column, percent: int, words: int) -> Column:
    """Whether two sets can be similar by their facts: sizes n, and parities p0 ... in as many words. A set's parity tells
    which remainders of its hashes occur an odd number of times, so two sets differ in at least as many items as these bits
    do; similar ones differ in (1 - J) / (1 + J) of both sizes at most."""
    bits = sum(F.bit_count(x[f"p{i}"].bitwiseXOR(y[f"p{i}"])) for i in range(words))
    return (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & ((100 + percent) * bits <= (100 - percent) * (x["n"] + y["n"]))


def _once(entries: DataFrame) -> DataFrame:
    """The entries of lists of two items and more, of lists with the same items one (told by count and 128 bits)."""
    marks = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("x2")]
    lists = entries.groupBy("value").agg(*marks).where("m > 1").groupBy("m", "x1", "x2").agg(F.min("value").alias("value"))
    return entries.join(lists.select("value"), "value", "left_semi")


#: Once the lists hold at most so many pairs for each entry, all of them are tested in one round.
PAIRS_PER_ENTRY = 64
#: Tables of up to this many rows (of some numbers each) are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def _few(df: DataFrame) -> DataFrame:
    """df, which is stored, to be broadcast if its number of rows, which is counted, allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def linked(entries: DataFrame, compare: Callable[[DataFrame], DataFrame], may: Callable[[Column, Column], Column], widen: int = 6) -> DataFrame:
    """node, component for items of the lists that a link joins to a smaller one.

    entries: value, doc, facts (a struct of the item), each once; items that share a value are candidates. may: a condition on the
    facts of two items that every link fulfils; it is part of the join, so pairs that fail it are never written. compare:
    takes pairs (pivot, doc), returns those that are links.

    In a round, some pivots of each list (the smallest item of each hashed slot: one slot, then 2 ** widen times as many in
    each further round) are paired with its other items of other components, and leave the list. Lists that lie within one
    component are closed. When what is left of the lists has few pairs (their number is counted, and is linear in the
    entries), all of them of different components are paired. So a list of m copies takes some m comparisons, one of
    unlike items all of them, and no pair of unjoined items is passed over.
    """
    members = tested = held = placed = pivots = None
    turn = 0
    left = _once(entries)
    while True:
        before, placed = (placed, pivots), left.withColumn("comp", F.col("doc"))
        if members is not None:
            placed = left.join(_few(members), F.col("doc") == F.col("node"), "left").select("value", "doc", "facts", F.coalesce("component", "doc").alias("comp"))
            still_open = placed.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("value")
            placed = placed.join(still_open, "value", "left_semi")
        placed = cut(placed)
        release(*before)
        per_list = placed.groupBy("value").agg(F.count("*").alias("m"))
        rows, pairs_left = per_list.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2), F.lit(0.0))).first()
        if not rows:
            break
        last = turn > 0 and pairs_left <= PAIRS_PER_ENTRY * rows
        if last:
            pivots, chosen = None, placed
        else:
            slot = F.pmod(F.xxhash64("doc"), F.lit(1 << min(widen * turn, 42)))
            pivots = cut(placed.groupBy("value", slot.alias("slot")).agg(F.min(F.struct("doc", "facts", "comp")).alias("p")).select("value", "p.*"))
            chosen = pivots
        few = chosen.count() <= BROADCAST_ROWS
        items = placed
        if turn > 0:
            # From here on a pair counts in the smallest list only that both were in, so it comes once.
            held = held if held is not None else cut(placed.groupBy("doc").agg(F.collect_list("value").alias("held")))
            lists_of = _few(held)
            items, chosen = placed.join(lists_of, "doc"), chosen.join(lists_of, "doc")
        chosen = chosen.select("value", *(F.col(c).alias("pivot" if c == "doc" else f"pivot_{c}") for c in chosen.columns if c != "value"))
        near = items.join(F.broadcast(chosen) if few else chosen, "value").where("pivot < doc" if last else "pivot <> doc")
        near = near.where("comp <> pivot_comp").where(may(F.col("facts"), F.col("pivot_facts")))
        if turn > 0:
            near = near.where(F.array_min(F.array_intersect("held", "pivot_held")) == F.col("value"))
        # The smaller of two items counts as the pivot, so that a pair is one pair.
        ends = [F.least("pivot", "doc").alias("pivot"), F.greatest("pivot", "doc").alias("doc")]
        sides = [F.when(F.col("pivot") < F.col("doc"), F.col(x)).otherwise(F.col(y)) for x, y in (("pivot_comp", "comp"), ("comp", "pivot_comp"))]
        pairs = near.select(*ends, sides[0].alias("a"), sides[1].alias("b")).distinct()
        if turn > 0:
            pairs = pairs.join(_few(tested), ["pivot", "doc"], "left_anti")
        pairs = cut(pairs)
        if not pairs.isEmpty():
            found = compare(pairs.select("pivot", "doc"))
            # Links join the components of their ends; what pointed to a component follows it.
            new = components(found.join(_few(pairs), ["pivot", "doc"]), "a", "b")
            if members is not None and new.isEmpty():
                new = members
            elif members is not None:
                onward = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
                parts = members, new
                new = cut(members.join(onward, "component", "left").select("node", F.coalesce("further", "component").alias("component")).unionByName(new))
                release(*parts)
            members = new
        if tested is not None:
            release(pairs)
        collect_garbage(entries.sparkSession)
        if last:
            break
        # Pairs of the first round; those of later ones can't come again.
        tested = pairs.select("pivot", "doc") if tested is None else tested
        gone = pivots.select("value", "doc")
        left = placed.drop("comp").join(F.broadcast(gone) if few else gone, ["value", "doc"], "left_anti")
        turn += 1
    return members if members is not None else components(entries.select(F.col("doc").alias("a"), F.col("doc").alias("b")))
