"""Merges of products and their undoing, replayed from a journal in the order of its events.

A merge moves all that its merged products hold, then, to the survivor; what it moved is its trace. Undoing a merge puts
its trace back where it was, wherever it has gone since, and makes the products of the merge live again.

What a product held at first moves together for ever, so its life is a chain: from where it is at a time, the next event
is the first merge of that place after this time, or the first undoing after it of a merge that has moved it. Each round
of joins takes every life one event further, and is written to the shared folder; there are as many rounds as the longest
life has events, and no task holds a product's lives or a journal's part.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators.tables import written


def _applied(merges: DataFrame) -> DataFrame:
    return merges.select("seq", "merge", "product", "survivor").dropna().where("product <> survivor").distinct()


def replayed(merges: DataFrame, undos: DataFrame) -> DataFrame:
    """(product, holder, events): where what each merged product held at first is after all events, and how many moved it.

    merges: (seq, merge, product, survivor), a row for each product that a merge took in; undos: (seq, merge). seq orders
    all events, and those of one seq are one merge. Merges have been applied: none takes in a product that is merged
    already, or into one that is. An undo before its merge, or a second one, does nothing. Rows with nulls take no part."""
    took = _applied(merges)
    back = took.groupBy("merge").agg(F.min("seq").alias("made")).join(undos.where("seq is not null").select("merge", F.col("seq").alias("undone")), "merge").where("undone > made").groupBy("merge").agg(F.min("undone").alias("undone"))
    took, back = written(took, "merges"), written(back, "undos")
    lives = written(took.select(F.col("product")).distinct().selectExpr("product", "product as holder", "cast(null as bigint) as at", "0 as events"), "lives")
    moved: list[DataFrame] = []  # (product, merge, place before it)
    done: list[DataFrame] = []
    while not lives.isEmpty():
        here = lives.select(F.col("product").alias("life"), "holder", "at", "events")
        next_merge = here.join(took, F.expr("holder = product and (at is null or seq > at)")).selectExpr("life", "struct(seq, true as merged, survivor as to, merge, holder as before) as e")
        found = next_merge
        if moved:
            trace = functools.reduce(DataFrame.union, moved).select(F.col("product").alias("life"), "merge", "before")
            next_undo = trace.join(back, "merge").join(here.select("life", "at"), "life").where("undone > at").selectExpr("life", "struct(undone as seq, false as merged, before as to, merge, before) as e")
            found = found.unionByName(next_undo)
        first = found.groupBy("life").agg(F.min("e").alias("e"))
        after = written(here.join(first, "life", "left").selectExpr("life as product", "coalesce(e.to, holder) as holder", "coalesce(e.seq, at) as at", "events + if(e is null, 0, 1) as events", "e is null as ended", "e.merged", "e.merge", "e.before"), "lives")
        done.append(after.where("ended").select("product", "holder", "events"))
        moved.append(after.where("merged").select("product", "merge", "before"))
        lives = after.where("not ended").select("product", "holder", "at", "events")
    return functools.reduce(DataFrame.union, done) if done else lives.select("product", "holder", "events")


def states(merges: DataFrame, undos: DataFrame) -> DataFrame:
    """(product, merged_into): what the last event that touched each product of the journal left it as; null: live."""
    took = _applied(merges)
    made = took.groupBy("merge").agg(F.min("seq").alias("made"))
    back = made.join(undos.select("merge", F.col("seq").alias("undone")), "merge").where("undone > made").groupBy("merge").agg(F.min("undone").alias("seq"))
    all_of = took.select("merge", "product").union(took.select("merge", F.col("survivor").alias("product"))).distinct()
    kind = took.schema["survivor"].dataType.simpleString()
    said = took.select("product", "seq", F.col("survivor").alias("merged_into")).unionByName(all_of.join(back, "merge").selectExpr("product", "seq", f"cast(null as {kind}) as merged_into"))
    return said.unionByName(took.selectExpr("survivor as product", "seq", f"cast(null as {kind}) as merged_into")).groupBy("product").agg(F.max_by("merged_into", "seq").alias("merged_into"))
