"""Threads from reply headers: every message's root, its depth below it and the thread's size.

A message answers the first known message that its In-Reply-To names, else the last known one of its References.  From
this table of parents roots are found by pointer jumping: in each round a message that doesn't yet point at a root takes
its pointer's pointer, so a chain of n messages takes log2(n) rounds, and only what is still under way takes part.

Forged or broken headers can make cycles.  Messages that still have no root after as many rounds as there could be messages are
on a cycle or hang on one; what they point at then is on one.  A cycle is cut above its smallest message, which so
becomes the root, and the jumps are made once more for what hung on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import message_id_of
from postlake.runtime import Scratch


def ids_in(header: Column) -> Column:
    """Message ids that a header names, in order: what is in angle brackets, or else its words."""
    text = F.coalesce(header, F.lit(""))
    named = F.regexp_extract_all(text, F.lit(r"<\s*([^<>]*[^<>\s])\s*>"), F.lit(1))
    return F.when(F.size(named) > 0, named).otherwise(F.regexp_extract_all(text, F.lit(r"([^\s<>]+)"), F.lit(1)))


def parents_of(emails: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, node) of every message and (node, parent) of every node that answers a known one.

    Messages of one message id are one node, named by their smallest id, whose headers count; a message without an id is a
    node of its own.  A message doesn't answer itself.
    """
    rows = emails.select("id", message_id_of("message_id").alias("mid"), "in_reply_to", "references_header")
    known = rows.where("mid is not null").groupBy("mid").agg(F.min("id").alias("node"))
    known = scratch.keep(known, "known")
    nodes = rows.where("mid is not null").select("id", "mid").join(known, "mid").select("id", "node").unionByName(rows.where("mid is null").select("id", F.col("id").alias("node")))
    nodes = scratch.keep(nodes, "nodes")
    first = rows.join(nodes.where("id = node").select("id"), "id", "left_semi")
    named = F.concat(ids_in(F.col("in_reply_to")), F.reverse(ids_in(F.col("references_header"))))
    asked = first.select("id", F.posexplode(named).alias("place", "mid"))
    found = asked.join(known.withColumnRenamed("node", "parent"), "mid").where("parent <> id")
    return nodes, found.groupBy("id").agg(F.min(F.struct("place", "parent"))["parent"].alias("parent")).withColumnRenamed("id", "node")


def jumped(links: DataFrame, scratch: Scratch, name: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, root, depth) of links (node, parent) that lead to a root, which is what has no parent, and (node, at, low) of the
    others: where they point after 2^rounds >= ``most`` jumps, and the smallest node on the way there."""
    parents = scratch.keep(links, f"{name}-links")
    roots = parents.select(F.col("parent").alias("node")).distinct().join(parents.select("node"), "node", "left_anti")
    settled = scratch.keep(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth")), f"{name}-roots")
    active = parents.select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("node").alias("low"))
    done = [settled]
    for i in range(max(1, most).bit_length() + 1):
        # what points at a settled node is settled; what points at one under way takes its pointer
        now = active.join(settled.select(F.col("node").alias("at"), "root", "depth"), "at", "left")
        now = scratch.keep(now, f"{name}-{i}")
        settled = now.where("root is not null").select("node", "root", (F.col("depth") + F.col("steps")).alias("depth"))
        done.append(settled)
        left = now.where("root is null").select("node", "at", "steps", "low")
        if left.isEmpty():
            break
        there = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("low").alias("below"), F.col("root").alias("r"), F.col("depth").alias("d"))
        both = scratch.keep(left.join(there, "at"), f"{name}-{i}-next")
        just = both.where("r is not null").select("node", F.col("r").alias("root"), (F.col("steps") + F.col("more") + F.col("d")).alias("depth"))
        done.append(just)
        settled = settled.unionByName(just)
        active = both.where("r is null").select("node", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "below").alias("low"))
        if active.isEmpty():
            break
    else:
        return _all(done), active.select("node", "at", "low")
    return _all(done), None


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def threads(emails: DataFrame) -> DataFrame:
    """id, root_id, depth, size of every message: the root's smallest id, answers between them, messages of the thread
    (copies of one message id count each).  A message that answers nothing known and that nothing known answers is a thread
    of one.  Null headers name nothing."""
    scratch = Scratch(emails.sparkSession, "threads")
    nodes, links = parents_of(emails, scratch)
    links = scratch.keep(links, "links")
    most = links.count()
    found, circling = jumped(links, scratch, "first", most)
    if circling is not None:
        circling = scratch.keep(circling, "circling")
        on = circling.select(F.col("at").alias("node")).distinct()
        tops = circling.join(on, "node", "left_semi").where("node = low").select("node")
        again = links.join(circling.select("node"), "node", "left_semi").join(tops, "node", "left_anti")
        # the tops of cycles of which nothing else is left are roots all the same
        more, _ = jumped(again, scratch, "again", most)
        found = found.unionByName(more).unionByName(tops.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))).distinct()
    found = scratch.keep(found, "roots")
    rows = nodes.join(found, "node", "left").select("id", F.coalesce("root", "node").alias("root_id"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
    rows = scratch.keep(rows, "rows")
    sizes = scratch.keep(rows.groupBy("root_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    return rows.join(sizes, "root_id").select("id", "root_id", "depth", "size")
