"""Exact de-duplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name, the number of the first of
them, found by sorting blocks next to each other. Then adjacent names are paired and the pairs named in the same
way, until one name is left for each document: equal names mean equal texts, and different ones different texts,
without any hash in between.

A task remembers the blocks it has met (up to ``REMEMBERED`` bytes of them, then it starts anew), so a block that a third
of all texts share leaves a task once, as one row without any of its members. The naming sees these rows alone; their
members then fetch the name by the number of that row, so no task receives all members of a block. Groups that hold more
than one in ``SHARES`` of all rows, of which there are fewer than ``SHARES``, reach their members by broadcast, all
others by a join.

Defined cases: a null text equals an empty one; repeated rows (equal doc_id and text) are copies, of which one is kept;
a null doc_id ranks below all others; an empty table gives an empty result; other columns are ignored, or passed on as
they are by ``drop_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .tasks import by_shuffle, map_rows, row_numbers, same, texts

BLOCK_BYTES = 16_384
REMEMBERED = 32 << 20
SHARES = 1000
PLACES = "block binary, number long, place long, row long, doc_id long, at int, blocks int, text_sha256 string"
MEMBERS = ("place", "row", "doc_id", "at", "blocks", "text_sha256")
NOBODY = -(1 << 63)


def cut_blocks(docs: DataFrame, block_bytes: int, remembered: int = REMEMBERED) -> DataFrame:
    """Every place of a block, with the number of the first place of this block that the task remembers; ``block`` itself
    stands in the row of that first place only. Every place has a number of its own."""

    def make():
        numbers = row_numbers()
        known: dict[bytes, int] = {}
        held = 0

        def work(columns):
            nonlocal held
            out: dict[str, list] = {name: [] for name in ("block", "number", *MEMBERS)}
            for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
                data = text.encode().lower()  # on bytes: A to Z only
                digest = hashlib.sha256(data).hexdigest()
                blocks = [data[i : i + block_bytes] for i in range(0, len(data), block_bytes)] or [b""]
                row = None
                for at, block in enumerate(blocks):
                    place = next(numbers)
                    row = place if row is None else row
                    first = known.get(block)
                    if first is None:
                        if held > remembered:
                            known.clear()
                            held = 0
                        known[block] = place
                        held += len(block) + 128
                    found = (None if first is not None else block, place if first is None else first,
                             place, row, doc_id, at, len(blocks), digest)
                    for values, value in zip(out.values(), found, strict=True):
                        values.append(value)
            return out

        return work

    return map_rows(texts(docs), PLACES, make)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; null equals null. Groups of more than total / ``SHARES`` of the ``total``
    rows are fewer than ``SHARES`` and broadcast; the rows of the others are joined, so no task gets more of one key."""
    names = [c for c in groups.columns if c not in keys]
    large = F.col(size) * SHARES > total

    def on(left, right):
        condition = F.lit(True)
        for key in keys:
            condition = condition & same(left[key], right[key])
        return condition

    hot = groups.where(large).withColumn("hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), on(rows, hot), "left").select(*[rows[c] for c in rows.columns], *names, "hot")
    cold = groups.where(~large)
    rest = marked.where("hot is null").select(*rows.columns)
    rest = rest.join(by_shuffle(cold), on(rest, cold)).select(*[rest[c] for c in rows.columns], *names)
    return marked.where("hot").select(*rows.columns, *names).unionByName(rest)


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, text_sha256, rounds, name): rows with equal (rounds, name) have equal texts."""
    places = materialize(cut_blocks(docs, block_bytes), "block-places")
    first = F.min("number").over(Window.partitionBy("block")).alias("name")
    names = places.where("block is not null").select("number", "block", first).select("number", "name")
    level = places.drop("block").join(names, "number").select(*MEMBERS, "name")
    level = materialize(level, "block-names")
    done, rounds = None, 0
    while True:
        whole = level.where("blocks = 1").select("row", "doc_id", "text_sha256", F.lit(rounds).alias("rounds"), "name")
        done = whole if done is None else done.unionByName(whole)
        longer = level.where("blocks > 1")
        if longer.isEmpty():
            return done
        # a pair lies where its left half lies; the last half of an odd number of names stays alone
        pairs = longer.groupBy("row", F.expr("at div 2").cast("int").alias("half")).agg(
            F.min("place").alias("place"), F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256"),
            F.max(F.expr("cast((blocks + 1) div 2 as int)")).alias("blocks"),
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right"),
        )
        pairs = materialize(pairs.withColumnRenamed("half", "at"), "name-pairs")
        names = pairs.groupBy("left", "right").agg(F.min("place").alias("name"), F.count("*").alias("copies"))
        names = materialize(names, "pair-names")
        matched = join_groups(pairs, names, ["left", "right"], "copies", pairs.count())
        level = materialize(matched.select(*MEMBERS, "name"), "block-names")
        rounds += 1


def exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row. Of equal texts the largest doc_id stays."""
    rows = name_documents(docs, block_bytes)
    groups = rows.groupBy("rounds", "name").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
        F.max_by("row", F.coalesce("doc_id", F.lit(NOBODY))).alias("keep_row"),
    )
    groups = materialize(groups, "copy-groups")
    joined = join_groups(rows, groups, ["rounds", "name"], "group_size", rows.count())
    kept = F.col("row") == F.col("keep_row")
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of equal texts one row, with the largest doc_id."""
    keep = exact_copies(docs).where("kept").select(_key("doc_id").alias("key"), "text_sha256").distinct()
    lowered = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key("doc_id").alias("key"),
        F.sha2(lowered, 256).alias("text_sha256"),
    )
    # rows that repeat doc_id and text; both columns are set, so the window needs no shuffle beyond the join's
    nth = F.row_number().over(Window.partitionBy("key", "text_sha256").orderBy(F.lit(0)))
    rows = rows.join(keep, ["key", "text_sha256"], "left_semi").withColumn("nth", nth).where("nth = 1")
    return rows.select("doc.*")


def _key(column: str) -> Column:
    """A doc_id as text, also where it is null."""
    return F.coalesce(F.col(column).cast("long").cast("string"), F.lit(""))
