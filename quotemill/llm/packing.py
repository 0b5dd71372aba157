"""Best-two-fit packing of token pieces into sequences of at most ``capacity`` tokens.

Only lengths matter for a packing, and there are ``capacity`` of them however many documents there are. So the bins are
planned on the histogram of lengths: a pattern (the lengths in one bin) is filled greedily, longest first; then, while
it helps, its smallest member is replaced by two waiting ones that fit the widened gap more tightly. A pattern is used as often
as the histogram allows. Every piece then finds its place from its rank among the pieces of its length, which comes
from counts per (task, length): no sort of all pieces and no task that sees all pieces of one length.

Defined cases: null or empty text is a document of the end id alone; an empty table gives an empty result; repeated
rows are packed once each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .pieces import encoder
from .tasks import map_rows, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole ones, with the shorter rest first."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def _two_for(waiting: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """Two waiting lengths with the largest sum in (least, most]."""
    lengths = np.flatnonzero(waiting[: most + 1])
    if not len(lengths) or 2 * int(lengths[0]) > most:
        return None
    have = sum(1 << int(x) for x in lengths)
    best = (0, 0, 0)
    for a in lengths[::-1].tolist():
        if 2 * a < best[0]:
            break
        room = most - a
        mates = have & ((1 << min(a, room) + 1) - 1)
        if waiting[a] < 2:
            mates &= ~(1 << a)
        b = mates.bit_length() - 1
        if b > 0 and a + b > best[0]:
            best = (a + b, a, b)
    return best[1:] if best[0] > least else None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, how many such bins) until no length waits. ``counts[n]``: pieces of length n."""
    waiting = np.asarray(counts, np.int64).copy()
    patterns = []
    while waiting.any():
        content: list[int] = []
        gap = capacity
        while gap:
            fits = np.flatnonzero(waiting[: gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            copies = min(int(waiting[longest]), gap // longest)
            content += [longest] * copies
            waiting[longest] -= copies
            gap -= longest * copies
        while gap and len(content) > 1 and (pair := _two_for(waiting, content[-1], gap + content[-1])):
            smallest = content.pop()
            waiting[smallest] += 1
            for x in pair:
                waiting[x] -= 1
            gap += smallest - sum(pair)
            content = sorted([*content, *pair], reverse=True)
        need = Counter(content)
        times = 1 + min(int(waiting[x]) // k for x, k in need.items())
        for x, k in need.items():
            waiting[x] -= k * (times - 1)
        patterns.append((tuple(content), times))
    return patterns


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, pieces per bin, first sequence, offset in it), ascending by rank."""
    ranks: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for content, times in patterns:
        offset = 0
        for length, copies in Counter(content).items():
            out[length].append((ranks[length], copies, sequence, offset))
            ranks[length] += copies * times
            offset += length * copies
        sequence += times
    return {length: np.asarray(rows, np.int64) for length, rows in out.items()}


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its checksum and its place among the pieces of equal length in the same task."""

    def make():
        encode = encoder(vocabulary).encode
        end = np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def work(columns):
            out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
            for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
                packed = encode(text) + end
                start = 0
                for i, length in enumerate(cut_lengths(len(packed) // 4, capacity)):
                    crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
                    row = (doc_id, i, start, length, crc, part, seen[length])
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    seen[length] += 1
                    start += length
            return out

        return work

    return map_rows(texts(docs), PIECES, make)


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    pieces = materialize(cut_pieces(docs, vocabulary, end_id, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row.length] = row.n
    # bounded by the histogram, not by the documents: a few rows per pattern, and a pattern exhausts a length
    table = places(plan(histogram, capacity))

    def make():
        def work(columns):
            length = np.asarray(columns["length"], np.int64)
            rank = np.asarray(columns["rank"], np.int64)
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for n in np.unique(length).tolist():
                own = length == n
                first, copies, base, inside = table[n].T
                at = np.searchsorted(first, rank[own], "right") - 1
                k = rank[own] - first[at]
                sequence[own] = base[at] + k // copies[at]
                offset[own] = inside[at] + k % copies[at] * n
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            return {n: columns[n] for n in names} | {"sequence_id": sequence, "offset": offset}

        return work

    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    return map_rows(ranked.drop("part", "base", "place"), PACKED, make)
