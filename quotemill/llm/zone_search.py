"""Hard negatives by exact search in Hilbert-ordered blocks with zone maps.

1. Vectors are quantised and sorted along a Hilbert curve through their space, so neighbours in the file are neighbours
   in space. Runs of the order are *parts* of at most ``PART_ROWS`` vectors, cut into *blocks* of ``BLOCK_ROWS``; both
   are Parquet rows with their smallest and largest value in each dimension.
2. For an anchor, interval arithmetic over these ranges bounds every inner product in a part or block from both sides.
   An anchor is sent to the parts whose bounds meet what it looks for, and there reads the blocks whose bounds do.
   Bounds only ever exclude; all scores are computed in full, so results are exact.
3. Positives: the best of an anchor's own part are a first threshold; parts that cannot beat it are not read. Negatives:
   the positives' scores give windows, and only blocks whose bounds meet a window are read.

Anchors travel to the parts, a hundredth of the rows to few places, and parts stay bounded however many vectors are alike
(the order continues within equal vectors), so no key gathers rows in one task. What each part finds for an anchor is
cut to what can be in the result before it is merged.

Defined cases: rows with a null id take no part, as rows with a null label, vector or component and those with a
component that is not finite. Vectors of unlike length are compared as if the shorter ended in zeros; an empty vector
scores 0. Rows count one by one: an id that stands twice is two candidates, and an anchor that stands twice gives its
rows twice; rows with the anchor's own id are never its candidates. Scores beyond 64 bits count as the nearest
64-bit number. Equal scores go by the smaller id. No anchors, no positives or no negatives give no rows; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .tasks import map_rows, ship

BLOCK_ROWS = 512
PART_ROWS = 262_144
PAGE_PARTS = 256  # zone maps of parts that are compared at once
LEAST_PARTS = 32  # small tables are split this far, for the sake of parallel tasks
ANCHORS = 100
RELABELLED = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
NEAREST = 80  # a negative scores at least this percentage of the positive
SCORES = 4_000_000  # scores that a task holds at once

# one row layout for what is held in a task (zone maps, blocks) and what passes by it (anchors), so both travel together
ROW = (
    "grp long, kind int, part long, rid long, vec_id long, label long, n int, a binary, b binary, ids binary, "
    "labels binary, seed_scores array<bigint>, seed_ids array<bigint>"
)
NAMES = [column.split()[0] for column in ROW.split(", ")]
FOUND = "rid long, anchor_id long, wanted long, vec_id long, score long"
ZONE, BLOCK, ANCHOR = 0, 1, 2


@dataclass(frozen=True)
class Space:
    """What all vectors have in common: number of rows, dimensions, ranges."""

    rows: int
    low: np.ndarray
    high: np.ndarray

    @property
    def largest(self) -> float:
        return max((float(np.abs(x).max()) for x in (self.low, self.high) if x.size), default=0.0)

    @property
    def kind(self) -> str:
        """The smallest type in which every sum of products is exact."""
        reach = len(self.low) * self.largest**2
        return "f4" if reach < 2**24 else "f8" if reach < 2**53 else "O"

    @property
    def stored(self) -> str:
        return "f4" if self.largest < 2**24 else "f8"


def eligible(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, some of them relabelled."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    return (
        embeddings.select(
            F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .where(finite)
        .withColumn("label", F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    )


def quantised(vectors: list[list[float]], width: int) -> np.ndarray:
    """floor(256 x) as whole doubles, one row per vector, padded with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.floor(out * 256)


def measure(vectors: DataFrame) -> Space:
    """Number of rows and range of each dimension; as many rows come back as there are dimensions."""

    def make():
        def work(columns):
            vectors = columns["embedding"]
            width = max(map(len, vectors), default=0)
            q = quantised(vectors, width)
            return {"i": [-1, *range(width)], "low": [float(len(vectors)), *q.min(axis=0).tolist()],
                    "high": [0.0, *q.max(axis=0).tolist()]} if vectors else {"i": [], "low": [], "high": []}

        return work

    partial = map_rows(vectors.select("embedding"), "i int, low double, high double", make)
    found = partial.groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("low").alias("n")).collect()
    rows = int(sum(r.n for r in found if r.i < 0))
    ranges = sorted((r.i, r.low, r.high) for r in found if r.i >= 0)
    # a shorter vector ends in zeros, which the longer ones of its batch may not show
    return Space(rows, np.array([min(r[1], 0.0) for r in ranges]), np.array([max(r[2], 0.0) for r in ranges]))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of cells with ``bits`` bits per coordinate, as rows of bytes in sort order.

    The axes are turned into the transposed index by undoing excess work from the highest bit down, then Gray-encoding
    (Skilling's method), all rows at once; the bits are then dealt out highest first."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, np.uint32(0)) ^ swap
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= t
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def with_keys(vectors: DataFrame, space: Space) -> DataFrame:
    """(key, vec_id, rid, label, a): the place on the curve and the quantised vector as bytes."""
    width = len(space.low)
    bits = max(1, min(8, 256 // max(width, 1)))
    span = np.maximum(space.high - space.low, 1.0)

    def make():
        def work(columns):
            q = quantised(columns["embedding"], width)
            if width:
                cells = np.minimum((q - space.low) / span * 2**bits, 2**bits - 1).astype(np.uint32)
                keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
            else:
                keys = [b""] * len(q)
            kept = {n: columns[n] for n in ("vec_id", "rid", "label")}
            return {"key": keys, "a": [r.tobytes() for r in q.astype(space.stored)], **kept}

        return work

    numbered = vectors.withColumn("rid", F.monotonically_increasing_id())
    return map_rows(numbered, "key binary, vec_id long, rid long, label long, a binary", make)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with anything between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    if exact:
        return least, most
    slack = 1e-6 * (up @ np.maximum(np.abs(low), np.abs(high)).T - down @ np.maximum(np.abs(low), np.abs(high)).T) + 1
    return least - slack, most + slack


def best(scores, ids: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """The first k of the chosen rows by descending score, then ascending id."""
    if len(chosen) > 8 * k and scores.dtype != object:
        s = scores[chosen]
        chosen = chosen[s >= np.partition(s, len(s) - k)[len(s) - k]]
    if scores.dtype == object:
        return np.array(sorted(chosen.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return chosen[np.lexsort((ids[chosen], -scores[chosen]))[:k]]


LARGEST = 2**63 - 1


def _long(score) -> int:
    return LARGEST if score >= LARGEST else max(-LARGEST - 1, int(score))


class Part:
    """Vectors of one part in memory, with the ranges of its blocks."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray,
                 sizes: list[int]):
        self.space, self.ids, self.labels, self.low, self.high = space, ids, labels, low, high
        # Python's whole numbers where no machine type is exact
        self.vectors = np.array([[int(x) for x in r] for r in vectors], object).reshape(vectors.shape) if space.kind == "O" else vectors.astype(space.kind)
        self.ends = np.cumsum([0, *sizes])

    def search(self, anchors: np.ndarray, ids: list[int], labels: list[int], windows: list[list[tuple]], same: bool, k: int) -> Iterator[tuple]:
        """(anchor number, window number, row, score) of the first k rows of every window of every anchor. ``windows``:
        for each anchor, (least, greatest) scores; ``same`` asks for rows of the anchor's label, else for the others."""
        exact = self.space.kind != "O"
        least, most = bounds(anchors.astype("f8"), self.low, self.high, exact)
        step = max(1, SCORES // max(len(self.ids), 1))
        for start in range(0, len(anchors), step):
            group = range(start, min(start + step, len(anchors)))
            needed = np.zeros(len(self.low), bool)
            for i in group:
                for lo, hi in windows[i]:
                    needed |= (most[i] >= lo) & (least[i] <= hi)
            blocks = np.flatnonzero(needed)
            if not len(blocks):
                continue
            rows = np.concatenate([np.arange(self.ends[b], self.ends[b + 1]) for b in blocks])
            if exact:
                scores = anchors[group.start : group.stop].astype(self.space.kind) @ self.vectors[rows].T
            else:
                whole = np.array([[int(x) for x in r] for r in anchors[group.start : group.stop]], object)
                scores = whole.reshape(len(group), -1) @ self.vectors[rows].T
            row_ids, row_labels = self.ids[rows], self.labels[rows]
            for i, line in zip(group, scores, strict=True):
                allowed = (row_labels == labels[i]) if same else (row_labels != labels[i])
                allowed &= row_ids != ids[i]
                for w, (lo, hi) in enumerate(windows[i]):
                    chosen = np.flatnonzero(allowed & (line >= lo).astype(bool) & (line <= hi).astype(bool))
                    for at in best(line, row_ids, chosen, k):
                        yield i, w, int(row_ids[at]), _long(line[at])


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}, schema=schema)


def build(keyed: DataFrame, space: Space) -> DataFrame:
    """Zone maps of parts, blocks, and anchors with the best positives of their own part, as one stored table."""
    spark = keyed.sparkSession
    ship(spark)
    width = len(space.low)
    arrow = to_arrow_schema(spark.createDataFrame([], ROW).schema)
    parts = max(-(-space.rows // PART_ROWS), min(LEAST_PARTS, -(-space.rows // BLOCK_ROWS)), 1)

    def flush(number: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        vectors = np.frombuffer(b"".join(r["a"] for r in held), space.stored).reshape(len(held), width)
        ids, labels = np.array([r["vec_id"] for r in held], np.int64), np.array([r["label"] for r in held], np.int64)
        starts = range(0, len(held), BLOCK_ROWS)
        low = np.array([vectors[s : s + BLOCK_ROWS].min(axis=0) for s in starts], "f8").reshape(len(starts), width)
        high = np.array([vectors[s : s + BLOCK_ROWS].max(axis=0) for s in starts], "f8").reshape(len(starts), width)
        sizes = [len(ids[s : s + BLOCK_ROWS]) for s in starts]
        zone = np.concatenate((low.min(axis=0), high.max(axis=0)))
        yield _rows(arrow, [{"grp": number, "kind": ZONE, "part": number, "n": len(held), "b": zone.tobytes(),
                             "labels": np.unique(labels).tobytes()}])
        for i, s in enumerate(starts):
            e = s + BLOCK_ROWS
            yield _rows(arrow, [{"grp": number, "kind": BLOCK, "part": number, "n": sizes[i], "a": vectors[s:e].tobytes(),
                                 "b": low[i].tobytes() + high[i].tobytes(), "ids": ids[s:e].tobytes(),
                                 "labels": labels[s:e].tobytes()}])
        anchors = np.flatnonzero(ids % ANCHORS == 0)
        if not len(anchors):
            return
        seeds: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(anchors))}
        everything = [[(float("-inf"), float("inf"))]] * len(anchors)
        part = Part(space, vectors, ids, labels, low, high, sizes)
        for i, _, vec_id, score in part.search(vectors[anchors], ids[anchors].tolist(), labels[anchors].tolist(), everything, True, POSITIVES):
            seeds[i].append((score, vec_id))
        rows = [{"kind": ANCHOR, "part": number, "rid": held[at]["rid"], "vec_id": held[at]["vec_id"], "label": held[at]["label"],
                 "a": held[at]["a"], "seed_scores": [s for s, _ in seeds[i]], "seed_ids": [v for _, v in seeds[i]]}
                for i, at in enumerate(anchors)]
        for start in range(0, len(rows), 1024):
            yield _rows(arrow, rows[start : start + 1024])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            held.extend(batch.to_pylist())
            while len(held) >= PART_ROWS:
                yield from flush(number, held[:PART_ROWS])
                number, held = number + 1, held[PART_ROWS:]
        if held:
            yield from flush(number, held)

    order = ["key", "vec_id", "rid"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(run, ROW), "zone-blocks")


def meet(held: DataFrame, passing: DataFrame, take: Callable, schema: str) -> DataFrame:
    """Bring the rows of two frames with one ``grp`` together: ``take()`` gives (hold, work); ``hold(rows)`` gets all held
    rows of a group, ``work(rows)`` then yields result rows for one batch of passing rows after another."""
    spark = held.sparkSession
    ship(spark)
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    both = held.select(*NAMES).unionByName(passing.select(*NAMES)).repartition("grp").sortWithinPartitions("grp", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, work = take()
        group, kept, ready = None, [], False
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                passing: list[dict] = []
                out: list[dict] = []
                for row in batch.slice(start, 256).to_pylist():
                    if row["grp"] != group:
                        out.extend(work(passing) if passing and ready else ())
                        group, kept, passing, ready = row["grp"], [], [], False
                    if row["kind"] == ANCHOR:
                        if kept and not ready:
                            hold(kept)
                            kept, ready = [], True
                        passing.append(row)
                    else:
                        kept.append(row)
                out.extend(work(passing) if passing and ready else ())
                for first in range(0, len(out), 4096):
                    yield _rows(arrow, out[first : first + 4096])

    return both.mapInArrow(run, schema)


def _number(text: str) -> int | float:
    return float(text) if text.endswith("inf") else int(text)


def _windows(row: dict) -> list[tuple]:
    return [tuple(map(_number, pair.split(":"))) for pair in row["b"].decode().split(",")]


def route(stored: DataFrame, anchors: DataFrame, space: Space, same: bool) -> DataFrame:
    """Anchors with ``grp`` set to each part that can hold what they look for (their windows are in ``b``)."""
    zones = stored.where(F.col("kind") == ZONE)
    pages = -(-zones.count() // PAGE_PARTS) or 1
    width = len(space.low)

    def take():
        zone: dict = {}

        def hold(rows):
            ranges = np.array([np.frombuffer(r["b"], "f8") for r in rows]).reshape(len(rows), 2 * width)
            zone.update(low=ranges[:, :width], high=ranges[:, width:], parts=[r["part"] for r in rows],
                        labels=[set(np.frombuffer(r["labels"], np.int64).tolist()) for r in rows])

        def work(rows):
            vectors = np.array([np.frombuffer(r["a"], space.stored) for r in rows], "f8").reshape(len(rows), width)
            least, most = bounds(vectors, zone["low"], zone["high"], space.kind != "O")
            for i, row in enumerate(rows):
                needed = np.zeros(len(zone["parts"]), bool)
                for lo, hi in _windows(row):
                    needed |= (most[i] >= lo) & (least[i] <= hi)
                for at in np.flatnonzero(needed):
                    part, labels = zone["parts"][at], zone["labels"][at]
                    # the own part has been read for positives; another label may be all that a part holds
                    if (part != row["part"] and row["label"] in labels) if same else (labels != {row["label"]}):
                        yield {**row, "grp": part}

        return hold, work

    paged = zones.withColumn("grp", F.pmod(F.xxhash64("part"), F.lit(pages)))
    everywhere = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    return meet(paged, everywhere, take, ROW)


def search(stored: DataFrame, routed: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """What every part holds for the anchors sent to it: ``FOUND`` rows, at most k for an anchor, window and part."""
    width = len(space.low)

    def take():
        state: dict = {}

        def hold(rows):
            ranges = np.array([np.frombuffer(r["b"], "f8") for r in rows]).reshape(len(rows), 2 * width)
            vectors = np.frombuffer(b"".join(r["a"] for r in rows), space.stored)
            sizes = [r["n"] for r in rows]
            ids, labels = (np.frombuffer(b"".join(r[n] for r in rows), np.int64) for n in ("ids", "labels"))
            state["part"] = Part(space, vectors.reshape(sum(sizes), width), ids, labels, ranges[:, :width], ranges[:, width:], sizes)

        def work(rows):
            vectors = np.array([np.frombuffer(r["a"], space.stored) for r in rows]).reshape(len(rows), width)
            windows = [_windows(r) for r in rows]
            found = state["part"].search(vectors, [r["vec_id"] for r in rows], [r["label"] for r in rows], windows, same, k)
            for i, w, vec_id, score in found:
                yield {"rid": rows[i]["rid"], "anchor_id": rows[i]["vec_id"], "vec_id": vec_id, "score": score,
                       "wanted": None if same else _long(windows[i][w][1])}

        return hold, work

    return meet(stored.where(F.col("kind") == BLOCK), routed, take, FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ask(anchors: DataFrame, windows: Callable[[dict], list[tuple]], more: list[str]) -> DataFrame:
    """Anchors with their windows, as text, in ``b``. ``more``: columns beside those of ``ROW`` that ``windows`` reads."""

    def make():
        def work(columns):
            rows = [dict(zip(columns, r, strict=True)) for r in zip(*columns.values(), strict=True)]
            columns["b"] = [",".join(f"{lo}:{hi}" for lo, hi in windows(r)).encode() for r in rows]
            return columns

        return work

    return map_rows(anchors.select(*NAMES, *more), ROW, make)


def positives_of(stored: DataFrame, space: Space) -> DataFrame:
    """(rid, anchor_id, vec_id, score): the first positives of every anchor."""
    anchors = stored.where(F.col("kind") == ANCHOR)

    def threshold(row):
        seeds = row["seed_scores"]
        return [(seeds[-1] if len(seeds) == POSITIVES and space.kind != "O" else float("-inf"), float("inf"))]

    routed = route(stored, _ask(anchors, threshold, []), space, True)
    elsewhere = search(stored, routed, space, True, POSITIVES)
    seeds = anchors.select("rid", F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("seed_scores", "seed_ids")).alias("s"))
    own = seeds.select("rid", "anchor_id", F.col("s.seed_ids").alias("vec_id"), F.col("s.seed_scores").alias("score"))
    every = elsewhere.select("rid", "anchor_id", "vec_id", "score").unionByName(own)
    return materialize(_first(every, ["rid"], POSITIVES).drop("rank"), "positives")


def negatives_of(stored: DataFrame, positives: DataFrame, space: Space) -> DataFrame:
    """(rid, wanted, vec_id, score, rank): the first negatives below every positive score ``wanted`` of an anchor."""
    asked = positives.where("score >= 0").groupBy("rid").agg(F.array_sort(F.collect_set("score")).alias("wanted"))  # five at most
    anchors = stored.where(F.col("kind") == ANCHOR).join(asked, "rid")

    def windows(row):
        # a score at the end of the range may stand for a greater one
        return [(-(-p * NEAREST // 100), p if p < LARGEST else float("inf")) for p in row["wanted"]]

    routed = route(stored, _ask(anchors, windows, ["wanted"]), space, False)
    return _first(search(stored, routed, space, False, NEGATIVES), ["rid", "wanted"], NEGATIVES)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors and positives."""
    vectors = eligible(embeddings)
    space = measure(vectors)
    stored = build(with_keys(vectors, space), space)
    positives = positives_of(stored, space)
    negatives = negatives_of(stored, positives, space)
    return (
        positives.select("rid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        .join(negatives.select("rid", F.col("wanted").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"),
                               F.col("score").alias("negative_score")), ["rid", "positive_score"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
