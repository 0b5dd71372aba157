"""Near-duplicates by SetSketch registers.

A document's set of word shingles is kept as registers: each is the least of exponentially distributed hashes of the
set, truncated to a power of ``BASE``. Registers merge by maximum and agree between two sets about as often as
the sets do, so bands of registers are join keys.

1. Documents with equal sets are one class, represented by its smallest doc_id.
2. In every band bucket each representative is paired with the least one there. Pairs that the joint likelihood of
   both sketches rules out go; the rest are verified on full shingle sets. The links give components.
3. Buckets that hold representatives of several components are compared across these, in pairs of blocks of bounded
   size spread over tasks: first by equal registers; then members with hope are compared on full sets, all pairs of a
   block in one matrix product, and links join the components. No pair is written that isn't a link.

Step 3 makes it complete: each pair that shares a bucket ends up in one component or is compared. A bucket of copies, whatever its
size, is settled in step 2 with one pair per member. A link at similarity 0.75 shares none of the 32 bands
with probability 5e-6, and the likelihood test drops fewer than one in ten million links.

Defined cases: null, empty and wordless texts have an empty set and no link; a row without doc_id is linked with
nothing and kept; rows that repeat a doc_id with other texts get the smallest component of these; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .components import components
from .tasks import by_shuffle, map_rows, same, ship, texts

WORDS = 5
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.02, 20.0, 65_534
# twice the drop in log-likelihood from the best similarity to the threshold beyond which a pair is ruled out
IMPLAUSIBLE = 30.0
# sets with similarity 0.75 agree in 96 registers on average, with a standard deviation below 5
FEWEST_TIES = 70
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 2_000_000  # of the sets in a block, unless one set alone is larger
LEADER_MEMBERS = 64
BROADCAST_IDS = 500_000  # the driver takes about 130 bytes an id to build a hash table and send it
MARKS = 1 << 27  # bits, 16 MB

_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, (2, REGISTERS), dtype=np.uint64)
_XORS, _ODDS = _SEEDS[0] * np.uint64(2) + np.uint64(1), _SEEDS[1] * np.uint64(2) + np.uint64(1)
_MIXERS = np.random.default_rng(4).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCHES = "doc_id long, n_shingles long, set_key binary, registers binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles of a text as ascending 64-bit numbers."""
    words = (text or "").encode().lower().split()  # on bytes: A to Z, and exactly the separators of the contract
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(_MIXERS):
        total = _mix(total + hashes[i : i + n] * factor)
    return np.unique(total)


def registers_of(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 256):
        hashes = (shingles[start : start + 256, None] ^ _XORS) * _ODDS
        np.minimum(least, hashes.min(axis=0), out=least)
    exponential = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= 75 * (len(left) + len(right) - common)


_GRID = np.linspace(0, 1, 101)


def _order_probability(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def plausible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Row by row, whether two sketches of sets of known sizes can belong to sets with similarity 0.75."""
    above, below = (left > right).sum(axis=1), (left < right).sum(axis=1)
    sizes = n_left.astype(float), n_right.astype(float)
    share = sizes[0] / (sizes[0] + sizes[1])
    most = np.minimum(*sizes) / np.maximum(*sizes)
    keep = most >= 0.75
    keep &= REGISTERS - above - below >= FEWEST_TIES
    rows = np.flatnonzero(keep)
    if not len(rows):
        return keep
    u, v = share[rows, None], 1 - share[rows, None]
    similarity = np.minimum(_GRID[None, :], most[rows, None])
    up = np.maximum(_order_probability(u - v * similarity), 1e-12)
    down = np.maximum(_order_probability(v - u * similarity), 1e-12)
    tie = np.maximum(1 - up - down, 1e-12)
    up_n, down_n = above[rows, None], below[rows, None]
    likelihood = up_n * np.log(up) + down_n * np.log(down) + (REGISTERS - up_n - down_n) * np.log(tie)
    fit = likelihood.argmax(axis=1)
    drop = 2 * (likelihood.max(axis=1) - likelihood[:, 75])
    keep[rows] = (_GRID[fit] >= 0.75) | (drop <= IMPLAUSIBLE)
    return keep


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers) per document; an empty set has no key and no registers."""

    def make():
        def work(columns):
            sets = [shingle_set(t) for t in columns["text"]]
            return {
                "doc_id": columns["doc_id"], "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "registers": [registers_of(s).tobytes() if len(s) else None for s in sets],
            }

        return work

    return map_rows(texts(docs), SKETCHES, make)


def _bands(classes: DataFrame, *more: str) -> DataFrame:
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    rows = classes.select("doc_id", *more, "registers", band)
    values = F.expr(f"substring(registers, band * {2 * ROWS} + 1, {2 * ROWS})")
    return rows.select("doc_id", "band", *more, F.xxhash64("band", values).alias("bucket"))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one column, doc_id, distinct), before any text is moved.

    Candidates are few beside the documents. Up to a known number their ids go to every task, which then reads its own
    texts and passes on the candidates' alone. Beyond it the tasks get one bit for each value of a hash, ``MARKS`` in all
    whatever the number of ids, and what these pass on is shuffled by id and joined with the ids."""
    ids = materialize(ids, "ids")
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return _marked(docs, ids).join(by_shuffle(ids), "doc_id", "left_semi")


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and a few others whose hash is that of one of these."""
    wide = 8 * 4096  # bits that one aggregate holds
    value = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    part, at = F.expr(f"cast(h div {wide} AS int)"), F.expr(f"h % {wide}")
    # dealt by part before the sum, so that a part is made once instead of once per task
    marks = ids.select(value.alias("h")).select(part.alias("part"), at.alias("at")).repartition("part")
    marks = marks.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    hashed = docs.withColumn("h", value).withColumn("part", part).withColumn("at", at)
    byte = "cast(conv(hex(substring(bits, cast(at div 8 AS int) + 1, 1)), 16, 10) AS int)"
    found = hashed.join(F.broadcast(marks), "part").where(f"shiftright({byte}, cast(at % 8 AS int)) & 1 = 1")
    return found.select(*docs.columns)


def _plausible_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the sketches do not rule out."""

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}")
        )

    def make():
        def work(columns):
            left, right = (
                np.frombuffer(b"".join(columns[c]), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b")
            )
            keep = plausible(left, right, np.asarray(columns["n_a"], float), np.asarray(columns["n_b"], float))
            rows = np.flatnonzero(keep).tolist()
            return {c: [columns[c][i] for i in rows] for c in ("a", "b")}

        return work

    return map_rows(pairs.join(side("b"), "b").join(side("a"), "a"), "a long, b long", make)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Members of ``a`` travel in groups of about ``LEADER_MEMBERS`` with one copy of its text; a task holds one leader's
    set and one member's at a time."""
    spark = docs.sparkSession
    ship(spark)
    groups = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {LEADER_MEMBERS}) as int)").alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), groups) as int)").alias("nth"))
    leaders = groups.select("a", F.explode(F.expr("sequence(0, groups - 1)")).alias("nth"))
    wanted = leaders.select("a", F.col("a").alias("b"), "nth", F.lit(0).alias("member")).union(
        dealt.select("a", "b", "nth", F.lit(1).alias("member"))
    )
    candidates = only(docs, wanted.select(F.col("b").alias("doc_id")).distinct())
    rows = wanted.join(candidates, F.col("b") == F.col("doc_id")).select("a", "b", "nth", "member", "text")
    rows = rows.repartition("a", "nth").sortWithinPartitions("a", "nth", "member")
    schema = to_arrow_schema(spark.createDataFrame([], "a long, b long").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            ids = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "nth", "member")), strict=True)
            for (a, b, nth, member), text in zip(ids, batch.column("text"), strict=True):
                shingles = shingle_set(text.as_py())
                if not member:
                    group, leader = (a, nth), shingles
                elif group == (a, nth) and linked(leader, shingles):
                    found.append((a, b))
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema)

    return rows.mapInArrow(run, "a long, b long")


def _compared(rows: DataFrame, schema: str, compare) -> DataFrame:
    """Run ``compare(key, members)`` on each pair of blocks; rows of one (bucket, low, high) meet in one task."""
    ship(rows.sparkSession)
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    dealt = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["low"], row["high"]) != key:
                    if len(members) > 1:
                        yield pa.RecordBatch.from_pylist(compare(key, members), arrow)
                    key, members = (row["bucket"], row["low"], row["high"]), []
                members.append(row)
        if len(members) > 1:
            yield pa.RecordBatch.from_pylist(compare(key, members), arrow)

    return dealt.mapInArrow(run, schema)


def _apart(members: list[dict], key: tuple) -> np.ndarray:
    """Pairs to be compared here: of different components; of different blocks, unless a block meets itself."""
    component = np.asarray([m["component"] for m in members])
    own = np.asarray([m["own"] for m in members])
    apart = component[:, None] != component
    if key[1] != key[2]:
        apart &= own[:, None] != own
    return apart


def _blocks(unsettled: DataFrame) -> DataFrame:
    """Members of a bucket in blocks of bounded size, once for each block that theirs is compared with."""
    number = f"greatest(ceil(members / {BLOCK_MEMBERS}), ceil(shingles / {BLOCK_SHINGLES}))"
    rows = unsettled.withColumn("blocks", F.expr(f"cast(least({number}, members) as int)"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _hopeful(unsettled: DataFrame) -> DataFrame:
    """Members that a member of another component may be linked with, by the number of equal registers.

    A pair counts in the first band that it shares only, so it is compared once later on."""

    def compare(key: tuple, members: list[dict]) -> list[dict]:
        values = np.frombuffer(b"".join(m["registers"] for m in members), "<u2").reshape(-1, REGISTERS)
        apart, band = _apart(members, key), members[0]["band"]
        hope = np.zeros(len(members), bool)
        for i in range(len(members)):
            equal = values == values[i]
            near = apart[i] & (equal.sum(axis=1) >= FEWEST_TIES)
            if near.any() and band:
                earlier = equal[:, : band * ROWS].reshape(len(members), band, ROWS).all(axis=2).any(axis=1)
                near &= ~earlier
            if near.any():
                hope[i] = True
                hope |= near
        return [
            {c: m[c] for c in ("bucket", "low", "high", "own", "doc_id", "component")}
            for m, h in zip(members, hope, strict=True) if h
        ]

    columns = ("bucket", "band", "low", "high", "own", "doc_id", "component", "registers")
    return _compared(
        _blocks(unsettled).select(*columns), "bucket long, low int, high int, own int, doc_id long, component long", compare
    )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix of shared shingles."""
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rows, column = rows[shared], np.cumsum(times > 1)[column[shared]] - 1
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        first, last = np.searchsorted(column, [start, start + width])
        has = np.zeros((len(sets), width), np.float32)
        has[rows[first:last], column[first:last] - start] = 1
        common += has @ has.T
    return common


def _links_across(hopeful: DataFrame, body: DataFrame) -> DataFrame:
    """Links (a, b) between components inside blocks, on full sets; one link a member and component is enough."""

    def make():
        def work(columns):
            return {"doc_id": columns["doc_id"], "shingles": [shingle_set(t).tobytes() for t in columns["text"]]}

        return work

    held = only(body, hopeful.select("doc_id").distinct()).dropDuplicates(["doc_id"])
    sets = map_rows(held, "doc_id long, shingles binary", make)

    def compare(key: tuple, members: list[dict]) -> list[dict]:
        full = [np.frombuffer(m["shingles"], np.uint64) for m in members]
        sizes = np.asarray([len(s) for s in full], np.float32)
        common = _common(full)
        link = _apart(members, key) & (100 * common >= 75 * (sizes[:, None] + sizes - common))
        found = {}
        for i, j in zip(*np.nonzero(link), strict=True):
            found.setdefault((int(i), members[j]["component"]), int(j))
        return [{"a": members[i]["doc_id"], "b": members[j]["doc_id"]} for (i, _), j in found.items()]

    return _compared(hopeful.join(sets, "doc_id"), "a long, b long", compare)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    body = texts(docs)
    rows = materialize(sketches(docs), "sketches")
    usable = rows.where("doc_id is not null and set_key is not null")
    classes = usable.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")
    )
    # a doc_id may stand for several sets when rows repeat it; a pair needs one sketch for each
    classes = materialize(classes, "classes")
    one = classes.dropDuplicates(["doc_id"])

    buckets = _bands(classes, "n_shingles")
    heads = buckets.groupBy("bucket").agg(
        F.min(F.struct("doc_id", "n_shingles")).alias("head"), F.count("*").alias("members")
    ).where("members > 1")
    # what shares no bucket is left behind here, and so is not dealt out again
    shared = materialize(buckets.join(by_shuffle(heads), "bucket"), "shared")
    near = F.least("n_shingles", "head.n_shingles") * 100 >= F.greatest("n_shingles", "head.n_shingles") * 75
    pairs = shared.where(F.col("doc_id") != F.col("head.doc_id")).where(near)
    pairs = materialize(pairs.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = materialize(verified(_plausible_pairs(pairs, one), body), "links")

    settled = _component_of(one, components(links))
    sized = by_shuffle(settled.select("doc_id", "n_shingles", "component"))
    spread = shared.select("bucket", "band", "doc_id").join(sized, "doc_id")
    mixed = spread.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"),
        F.min("component").alias("low_one"), F.max("component").alias("high_one"),
    ).where("low_one <> high_one").select("bucket", "members", "shingles")
    unsettled = spread.join(mixed, "bucket").join(one.select("doc_id", "registers"), "doc_id")
    hopeful = materialize(_hopeful(unsettled), "hopeful")
    links = links.union(materialize(_links_across(hopeful, body), "links"))
    # rows that share a set, or a doc_id, are linked through the class's smallest doc_id
    members = usable.select("set_key", F.col("doc_id").alias("b")).join(
        classes.select("set_key", F.col("doc_id").alias("a")), "set_key"
    )
    found = components(links)
    head = members.join(found, F.col("a") == F.col("node"), "left").select(
        "b", F.coalesce("component", "a").alias("component")
    ).groupBy("b").agg(F.min("component").alias("component"))
    out = rows.join(head, rows["doc_id"] == head["b"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), same(F.col("doc_id"), component).alias("kept"))


def _component_of(classes: DataFrame, found: DataFrame) -> DataFrame:
    joined = classes.join(found, F.col("doc_id") == F.col("node"), "left")
    component: Column = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", "registers", component.alias("component"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, all columns as they are."""
    keep = near_copies(docs).where("kept").select(F.col("doc_id").alias("kept_doc_id")).distinct()
    return docs.join(keep, same(docs["doc_id"], keep["kept_doc_id"]), "left_semi")
