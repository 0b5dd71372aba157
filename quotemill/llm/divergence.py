"""How far the sources of a language differ from each other and from the language, by their terms.

A text becomes terms in two calls: ``bytes.translate`` lowers A to Z and turns all other ASCII into blanks, ``bytes.split``
cuts at the blanks. A Counter per document adds to the counts of its (language, source) group in the task; those sparse
counts, not the documents, are shuffled and summed. A group gives each kept term of its language a smoothed whole-number
share; two groups are compared by a symmetric sum over all kept terms. A term that neither has adds one constant, so only
terms that a group has are ever looked at: pairs are summed in tiles of ``TILE_SOURCES`` by ``TILE_SOURCES`` sources and
about ``TILE_TERMS`` terms, and every tile returns one number per pair.

No step gathers a language or a source in one task: terms are counted in the tasks first, tiles are bounded in both
directions, ranks are cut to the first ten before they are shuffled.

Defined cases: null text, language and source count as ''. A group without terms still has its pairs, and its shares come
from counts of 0; a language without kept terms gives pairs of value 0 and no terms; a language with one source has no
pairs. Repeated rows and repeated doc_ids are separate documents; null doc_ids count. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .tasks import ship

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
TILE_SOURCES = 128
TILE_TERMS = 4096
HELD = 250_000  # counts that a task holds before it passes them on
COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, source string, item string, excess long, base long"

# letters lowered, all other ASCII blank, everything beyond ASCII kept
TERMS = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERMS).split()


def named(documents: DataFrame) -> DataFrame:
    """(text, lang, source) without nulls, whatever else the table carries."""
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group."""
    spark = documents.sparkSession
    ship(spark)
    arrow = to_arrow_schema(spark.createDataFrame([], COUNTS).schema)

    def out(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            names = list(found)
            for start in range(0, len(names), 50_000):
                some = names[start : start + 50_000]
                size = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                     pa.array(some, pa.binary()).cast(pa.string()), pa.array([found[t] for t in some], pa.int64()),
                     pa.array([docs[lang, source][t] for t in some], pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pydict()
                for text, lang, source in zip(rows["text"], rows["lang"], rows["source"], strict=True):
                    found, where = Counter(terms(text)), (lang, source)
                    if where not in counts:
                        counts[where], docs[where] = Counter(), Counter()
                    before = len(docs[where])
                    counts[where].update(found)
                    docs[where].update(found.keys())
                    held += len(docs[where]) - before
                    if held >= HELD:
                        yield from out(counts, docs)
                        counts, docs, held = {}, {}, 0
        yield from out(counts, docs)

    sums = [F.sum(c).alias(c) for c in ("n", "docs")]
    return named(documents).mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(*sums)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)), in whole numbers of any size."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")).cast("long") + 1


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile_sums(rows: pa.Table) -> pa.Table:
    """Sums of one tile. Rows: (i, j) of the tile, lang, kept, and either a source's (block, source, share of an absent
    term) with a null term, or the share ``p`` of a term of such a source."""
    columns = rows.to_pydict()
    i, j = columns["i"][0], columns["j"][0]
    heads, names = {}, {}
    for block, source, term, p in zip(columns["block"], columns["source"], columns["term"], columns["p"], strict=True):
        if term is None:
            heads[block, source] = p
        else:
            names.setdefault(term, len(names))
    tables, sources, absent = {}, {}, {}
    for side in {i, j}:
        sources[side] = sorted(s for b, s in heads if b == side)
        absent[side] = np.array([heads[side, s] for s in sources[side]], np.int64)
        tables[side] = np.repeat(absent[side][:, None], len(names), axis=1)
    at = {side: {s: n for n, s in enumerate(sources[side])} for side in sources}
    for block, source, term, p in zip(columns["block"], columns["source"], columns["term"], columns["p"], strict=True):
        if term is not None:
            tables[block][at[block][source], names[term]] = p
    kept = columns["kept"][0]
    out: dict[str, list] = {"source": [], "item": [], "excess": [], "base": []}
    for n, source in enumerate(sources[i]):
        first = n + 1 if i == j else 0
        q, zero = tables[j][first:], absent[j][first:]
        if not len(zero):
            continue
        p, mine = tables[i][n], absent[i][n]
        if kept:
            base = (mine - zero) ** 2 // (mine + zero)
            excess = ((p - q) ** 2 // (p + q) - base[:, None]).sum(axis=1)
        else:
            base = excess = np.zeros(len(zero), np.int64)
        for other, e, b in zip(sources[j][first:], excess.tolist(), base.tolist(), strict=True):
            for one, two in ((source, other), (other, source)):
                out["source"].append(one)
                out["item"].append(two)
                out["excess"].append(e)
                out["base"].append(b * kept)
    return pa.table({"lang": pa.array([columns["lang"][0]] * len(out["base"]), pa.string()),
                     "source": pa.array(out["source"], pa.string()), "item": pa.array(out["item"], pa.string()),
                     "excess": pa.array(out["excess"], pa.int64()), "base": pa.array(out["base"], pa.int64())})


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language. ``groups``: (lang, source, total, kept,
    sources); ``shares``: (lang, source, term, p) of the terms that a source has."""
    ship(groups.sparkSession)
    blocks = F.ceil(F.col("sources") / TILE_SOURCES).cast("long")
    slots = F.greatest(F.ceil(F.col("kept") / TILE_TERMS), F.lit(1)).cast("long")
    absent = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1)
    heads = groups.select("lang", "source", "kept", blocks.alias("blocks"), slots.alias("slots"), absent.alias("p")).withColumn(
        "block", F.pmod(F.xxhash64("source"), F.col("blocks"))
    )
    own = heads.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).select(
        "lang", "source", "kept", "blocks", "block", "slot", F.lit(None).cast("string").alias("term"), "p"
    )
    present = shares.join(heads.drop("p"), ["lang", "source"]).select(
        "lang", "source", "kept", "blocks", "block", F.pmod(F.xxhash64("term"), F.col("slots")).alias("slot"), "term", "p"
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = own.unionByName(present).select("*", other).select(
        "lang", "source", "kept", "block", "slot", "term", "p",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    sums = dealt.groupBy("lang", "i", "j", "slot").applyInArrow(_tile_sums, PAIRS)
    summed = sums.groupBy("lang", "source", "item").agg(F.sum("excess").alias("excess"), F.max("base").alias("base"))
    return summed.select("lang", "source", "item", (F.col("excess") + F.col("base")).alias("value"))


def audit(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language (part ``pair``) and the terms
    that set a source most apart from its language (part ``term``)."""
    counts = materialize(term_counts(documents), "term-counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    kept_terms = materialize(totals.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "kept-terms")
    kept = materialize(counts.drop("docs").join(kept_terms, ["lang", "term"]), "kept-counts")
    languages = kept_terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total"))
    found = named(documents).select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    joined = found.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
    sources = found.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = materialize(joined.join(sources, "lang").na.fill(0, ["total", "kept", "lang_total"]), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    shares = materialize(shares, "shares")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, shares.drop("q")).withColumn("rank", F.row_number().over(ranked))
    marked = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    top = marked.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(top.withColumn("part", F.lit("term")).select(*columns))
