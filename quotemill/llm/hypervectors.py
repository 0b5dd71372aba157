"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound as the product of its letters' vectors, the
first permuted twice and the second once; a document is the bundle (sum) of its trigrams; a language prototype is the bundle
of its documents' normalised vectors, less what all languages share. The nearest prototype by cosine is the prediction.

Letters are folded to ``CLASSES`` classes (a to z one each, others by a hash of the code point). A worker remembers the
bound vectors of the first ``REMEMBERED`` trigrams it meets, in bytes (16 MiB); further ones are bound anew from the
letters' vectors, ``AT_ONCE`` at a time, with the same result. So its memory has a fixed bound whatever the script, apart
from the text in hand, of which trigrams are counted ``PIECE`` letters at a time.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as is everything if nothing can be learned
from; a null doc_id is not held out and not learned from; repeated rows count as often as they occur; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .tasks import map_rows, texts

CLASSES = 128
DIMENSIONS = 512
REMEMBERED = 1 << 15
AT_ONCE = 1 << 12
PIECE = 1 << 20
SCALE = 10_000
UNKNOWN = "und"


class TrigramVectors:
    def __init__(self, remembered: int = REMEMBERED):
        signs = np.random.default_rng(7).integers(0, 2, (CLASSES, DIMENSIONS), dtype=np.int8) * 2 - 1
        # the letters' vectors as the first, second and third of a trigram
        self.first, self.second, self.third = np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs
        self.slot = np.full(CLASSES**3, -1, np.int32)
        self.rows = np.zeros((remembered, DIMENSIONS), np.int8)
        self.used = 0
        # classes of code points; 0 stands for any run of other characters
        self.of_point = np.full(0x110000, -1, np.int16)

    @property
    def nbytes(self) -> int:
        """What stays in memory between texts; it never changes."""
        kept = (self.first, self.second, self.third, self.slot, self.rows, self.of_point)
        return sum(a.nbytes for a in kept)

    def _classes(self, points: np.ndarray) -> np.ndarray:
        found = self.of_point[points]
        for point in np.unique(points[found < 0]).tolist():
            letter = chr(point)
            if not letter.isalpha():
                number = 0
            elif "a" <= letter <= "z":
                number = 1 + point - ord("a")
            else:
                number = 27 + (point * 2654435761 >> 7) % (CLASSES - 27)
            self.of_point[point] = number
        return self.of_point[points].astype(np.uint8)

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigrams: product of the letters' vectors, permuted by place."""
        a, b, c = grams // CLASSES**2, grams // CLASSES % CLASSES, grams % CLASSES
        return self.first[a] * self.second[b] * self.third[c]

    def _rows_of(self, grams: np.ndarray) -> np.ndarray:
        slots = self.slot[grams]
        new = grams[slots < 0][: len(self.rows) - self.used]
        if len(new):
            self.rows[self.used : self.used + len(new)] = self.bind(new)
            self.slot[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            slots = self.slot[grams]
        rows = self.rows[slots]
        rest = slots < 0
        if rest.any():
            rows[rest] = self.bind(grams[rest])
        return rows

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The document's vector, or nothing if the text has no letter."""
        classes = self._classes(np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32))
        if not classes.any():
            return None
        framed = np.concatenate(([0], classes, [0])).astype(np.uint8)
        framed = framed[np.concatenate(([True], (framed[1:] != 0) | (framed[:-1] != 0)))]
        total = np.zeros(DIMENSIONS)
        for start in range(0, len(framed) - 2, PIECE):
            piece = framed[start : start + PIECE + 2].astype(np.int32)
            codes = piece[:-2] * CLASSES**2 + piece[1:-1] * CLASSES + piece[2:]
            grams, counts = np.unique(codes, return_counts=True)
            for at in range(0, len(grams), AT_ONCE):
                # whole numbers below 2^24, so that the sum is exact in any order
                some = self._rows_of(grams[at : at + AT_ONCE]).astype(np.float32)
                total += counts[at : at + AT_ONCE].astype(np.float32) @ some
        return total


_vectors: list[TrigramVectors] = []


def vectors() -> TrigramVectors:
    """One table per worker."""
    if not _vectors:
        _vectors.append(TrigramVectors())
    return _vectors[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit vectors, from all documents given. ``docs``: text, lang."""
    rows = docs.where("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def make():
        bundle = vectors().bundle

        def work(columns):
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(columns["lang"], columns["text"], strict=True):
                v = bundle(text)
                norm = 0 if v is None else float(np.linalg.norm(v))
                if norm:
                    whole = np.rint(v / norm * SCALE).astype(np.int64)  # whole numbers: sums don't depend on order
                    sums[lang] = sums.get(lang, 0) + whole
            return {"lang": list(sums), "sums": [s.tolist() for s in sums.values()]}

        return work

    partial = map_rows(rows, "lang string, sums array<bigint>", make)
    flat = partial.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    # as many rows as languages times dimensions
    table = flat.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("sums")).orderBy("lang").collect()
    if not table:
        return [], np.zeros((0, DIMENSIONS))
    units = np.asarray([[p.v for p in r.sums] for r in table], float)
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
    if len(table) > 1:
        units -= units.mean(axis=0)
        units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
    return [r.lang for r in table], units


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score); the score is the cosine with the nearest prototype, 0 if negative."""
    units = prototypes.astype(np.float32).T  # one vector per language

    def make():
        bundle = vectors().bundle

        def one(text: str) -> tuple[str, float]:
            v = bundle(text) if languages else None
            norm = 0 if v is None else float(np.linalg.norm(v))
            if not norm:
                return UNKNOWN, 0.0
            cosines = v @ units / norm
            best = int(cosines.argmax())
            return languages[best], min(1.0, max(0.0, float(cosines[best])))

        def work(columns):
            found = [one(t) for t in columns["text"]]
            return {"doc_id": columns["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    return map_rows(texts(docs), "doc_id long, lang_pred string, score double", make)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out."""
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = predict(docs, *learn_prototypes(learned.select("text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
