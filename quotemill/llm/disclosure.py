"""Personal data: fixed patterns, and terms that give protected entities away.

A protected entity is a value that a pattern finds (a mail address, a number), or the group it belongs to: the host of a
mail address, the first three parts of an IP address. From the whole corpus, co-occurrence in whole documents tells how much of an entity's information a term carries: with document counts n over N documents,

    disclosure(entity, term) = PMI(entity, term) / IC(entity)
                             = log(n(entity, term) * N / (n(entity) * n(term))) / log(N / n(entity))

is 1 for a term that occurs with this entity only and about 0 for one that is everywhere. Terms from ``GENERALISE`` on are
replaced by their kind (name, number, word), from ``REMOVE`` on they go, wherever they stand in a document that holds the
entity. One context proves nothing, so a term needs
``CONTEXTS`` different ones with a value, and ``GROUP_CONTEXTS`` with a group. A context is a whole text, and copies of one text (but for the case of A to
Z, as in ``op7_exact_dedup``) are one context; a passage that different texts share counts once for each of them.

Entities that stand in the same documents score alike, and so do words that stand in the same of these documents and in
as many others; each such class is one row of a document, so a list of thousands of addresses that two texts share meets
the words of these texts once. Entities without enough contexts, and words too frequent for any entity to reach
``GENERALISE`` with, are left out before they meet, which loses nothing: n(entity, term) is at most n(entity), so
n(term) is at most N^(1 - GENERALISE) * n(entity)^GENERALISE. What remains is one pair per class of entities and class
of words of a document.

Everything is built-in SQL functions: patterns run inside the JVM, possessively, so that a long run of digits or letters
costs linear time and no stack. A lookbehind starts a match only where a run starts, which is where the
leftmost match starts.

Defined cases: null and empty texts have no spans; repeated rows give repeated results; a null doc_id is kept; an
empty table gives an empty result; other columns are ignored, or passed on as they are by ``sanitise``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .tasks import by_shuffle

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # a run is taken whole, so runs of fewer than 13 digits can be left out at once
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]++(?:['_-][\p{L}\p{N}]++)*+"
CONTEXTS = 2
GROUP_CONTEXTS = 3
GENERALISE, REMOVE = 0.6, 0.8
SALTS = 16
STEP = 128
SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _walked(items: str, start: str, state: str, made: str, kind: str) -> str:
    """SQL: struct(s, made) after one walk over the array ``items``. ``state`` and ``made`` are expressions of the state
    so far, ``acc.s``, and the item, ``x``; what ``made`` gives is listed unless it is null. A growing list is copied at
    each step, so ``STEP`` items fill a list of their own, and these lists are joined."""
    chunk = f"""aggregate(slice(z, c * {STEP} + 1, {STEP}), struct(big.s AS s, cast(array() AS array<{kind}>) AS made),
        (acc, x) -> struct({state} AS s,
            transform(array({made}), m -> if(m IS NULL, acc.made, array_append(acc.made, m)))[0] AS made))"""
    return f"""transform(array({items}), z -> aggregate(sequence(0, cast((size(z) - 1) div {STEP} AS int)),
        struct({start} AS s, cast(array() AS array<array<{kind}>>) AS lists),
        (big, c) -> transform(array({chunk}), r -> struct(r.s AS s, array_append(big.lists, r.made) AS lists))[0],
        big -> struct(big.s AS s, flatten(big.lists) AS made)))[0]"""


def _located(text: str, pattern: str) -> str:
    """SQL: [(start, end, value)] of all matches, positions in characters. What lies between matches comes from split."""
    quoted = _quoted(pattern)
    return _walked(
        f"zip_with(split({text}, {quoted}), regexp_extract_all({text}, {quoted}, 0), (gap, hit) -> (gap, hit))",
        "0", "acc.s + length(x.gap) + coalesce(length(x.hit), 0)",
        """if(x.hit IS NULL, NULL, struct(acc.s + length(x.gap) AS start, acc.s + length(x.gap) + length(x.hit) AS end,
            x.hit AS value))""",
        "struct<start:int,end:int,value:string>",
    ) + ".made"


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"
# doubled digits above 9 lose 9; counted from the right, every second digit is doubled
_LUHN = f"""
    case when length({_DIGITS}) > 19 then false else aggregate(
        transform(split(reverse({_DIGITS}), ''), (d, i) ->
            if(i % 2 = 0, try_cast(d AS int), try_cast(d AS int) * 2 - if(try_cast(d AS int) > 4, 9, 0))),
        0, (a, d) -> a + coalesce(d, 0)) % 10 = 0 end"""
CHECKS = {
    "email": "true",
    "ip": r"x.value rlike r'^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$'",
    "card": _LUHN,
    "phone": f"length({_DIGITS}) between 9 and 15",
}
# a character without which there is no match
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: str = "text") -> Column:
    """All spans of the fixed kinds, by kind and start."""
    body = f"coalesce({text}, '')"
    parts = []
    for number, kind in enumerate(KINDS):
        found = f"filter({_located(body, PATTERNS[kind])}, x -> {CHECKS[kind]})"
        marked = f"transform({found}, x -> struct({number} AS kind, x.start AS start, x.end AS end, x.value AS value))"
        if NEEDS[kind]:
            marked = f"if(instr({body}, '{NEEDS[kind]}') > 0, {marked}, cast(array() AS {SPANS}))"
        parts.append(marked)
    return F.expr(f"concat({', '.join(parts)})")


CUT = "struct<start:int,end:int,put:string>"


def _apart(cuts: str) -> str:
    """SQL: of ascending cuts that overlap, the first keeps its text and reaches to the end of the last."""
    walk = _walked(
        cuts, f"cast(NULL AS {CUT})",
        """if(coalesce(acc.s.end > x.start, false),
            struct(acc.s.start AS start, greatest(acc.s.end, x.end) AS end, acc.s.put AS put), x)""",
        "if(coalesce(acc.s.end <= x.start, false), acc.s, NULL)", CUT,
    )
    return f"transform(array({walk}), w -> if(w.s IS NULL, w.made, array_append(w.made, w.s)))[0]"


def _cleaned(text: str, cuts: str) -> str:
    """SQL: ``text`` with each of ``cuts``, ascending and apart, replaced. ``STEP`` cuts share one part of the text,
    because finding a character counts from the start of its string."""
    chunk = f"""transform(array(slice(z, c * {STEP} + 1, {STEP})), k ->
        transform(array(substring({text}, big.at + 1, element_at(k, -1).end - big.at)), near ->
            aggregate(k, struct(big.at AS at, cast(array() AS array<string>) AS parts),
                (acc, x) -> struct(x.end AS at, array_append(acc.parts,
                    concat(substring(near, acc.at - big.at + 1, x.start - acc.at), x.put)) AS parts)))[0])[0]"""
    return f"""transform(array({cuts}), z -> if(size(z) = 0, {text},
        aggregate(sequence(0, cast((size(z) - 1) div {STEP} AS int)),
            struct(0 AS at, cast(array() AS array<string>) AS parts),
            (big, c) -> transform(array({chunk}),
                r -> struct(r.at AS at, array_append(big.parts, array_join(r.parts, '')) AS parts))[0],
            big -> concat(array_join(big.parts, ''), substring({text}, big.at + 1)))))[0]"""


def context(text: str = "text") -> Column:
    """The same number for copies of one text."""
    return F.xxhash64(F.translate(text, ascii_uppercase, ascii_lowercase))


def masked(text: str = "text") -> Column:
    """``text`` with the personal data of ``spans`` blanked out, position by position, so that no term is part of it."""
    hidden = "transform(spans, s -> struct(s.start AS start, s.end AS end, cast('' AS string) AS put))"
    blanks = f"""transform({_apart(f"array_sort({hidden})")},
        c -> struct(c.start AS start, c.end AS end, repeat(' ', c.end - c.start) AS put))"""
    return F.expr(_cleaned(text, blanks))


def with_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, spans, context, rest): ``rest`` is the masked text, null like ``context`` where there are no spans.

    ``row`` tells rows with equal ids apart. The one-element array keeps the optimizer from running the patterns again
    wherever ``spans`` is read, and likewise below."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    rows = rows.select("row", "doc_id", "text", F.explode(F.array(base_spans())).alias("spans"))
    some = F.size("spans") > 0
    return rows.select(
        "row", "doc_id", "spans", F.when(some, context()).alias("context"), F.when(some, masked()).alias("rest")
    )


def _terms(text: str) -> str:
    """SQL: hashes of the different words of ``text``, in lower case."""
    return f"array_distinct(transform(regexp_extract_all({text}, {_quoted(TERM)}, 0), w -> xxhash64(lower(w))))"


def document_terms(found: DataFrame) -> DataFrame:
    """(row, context, entities, terms): what each document with spans holds, every entity and word once. An entity is
    (entity, needs), the second the contexts it takes."""
    email, ip = KINDS.index("email"), KINDS.index("ip")
    # distinct numbers are found by hash, distinct structs would be compared pair by pair
    entities = f"""concat(
        transform(array_distinct(transform(spans, s -> xxhash64(lower(s.value), s.kind))),
            e -> struct(e AS entity, {CONTEXTS} AS needs)),
        transform(array_distinct(transform(filter(spans, s -> s.kind IN ({email}, {ip})), s -> xxhash64(
                lower(if(s.kind = {email}, substring_index(s.value, '@', -1), substring_index(s.value, '.', 3))),
                s.kind, 'group'))),
            e -> struct(e AS entity, {GROUP_CONTEXTS} AS needs)))"""
    return found.where("size(spans) > 0").select(
        "row", "context", F.expr(entities).alias("entities"), F.expr(_terms("rest")).alias("terms")
    )


def term_documents(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(term, documents) over the whole corpus; words are counted once per document, by hash."""
    words = F.expr(_terms(text_column))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))


def _rows_met() -> tuple[Column, Column]:
    """Two numbers that tell sets of rows apart, whatever the order."""
    return F.bit_xor(F.xxhash64("row")).alias("mark"), F.bit_xor(F.xxhash64("row", F.lit("again"))).alias("again")


def _salted(few: DataFrame) -> DataFrame:
    """Every row once per salt, for a join with ``_by_row``; both sides come from lists, so neither is broadcast."""
    return by_shuffle(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def _by_row(many: DataFrame) -> DataFrame:
    return many.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))


def entity_classes(held: DataFrame, total: int) -> DataFrame:
    """(entity, n_entity, needs) for one entity of each class, of those with enough contexts."""
    each = held.select("row", "context", F.inline("entities"))
    # first per context, so that an entity in many documents is summed by many tasks
    counted = each.groupBy("entity", "needs", "context").agg(F.count("*").alias("n"), *_rows_met())
    counted = counted.groupBy("entity", "needs").agg(
        F.sum("n").alias("n_entity"), F.count("*").alias("contexts"), F.bit_xor("mark").alias("mark"),
        F.bit_xor("again").alias("again"),
    )
    counted = counted.where("contexts >= needs").where(F.col("n_entity") < total)
    classes = counted.groupBy("n_entity", "mark", "again").agg(F.min("entity").alias("entity"), F.min("needs").alias("needs"))
    return classes.select("entity", "n_entity", "needs")


def _most(n_entity: Column, total: int) -> Column:
    """The documents a word can be in at most to reach ``GENERALISE`` with an entity; a hair more, for rounding."""
    return F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) * F.pow(n_entity, F.lit(GENERALISE)) * (1 + 1e-9)


def tied_terms(held: DataFrame, docs: DataFrame, total: int, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(row, context, classes, words) of documents where classes of entities and of words can meet, and (row, term, word)
    with the class ``word`` of each of their terms."""
    classes = materialize(entity_classes(held, total), "entity-classes")
    each = held.select("row", F.inline("entities")).drop("needs")
    each = _by_row(each).join(_salted(classes), ["entity", "salt"])
    each = each.groupBy("row").agg(F.collect_list(F.struct("entity", "n_entity", "needs")).alias("classes"))
    met = materialize(held.drop("entities").join(each, "row"), "met-entities")
    words = met.select("row", F.explode("terms").alias("term"))
    # one row per term on both sides
    kinds = words.groupBy("term").agg(F.count("*").alias("n"), *_rows_met()).where(f"n >= {CONTEXTS}")
    largest = classes.agg(F.max("n_entity").alias("n_entity"))
    kinds = kinds.join(by_shuffle(term_documents(docs, text_column)), "term").join(F.broadcast(largest), F.lit(True))
    kinds = materialize(kinds.where(F.col("documents") <= _most(F.col("n_entity"), total)).drop("n_entity"), "kinds")
    alike = ["n", "mark", "again", "documents"]
    named = kinds.join(kinds.groupBy(*alike).agg(F.min("term").alias("word")), alike)
    terms = _by_row(words).join(_salted(named.select("term", "word", "documents")), ["term", "salt"])
    terms = materialize(terms.select("row", "term", "word", "documents"), "row-terms")
    lists = terms.groupBy("row").agg(F.collect_set(F.struct("word", "documents")).alias("words"))
    tied = met.select("row", "context", "classes").join(lists, "row")
    return materialize(tied, "tied-terms"), terms.drop("documents")


def disclosing(tied: DataFrame, total: int) -> DataFrame:
    """(row, word, disclosure) of the classes of words that reveal an entity of their document, from ``GENERALISE`` on. A
    pair that stands in very many documents is summed and joined by many tasks."""
    pairs = tied.select("row", "context", F.inline("classes"), "words").select("*", F.inline("words")).drop("words")
    pairs = pairs.where(F.col("documents") <= _most(F.col("n_entity"), total))
    both = pairs.groupBy("entity", "word", "n_entity", "documents", "needs", "context").agg(F.count("*").alias("copies"))
    both = both.groupBy("entity", "word", "n_entity", "documents", "needs").agg(
        F.sum("copies").alias("n_both"), F.count("*").alias("contexts")
    ).where("contexts >= needs")
    information = F.log(F.lit(float(total)) / F.col("n_entity"))
    shared = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("documents")))
    scored = both.select("entity", "word", (shared / information).alias("disclosure")).where(f"disclosure >= {GENERALISE}")
    marked = _by_row(pairs.select("row", "entity", "word")).join(_salted(scored), ["entity", "word", "salt"])
    return marked.groupBy("row", "word").agg(F.max("disclosure").alias("disclosure"))


def revealing_terms(held: DataFrame, docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(row, term, disclosure) of every revealing term of a document."""
    total = docs.count()
    tied, terms = tied_terms(held, docs, total, text_column)
    return terms.join(by_shuffle(disclosing(tied, total)), ["row", "word"]).select("row", "term", "disclosure")


def _places(text: str, known: str) -> str:
    """SQL: [(start, end, value, disclosure)] of the words of ``text`` that the map ``known`` holds."""
    quoted = _quoted(TERM)
    return _walked(
        f"""zip_with(split({text}, {quoted}), regexp_extract_all({text}, {quoted}, 0),
            (gap, hit) -> struct(length(gap) AS gap, hit AS hit, {known}[xxhash64(lower(hit))] AS disclosure))""",
        "0", "acc.s + x.gap + coalesce(length(x.hit), 0)",
        """if(x.hit IS NULL OR x.disclosure IS NULL, NULL, struct(acc.s + x.gap AS start,
            acc.s + x.gap + length(x.hit) AS end, x.hit AS value, x.disclosure AS disclosure))""",
        "struct<start:int,end:int,value:string,disclosure:double>",
    ) + ".made"


def term_spans(found: DataFrame, docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(row, places) with the (start, end, value, disclosure) of every place of a revealing term, in the whole text of
    every document that holds the entity."""
    held = materialize(document_terms(found), "document-terms")
    marked = revealing_terms(held, docs, text_column)
    told = marked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("known"))
    return found.join(told, "row").select("row", F.expr(_places("rest", "known")).alias("places"))


def _written(spans: str, kind: str) -> str:
    return f"concat_ws(',', transform({spans}, s -> concat({kind}, ':', s.start, ':', s.end)))"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""
    found = materialize(with_spans(docs), "base-spans")
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")[s.kind]"
    more = term_spans(found.where("size(spans) > 0"), docs)
    rows = found.drop("context", "rest").join(more, "row", "left")
    base = F.expr(_written("spans", names))
    added = F.expr(_written("places", "'term'"))
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)
    ]
    every = F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(added, F.lit("")))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with personal data replaced: base spans by their kind in brackets, terms by a general word or nothing.
    Rows without spans pass through untouched; only the others move to be joined with their terms."""
    columns = docs.columns
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text_column), F.lit("")).alias("body"),
    )
    spotted = marked.select("doc", "row", "body", F.explode(F.array(base_spans("body"))).alias("spans"))
    clean = spotted.where("size(spans) = 0").select("doc.*")
    held = materialize(spotted.where("size(spans) > 0"), "personal")
    found = held.select("row", "spans", context("body").alias("context"), F.explode(F.array(masked("body"))).alias("rest"))
    more = term_spans(found, docs, text_column)
    kind = r"case when t.value rlike '[0-9]' then '[NUMBER]' when t.value rlike r'^\p{Lu}' then '[NAME]' else '[WORD]' end"
    terms = f"""transform(places, t -> struct(t.start AS start, t.end AS end,
        if(t.disclosure >= {REMOVE}, '', {kind}) AS put))"""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")[s.kind]"
    cuts = F.expr(
        f"""array_sort(concat(
            transform(spans, s -> struct(s.start AS start, s.end AS end, {names} AS put)),
            coalesce({terms}, cast(array() AS array<struct<start:int,end:int,put:string>>))))"""
    )
    joined = held.join(more, "row", "left").withColumn("cuts", cuts)
    text = F.expr(_cleaned("body", _apart("cuts")))
    dirty = joined.select(*[(text if c == text_column else F.col(f"doc.`{c}`")).alias(c) for c in columns])
    return clean.unionByName(dirty)
