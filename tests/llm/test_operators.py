"""Every operator against brute force, on rows that are hard: null, empty, long, repeated, odd Unicode, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quotemill.llm import (
    block_names, disclosure, dom_model, hypervectors, packing, prefix_bpe, quality_rules, set_sketch, token_counts, token_file,
)

BYTE, WORD, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, piece string, component_id long"


def hard_rows():
    rng = random.Random(11)
    words = ["river", "stone", "Élan", "über", "niño", "the", "of", "and", "it's", "1,234", "漢字", "x́y", "<|endoftext|>",
             "a@b.example.com", "10.0.0.1", "4041894974608795", "+1 (456) 555-2186"]
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "Hello"), (5, "hello"), (6, "HELLO"), (6, "HELLO"), (7, "É"), (8, "é")]
    base = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(120)]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = f"changed{i}"
        rows.append((100 + i, " ".join(copy)))
    for i in range(60):
        rows.append((200 + i, rng.choice(["  ", "\n", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))))
    rows.append((400, "word " * 30_000))
    rows.append((401, "x" * 200_000))
    rows.append((402, "Ab" * 8192 + "tail"))
    rows.append((403, "aB" * 8192 + "TAIL"))
    return [(i, t, ["en", "fr"][n % 2] if n % 5 else None, "s", 0, None, "p", 9) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1] or "") for r in hard_rows()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def library_ids(path, text, end):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_pieces_equal_the_library():
    from quotemill.llm.pieces import PieceEncoder

    rng = random.Random(3)
    parts = ["river", "River", "XQZJV", "thheingnd", "don't", "a'll", "É", "naïve", "ß", "12", ".", "\n", "\t", " ", "  ", "'", "'s", "漢", "\x00", "\x7f", "~"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(3_000)]
    for path in (BYTE, WORD):
        encode = PieceEncoder(path)
        for text in texts:
            expected = encode.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encode.encode(text), "<u4").tolist() == expected, text


def test_elias_fano_selects_every_value():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000):
        values = np.cumsum(rng.integers(0, 900, n)) + 1
        sequence = token_file.EliasFano.of(values)
        assert sequence.all().tolist() == values.tolist() == [sequence.select(i) for i in range(n)]
        assert len(sequence.low) + len(sequence.high) <= n * (2.5 + np.log2(values[-1] / n + 1)) / 8 + 8
    assert token_file.EliasFano.of(np.zeros(0)).all().tolist() == []


def test_token_file(docs, rows, none):
    got = token_file.token_files(docs, WORD, 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    expected = sorted((i, len(ids), crc(ids)) for i, t in rows for ids in [library_ids(WORD, t, 2)])
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert token_file.token_files(none, WORD, 2).count() == 0


def test_given_documents_are_read_by_select(spark, docs, rows, tmp_path):
    path = str(tmp_path / "files")
    token_file.write_token_files(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), path, WORD, 2)
    wanted = [1, 4, 6, 139, 400, 401]
    ask = spark.createDataFrame([(i,) for i in [*wanted, 4, 999_999, None]], "doc_id long")
    got = token_file.read_documents(spark, path, ask).collect()
    expected = Counter((i, tuple(library_ids(WORD, t, 2))) for i, t in rows if i in wanted)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got if r.doc_id is not None) == expected
    assert sum(r.doc_id is None for r in got) == 1
    assert token_file.read_documents(spark, path, ask.limit(0)).count() == 0


def test_packing(docs, rows, none):
    capacity = 256
    got = packing.pack(docs, BYTE, 0, capacity).collect()
    expected = Counter()
    for i, t in rows:
        ids = library_ids(BYTE, t, 0)
        start = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            expected[i, k, start, n, crc(ids[start : start + n])] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.1 * sum(r.length for r in got) / capacity + 1
    assert packing.pack(none, BYTE, 0, capacity).count() == 0


def test_two_fit_beats_greedy_filling():
    counts = np.zeros(11, np.int64)
    for n in (6, 3, 2, 2, 5, 5):
        counts[n] += 1
    assert ((6, 2, 2), 1) in packing.plan(counts, 10)


def test_exact_copies(docs, rows, none):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t.translate(LOWER)].append(i)
    expected = sorted(
        (i, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    )
    got = block_names.exact_copies(docs, 64)
    assert found(got, "doc_id", "keep_id", "group_size", "text_sha256") == expected
    assert Counter(r.doc_id for r in got.where("kept").collect()) == Counter(max(g) for g in groups.values())
    assert block_names.exact_copies(none).count() == 0
    left = block_names.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_a_block_that_many_texts_share_is_one_row_of_its_task(spark):
    texts = ["hot"] * 3000 + [f"text {i}" for i in range(600)] + ["hot and long " * 9] * 700
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    cut = block_names.cut_blocks(frame, 32)
    blocks = cut.where("block is not null").groupBy(F.spark_partition_id().alias("p"), "block").count()
    assert blocks.agg(F.max("count")).first()[0] == 1
    # forgetting blocks adds rows and changes no name
    assert block_names.cut_blocks(frame, 32, remembered=40).where("block is not null").count() > blocks.count()
    sizes = Counter(texts)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in block_names.exact_copies(frame, 32).collect()}
    last = {t: i for i, t in enumerate(texts)}
    assert got == {i: (last[t], sizes[t], last[t] == i) for i, t in enumerate(texts)}


def broadcasts(df):
    """What the plan of a frame broadcasts, each as text."""
    out = []

    def walk(node):
        if node.nodeName() == "BroadcastExchange":
            out.append(node.toString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    return out


def written(monkeypatch, module):
    """What the work tables of a module broadcast, by label, filled as they are made."""
    out, write = defaultdict(list), module.materialize

    def noted(df, label):
        out[label] += broadcasts(df)
        return write(df, label)

    monkeypatch.setattr(module, "materialize", noted)
    return out


def test_only_large_groups_of_copies_are_broadcast(spark):
    frame = spark.createDataFrame([(i, f"text {i // 2}") for i in range(60)], "doc_id long, text string")
    plan = broadcasts(block_names.exact_copies(frame))
    assert plan and all("* 1000) > 60)" in x for x in plan)


def test_columns_and_null_ids_pass_through_exact_dedup(spark):
    rows = [(None, "x", 1), (None, "x", 2), (None, None, 3), (5, "", 4), (5, None, 5), (7, "X", 6), (8, "y", 7), (None, "z", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __nth int").withColumn("name", F.lit(1)).withColumn("a.b", F.lit(2))
    left = block_names.drop_copies(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "z"), (5, ""), (7, "X"), (8, "y")]


def shingles(text):
    words = WORDS.findall(text.translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies(docs, rows, none):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 75 * len(sets[a] | sets[b]) and least[b] < least[a]:
                    least[a], changed = least[b], True
    got = set_sketch.near_copies(docs)
    expected = sorted((i, len(sets[i]), least[i], least[i] == i) for i, _ in rows)
    assert found(got, "doc_id", "n_shingles", "component_id", "kept") == expected
    assert set_sketch.near_copies(none).count() == 0
    kept = set_sketch.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if least[i] == i}


def test_bands_are_not_broadcast(docs, monkeypatch):
    # Spark counts 32 bands of a document as one row, so it took them for small when they weren't
    made = written(monkeypatch, set_sketch)
    set_sketch.near_copies(docs)
    assert not made["shared"]
    assert not [x for x in made["hopeful"] if "band" in x]


def test_many_candidates_are_broadcast_as_bits(spark, monkeypatch):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).repartition(5)
    frame = frame.union(spark.createDataFrame([(None, "none"), (7, "again"), (-5, "below")], "doc_id long, text string"))
    ids = spark.range(0, 20_000, 7).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(-5,), (-9,)], "doc_id long"))
    expected = [(-5, "below"), (7, "again")] + [(i, f"t{i}") for i in range(0, 20_000, 7)]
    assert found(set_sketch.only(frame, ids), "doc_id", "text") == sorted(expected)
    monkeypatch.setattr(set_sketch, "BROADCAST_IDS", 0)
    few = set_sketch.only(frame, ids)
    assert found(few, "doc_id", "text") == sorted(expected)
    assert broadcasts(few) and all("bits" in x for x in broadcasts(few))
    # no text is moved but the candidates' and those of a few equal hashes
    assert set_sketch._marked(frame, ids).count() <= len(expected) + 10


def test_incidence_products_count_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (1, 50, 200, 250)]
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    common = set_sketch._common(sets)
    for i in range(4):
        for j in range(4):
            assert i == j or common[i, j] == expected[i][j]


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def test_personal_data(spark, docs, rows, none):
    rng = random.Random(5)
    parts = ["1", "23", "192.", "0", ".", "-", " ", "+", "(", "b.c", "@", "x@y.de", "+1 (456) 555-2186", "000.1.2.3", "_", "😀",
             "4041 8949 7460 8795", "256.1.1.1"]
    more = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    expected = []
    for i, t in rows + more:
        spans = [
            (k, m.start(), m.end()) for k, (p, ok) in PERSONAL.items() for m in re.finditer(p, t) if ok(m.group())
        ]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        expected.append((i, *(n[k] for k in PERSONAL), hashlib.sha256(written.encode()).hexdigest()))
    got = disclosure.personal_data(every)
    assert found(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected)
    assert disclosure.personal_data(none).count() == 0


def test_terms_that_reveal_are_found_and_removed(spark, none):
    filler = [(i, f"the boat of the town number{i} came in") for i in range(60)]
    told = [(100, "write to jo@x.example.com the zanzibar captain of old"), (101, "our zanzibar man is jo@x.example.com of the town")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in filler + told], "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r.doc_id: r.spans for r in disclosure.personal_data(docs).collect()}
    assert spans[100] == "email:9:25,term:30:38" and "term:4:12" in spans[101] and spans[5] == ""
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert clean[100] == "write to [EMAIL] the  captain of old" and clean[5] == filler[5][1]
    assert disclosure.sanitise(none).columns == none.columns


def test_disclosure_equals_brute_force(spark):
    rng = random.Random(9)
    people = [f"p{i}@host{i % 3}.example.com" for i in range(8)] + ["10.1.2.3", "10.1.2.4", "10.1.9.9"]
    common, rare = [f"w{i}" for i in range(30)], [f"rare{i}" for i in range(40)]
    texts = []
    for i in range(240):
        parts = rng.choices(common, k=6) + rng.sample(rare, rng.randint(0, 2))
        if i % 3 == 0:
            who = rng.randrange(len(people))
            parts += [people[who], f"rare{who}", *(rng.sample(people, 2) if i % 9 == 0 else [])]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[:30]  # copies are no contexts of their own
    held, words = [], []
    for t in texts:
        who = [w for w in t.split() if "@" in w or w.startswith("10.")]
        held.append({(w, 2) for w in who} | {(w.split("@")[-1] if "@" in w else w.rsplit(".", 1)[0], 3) for w in who})
        words.append({w for w in t.split() if w not in who})
    at, of = defaultdict(set), defaultdict(set)
    for i in range(len(texts)):
        for e in held[i]:
            at[e].add(i)
        for w in words[i]:
            of[w].add(i)
    n, expected = len(texts), {}
    for e, rows in at.items():
        for w, places in of.items():
            both = rows & places
            if len({texts[i] for i in both}) >= e[1]:
                score = np.log(len(both) * n / (len(rows) * len(places))) / np.log(n / len(rows))
                if score >= disclosure.GENERALISE:
                    for i in both:
                        expected[texts[i], i, w] = max(score, expected.get((texts[i], i, w), 0))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = disclosure.with_spans(frame).join(frame, "doc_id")
    got = disclosure.revealing_terms(disclosure.document_terms(found), frame)
    spelled = spark.createDataFrame([(w,) for w in of], "w string").select("w", F.xxhash64("w").alias("term"))
    got = got.join(spelled, "term").join(found.select("row", "text", "doc_id"), "row").collect()
    assert expected and {(r.text, r.doc_id, r.w): pytest.approx(r.disclosure) for r in got} == expected
    assert len(got) == len(expected)


def test_a_host_is_revealed_by_a_name_that_stands_with_different_addresses(spark):
    texts = [f"the boat of the town number{i} came in" for i in range(60)]
    texts += [f"{name}@mail.zanzibar.example said Quagga came in" for name in ("jo", "al", "bo")]
    texts += [f"{name}@post.example said Okapi came in" for name in ("jo", "al")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert all(clean[i] == "[EMAIL]   came in" or "Quagga" not in clean[i] for i in (60, 61, 62))
    assert "Okapi" in clean[63] and "Okapi" in clean[64] and clean[7] == texts[7]


def test_salted_rows_and_words_are_not_broadcast(spark, monkeypatch):
    rows = [(i, f"mail to someone{i % 4}@host{i % 3}.example.com or Person{i % 4} here {i}") for i in range(24)]
    rows += [(100 + i, f"nothing but words {i}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = written(monkeypatch, disclosure)
    held = disclosure.document_terms(disclosure.with_spans(docs))
    last = disclosure.revealing_terms(held, docs)
    assert {"met-entities", "kinds", "row-terms"} <= made.keys()
    assert last.count() > 0
    assert not [x for x in made["met-entities"] + made["row-terms"] + broadcasts(last) if "salt" in x]
    # the largest number of documents of an entity alone
    assert len(made["kinds"]) == 1 and "term" not in made["kinds"][0]
    assert not [x for x in broadcasts(last) if "row-terms" in x or "word" in x]


def test_many_spans_in_one_text_take_linear_time(spark):
    long = " ".join(f"a{i}@b.example.com" for i in range(50_000))
    docs = spark.createDataFrame([(1, long), (2, "a7@b.example.com, 1.2.3.4")], "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: r for r in disclosure.personal_data(docs).collect()}
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert time.monotonic() - start < 120
    assert got[1].n_email == 50_000 and got[2].n_ip == 1
    expected = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", long))
    assert got[1].base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
    assert clean == {1: " ".join(["[EMAIL]"] * 50_000), 2: "[EMAIL], [IP]"}


def test_a_shared_passage_is_a_context_in_each_text_but_copies_are_one(spark):
    footer = " this is the same long passage that stands below each of the letters that leave the house every single day: " \
             "signed zanzibar, jo@x.example.com, this is the same long passage that stands below each of the letters that leave"  # fmt: skip
    other = "quagga wrote to al@y.example.com of the town"
    texts = [f"the boat of the town number{i} came in" for i in range(60)]
    texts += [f"letter{i} of the town." + footer for i in range(3)] + [other, other.upper(), other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert all("zanzibar" not in clean[i] and "[EMAIL]" in clean[i] for i in range(60, 63))
    assert all("quagga" in clean[i].lower() for i in range(63, 66))


def test_terms_far_from_the_entity_are_found_and_removed_everywhere(spark):
    far = " ".join(["and the boat of the town came in"] * 8)  # 255 characters
    texts = [f"the boat of the town number{i} came in and" for i in range(60)]
    texts += [
        f"jo@x.example.com wrote one. {far} Zanzibar {far} zanzibar came", f"Zanzibar {far} two {far} jo@x.example.com",
        f"{far} three jo@x.example.com {far}, zanzibar's, zanzibar", "the town of zanzibars",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in disclosure.personal_data(docs).collect()}
    for i in (60, 61, 62):
        expected = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\bzanzibar\b(?!')", texts[i], re.I)]
        assert [x for x in spans[i].split(",") if x.startswith("term")] == expected and expected
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert clean[60] == f"[EMAIL] wrote one. {far}  {far}  came" and clean[62] == f"{far} three [EMAIL] {far}, zanzibar's, "
    assert clean[63] == texts[63] and clean[0] == texts[0]


def test_language(docs, rows, none):
    got = hypervectors.identify(docs).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    text = dict(rows)
    for r in got:
        letters = any(c.isalpha() for c in text[r.doc_id])
        assert (r.lang_pred in ("en", "fr")) == letters and (r.lang_pred == "und") != letters and 0 <= r.score <= 1
    assert hypervectors.identify(none).count() == 0


def test_language_vectors_equal_brute_force_in_bounded_memory(spark):
    rng = random.Random(4)
    scripts = {"zh": (0x4E00, 6000), "ko": (0xAC00, 6000), "am": (0x1200, 300), "el": (0x3B1, 24)}
    texts = ["".join(chr(low + rng.randrange(n)) if rng.random() < 0.8 else " " for _ in range(30_000)) for low, n in scripts.values()]
    table = hypervectors.TrigramVectors(remembered=1000)
    before = table.nbytes
    for text in [*texts, "Il y a, là: 3 mots", "a", "x" * 50]:
        classes = [0, *table._classes(np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)).tolist(), 0]
        classes = [c for i, c in enumerate(classes) if i == 0 or c or classes[i - 1]]
        slow = np.zeros(hypervectors.DIMENSIONS, np.int64)
        for (a, b, c), n in Counter(zip(classes, classes[1:], classes[2:])).items():
            slow += n * np.roll(table.third[a], 2).astype(np.int64) * np.roll(table.third[b], 1) * table.third[c]
        assert table.bundle(text).tolist() == slow.tolist()
        assert hypervectors.TrigramVectors().bundle(text).tolist() == slow.tolist()
    assert table.nbytes == before and table.used == 1000
    assert hypervectors.TrigramVectors().nbytes < 32 << 20
    whole, hypervectors.PIECE = table.bundle(texts[0]), 1001
    try:
        assert table.bundle(texts[0]).tolist() == whole.tolist()
    finally:
        hypervectors.PIECE = 1 << 20
    frame = []
    for number, (lang, (low, n)) in enumerate(scripts.items()):  # texts of words, of which some are frequent
        words = ["".join(chr(low + rng.randrange(n)) for _ in range(rng.randint(1, 5))) for _ in range(400)]
        shares = [1 / rank for rank in range(1, 401)]
        frame += [(1000 * number + i, " ".join(rng.choices(words, shares, k=80)), lang) for i in range(75)]
    got = hypervectors.identify(spark.createDataFrame(frame, "doc_id long, text string, lang string"))
    truth = {i: lang for i, _, lang in frame}
    told = [(truth[r.doc_id], r.lang_pred) for r in got.where("held_out").collect()]
    assert len(told) > 80 and sum(a == b for a, b in told) >= 0.97 * len(told)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hypervectors.identify(docs).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_token_counts(docs, rows, none):
    expected = sorted((i, len(t.encode()), n, n > 20) for i, t in rows for n in [len(library_ids(BYTE, t, 0)) - 1])
    assert found(token_counts.count_tokens(docs, BYTE, 20), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.count_tokens(none, BYTE, 20).count() == 0


def test_quality_statistics(docs, rows, none):
    def slow(t):
        words = WORDS.findall(t)
        where = defaultdict(list)
        for i in range(len(words) - 4):
            where[tuple(words[i : i + 5])].append(i)
        repeated = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)

    got = quality_rules.judge(docs, [])
    assert found(got, "doc_id", *quality_rules.BASE) == sorted((i, *slow(t)) for i, t in rows)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) == (not r.kept)
    assert quality_rules.judge(none, []).count() == 0


def test_rules_are_learned_and_emitted(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random(900), rng.random(900)
    bad = (a > 0.7) & (b < 0.4) | (b > 0.95)
    rules = quality_rules.learn({"upper_share": a, "digit_share": b}, bad)
    frame = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "upper_share double, digit_share double")
    kept = np.asarray([r.kept for r in frame.select(quality_rules.emit(rules).alias("kept")).collect()])
    assert len(rules) >= 2 and (kept != bad).mean() > 0.97
    assert quality_rules.learn({"x": a}, np.zeros(900, bool)) == [] and quality_rules.learn({"x": a[:0]}, bad[:0]) == []


def test_quality_stage_passes_columns_through(spark, docs, none):
    left = quality_rules.drop_poor(docs.withColumn("stats_0", F.array(F.lit(1.5))), [])
    assert left.columns == [*docs.columns, "stats_0"] and left.where("length(text) > 0").count() == left.count() > 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.learn_rules(none, labels) == []


def test_prefix_bpe(docs, rows, none):
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(RANKS), special_tokens={})
    expected = []
    for i, t in rows:
        ids = library.encode_ordinary(t)
        digest = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        expected.append((i, len(ids), digest, hashlib.sha256(t.encode()).hexdigest()))
    got = prefix_bpe.check_codes(docs, RANKS, P.PATTERN)
    assert found(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected)
    assert prefix_bpe.check_codes(none, RANKS, P.PATTERN).count() == 0
    back = prefix_bpe.decode_ids(prefix_bpe.encode_texts(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in back.collect()) == sorted(rows)


def test_appends_and_edits_equal_encoding_anew():
    bpe = prefix_bpe.PrefixBpe(prefix_bpe.read_ranks(RANKS))
    rng = random.Random(8)
    data, last = b"", []
    for _ in range(40):
        data = bpe.append(data, last, bytes(rng.choice(b"abcdeinorst ") for _ in range(rng.randint(1, 9))))
    assert b"".join(bpe.bytes_of[i] for i in bpe.ids(last)) == data
    for _ in range(30):
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.randint(0, 5))
        data, last, _ = bpe.edit(data, last, a, b, bytes(rng.choice(b"abcdeinorst ") for _ in range(rng.randint(0, 5))))
        whole = []
        bpe.append(b"", whole, data)
        assert last == whole


def test_pages(spark):
    pages = [
        (1, "u", None), (2, None, ""), (3, "u", "<article><p>unfinished <b>bold &amp; brave</b> text here</p"),
        (4, "u", dom_model.LABELLED[0]), (5, "u", '<article><h1>T &lt; 1</h1><p>a\n b<br>c<p>d<script>x="<p>"</script></article>'
         "<footer>&copy; f</footer>"), (6, "u", "<nav><a href=x>home</a></nav>"),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    model = dom_model.learn_model(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    got = {r.page_id: r for r in dom_model.extract(df, model).collect()}
    assert got[1].text == got[2].text == got[6].text == "" and got[2].url is None
    assert got[5].text == "T < 1\n\na b c\n\nd"
    assert got[3].text == "unfinished bold & brave text here"
    assert got[4].text.startswith("The ferry is late again") and "cookies" not in got[4].text and "fog at all" not in got[4].text
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert dom_model.extract(df.limit(0), model).count() == 0
    assert dom_model.learn_model(df.limit(0)).marginals(dom_model.read_page("")[0])


def test_a_closed_svg_is_empty_and_an_open_one_goes():
    def read(page):
        return [text for _, text in dom_model.read_page(page)[1]]

    assert read('<article><h1>T</h1><svg class="i"/><p>one.</p><p>two.</p></article>') == ["T", "one.", "two."]
    assert read("<p>a <SVG a='>' b=\">\" />b</p><p>c</p>") == ["a b", "c"]
    assert read("<p>a<svg/>b</p><svg><path d='x'/><text>no</text></svg><p>c</p><svg /><p>d</p>") == ["a b", "c", "d"]
    assert read('<p>a</p><svg class="/>" id="x"><text>no</text></svg><p>b</p><svg><p>c</p>') == ["a", "b"]
    assert [n.tag for n in dom_model.read_page("<div><svg/><p>x</p></div>")[0]] == ["html", "div", "p"]


def test_marginals_equal_enumeration():
    model = dom_model.TreeModel(dom_model.hand_counts())
    nodes, _ = dom_model.read_page('<div class="content"><p>One sentence here.</p><ul><li>x</li></ul></div><p>tail</p>')
    weight = Counter()
    for bits in range(1 << len(nodes)):
        state = [bits >> i & 1 for i in range(len(nodes))]
        p = 1.0
        for node, s in zip(nodes, state, strict=True):
            odds = model.node_odds(node, len(nodes[node.parent].below) if node.parent >= 0 else 1)
            above = state[node.parent] if node.parent >= 0 else 0
            p *= (odds if s else 1) / (1 + odds) * model.down.get(node.tag, model.general)[above][s]
        for i, s in enumerate(state):
            weight[i, s] += p
    for i, m in enumerate(model.marginals(nodes)):
        assert m == pytest.approx(weight[i, 1] / (weight[i, 0] + weight[i, 1]))


def test_pipeline(spark, tmp_path, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "piece", "start", "length"]
    kept = {r.doc_id for r in got.collect()}
    assert not kept & {1, 2, 3, 4, 5, 6, 7, 8, 400} and any(100 <= i < 140 for i in kept)
