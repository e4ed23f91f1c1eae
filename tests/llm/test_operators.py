"""The operators of vectormart.llm on small tables with awkward rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from vectormart.llm import (bpe, exact_dedup, fingerprints, language, mixing, near_dedup, pii, queries, sharding, span_dedup,
                            token_files, words)
from vectormart.session import work_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "The quick brown fox jumps over the lazy dog near the river bank while seven old men watch it and laugh aloud today. " * 2
TEXTS = [
    "", None, " \n\t ", "one", "Two words", "Hello,  world!\r\nIt's fine.\x0bYes", "a<|endoftext|>b    xéé café, ×!y", "日本語 テキスト 😀 ok",
    BASE + "alpha", BASE + "alpha", (BASE + "alpha").upper(), BASE + "beta", "x" * 30_000, "na " * 5_000, "a  b", "a b", "a\nb",
    "mail bob.x+y@mail.example.org now, 10.0.0.255 or 10.0.0.256, 4111 1111 1111 1111 and +49 (30) 123-4567. a@b.c_d@e.f",
    "1.2.3.4.5.6.7.8 4111-1111-1111-1112 +1 2 +123456789012345678",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 2}", None][i % 7 == 0], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[9], (None, "no id", "en", "s0", 5)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.BYTE_BPE)


def test_bpe(docs, empty, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    library = tokenizer()
    want = []
    for i, text in plain(docs):
        ids = library.encode(text, add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert rows(bpe.digests(docs, queries.BYTE_BPE)) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, queries.BYTE_BPE), queries.BYTE_BPE)
    assert rows(back) == sorted(plain(docs), key=str)
    assert rows(bpe.digests(empty, queries.BYTE_BPE)) == []


def test_token_files(spark, docs, empty, monkeypatch):
    library = tokenizer()
    path = work_folder(spark)
    token_files.write_token_files(docs, path, queries.BYTE_BPE, 2)
    got = {}
    at = 0
    for r in sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append(r.ids)
    for i, text in plain(docs):
        assert library.encode(text, add_special_tokens=False).ids + [2] in got[i]
    for r in token_files.token_file_digests(spark, path).collect():
        assert r.ids_crc32 in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in got[r.doc_id]]
    none = work_folder(spark)
    token_files.write_token_files(empty, none, queries.BYTE_BPE, 2)
    assert rows(token_files.token_file_digests(spark, none)) == []


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5_000])
def test_blocks(n):
    ids = np.random.default_rng(n).choice([5, 300, 70_000, 2 ** 32 - 1], n, p=[.6, .3, .09, .01]).astype(np.uint32)
    minima, widths, counts, starts, payload = token_files.pack(ids)
    assert (token_files.unpack(n, minima, widths, counts, starts, payload) == ids).all()


def test_exact_dedup(docs, empty):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = {}
    for i, text in plain(docs):
        groups.setdefault(normal(text), []).append(i)
    for r in exact_dedup.exact_groups(docs, carry=["text"]).collect():
        group = groups[normal(r.text or "")]
        ids = [i for i in group if i is not None]
        assert (r.keep_id, r.group_size) == (min(ids) if ids else None, len(group))
        assert r.text_sha256 == hashlib.sha256(normal(r.text or "").encode()).hexdigest()
    clashing = docs.withColumns({"range": F.lit(1), "run": F.lit("x"), "kept": F.lit(2), "row": F.lit(3)})
    kept = exact_dedup.exact_dedup(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_splits_a_large_group(spark):
    many = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same  text").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_dedup.exact_groups(many).filter("group_size > 1")
    assert found.agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int")), F.max("group_size")).first()[:] == (1667, 0, 0, 1, 1667)


def shingles(text, width):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if len(parts) < width:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i:i + width]) for i in range(len(parts) - width + 1)}


def test_near_dedup(docs, empty):
    table = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    sets = {i: shingles(t, 3) for i, t in plain(table)}
    name = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            low, high = sorted((name[a], name[b]))
            name = {i: low if n == high else n for i, n in name.items()}
    want = sorted((i, len(sets[i]), name[i], name[i] == i) for i in sets)
    assert rows(near_dedup.near_duplicates(table)) == sorted(want, key=str)
    assert near_dedup.near_duplicates(docs).count() == docs.count()
    clashing = docs.withColumns({"rep": F.lit(1), "key": F.lit(2), "row": F.lit(3)})
    assert near_dedup.near_dedup(clashing).columns == clashing.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_between_extremes(spark):
    # A family below the threshold, and in the midst of its ids two texts that are linked.
    shared = " ".join(f"word{i}" for i in range(302))
    told = [(i, f"{shared} " + " ".join(f"own{i}x{j}" for j in range(10 if i in (60, 61) else 70))) for i in range(122)]
    sets = {i: shingles(t, 3) for i, t in told}
    alike = [(a, b) for a, b in combinations(range(122), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert alike == [(60, 61)]
    found = near_dedup.near_duplicates(spark.createDataFrame(told, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: 60 if i == 61 else i for i in range(122)}


def test_prefixes_lose_no_link(spark):
    # Families of sets around common cores, of many sizes, against all pairs; minhashes rule nothing out here.
    draw = random.Random(7)
    sets = {}
    for rep in range(240):
        core, lost = 1000 * (rep % 4), draw.randrange(12)
        size = draw.choice([20, 60, 64, 70])
        body = [v for v in range(core, core + size) if draw.random() > lost / 100]
        sets[rep] = sorted({*body, *(draw.randrange(10 ** 6, 2 * 10 ** 6) for _ in range(draw.randrange(8)))})
    table = spark.createDataFrame([(r, r // 2 * 2, v) for r, v in sets.items()], "rep long, group long, shingles array<long>")
    sketches = spark.createDataFrame([(r, [0] * near_dedup.MINHASHES) for r in sets], "rep long, mins array<int>")
    for similarity in (80, 85, 100):
        want = {(a, b) for a, b in combinations(sets, 2) if a // 2 != b // 2
                and 100 * len({*sets[a]} & {*sets[b]}) >= similarity * len({*sets[a]} | {*sets[b]})}
        pairs = near_dedup.fitting(near_dedup.in_cells(near_dedup.prefixes(table, similarity), sketches, similarity), similarity).collect()
        met = {(r.x, r.y) for r in pairs}
        assert len(met) == len(pairs) and want <= met
        assert want or similarity == 100


def test_sets_are_cut_in_small_slices(monkeypatch):
    """However many texts are compared at once, a slice of about a megabyte is cut at a time, with the same sets."""
    import pyarrow as pa

    texts = [b" ".join(b"w%d" % (i * j % 997) for i in range(20_000)) for j in range(1, 40)] + [b"", b"one two"]
    values, places = near_dedup.shingle_sets(pa.array(texts, pa.large_binary()), 3)
    seen, cut = [], near_dedup.shingle_sets
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda column, width: seen.append(column.nbytes) or cut(column, width))
    sets = near_dedup.full_sets(texts, 3)
    assert len(seen) > 2 and max(seen) < 1.3 * near_dedup.SMALL_STEP_BYTES
    assert [s.tolist() for s in sets] == [values[a:b].tolist() for a, b in zip(places[:-1], places[1:])]


def test_classes_make_their_keys_in_many_tasks(spark):
    """A class makes 81 rows: classes of one small file are dealt out before that, and none is lost."""
    named = spark.createDataFrame([(r, [r + i for i in range(near_dedup.MINHASHES)]) for r in range(500)], "rep long, mins array<int>").coalesce(1)
    keyed = near_dedup.table_keys(named)
    made = keyed.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == 81 * 500
    assert len(made) > 1 and max(r["count"] for r in made) < 81 * 500


def test_workers_keep_little_between_tasks(spark):
    """Words of a finished run are forgotten, and what Arrow and the allocator kept goes back to the system."""
    from vectormart.llm import words as used

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(e.kept) for e in used.Encoder.loaded.values())], pa.int64())})

    table = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(2000)), None, None, 0) for i in range(50)], SCHEMA).repartition(8)
    assert bpe.digests(table, queries.BYTE_BPE).agg(F.sum("n_tokens")).first()[0] > 100_000
    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(kept, "n long").collect()} == {0}


def test_token_files_leave_no_words_in_workers(spark):
    import time

    from vectormart.llm import words as used

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(e.kept) for e in used.Encoder.loaded.values())], pa.int64())})

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200)), None, None, 0) for i in range(50)], SCHEMA).repartition(8)
    token_files.write_token_files(docs, work_folder(spark), queries.BYTE_BPE, 2)
    time.sleep(8)
    assert {r.n for r in spark.range(64).repartition(16).mapInArrow(kept, "n long").collect()} == {0}


def test_a_finished_task_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    whole = words.lean(lambda batches: (b + 1 for b in batches))([1, 2, 3])
    assert list(whole) == [2, 3, 4] and calls == [1]
    part = words.lean(lambda batches: (b for b in batches))([1, 2, 3])
    assert next(part) == 1 and calls == [1]
    part.close()
    assert calls == [1, 1]
    assert words.leanly(lambda key, table: key + table, 1, 2) == 3 and calls == [1, 1, 1]


def test_prefixes_leave_unlike_families_apart(spark):
    # A core that all hold, and more shingles of their own than a link may leave: no pair meets at all.
    table = spark.createDataFrame([(r, r, [*range(300), *range(1000 * (r + 1), 1000 * (r + 1) + 70)]) for r in range(200)],
                                  "rep long, group long, shingles array<long>")
    assert near_dedup.prefixes(table, 85).count() == 0

def luhn(value):
    number = [int(c) for c in reversed(re.sub("[^0-9]", "", value))]
    return sum(n if i % 2 == 0 else 2 * n - 9 * (n > 4) for i, n in enumerate(number)) % 10 == 0


def test_personal_data(spark, docs, empty):
    size = lambda m: len(re.sub("[^0-9]", "", m))
    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= size(m) <= 19 and luhn(m)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= size(m) <= 15)}
    want = {}
    for i, text in plain(docs):
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in forms.items()}
        joined = ",".join(sum(spans.values(), []))
        want[i] = (*[len(spans[k]) for k in forms], hashlib.sha256(joined.encode()).hexdigest())
    found = pii.personal_data(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id]
    assert pii.personal_data(empty).count() == 0


def test_disclosing_terms(spark):
    told = [(i, "Call Zanzibar via jo@ex.org please") for i in range(5)] + [(100 + i, f"please call number{i} again") for i in range(60)]
    table = spark.createDataFrame(told, "doc_id long, text string")
    terms = {r.spans.split(",")[-1] for r in pii.personal_data(table).collect() if r.n_term}
    assert terms == {"term:5:13"}
    assert {r.clean_text for r in pii.sanitised(table).collect() if r.doc_id < 5} == {"Call  via <EMAIL> please"}


def test_disclosing_terms_anywhere(spark):
    far = "some common words stand between them " * 4
    told = [(i, f"Zanzibar {far} and number{i} at jo@ex.org") for i in range(4)]
    told += [(10, "we saw zanzibar again"), (11, f"Timbuktu {far} al@ex.net"), (12, f"timbuktu {far.upper()} al@ex.net")]
    told += [(100 + i, f"we saw number{i} again and {far}") for i in range(60)]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    for i in (0, 1, 2, 3, 11, 12):
        assert "term:0:8" in found[i].spans and found[i].n_term == 1
    assert found[10].spans == "term:7:15" and found[100].n_term == 0


def test_common_weak_terms_stay_where_they_are(spark):
    """Only terms that may be strong are looked up, strong ones always, however common they are."""
    told = [(i, f"Zanzibar some common words at jo@ex.org and number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(150)]
    told += [(1000 + i, "some common words again") for i in range(600)]
    rows = pii.prepared(spark.createDataFrame(told, "doc_id long, text string"), "doc_id", "text")
    shared = pii.shared(rows)
    base = pii.base_spans(shared).withColumns({
        "entities": F.transform("email", lambda s: s["value"]), "inside": pii.terms_of(pii.between(F.col("text"), F.col("email")))})
    strong, weak = pii.disclosing(shared, base)
    common = {r.term for r in weak.collect()}
    assert {"some", "common", "words", "again"} <= common and not common & {r.term for r in strong.collect()}
    terms = [r.term for r in pii.looked_up(rows, weak).collect()]
    assert terms.count("zanzibar") == 150 and len(terms) == 300


def test_fingerprints(docs, empty):
    table = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = dict(plain(table))
    ids = sorted(texts)
    found = {r.doc_id: r for r in fingerprints.fingerprints_beside_edits(table).collect()}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        text, take = texts[i], len(texts[i]) // 2
        edited = text[:len(text) - take] + texts[after][:take]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == (1.0 if texts[after] == text else r.near_next) and 0 <= r.near_edited <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (sorted(re.split(r"(?<=\n)|(?<=[.!?] )", text)) == sorted(re.split(r"(?<=\n)|(?<=[.!?] )", edited)))
    assert fingerprints.fingerprints_beside_edits(empty).count() == 0


def test_fingerprint_values(spark):
    # By another way: one row per paragraph and bit, counted by Spark's grouping.
    random = np.random.default_rng(7)
    some = lambda n: "".join(f"{w}{end}" for w, end in zip(random.integers(0, 200, n), random.choice([". ", "! ", "\n", " ", ".", "\n\n"], n)))
    told = [(i, some(n)) for i, n in enumerate([0, 1, 2, 7, 30, 254, 255, 256, 400, 900, 5, 40, 0, 3])]
    table = spark.createDataFrame(told, "doc_id long, text string")
    texts = dict(told)
    ids = sorted(texts)
    edits = []
    for i, after in zip(ids, ids[1:] + ids[:1]):
        take = len(texts[i]) // 2
        edits.append((i, texts[i][:len(texts[i]) - take] + texts[after][:take]))
    split = lambda t: [p for p in re.split(r"(?<=\n)|(?<=[.!?] )", t) if p]
    parts = spark.createDataFrame([(kind, i, p) for kind, some_ in (("own", told), ("edit", edits)) for i, t in some_ for p in split(t)], "kind string, i long, p string")
    bits = parts.select("kind", "i", F.explode(F.array(F.xxhash64("p"), F.xxhash64("p", F.lit(1)))).alias("h"))
    hashes = {}
    for r in bits.collect():
        hashes.setdefault((r.kind, r.i), []).append(r.h % 2 ** 64)

    def plain_lanes(key):
        both = hashes.get(key, [])
        lanes = [sum(h >> bit & 1 for h in both[half::2]) for low in (0, 32) for half in (0, 1) for bit in range(low, low + 32)]
        return [len(both) // 2, *lanes]

    def likeness(a, b):
        if a == b:
            return 1.0
        x, y = ([2 * v - p[0] for v in p[1:]] for p in (a, b))
        size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
        return min(max(sum(v * w for v, w in zip(x, y)) / size, 0.0), 1.0) if a[0] and b[0] and size else 0.0

    found = {r.doc_id: r for r in fingerprints.fingerprints_beside_edits(table).collect()}
    assert len(found) == len(told)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        own, edit, following = plain_lanes(("own", i)), plain_lanes(("edit", i)), plain_lanes(("own", after))
        assert (found[i].fingerprint, found[i].edited_fingerprint) == tuple("".join(f"{v:08x}" for v in x) for x in (own, edit))
        assert found[i].near_edited == pytest.approx(likeness(own, edit)) and found[i].near_next == pytest.approx(likeness(own, following))


def test_fingerprints_of_very_long_texts(spark):
    long = lambda n: F.concat_ws("", F.transform(F.sequence(F.lit(n), F.lit(n + 199_999)), lambda i: F.concat(i.cast("string"), F.lit("\n"))))
    row = spark.range(1).select(fingerprints.fingerprint(long(0)).alias("a"), fingerprints.fingerprint(long(10 ** 6)).alias("b"),
                                fingerprints.fingerprint(long(100_000)).alias("c"))
    row = row.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("unlike"), fingerprints.likeness(F.col("a"), F.col("c")).alias("half")).first()
    assert row.unlike < 0.4 and 0.2 < row.half < 0.8


def test_cards_written_digit_by_digit(spark):
    number = "4111111111111111"
    table = spark.createDataFrame([(1, "pay " + " ".join(number)), (2, "pay " + "-".join(number) + " now")], "doc_id long, text string")
    assert {(r.doc_id, r.n_card, r.spans.split(",")[0]) for r in pii.personal_data(table).collect()} == {(1, 1, "card:4:35"), (2, 1, "card:4:35")}


def test_fingerprint_knows_no_order(spark):
    row = spark.sql("select 'one\\ntwo\\nthree\\n' as a, 'three\\none\\ntwo\\n' as b, 'one\\nthree\\n' as c, array('two\\n') as p").select(
        fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"),
        fingerprints.inserted(fingerprints.fingerprint(F.col("c")), F.col("p")).alias("more"),
        fingerprints.deleted(fingerprints.fingerprint(F.col("a")), F.col("p")).alias("less"), fingerprints.fingerprint(F.col("c")).alias("c")).first()
    assert row.a == row.b == row.more and row.less == row.c != row.a


def test_sharding(docs, empty):
    table = sharding.lookup_table([f"n{i}" for i in range(10)], 1009)
    sizes = [table.count(f"n{i}") for i in range(10)]
    assert max(sizes) - min(sizes) <= 1
    less = sharding.lookup_table([f"n{i}" for i in range(9)], 1009)
    assert sum(a != b for a, b in zip(table, less)) < 0.25 * 1009
    clashing = docs.withColumn("slot", F.lit("x"))
    assert sharding.place(clashing).count() == docs.count() and sharding.placements(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_mixing(spark, docs, empty):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "p", 300), ("b", "x", "q", 500), ("b", "y", "p", 100)], "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": .5, "b": .5}, "lang": {"x": .6, "y": .4}}
    raked = mixing.rake(cells, {d: spark.createDataFrame(list(g.items()), f"{d} string, target double") for d, g in goals.items()}).collect()
    for d, goal in goals.items():
        for value, share in goal.items():
            assert sum(r.weight for r in raked if r[d] == value) == pytest.approx(share, abs=1e-5)
    found = mixing.mixed(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.probability <= 1 for r in found)
    assert not any(r.drawn for r in found if r.n_tokens == 0)
    clashing = docs.withColumns({"topic": F.lit(1), "n_tokens": F.lit(2), "probability": F.lit(3), "row": F.lit(4)})
    drawn = mixing.mix(clashing)
    assert drawn.columns == clashing.columns and drawn.count() == sum(r.drawn for r in found)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_hands_on_what_full_cells_cannot_take(spark):
    told = [("a", "x", "p", 6000), ("a", "y", "p", 3000), ("b", "x", "p", 900), ("b", "y", "p", 100)]
    cells = mixing.calibrated(spark.createDataFrame(told, "source string, lang string, topic string, n_tokens long"), 0.5)
    found = {(r.source, r.lang): r.probability * r.tokens for r in cells.collect()}
    assert sum(found.values()) == pytest.approx(5000, rel=1e-4)
    assert found["b", "x"] == pytest.approx(900, rel=1e-4) and found["b", "y"] == pytest.approx(100, rel=1e-4)
    assert found["a", "x"] + found["b", "x"] == pytest.approx(5000 * 6900 ** .7 / (6900 ** .7 + 3100 ** .7), rel=1e-4)
    goal = spark.createDataFrame([("a", .75), ("b", .25)], "source string, target double")
    assert {r.value: r.reached for r in mixing.margins(cells, {"source": goal}).collect()} == pytest.approx({"a": .8, "b": .2}, rel=1e-4)


def test_language(spark, empty):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predictions(given, queries.PIECES).join(given, "doc_id").filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert language.predictions(empty, queries.PIECES).count() == 0


def test_language_of_awkward_rows(docs):
    for r in language.predictions(docs, queries.PIECES).join(docs, "doc_id").collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    clashing = docs.withColumns({"id": F.lit(1), "lang_pred": F.lit("x"), "score": F.lit(2)})
    assert language.recognised(clashing, queries.PIECES, 0.0).columns == clashing.columns


def segmentations(word, table, at=0):
    if at == len(word):
        return 1.0
    return sum(p * segmentations(word, table, at + len(piece)) for piece, p in table.items() if word.startswith(piece, at))


def test_forward_sum():
    import pyarrow as pa

    table = language.Vocabulary.of(queries.PIECES)
    probabilities = np.full((table.size, 1), 0.01)
    known = [p for p in (b" t", b" th", b" the", b"t", b"h", b"e", b"th", b"he", b"the", b" ") if language.Vocabulary.hash_of(p) in set(table.hashes.tolist())]
    pieces = {p: 0.01 for p in known}
    for letter in (b" ", b"t", b"h", b"e"):
        pieces[letter] = pieces.get(letter, 0.0) + language.FLOOR
    got = language.word_scores(pa.array([b" the"], pa.binary()), table, probabilities)[0, 0]
    assert got == pytest.approx(np.log(segmentations(b" the", pieces)))


def test_forward_sum_over_whole_words():
    import pyarrow as pa

    table = language.Vocabulary.of(queries.PIECES)
    probabilities = np.random.default_rng(1).random((table.size, 2)) * 1e-3
    known = {int(h): i for i, h in enumerate(table.hashes)}
    texts = [" the", " institutions", " donaudampfschifffahrtsgesellschaft", " " + "x" * 400, " " + "日本語" * 60, "a"]
    got = language.word_scores(pa.array([t.encode() for t in texts], pa.binary()), table, probabilities)
    for i, text in enumerate(texts):
        word = text.encode()
        for j in (0, 1):
            sums = [Fraction(1)] + [Fraction(0)] * len(word)
            for at in range(len(word)):
                sums[at + 1] += sums[at] * Fraction(language.FLOOR)
                for end in range(at + 1, len(word) + 1):
                    piece = known.get(language.Vocabulary.hash_of(word[at:end]))
                    if piece is not None:
                        sums[end] += sums[at] * Fraction(probabilities[piece, j])
            power = sums[-1].denominator.bit_length() - sums[-1].numerator.bit_length()
            assert got[i, j] == pytest.approx(math.log(sums[-1] * 2 ** power) - power * math.log(2))


def test_span_dedup(spark, empty):
    passage = " ".join(f"Sentence {w} has its own words here." for w in "alpha beta gamma delta epsilon zeta".split())
    told = [(1, f"An opening line. {passage} The end of one."), (2, f"Something else entirely\n{passage} And more."), (3, "A clean text. With sentences. Of its own. And nothing shared at all with others here."), (4, None), (5, "")]
    table = spark.createDataFrame(told, "doc_id long, text string").withColumns({"first": F.lit(1), "row": F.lit(2), "hash": F.lit(3)})
    kept = {r.doc_id: r.text for r in span_dedup.span_dedup(table).collect()}
    assert kept[1] == told[0][1] and kept[3] == told[2][1] and kept[4] is None and kept[5] == ""
    assert kept[2] == "Something else entirely\nAnd more."
    assert span_dedup.span_dedup(table).columns == table.columns
    assert span_dedup.repeats(empty).count() == 0


def test_runs_travel_once_and_packed(spark, monkeypatch):
    """Every run is packed with others, over any slices and buckets; the first of a hash stays, also in rows without id and repeated rows."""
    random = np.random.default_rng(7)
    some = lambda n: " ".join(f"w{i}" for i in random.integers(0, 10 ** 9, n))
    often, twice = some(60), some(80)
    told = [(i, f"{some(20)}. {often}. {some(20)}") for i in range(40)]
    told += [(50, f"{twice}. {some(9)}"), (51, f"{some(9)}. {twice}"), (51, f"{some(9)}. {twice}"), (60, f"{some(30)}. {often}"), (None, f"{often}. {some(10)}")]
    told += [told[-2], told[5], (70, None)]
    monkeypatch.setattr(span_dedup, "BUCKET_BYTES", 4 << 10)
    table = spark.createDataFrame(told, "doc_id long, text string").repartition(5)
    found = span_dedup.repeats(table).collect()
    assert len(found) == len(told)
    gone = {(r.doc_id, r.text): r.removed_words for r in found}
    for r in found:
        if r.doc_id in (None, 50, 70):
            assert not r.changed
        elif r.doc_id == 51:
            assert r.removed_words >= 60
        else:
            assert 40 <= r.removed_words <= 60
    assert len(gone) == len(set(told))
    plan = span_dedup.repeats(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hash#" not in plan.replace("xxhash", "")


def test_span_dedup_of_short_passages():
    import pyarrow as pa

    random = np.random.default_rng(5)
    some = lambda n: [f"w{i}{end}" for i, end in zip(random.integers(0, 10 ** 9, n), random.choice(["", ",", "."], n, p=[.9, .06, .04]))]
    for trial in range(300):
        passage = some(51 + trial % 10)
        texts = [" ".join(some(random.integers(0, 60)) + passage + some(random.integers(0, 60))) for _ in range(2)]
        text, _, _, hashes = span_dedup.runs_of(pa.array(texts))
        assert set(hashes[text == 0]) & set(hashes[text == 1])


def test_words_join_again():
    import pyarrow as pa

    column = pa.array(TEXTS)
    cut, firsts = words.cut(*words.flat(column))
    parts = cut.to_pylist()
    assert [b"".join(parts[a:b]).decode() for a, b in zip(firsts[:-1], firsts[1:])] == [t or "" for t in TEXTS]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = connect(folder).execute(queries.SQL[name])
    names = [d[0] for d in con.description]
    df = queries.QUERIES[name](spark, folder)
    assert difference(df.collect(), df.columns, con.fetchall(), names) is None


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    library = tokenizer()
    given = {r.doc_id: r for r in queries.documents(spark, "/root/testdata/sf0.001").collect()}
    found = out.collect()
    assert 0 < len(found) < len(given) and len({r.doc_id for r in found}) == len(found)
    for r in found:
        text = given[r.doc_id].text
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
