import math

import pytest
from pyspark.sql import functions as F

from vectormart import fixed_values as V
from vectormart.functions import documents as D
from vectormart.functions import labels as B
from vectormart.functions import numbers as N
from vectormart.functions import text as X
from vectormart.functions import vectors as E
from vectormart.operators import catalog, lookup


def test_whitespace_matches_python(column):
    every = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(V.WHITESPACE) == every
    texts = [c + "a" + c + c + "b" + c for c in every]
    assert column(texts, X.strip) == [t.strip() for t in texts]
    assert column(texts, X.collapse_ws) == ["a b"] * len(every)


def test_first_string_and_csv(spark):
    def doc(value):
        return '{"metadata": {"tags": {"genre": %s}}}' % value

    cases = [
        (doc('"x"'), "x", "x"), (doc('[" x "]'), "x", "x"), (doc('["", "x"]'), "x", "x"), (doc("[]"), None, None),
        (doc("[1]"), None, None), (doc('""'), None, None), (doc("null"), None, None), (doc("7"), "7", "7"),
        ("{}", None, None), ('{"metadata": 5}', None, None), (doc('["b", "a", " b ", 3, ""]'), "b", "b, a"),
        ("no json", None, None),
    ]
    df = spark.createDataFrame(cases, "text string, first string, csv string")
    d = df.withColumn("doc", F.try_parse_json("text"))
    path = "metadata.tags.genre"
    for row in d.select("*", D.first_string(F.col("doc"), path).alias("a"),
                        D.list_to_csv(F.col("doc"), path).alias("b")).drop("doc").collect():
        assert (row["a"], row["b"]) == (row["first"], row["csv"]), row["text"]


def test_parsing_tells_broken_from_odd(spark):
    texts = ['{"rhythm": {"bpm": 1.5}}', '{"rhythm": 5}', "[1]", "7", "{}", "{broken", "", None, '{"rhythm": {"bpm": "1d"}}',
             '{"rhythm": {"bpm": "120.5"}, "tonal": {"thpcp": 3}}', '{"rhythm": {"bpm": [1]}}', '{"rhythm": {"bpm": NaN}}']
    df = D.parse_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string"))
    got = df.select("i", F.col("doc").isNotNull(), N.json_double(F.col("doc.rhythm.bpm"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        (True, 1.5), (True, None), (True, None), (True, None), (True, None), (False, None), (False, None),
        (False, None), (True, None), (True, 120.5), (True, None), (True, None)]


def test_lenient_int(column):
    given = ["03/12", " 7 ", "3.0", "3.0/12", '["3"]', "x", None, "", "-4.7", "+5", "1e2", "nan", "1d"]
    assert column(given, N.lenient_int) == [3, 7, 3, None, None, None, None, None, -4, 5, 100, None, None]


def test_whole_numbers(column):
    assert column(["2.5", "-2.5", "2.7", "x", "", None], lambda c: N.cast_whole(c, "string")) == [
        3, -3, 3, None, None, None]
    assert column([2.5, 3.5, 2.7, None, math.inf, math.nan], lambda c: N.cast_whole(c, "double"), "double") == [
        2, 4, 3, None, None, None]
    assert column([3e9], lambda c: N.cast_whole(c, "double", "int"), "double") == [None]


def test_first_block_never_mixes(spark):
    texts = [
        '{"tonal":{"key_edma":{"key":"","scale":""},"key_krumhansl":{"key":"C","scale":"major","strength":0.5}}}',
        '{"tonal":{"key_edma":{"scale":"minor"},"key_krumhansl":{"key":"C"}}}',
        '{"tonal":{"key_temperley":{"strength":0}}}',
        '{"tonal":{"key_edma":7}}',
    ]
    df = D.parse_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string"))
    block = D.first_block(lambda path: F.col("doc." + path))
    rows = df.select("i", block.alias("b")).select("i", "b.*").orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("C", "major", "0.5"), (None, "minor", None), (None, None, "0"), (None, None, None)]


@pytest.mark.parametrize("label,buckets", [
    (B.tempo_label, V.TEMPO_BUCKETS), (B.energy_label, V.ENERGY_BUCKETS), (B.groove_label, V.GROOVE_BUCKETS),
    (B.dynamics_label, V.DYNAMICS_BUCKETS)])
def test_bucket_edges(column, label, buckets):
    bounds = [float(b) for b, _ in buckets if b is not None]
    names = [n for _, n in buckets]
    assert column(bounds, label, "double") == names[1:]
    assert column([math.nextafter(b, -math.inf) for b in bounds], label, "double") == names[:-1]
    assert column([None, math.nan], label, "double") == [None, None]


def test_track_document(spark):
    df = spark.createDataFrame([
        ("Song", "Band", "Disk", "1981-04-01", "Rock", "G", "major", 76.5, 1.05, -18.0, 9.0),
        (None, "", None, None, None, None, "minor", None, None, math.nan, None),
    ], "title string, artist string, album string, date string, genre string, key_key string, key_scale string, "
       "bpm double, danceability double, loudness_integrated double, loudness_range double")
    a, b = [r[0] for r in df.coalesce(1).select(B.track_document()).collect()]
    assert a == ("Song by Band, from the album Disk (1981). Genre: Rock. Key: G major, brighter and more uplifting. "
                 "Tempo: slow at 76 BPM. Energy: quiet and gentle. Groove: moderate groove. "
                 "Dynamics: wide dynamic range.")
    assert b == ("Unknown Title by Unknown Artist, from the album Unknown Album (unknown year). "
                 "Genre: Unknown Genre. Key: .")


def test_years(column):
    assert column(["1981", "1981-04-01", "", None, "-5"], X.year_of) == ["1981", "1981", None, None, None]


def test_clean_album(column):
    given = ["X (Disc 1)", "X [disc 2]", "X (Live at Y)", "X - EP", "X (Deluxe Edition)", "(Oliver) X",
             "X - Remastered", "X (Remaster) Y", " X "]
    assert column(given, X.clean_album) == ["X", "X", "X", "X", "X", "(Oliver) X", "X", "X Y", "X"]


def test_names(column):
    assert column(["Björk", "AC/DC", "Simon & Garfunkel", "A + B", "  X_y..z ", None, "Ørsted ﬁ"],
                  X.lenient_key) == ["bjork", "ac dc", "simon and garfunkel", "a and b", "x y z", "", "rsted fi"]
    assert column(["X feat. Y", "X  Featuring Y", "X ft. Y", "Xfeat. Y", "A\tB c"], X.strict_key) == [
        "x", "x", "x", "xfeat. y", "a b c"]


def test_files(column):
    assert column(["a/b.MP3", "b", "a.b/c", "x.tar.gz", ".hidden"], X.file_ext) == ["mp3", "", "", "gz", ""]
    assert column(["/m/A/x.mp3", "/other/x"], lambda c: X.relative_path(c, "/m")) == ["A/x.mp3", "/other/x"]
    assert column(["A/x.mp3", "x.mp3"], X.top_dir) == ["A", None]


def test_search_term(column):
    from urllib.parse import quote

    given = ["AC/DC *~ é", "a+b & c?"]
    assert column(given, lambda c: X.search_term(c, F.lit("X - EP"))) == [quote(f"{g} X") for g in given]


def test_point_id(column):
    ids = column(["ffffffffffffffff00", "12", "zz", None, "0071aaa53d57b3b5ea"], E.point_id)
    assert ids[:2] == [2 ** 64 - 1, 0x12] and ids[3] is None and ids[4] == int("0071aaa53d57b3b5", 16)
    assert 0 <= ids[2] < 2 ** 64


def test_valid_vector(column):
    given = [[1.0, 2.0], [1.0, None], [1.0, math.nan], [1.0, math.inf], [1.0], None, [0.0, 0.0]]
    assert column(given, lambda c: E.valid_vector(c, 2), "array<double>") == [
        True, False, False, False, False, False, True]


def test_scores(column):
    other = F.array(F.lit(3.0), F.lit(4.0))
    assert column([[3.0, 4.0], [0.0, 0.0]], lambda c: E.cosine(c, other), "array<double>") == [1.0, 0.0]
    assert column([[1.0, 2.0]], lambda c: E.score(c, other, "dot"), "array<double>") == [11.0]


def test_one_decimal_like_python(column):
    given = [0.25, 0.35, 13.45, -13.45, 0.05, 2.675, 99.95, 0.0, 1e6 + 0.05, -7.25, 119.99]
    assert column(given + [None, math.nan], catalog.one_decimal, "double") == [f"{x:.1f}" for x in given] + [
        V.DASH, V.DASH]
    assert column([1e20, -1e20, math.inf, -math.inf], catalog.one_decimal, "double") == [f"{x:.1f}" for x in (1e20, -1e20, math.inf, -math.inf)]


def test_art_response(column):
    big = "https://a/600x600bb.jpg"
    given = [
        '{"results":[{"wrapperType":"track","artworkUrl100":"https://t"},'
        '{"wrapperType":"collection","artworkUrl100":""},'
        '{"wrapperType":"collection","artworkUrl100":"https://a/100x100bb.jpg"}]}',
        '{"results":[]}', "{}", "broken", None,
    ]
    assert column(given, lookup.parse_art_response) == [big, None, None, None, None]


def test_folding_equals_the_character_tables(spark):
    import unicodedata

    given = ["", None, "Björk", "ǺǼ ﬁ ①", "e\u0301\u0327x", "İstanbul", "कि", "a\u20dd", "한글", "Ω\u0345"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, x string").repartition(3)
    got = [r["y"] for r in df.select("i", X.ascii_fold(F.col("x")).alias("y")).orderBy("i").collect()]
    want = ["".join(c for c in unicodedata.normalize("NFKD", v or "") if not unicodedata.combining(c)) for v in given]
    assert [g.lower() for g in got] == [w.lower() for w in want]
