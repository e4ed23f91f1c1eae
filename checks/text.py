"""Checks of text expressions and labels."""

from pyspark.sql import functions as F

from checks.base import query, tracks_sql
from checks.matching import OUT_NAME
from checks.sources import CTE_FILES, EXT, PATH, file_list
from vectormart import fixed_values as V
from vectormart.functions import labels as B
from vectormart.functions import text as X
from vectormart.functions.vectors import point_id
from vectormart.operators import lookup as L

WS = V.WHITESPACE_CLASS
COLLAPSED = "trim(regexp_replace(text, '{}+', ' ', 'g'))".format(WS)
# Fixed rule of the check: a suffix per part.
SUFFIX = """concat(p_name, case p_size % 10 when 0 then ' (Disc 1)' when 1 then ' [disc 22]' when 2 then ' (Live at Y)'
  when 3 then ' - EP' when 4 then ' (Deluxe Edition)' when 5 then ' - Remastered' when 6 then ' (Remaster)'
  when 7 then ' & Friends / Vol. 2*' when 8 then ' [Expanded] (disc 3)' else '' end)"""
GUEST = """concat('  ', p_name, case p_size % 6 when 0 then ' feat. Other One' when 1 then ' FEATURING Other'
  when 2 then ' ft. A & B' when 3 then ' feat Someone' when 4 then ' defeat. Other' else ' ' end)"""


@query("collapse_ws", f"select doc_id, md5({COLLAPSED}) as collapsed_md5, length({COLLAPSED}) as n from documents")
def collapse_ws(t):
    c = X.collapse_ws(F.col("text"))
    return t.documents.select("doc_id", F.md5(c).alias("collapsed_md5"), F.length(c).cast("bigint").alias("n"))


CUT = r"regexp_replace({}, '(?i)\s+(feat\.?|featuring|ft\.)\s+.*$', '')".format(GUEST)


@query("strip_feat", f"select p_partkey, {CUT} as cut from part")
def strip_feat(t):
    return t.part.selectExpr("p_partkey", f"{GUEST} as s").select("p_partkey", X.strip_feat(F.col("s")).alias("cut"))


@query("strict_key", f"select p_partkey, lower(trim(regexp_replace({CUT}, '\\s+', ' ', 'g'))) as k from part")
def strict_key(t):
    return t.part.selectExpr("p_partkey", f"{GUEST} as s").select("p_partkey", X.strict_key(F.col("s")).alias("k"))


@query("ascii_fold", "select doc_id, md5(lower(strip_accents(text))) as folded_md5 from documents")
def ascii_fold(t):
    return t.documents.select("doc_id", F.md5(X.ascii_fold(F.col("text"))).alias("folded_md5"))


FOLDED = "replace(replace(lower(strip_accents(text)), '&', ' and '), '+', ' and ')"


@query("lenient_key", f"select doc_id, md5(trim(regexp_replace({FOLDED}, '[^a-z0-9]+', ' ', 'g'))) as k from documents")
def lenient_key(t):
    return t.documents.select("doc_id", F.md5(X.lenient_key(F.col("text"))).alias("k"))


@query("cache_key", f"""select p_partkey, concat(trim(lower({GUEST})), '|', trim(lower(p_type))) as k from part""")
def cache_key(t):
    return t.part.selectExpr("p_partkey", f"{GUEST} as a", "p_type").select(
        "p_partkey", X.cache_key(F.col("a"), F.col("p_type")).alias("k"))


CLEAN = SUFFIX
for cut in (r"\s*[\(\[]disc\s*\d+[\)\]]", r"\s*[\(\[](live|.*?live.*?)[\)\]]$",
            r"\s*-\s*(EP|Single|Remaster(ed)?|Deluxe.*|Expanded.*|Anniversary.*)$",
            r"\s*[\(\[](Remaster(ed)?|Deluxe.*|Expanded.*|Anniversary.*)[\)\]]"):
    CLEAN = f"regexp_replace({CLEAN}, '{cut}', '', 'gi')"


@query("clean_album", f"select p_partkey, trim({CLEAN}) as album from part")
def clean_album(t):
    return t.part.selectExpr("p_partkey", f"{SUFFIX} as s").select(
        "p_partkey", X.clean_album(F.col("s")).alias("album"))


@query("search_term", f"""
select cast(p_partkey as varchar) as k, replace(url_encode(concat(p_brand, ' ', trim({CLEAN}))), '%2F', '/') as term
from part union all select concat('u', page_id), replace(url_encode(concat(url, ' ', 'x')), '%2F', '/') from pages""")
def search_term(t):
    parts = t.part.selectExpr("cast(p_partkey as string) as k", "p_brand as a", f"{SUFFIX} as b")
    urls = t.pages.selectExpr("concat('u', page_id) as k", "url as a", "'x' as b")
    return parts.unionAll(urls).select("k", X.search_term(F.col("a"), F.col("b")).alias("term"))


@query("parse_art_response", """
select p_partkey, case when p_size % 3 = 0 then null when p_size % 3 = 1
  then concat('https://art.example/', p_partkey, '/600x600bb.jpg')
  else concat('https://art.example/b', p_partkey, '/600x600bb.jpg') end as url from part""")
def parse_art_response(t):
    def result(kind, url):
        return F.struct(F.lit(kind).alias("wrapperType"), url.alias("artworkUrl100"))

    key, turn = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    first = F.when(turn == 1, F.concat(F.lit("https://art.example/"), key, F.lit("/100x100bb.jpg"))).otherwise("")
    second = F.when(turn != 0, F.concat(F.lit("https://art.example/b"), key, F.lit("/100x100bb.jpg")))
    body = F.to_json(F.struct(F.array(
        result("track", F.lit("https://art.example/no/100x100bb.jpg")), result("collection", first),
        result("collection", second)).alias("results")))
    return t.part.withColumn("body", body).select("p_partkey", L.parse_art_response(F.col("body")).alias("url"))


@query("cache_status", """
select event_id, case event_type when 'error' then 'retry' when 'view' then 'miss' when 'click' then 'miss'
  else 'hit' end as status from events""")
def cache_status(t):
    kind = F.col("event_type")
    url = F.when(kind == "view", F.lit("")).when(kind != "click", F.concat(F.lit("https://a/"), kind))
    return t.events.select("event_id", L.cache_status(url, kind == "error").alias("status"))


@query("year_of", tracks_sql("""
select file_hash, nullif(string_split(coalesce(date, ''), '-')[1], '') as year,
  coalesce(nullif(string_split(coalesce(date, ''), '-')[1], ''), 'unknown year') as shown from tracks"""))
def year_of(t):
    d = F.col("date")
    return t.tracks.select("file_hash", X.year_of(d).alias("year"), X.year_of(d, V.UNKNOWN_YEAR).alias("shown"))


def bucket_sql(column, buckets):
    cases = " ".join(f"when {column} < {b} then '{n}'" for b, n in buckets if b is not None)
    return f"case {cases} else '{buckets[-1][1]}' end"


LABELS = {
    "tempo_label": ("bpm", V.TEMPO_BUCKETS, B.tempo_label),
    "energy_label": ("loudness_integrated", V.ENERGY_BUCKETS, B.energy_label),
    "groove_label": ("danceability", V.GROOVE_BUCKETS, B.groove_label),
    "dynamics_label": ("loudness_range", V.DYNAMICS_BUCKETS, B.dynamics_label),
}


def register_label(name, column, buckets, label):
    @query(name, tracks_sql(f"select file_hash, {bucket_sql(column, buckets)} as label from tracks"))
    def run(t):
        return t.tracks.select("file_hash", label(F.col(column)).alias("label"))


for name, (column, buckets, label) in LABELS.items():
    register_label(name, column, buckets, label)

PHRASE = """case when key_key is null then '' when key_scale = 'minor'
  then concat(key_key, ' minor, darker and more melancholic')
  else concat(key_key, ' major, brighter and more uplifting') end"""


@query("key_phrase", tracks_sql(f"select file_hash, {PHRASE} as phrase from tracks"))
def key_phrase(t):
    return t.tracks.select("file_hash", B.key_phrase(F.col("key_key"), F.col("key_scale")).alias("phrase"))


DOC = f"""concat(coalesce(title, 'Unknown Title'), ' by ', artist, ', from the album ', album, ' (',
  coalesce(nullif(string_split(coalesce(date, ''), '-')[1], ''), 'unknown year'), '). Genre: ',
  coalesce(genre, 'Unknown Genre'), '. Key: ', {PHRASE}, '. Tempo: ', {bucket_sql("bpm", V.TEMPO_BUCKETS)}, ' at ',
  cast(cast(round_even(bpm, 0) as bigint) as varchar), ' BPM. Energy: ',
  {bucket_sql("loudness_integrated", V.ENERGY_BUCKETS)}, '. Groove: ', {bucket_sql("danceability", V.GROOVE_BUCKETS)},
  '. Dynamics: ', {bucket_sql("loudness_range", V.DYNAMICS_BUCKETS)}, '.')"""


@query("track_document", tracks_sql(f"select file_hash, {DOC} as doc from tracks"))
def track_document(t):
    return t.tracks.select("file_hash", B.track_document().alias("doc"))


@query("point_id", "select doc_id, cast(cast(concat('0x', substr(md5(text), 1, 16)) as ubigint) as varchar) as pid "
                   "from documents")
def point_ids(t):
    return t.documents.select("doc_id", point_id(F.md5("text")).cast("string").alias("pid"))


@query("short_hash", "select page_id, substr(sha1(url), 1, 8) as h from pages")
def short_hash(t):
    return t.pages.select("page_id", X.short_hash(F.col("url")).alias("h"))


@query("output_name", f"select page_id, {OUT_NAME} as output_name from (select page_id, {PATH} as p from pages) x")
def output_name(t):
    return t.pages.selectExpr("page_id", f"{PATH} as p").select("page_id", X.output_name(F.col("p")).alias("output_name"))


@query("file_ext", f"with {CTE_FILES} select path, {EXT} as ext from files")
def file_ext(t):
    return file_list(t).distinct().select("path", X.file_ext(F.col("path")).alias("ext"))


@query("key_label", tracks_sql("select file_hash, concat(coalesce(key_key, ''), '-', key_scale) as label from tracks"))
def key_label(t):
    return t.tracks.select("file_hash", X.key_label(F.col("key_key"), F.col("key_scale")).alias("label"))


