"""Personal data: patterns first, then terms that give away what the patterns found.

E-mail and IP addresses, card and phone numbers are found by pattern.  Each distinct value is a protected
*entity*.  All terms of its documents are weighed by what they disclose: the pointwise mutual information
of entity and term, from the numbers of documents of the whole corpus, over the information of the entity
itself.  1 means that the term names the entity as surely as its own text.  Documents of the same normalised
text count as one.  The share of the entity among the documents of a term is smoothed by ``SMOOTHING``
documents of the usual share, so that rare pairs are weighed with care but none is left out.  Wherever they
stand in the corpus, terms above ``GENERALISE`` are replaced by a word for their kind, those above ``REMOVE``
are taken out.
"""

from pyspark.sql import functions as F

from vectormart.session import written

# Each pattern finds what its plain form finds, leftmost and without overlap, but in linear time: a match can
# only begin where the run of its first characters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"\p{L}{4,}"
SMOOTHING, GENERALISE, REMOVE = 0.2, 0.8, 0.95
COMMON = 1000  # terms of at least one document in so many are common; of those there are at most so many per term of a document


def digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value):
    """Whether the digits pass the check: every second one from the right doubled, 9 taken off above 9."""
    reverse = F.reverse(digits(value))
    number = lambda i: F.substring(reverse, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(number(i) > 4, number(i) * 2 - 9).otherwise(number(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(reverse)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(number(i)))
    return total % 10 == 0


def valid(kind, value):
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def matches(text, pattern):
    """Arrays of struct(start, end, value) of all matches, in code points; from the lengths between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,value:string>>) as out)")
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    return F.aggregate(pairs, empty, step, lambda s: s["out"])


def none():
    return F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")


def base_spans(docs):
    """``docs`` (id, mark, text) with one array of spans per kind.  The regular expressions run once per text."""
    text = F.col("text")
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
            "phone": F.contains(text, F.lit("+"))}
    raw = docs.withColumns({f"raw_{k}": F.when(hint[k], matches(text, p)).otherwise(none()) for k, p in PATTERNS.items()})
    keep = lambda k: F.filter(f"raw_{k}", lambda s: valid(k, s["value"]))
    return raw.withColumns({k: keep(k) for k in PATTERNS}).drop(*[f"raw_{k}" for k in PATTERNS])


def between(text, spans):
    """The text with a space in place of every span."""

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], gap, F.lit(" ")).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(F.array_sort(spans), F.expr("struct(0 as at, '' as out)"), step, rest)


def terms_of(text):
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def located(text, known):
    """struct(start, end, disclosure) of every occurrence of the terms of a map ``known`` from term to disclosure."""
    values, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))

    def step(state, pair):
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        told = F.try_element_at(known, F.lower(pair["value"]))
        item = F.struct(start.alias("start"), end.alias("end"), told.alias("disclosure"))
        # Only a hit copies the list.
        return F.struct(end.alias("at"), F.when(told.isNotNull(), F.concat(state["out"], F.array(item))).otherwise(state["out"]).alias("out"))

    return F.aggregate(pairs, F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,disclosure:double>>) as out)"), step, lambda s: s["out"])


def shared(rows):
    """``rows`` with ``share``: one over the number of rows of the same normalised text, so that copies sum to 1."""
    normal = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    rows = rows.withColumn("normal", F.xxhash64(normal))
    copies = written(rows.groupBy("normal").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    return rows.join(copies, "normal", "left").withColumn("share", F.lit(1.0) / F.coalesce("copies", F.lit(1))).drop("normal", "copies")


def prepared(docs, id, text):
    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def disclosing(rows, base):
    """(term, disclosure): the most that a term discloses of any entity, of those that disclose at least ``GENERALISE``;
    and (term): the common terms that disclose less, a list that does not grow with the corpus."""
    every = rows.agg(F.sum("share").alias("all"), F.count("*").alias("rows"))
    held = base.filter(F.size("entities") > 0).select("share", "inside", F.explode("entities").alias("entity"))
    pairs = held.select("share", "entity", F.explode("inside").alias("term")).groupBy("entity", "term").agg(F.sum("share").alias("both"))
    entities = held.groupBy("entity").agg(F.sum("share").alias("with_entity"))
    terms = rows.select("share", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(
        F.sum("share").alias("with_term"), F.count("*").alias("times"))
    terms = written(terms, "terms")
    weighed = pairs.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(every))
    usual = F.col("with_entity") / F.col("all")
    smoothed = (F.col("both") + SMOOTHING * usual) / (F.col("with_term") + SMOOTHING)
    own = -F.log(usual)
    weighed = weighed.select("term", F.when(own > 0, F.least(F.log(smoothed / usual) / own, F.lit(1.0))).alias("disclosure"))
    strong = written(weighed.filter(F.col("disclosure") >= GENERALISE).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")
    common = terms.crossJoin(F.broadcast(every)).filter(F.col("times") * COMMON >= F.col("rows")).select("term")
    return strong, written(common.join(strong, "term", "left_anti"), "weak")


def looked_up(rows, weak):
    """(id, mark, term): the terms of every row that may be strong.  Most are common and weak; those are dropped where they are."""
    return rows.select("id", "mark", F.explode(terms_of(F.col("text"))).alias("term")).join(F.broadcast(weak), "term", "left_anti")


def found(docs, id="doc_id", text="text"):
    """(id, mark, email, ip, card, phone, term): all spans of every row of ``docs``; terms carry their disclosure."""
    plain = prepared(docs, id, text)
    rows = shared(plain)
    every, words = F.concat(*PATTERNS), F.col("text")
    some = F.size(every) > 0
    base = base_spans(rows).withColumns({
        "entities": F.when(some, F.array_distinct(F.transform(every, lambda s: F.lower(s["value"])))),
        "inside": F.when(some, terms_of(between(words, every)))})
    base = written(base.drop("text"), "spans")
    strong, weak = disclosing(rows, base)
    told = looked_up(plain, weak).join(strong, "term")
    known = told.groupBy("id", "mark").agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("known"))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
    hits = plain.alias("r").join(known.alias("k"), same("r", "k")).select("r.id", "r.mark", located(F.col("r.text"), F.col("k.known")).alias("term"))
    hits = hits.groupBy("id", "mark").agg(F.first("term").alias("term"))
    joined = base.drop("entities", "inside", "share").alias("b").join(hits.alias("t"), same("b", "t"), "left")
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,disclosure:double>>)")
    free = lambda t: ~F.exists(every, lambda o: (t["start"] < o["end"]) & (o["start"] < t["end"]))
    return joined.select("b.*", F.coalesce("t.term", nothing).alias("term")).withColumn("term", F.filter("term", free))


def listed(kinds):
    shown = lambda k: F.transform(F.col(k), lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    return F.array_join(F.flatten(F.array(*[shown(k) for k in kinds])), ",")


def personal_data(docs):
    """The registered query.  Null texts are empty; rows that repeat id and text count as documents of their own,
    but as one in the numbers of documents with an entity; an empty table gives no rows."""
    spans = found(docs)
    base = listed(KINDS[:4])
    return spans.select(
        F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(base, 256).alias("base_sha256"), listed(KINDS).alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitised(docs, id="doc_id", text="text"):
    """(id, mark, clean_text): base spans become <KIND>, strong terms vanish, weaker ones become <WORD>."""
    named = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{k.upper()}>").alias("by")))
    terms = F.transform("term", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= REMOVE, "").otherwise("<WORD>").alias("by")))
    spans = found(docs, id, text).dropDuplicates(["id", "mark"]).select("id", "mark", F.array_sort(F.concat(*[named(k) for k in PATTERNS], terms)).alias("all"))
    rows = prepared(docs, id, text).alias("r").join(spans.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.mark") == F.col("s.mark")))
    rows = rows.select("r.id", "r.mark", "r.text", "s.all")

    def step(state, s):
        # Spans of two kinds may overlap: the later one then only goes on from where the former ended.
        gap = F.substring("text", state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        by = F.when(s["start"] >= state["at"], s["by"]).otherwise("")
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], gap, by).alias("out"))

    start = F.expr("struct(0 as at, '' as out)")
    rest = lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text")))
    return rows.select(F.col("id").alias(id), "mark", F.aggregate("all", start, step, rest).alias("clean_text"))
