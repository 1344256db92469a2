"""Personal data: exact patterns, then information-theoretic sanitisation of the terms that give it away.

Every value that a pattern finds is a protected entity. The words around its mentions co-occur with it; in how many
documents they do, against how many documents of the whole corpus hold them, estimates the pointwise mutual information
of term and entity. In documents with personal data, a term that carries nearly all of an entity's information content is
removed; one that carries much of it is generalised to the class of words with its first letters, the smallest that no
longer tells. Documents without any stay as they are, unless terms are asked for everywhere: a text that names no value may
still give one away. Everything here is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, near, packed, saved

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")
# The patterns of the contract, in forms that take time in proportion to the text: a match begins where a run of its
# first class begins or the last match ends, and runs are possessive where nothing could be given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WINDOW = 80  # characters on either side of a mention that are its context
SUPPORT = 2  # least number of documents in which a term must be seen with an entity; evidence must repeat
REMOVE, GENERALISE = 0.9, 0.75  # shares of an entity's information content
PREFIXES = (4, 3, 2, 1)  # letters of the classes that terms are generalised to
BROADCAST_ROWS = 500_000
_WORD = r"\p{L}{3,}+"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the check."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        d = F.substring(padded, i, 1).cast("int")
        total = total + (d if i % 2 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: F.length(F.regexp_replace(v, "[ -]", "")).between(16, 19) & luhn(F.regexp_replace(v, "[ -]", "")),
    "phone": lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15),
}


def found(text: Column, pattern: Column, holds: Column, valid=None) -> Column:
    """Leftmost matches that do not overlap and are valid: code points of start and end (exclusive), value, and what
    stands around.

    Starts are sums of the lengths of matches and of the pieces between them. The sums run once over the matches and
    gather text, which is cheap to extend, so that a text of very many matches takes time nearly in proportion."""
    start = lambda acc, x: acc["at"] + F.length(x["1"])
    end = lambda acc, x: start(acc, x) + F.length(x["0"])
    ok = (lambda x: F.lit(True)) if valid is None else (lambda x: valid(x["0"]))
    listed = F.aggregate(
        F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["0"].isNull(), acc).otherwise(F.struct(
            end(acc, x).alias("at"), F.when(ok(x), F.concat(acc["out"], start(acc, x).cast("string"), F.lit(":"), end(acc, x).cast("string"), F.lit(","))).otherwise(acc["out"]).alias("out"))),
    )["out"]
    places = F.filter(F.split(F.when(holds, listed).otherwise(""), ","), lambda p: p != "")
    places = F.transform(places, lambda p: F.struct(F.substring_index(p, ":", 1).cast("long").alias("start"), F.substring_index(p, ":", -1).cast("long").alias("end")))
    cut = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    return F.transform(places, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), cut(p["start"], p["end"]).alias("value"),
        cut(F.greatest(p["start"] - WINDOW, F.lit(0)), p["start"]).alias("before"), cut(p["end"], p["end"] + WINDOW).alias("after")))


def _base(docs: DataFrame) -> DataFrame:
    """Adds one array a kind to rows with a text."""
    holds = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains("text", F.lit("+"))}
    for kind in KINDS:
        docs = docs.withColumn(kind, found(F.col("text"), F.lit(PATTERNS[kind]), holds[kind], _VALID[kind]))
    return docs


def _spans(kind: str, array: Column, mark=None) -> Column:
    """Spans of a kind, and what takes their place: by default the kind in brackets."""
    mark = mark or (lambda x: F.lit(f"[{kind.upper()}]"))
    return F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), mark(x).alias("mark")))


def _mentions(base: DataFrame) -> DataFrame:
    """(rid, entity, terms): the words around all mentions of an entity in a document, each once."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.concat(F.lit(kind + ":"), F.lower(x["value"])).alias("entity"), x["before"].alias("before"), x["after"].alias("after")))

    each = base.select("rid", F.explode(F.concat(*map(of, KINDS))).alias("x")).select("rid", "x.*")
    # a word that the window cuts is none
    before = F.when(F.length("before") == WINDOW, F.regexp_replace("before", r"^\p{L}+", "")).otherwise(F.col("before"))
    after = F.when(F.length("after") == WINDOW, F.regexp_replace("after", r"\p{L}+$", "")).otherwise(F.col("after"))
    return each.select("rid", "entity", F.regexp_extract_all(F.lower(F.concat(before, F.lit(" "), after)), F.lit(_WORD), F.lit(0)).alias("terms"))


def _held(docs: DataFrame, asked: DataFrame, of: Column, name: str) -> DataFrame:
    """(name, documents): how many documents hold each of the `asked` words, or classes of words. Words that are not
    asked for are dropped before anything is counted."""
    each = docs.select(F.explode(F.array_distinct(of)).alias(name))
    return each.join(near(asked, BROADCAST_ROWS), name).groupBy(name).agg(F.count("*").alias("documents"))


def _share(together: Column, entity: Column, term: Column, n: int) -> Column:
    """The share of an entity's information content, log(n / entity), that a term carries, given the documents that hold
    both, either, and all."""
    return F.log(together * F.lit(float(n)) / (entity * term)) / F.log(F.lit(float(n)) / entity)


def _disclosing(docs: DataFrame, base: DataFrame, everywhere: bool) -> DataFrame | None:
    """(rid, removed, generalised): the disclosing terms of each document with personal data, or of each `everywhere`,
    the latter with their classes; None if no term discloses.

    A pair counts if its documents are more than chance explains among all pairs tested: documents together times mutual
    information, the logarithm of how much likelier they are than by chance, is at least the logarithm of the pairs."""
    n = base.count()
    mentions = saved(_mentions(base))
    entities = saved(mentions.groupBy("entity").agg(F.count_distinct("rid").alias("mentioned"), F.count("*").alias("held")).where((F.col("mentioned") >= SUPPORT) & (F.col("mentioned") < n)))
    seen = join_hot(mentions, entities.select("entity", "held"), ["entity"], "held", n)
    pairs = seen.select("rid", "entity", F.explode(F.array_distinct("terms")).alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("together"))
    pairs = saved(pairs)
    tested = pairs.count()
    pairs = pairs.where(F.col("together") >= SUPPORT).join(entities, "entity")
    asked = saved(pairs.select("term").distinct())
    if asked.isEmpty():
        return None
    texts = docs.select(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("words"))
    pairs = pairs.join(_held(texts, asked, F.col("words"), "term"), "term")
    mutual = F.log(F.col("together") * F.lit(float(n)) / (F.col("mentioned") * F.col("documents")))
    pairs = pairs.withColumn("share", _share(F.col("together"), F.col("mentioned"), F.col("documents"), n))
    telling = saved(pairs.where((F.col("share") >= GENERALISE) & (F.col("together") * mutual >= math.log(max(tested, 1)))))
    if telling.isEmpty():
        return None
    # the smallest class of words that carries less than a telling share; terms without one are removed
    some = telling.where(F.col("share") < REMOVE)
    classes = F.explode(F.array_distinct(F.array(*[F.substring("term", 1, k) for k in PREFIXES]))).alias("class")
    listed = saved(some.select(classes).distinct())
    first = lambda k: F.transform("words", lambda w: F.substring(w, 1, k))
    prefixed = F.flatten(F.array(*map(first, PREFIXES)))
    found = _held(texts, listed, prefixed, "class") if not listed.isEmpty() else listed.withColumn("documents", F.lit(0).cast("long"))
    wide = some.drop("documents").select("entity", "term", "together", "mentioned", classes).join(found, "class")
    wide = wide.where(_share(F.col("together"), F.col("mentioned"), F.greatest("documents", "together"), n) < GENERALISE)
    wide = wide.groupBy("entity", "term").agg(F.max_by("class", F.length("class")).alias("class"))
    telling = telling.select("entity", "term", "mentioned").join(wide, ["entity", "term"], "left")
    # a term that is removed for one entity is not generalised for another
    told = telling.groupBy("term").agg(F.max(F.col("class").isNull()).alias("gone"), F.min_by("class", F.length("class")).alias("class"))
    words = docs.select("rid", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("words")) if everywhere else base.where("words is not null")
    per_doc = words.select("rid", F.explode("words").alias("term")).join(near(saved(told), BROADCAST_ROWS), "term")
    entry = F.struct("term", "class")
    return saved(per_doc.groupBy("rid").agg(F.collect_list(F.when(F.col("gone"), entry)).alias("removed"), F.collect_list(F.when(~F.col("gone"), entry)).alias("generalised")))


def _terms(docs: DataFrame, base: DataFrame, everywhere: bool) -> DataFrame | None:
    """(rid, terms): spans of disclosing terms that lie in no base span, with what takes their place. `everywhere`, they
    are of all documents; else of those with base spans only."""
    telling = _disclosing(docs, base, everywhere)
    if telling is None:
        return None
    told = base.select("rid", "base", "text").join(near(telling, BROADCAST_ROWS), "rid")
    rows = told.where("size(base) > 0")
    if everywhere:  # the texts of documents without base spans are read again
        others = saved(told.where("size(base) = 0").drop("text"))
        rows = rows.unionByName(docs.select("rid", "text").join(near(others, BROADCAST_ROWS), "rid"))
    clear = lambda x: ~F.coalesce(F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), F.lit(False))
    spans = []
    for kind in TERM_KINDS:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(F.transform(kind, lambda x: x["term"])), "|"), F.lit(r")(?!\p{L})"))
        class_of = F.map_from_entries(kind)
        mark = (lambda x: F.lit("")) if kind == "removed" else (lambda x, m=class_of: F.concat(F.lit("["), F.coalesce(F.element_at(m, F.lower(x["value"])), F.lit("")), F.lit("*]")))
        spans.append(F.filter(_spans(kind, found(F.col("text"), pattern, F.size(kind) > 0), mark), clear))
    return rows.select("rid", F.concat(*spans).alias("terms"))


def _all_spans(docs: DataFrame, everywhere: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of rows (rid, id, text): the base spans, saved, and the method's, if any."""
    base = _base(docs.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("base", F.concat(*[_spans(k, F.col(k)) for k in KINDS]))
    # documents with personal data keep their texts and words at hand, so that no text is shuffled for them
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    has = F.size("base") > 0
    base = saved(base.select("rid", "id", *KINDS, "base", F.when(has, F.col("text")).alias("text"), F.when(has, words).alias("words")))
    return base, _terms(docs, base, everywhere)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", everywhere: bool = False) -> DataFrame:
    """One row per row of `docs`: id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans, listed as
    kind:start:end), spans (the same list followed by the method's: removed, then generalised terms), n_terms.

    Null texts are empty and have no spans. Repeated rows are each reported and each counted as a document. Terms are
    marked, wherever they stand, in documents that hold personal data, and in no others unless `everywhere` asks for
    those that a value does not stand in but its terms give away. Texts of any length are searched whole. Base spans of different kinds may overlap and all stay; a term inside one is not listed.
    Other columns are ignored; an empty table gives none. `docs` is to come from files, whose rows keep their order
    when read again.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base, terms = _all_spans(rows, everywhere)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,mark:string>>")
    out = base.withColumn("terms", empty) if terms is None else base.join(terms, "rid", "left").withColumn("terms", F.coalesce("terms", empty))
    return out.select(
        F.col("id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, text_col: str = "text", everywhere: bool = False) -> DataFrame:
    """`docs` with personal data replaced by its kind in brackets, disclosing terms removed or replaced by their class, as
    in [riv*]; an n_chars column is set to the new length. Where spans overlap the one that begins first counts, of these the longest.
    All columns and rows stay, other texts unchanged; see `find` for the cases."""
    rows = packed(docs)
    text = F.col("row")[text_col]
    base, terms = _all_spans(rows.select("rid", F.lit(None).cast("string").alias("id"), text.alias("text")), everywhere)
    spans = base.select("rid", F.col("base").alias("spans"))
    if terms is not None:
        spans = base.join(terms, "rid", "left").select("rid", F.concat("base", F.coalesce("terms", F.slice("base", 1, 0))).alias("spans"))
    spans = saved(spans.where("size(spans) > 0"))
    rows = rows.join(near(spans, BROADCAST_ROWS), "rid", "left")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"), x["mark"].alias("mark"))))
    part = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    joined = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct((-x["end"]).alias("at"), F.concat(acc["out"], part(acc["at"], x["start"]), x["mark"]).alias("out"))),
        lambda acc: F.concat(acc["out"], part(acc["at"], F.length(text).cast("long"))),
    )
    rows = rows.withColumn("clean", F.when(F.col("spans").isNotNull(), joined).otherwise(text))
    own = lambda c: F.col("row")[c]
    length = lambda c: F.when(F.col("spans").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(own(c))
    return rows.select(*[(F.col("clean") if c == text_col else length(c) if c == "n_chars" else own(c)).alias(c) for c in docs.columns])
