"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

*Protected entities* are e-mail addresses, IP addresses, card numbers and phone numbers, found by patterns over whole
texts and checked by value. Other *terms* can give an entity away: corpus co-occurrence measures how much.

1. Each entity's context is up to :data:`REACH` characters on either side, up to the next candidate of its kind, and
   of these the nearest :data:`TERMS` words of three characters or more.
2. Over all documents, ``n(e)`` have the entity, ``n(t)`` the term, ``n(e, t)`` the term in the entity's context.
   Pointwise mutual information ``log(n(e, t) N / (n(e) n(t)))`` is what the term tells about the entity, and the
   information content ``log(N / n(e))`` is all there is to tell; their quotient is the *disclosure*, 1 if the term
   never occurs without the entity beside it.
3. In the contexts of an entity, a term whose disclosure reaches :data:`REMOVE` is removed and one that reaches
   :data:`GENERALISE` is generalised to its word class, provided that :data:`SUPPORT` different texts hold the pair:
   copies of one text are no evidence. Entities themselves become placeholders of their kind.

Places come without loops over characters: a pattern's gaps (``split``) and its matches (``regexp_extract_all``) alternate,
so places are running sums of lengths, taken in blocks so that cost stays linear. The patterns are written so that
they neither back-track over long runs nor recurse; they find the same matches as the plain forms (see ``PATTERNS``).

Contexts are bounded per entity occurrence and each document sends a pair once, so pairs grow with the text, not with
its square; pair, entity and term counts combine before they are shuffled, and a hot entity or term is one
row a task. Terms are counted in the corpus only if their count beside entities leaves room for the threshold. Tables of flagged pairs are
broadcast only behind a size check.

Defined results: a null text is empty; rows sharing an id are documents of their own (equal ones get equal
results); an entity in every document has nothing left to tell, disclosure 0; terms that touch an entity's span stay
with it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.binding import bind
from pageloom.llm.substrings import small
from pageloom.plans.session import materialise, materialise_counted

KINDS = ("email", "ip", "card", "phone")
#: Plain forms: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]``. A run of characters is tried from its start (or from the
#: end of the match before) only, as a later start meets the same end; what need not be given back is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]++"
GAP = r"[^\p{L}\p{N}]++"
REACH, TERMS, LEAST = 120, 8, 3
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 3
BLOCK = 64

_PLACE = "array<struct<start:int,stop:int,value:string,left:string,right:string>>"
_NULL_ID = -(1 << 63)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, stop, value, left, right>>``: matches in order, with code point places and the text between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_PLACE)
    some = bind(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), lambda x: _placed(x["gaps"], x["found"]))
    return F.when(text.rlike(pattern), some).otherwise(none)


def _placed(gaps: Column, found: Column) -> Column:
    count = F.size(found)

    def indices(block: Column) -> Column:
        return F.sequence(block * BLOCK, F.least(block * BLOCK + BLOCK, count) - 1)

    def length(i: Column) -> Column:
        return F.length(F.get(gaps, i)) + F.length(F.get(found, i))

    def place(at: Column, i: Column) -> Column:
        start = at + F.length(F.get(gaps, i))
        return F.struct(
            start.alias("start"),
            (start + F.length(F.get(found, i))).alias("stop"),
            F.get(found, i).alias("value"),
            F.get(gaps, i).alias("left"),
            F.get(gaps, i + 1).alias("right"),
        )

    def step(out: Column, i: Column) -> Column:
        made = F.array_append(out["out"], place(out["at"], i))
        return F.struct((out["at"] + length(i)).alias("at"), made.alias("out"))

    def start_of(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(_PLACE).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
    sizes = F.transform(blocks, lambda b: F.aggregate(indices(b), F.lit(0), lambda a, i: a + length(i)))
    starts = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
    )["out"]
    filled = F.transform(starts, lambda at, b: F.aggregate(indices(b), start_of(at), step)["out"])
    return F.flatten(filled)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the check sum."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_part(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(digits) <= 3, F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


def _holds(kind: str, value: Column) -> Column:
    """Whether a match is an entity of its kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _name(kind: str, value: Column) -> Column:
    """An entity under one name however it is written."""
    plain = F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value)
    return F.concat(F.lit(f"{kind}:"), plain)


def _context(entity: Column, place: Column) -> Column:
    """Terms on both sides of an entity: ``array<struct<entity, term, start, stop>>``."""

    def terms(text: Column, at: Column) -> Column:
        words = F.filter(matches(text, WORD), lambda w: F.length(w["value"]) >= LEAST)
        return F.transform(
            words,
            lambda w: F.struct(
                entity.alias("entity"), F.lower(w["value"]).alias("term"), (at + w["start"]).alias("start"), (at + w["stop"]).alias("stop")
            ),
        )

    def near(side: Column, cut: str) -> Column:
        # a word cut by the reach is none
        part = F.substring(side, -REACH, REACH) if cut.startswith("^") else F.substring(side, 1, REACH)
        return F.when(F.length(side) > REACH, F.regexp_replace(part, cut, "")).otherwise(side)

    before = bind(near(place["left"], r"^[\p{L}\p{N}]+"), lambda x: terms(x, place["start"] - F.length(x)))
    after = bind(near(place["right"], r"[\p{L}\p{N}]+$"), lambda x: terms(x, place["stop"]))
    last = bind(before, lambda x: F.slice(x, F.greatest(F.size(x) - TERMS + 1, F.lit(1)), F.lit(TERMS)))
    return F.concat(last, F.slice(after, 1, TERMS))


def find_entities(text: Column) -> Column:
    """``array<struct<kind, start, stop, name, near>>`` of all entities, by kind, then place."""

    def of(kind: str) -> Column:
        real = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        return F.transform(
            real,
            lambda m: F.struct(
                F.lit(kind).alias("kind"),
                m["start"].alias("start"),
                m["stop"].alias("stop"),
                _name(kind, m["value"]).alias("name"),
                _context(_name(kind, m["value"]), m).alias("near"),
            ),
        )

    return F.concat(*(of(kind) for kind in KINDS))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, spans, near)`` of every row, stored: entity spans and the terms of their contexts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), find_entities(text).alias("e"))
    spans = F.transform("e", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["stop"].alias("stop"), e["name"].alias("name")))
    return materialise(rows.select("id", "digest", spans.alias("spans"), F.flatten("e.near").alias("near")))


def disclosures(
    found: DataFrame, docs: DataFrame, least: float = GENERALISE, support: int = SUPPORT, text_col: str = "text"
) -> DataFrame:
    """``(entity, term, disclosure)`` of the pairs that ``support`` different texts hold, from ``least`` on.

    ``found`` is what :func:`entities` made of ``docs``.
    """
    pair = F.explode(F.array_distinct(F.transform("near", lambda n: F.struct(n["entity"].alias("entity"), n["term"].alias("term")))))
    each = found.select("digest", pair.alias("p")).groupBy("p.entity", "p.term", "digest").agg(F.count("*").alias("n"))
    pairs = each.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    pairs = pairs.filter(F.col("texts") >= support).select("entity", "term", "both")
    holders = found.select(F.explode(F.array_distinct("spans.name")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    beside = found.select(F.explode(F.array_distinct("near.term")).alias("term")).groupBy("term").agg(F.count("*").alias("n_beside"))
    total = found.count()

    def share(n_term: str) -> Column:
        told = F.log(F.col("both") * F.lit(float(total)) / (F.col("n_entity").cast("double") * F.col(n_term)))
        whole = F.log(F.lit(float(total)) / F.col("n_entity"))
        return F.when(F.col("n_entity") < total, told / whole).otherwise(0.0)

    # a term is in at least as many documents as have it beside any entity, so this bounds its disclosure from above
    pairs = materialise(pairs.join(holders, "entity").join(beside, "term").filter(share("n_beside") >= least))
    words = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), GAP)
    words = F.array_distinct(F.transform(F.array_distinct(words), lambda w: F.lower(w)))
    candidates, n = materialise_counted(pairs.select("term").distinct())
    if not n:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    held = docs.select(F.explode(words).alias("term")).join(small(candidates), "term", "left_semi")
    seen = small(materialise(held.groupBy("term").agg(F.count("*").alias("n_term"))))
    return pairs.join(seen, "term").select("entity", "term", share("n_term").alias("disclosure")).filter(F.col("disclosure") >= least)


def personal_spans(
    docs: DataFrame,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    support: int = SUPPORT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(<id_col>, digest, spans)`` of every row: entities by kind and place, then ``generalised`` and ``removed`` terms.

    ``digest`` is the 64-bit hash of the text (null as empty); ``spans`` is ``array<struct<kind, start, stop>>``.
    """
    found = entities(docs, id_col, text_col)
    flagged = small(materialise(disclosures(found, docs, generalise, support, text_col)))
    mention = found.select(F.coalesce("id", F.lit(_NULL_ID)).alias("key"), "digest", F.explode("near").alias("m"))
    mention = mention.select("key", "digest", "m.*").join(flagged, ["entity", "term"])
    worst = mention.groupBy("key", "digest", "start", "stop").agg(F.max("disclosure").alias("disclosure"))
    kind = F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")
    more = worst.groupBy("key", "digest").agg(
        F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "start", "stop"))).alias("more")
    )
    base = found.select("id", F.coalesce("id", F.lit(_NULL_ID)).alias("key"), "digest", _spans("spans").alias("base"))
    both = base.join(small(materialise(more)), ["key", "digest"], "left")
    apart = F.filter(
        "more", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    )
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", apart))
    return both.select(F.col("id").alias(id_col), "digest", spans.alias("spans"))


def _spans(column: str) -> Column:
    return F.transform(column, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def spans_of_kind(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*KINDS))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities as ``<kind>``, generalised terms as their word class, and removed terms gone.

    Spans that overlap become the placeholder of the first. A text is cut once per span.
    """

    def label(s: Column) -> Column:
        word = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        general = F.when(word.rlike(r"^\p{N}+$"), "<number>").when(word.rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")
        return (
            F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", general)
            .otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        )

    def step(a: Column, s: Column) -> Column:
        inside = s["start"] < a["at"]
        more = F.array_append(
            F.array_append(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"])), label(s)
        )
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(inside, a["out"]).otherwise(more).alias("out"))

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = F.aggregate(by_place, start, step)
    return bind(end, lambda e: F.concat(F.array_join(e["out"], ""), F.substring(text, e["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``text_col`` sanitised and all else as it was; a null text stays null."""
    spans = personal_spans(docs, id_col=id_col, text_col=text_col, **options).filter(F.size("spans") > 0)
    spans = spans.select(F.coalesce(id_col, F.lit(_NULL_ID)).alias("_key"), F.col("digest").alias("_digest"), F.col("spans").alias("_spans"))
    side = small(materialise(spans.dropDuplicates(["_key", "_digest"])))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"_key": F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), "_digest": F.xxhash64(text)})
    joined = keyed.join(side, ["_key", "_digest"], "left")
    changed = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(sanitised(text, F.col("_spans")))
    return joined.withColumn(text_col, changed).select(*docs.columns)
