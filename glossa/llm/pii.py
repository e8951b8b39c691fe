"""Personal data: spans by pattern, and terms that give a protected value away.

A protected entity is the value of a pattern span.  The terms of the texts that hold it co-occur with it.
How much a term t reveals of an entity c is the pointwise mutual information of the two as a share
of the information of the entity, log(p(c,t) / p(c)p(t)) / -log p(c), from document frequencies over
the whole corpus.  Terms above a first threshold are generalised, above a second removed, wherever
they stand in a text that holds the entity.  A pair needs several texts with different terms, so
copies of one text prove nothing.  DataFrame functions only.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, joined, let, materialise, sized, text_key, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Possessive forms of the contract's patterns: linear, and without recursion on long runs.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators, if it has 13 to 19 of them
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@dataclass(frozen=True)
class Disclosure:
    """Thresholds on the share of an entity's information that a term may reveal."""

    generalise: float = 0.8
    remove: float = 0.95
    #: Texts with different terms in which a term must stand with an entity.
    support: int = 3


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?$"))
    if kind == "card":
        return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of one kind, null or empty if there are none."""
    guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
    found = F.transform(F.filter(find_spans(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"])), lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))
    return found if guard is None else F.when(guard, found)


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\P{L}+")), lambda w: F.char_length(w) >= 3)


def _beside(text: Column) -> Column:
    """The terms of a text in order, without words that look like data themselves."""
    return F.array_sort(_terms(F.regexp_replace(text, r"\S*[@0-9]\S*", " ")))


def disclosing_terms(spans: DataFrame, docs: DataFrame, limits: Disclosure) -> DataFrame:
    """(entity, term, share) above the first threshold; ``spans`` has h, entity and copies, ``docs`` text."""
    held = materialise(spans.groupBy("entity", "h").agg(F.max("copies").alias("copies")))
    # Only entities of several texts can have enough of them with different terms.
    entities = materialise(held.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("texts")).where(F.col("texts") >= limits.support).drop("texts"))
    if entities.isEmpty():
        return entities.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("share"))
    n_docs = docs.count()
    held = materialise(held.join(sized(entities.select("entity")), "entity", "left_semi"))
    of_texts = sized(materialise(held.select(F.col("h").alias("text_h")).distinct()))
    texts = materialise(docs.select(text_key().alias("h"), text_or_empty().alias("text")).join(of_texts, F.col("h") == F.col("text_h"), "left_semi")
                        .select("h", _beside(F.col("text")).alias("terms")).dropDuplicates(["h"]))
    around = held.join(texts, "h").groupBy("entity", F.sha2(F.array_join("terms", " "), 256).alias("around")).agg(F.sum("copies").alias("copies"), F.first("terms").alias("terms"))
    pairs = (around.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("with_both"), F.count("*").alias("support"))
             .where(F.col("support") >= limits.support))
    # A term is in at least as many documents as it has with entities, so common words fall out before the corpus is counted.
    copies = held.groupBy("h").agg(F.max("copies").alias("copies"))
    at_least = copies.join(texts, "h").select("copies", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("copies").alias("at_least"))
    share = lambda with_term: F.log2(F.col("with_both") * F.lit(n_docs) / (F.col("with_entity") * F.col(with_term))) / F.log2(F.lit(n_docs) / F.col("with_entity"))
    hopeful = materialise(pairs.join(entities, "entity").join(at_least, "term")
                          .where(F.col("with_entity") < n_docs).where(share("at_least") >= limits.generalise))
    wanted = sized(materialise(hopeful.select("term").distinct()))
    df = docs.select(F.explode(_terms(text_or_empty())).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    return hopeful.join(df, "term").select("entity", "term", share("with_term").alias("share")).where(F.col("share") >= limits.generalise)


def scan(docs: DataFrame, limits: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, email, ip, card, phone, term), a row for each row of ``docs``.

    The first four are array<struct<kind, start, end>> by start, ``term`` adds ``share``.  Positions
    are code points, the end exclusive.  A null text is empty and has no spans; repeated rows and
    null ids stay; an empty table gives an empty result; further columns are ignored.  Base spans
    never go; a term span that meets one is left out.
    """
    limits = limits or Disclosure()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = text_or_empty()
    base = materialise(docs.select("doc_id", text_key().alias("h"), *(F.coalesce(base_spans(text, k), F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")).alias(k) for k in KINDS)))
    listed = (base.select("h", F.explode(F.concat(*KINDS)).alias("s")).groupBy("h", F.concat_ws(" ", "s.kind", "s.value").alias("entity"), F.col("s.start").alias("start"))
              .agg(F.count("*").alias("copies")).drop("start"))
    spans = materialise(listed)
    told = materialise(disclosing_terms(spans, docs, limits))
    bare = base.select("doc_id", "h", *(F.transform(k, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,share:double>>")
    if told.isEmpty():
        return bare.select("doc_id", *KINDS, none.alias("term"))
    hold = spans.select("entity", "h").distinct().join(sized(told), "entity")
    texts = materialise(hold.groupBy("h", "term").agg(F.max("share").alias("share")).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
                        .select(F.col("h").alias("told_h"), "shares"))
    few = sized(texts)
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("shares"), "|"), F.lit(r")(?!\p{L})"))
    met = docs.select(text_key().alias("h"), text.alias("text")).join(few, F.col("h") == F.col("told_h")).dropDuplicates(["h"])
    extra = met.select(F.col("h").alias("extra_h"), F.transform(find_spans(F.col("text"), pattern), lambda s: F.struct(
        F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.coalesce(F.element_at("shares", F.lower(s["value"])), F.lit(limits.generalise)).alias("share"))).alias("found"))
    extra = sized(materialise(extra))
    clear = F.filter("found", lambda t: ~F.exists(F.concat(*KINDS), lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return bare.join(extra, F.col("h") == F.col("extra_h"), "left").select("doc_id", *KINDS, F.coalesce(clear, none).alias("term"))


def digest(spans: DataFrame) -> DataFrame:
    plain = lambda k: F.transform(k, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.concat(*KINDS)), 256).alias("base_sha256"), joined(F.concat(*KINDS, plain("term"))).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span of an array<struct<start, end, label>>, sorted by start, replaced by its label."""
    began = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
        s["end"].alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s["label"])).otherwise(F.lit(""))).alias("out")))
    return F.aggregate(spans, began, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))


def sanitise(docs: DataFrame, limits: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), a row for each row of ``docs``: base spans generalised to their kind, terms to ``<TERM>`` or removed.

    A null text comes back as an empty one; null and repeated ids stay.
    """
    limits = limits or Disclosure()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    label = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("label"))
    terms = F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= limits.remove, F.lit("")).otherwise(F.lit("<TERM>")).alias("label")))
    marks = F.array_sort(F.concat(*(F.transform(k, label) for k in KINDS), terms)).alias("marks")
    spans = scan(rows.select(text_key().alias("doc_id"), "text"), limits).select(F.col("doc_id").alias("of_text"), marks).where(F.size("marks") > 0).dropDuplicates(["of_text"])
    marked = rows.join(sized(materialise(spans)), text_key() == F.col("of_text"), "left")
    return marked.select("doc_id", F.when(F.col("marks").isNull(), F.col("text")).otherwise(let(F.col("marks"), lambda m: redact(F.col("text"), m))).alias("text"))
