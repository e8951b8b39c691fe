"""Event enrichment: participants, causal and reporting links, clauses, factuality, support."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.prims import nearest, top1

# Names of non-core arguments.
ARGUMENT_TYPES = {"ARGM-TMP": "Temporal", "ARGM-LOC": "Locative", "ARGM-CAU": "Cause", "ARGM-NEG": "Negation", "ARGM-MNR": "Manner", "ARGM-DIR": "Directional", "ARGM-EXT": "Extent", "ARGM-PRP": "Purpose", "ARGM-ADV": "Adverbial", "ARGM-MOD": "Modal", "ARGM-DIS": "Discourse", "ARGM-GOL": "Goal", "ARGM-COM": "Comitative", "ARGM-PRD": "Predicative", "ARGM-REC": "Reciprocal", "ARGM-PNC": "PurposeNotCause"}


def frame_events(frames: DataFrame, arguments: DataFrame, events: DataFrame) -> DataFrame:
    """EV-FRAME: events whose token is the head of a frame, or of one of its arguments."""
    heads = frames.select("doc_id", F.col("id").alias("frame_id"), F.col("head_tok").alias("start_tok"), F.lit("frame").alias("via"))
    args = arguments.select("doc_id", "frame_id", F.col("head_tok").alias("start_tok"), F.lit("argument").alias("via"))
    e = events.select("doc_id", "start_tok", F.col("id").alias("event_id"))
    return heads.unionByName(args).join(e, ["doc_id", "start_tok"]).groupBy("doc_id", "frame_id", "event_id").agg(F.max("via").alias("via"))


def core_participants(arguments: DataFrame, frames: DataFrame, events: DataFrame, roles: Sequence[str], at_most: int = 5) -> DataFrame:
    """EV-PART-CORE / -NONCORE: arguments of some roles at the event nearest to their frame."""
    a = arguments.where(F.col("role").isin(*roles)).select("doc_id", F.col("id").alias("argument_id"), "role", "frame_id")
    placed = a.join(frames.select(F.col("id").alias("frame_id"), F.col("head_tok").alias("frame_tok")), "frame_id")
    e = events.select("doc_id", F.col("id").alias("event_id"), F.col("start_tok").alias("event_tok"))
    return nearest(placed, e, ["doc_id"], ["argument_id", "frame_id"], "frame_tok", "event_tok", at_most, F.col("event_tok")).select("doc_id", "argument_id", "role", "event_id", "distance")


def causal_links(arguments: DataFrame, frames: DataFrame, events: DataFrame) -> DataFrame:
    """EV-CLINK-ARG: from the event in a causal argument to the event of its frame."""
    cause = arguments.where("role = 'ARGM-CAU'").select("doc_id", "frame_id", F.col("head_tok").alias("start_tok"))
    inner = cause.join(events.select("doc_id", "start_tok", F.col("id").alias("cause_id")), ["doc_id", "start_tok"])
    outer = frames.join(events.select("doc_id", F.col("start_tok").alias("head_tok"), F.col("id").alias("effect_id")), ["doc_id", "head_tok"]).select(F.col("id").alias("frame_id"), "effect_id")
    return inner.join(outer, "frame_id").where("cause_id <> effect_id").select("doc_id", "cause_id", "effect_id").distinct()


def reported(events: DataFrame, verbs: Column, at_most: int = 10) -> DataFrame:
    """EV-SLINK-*: from a reporting event to the nearest later event of its sentence."""
    w = Window.partitionBy("doc_id", "sent_idx").orderBy("start_tok")
    nxt = events.select("doc_id", "sent_idx", "id", "start_tok", verbs.alias("reports"), F.lead("id").over(w).alias("sub_id"), F.lead("start_tok").over(w).alias("sub_tok"))
    return nxt.where(F.col("reports") & (F.col("sub_tok") - F.col("start_tok") <= at_most)).select("doc_id", F.col("id").alias("event_id"), "sub_id", (F.col("sub_tok") - F.col("start_tok")).alias("distance"))


def factuality(events: DataFrame, reported_ids: DataFrame) -> DataFrame:
    """EV-FACTUALITY: NEGATED before REPORTED before HYPOTHETICAL before ASSERTED."""
    r = reported_ids.select(F.col("sub_id").alias("id")).distinct().withColumn("is_reported", F.lit(True))
    value = F.when(F.col("polarity") == "NEG", "NEGATED").when(F.col("is_reported"), "REPORTED").when(F.coalesce("tense", F.lit("NONE")).isin("FUTURE", "INFINITIVE"), "HYPOTHETICAL").otherwise("ASSERTED")
    return events.join(r, "id", "left").select("doc_id", "id", value.alias("factuality"))


def defaults(events: DataFrame) -> DataFrame:
    """EV-DEFAULTS, EV-TIME: null tense and aspect become NONE, an infinitive is in the future."""
    t, a = F.coalesce("tense", F.lit("NONE")), F.coalesce("aspect", F.lit("NONE"))
    time = F.when(t.isin("FUTURE", "INFINITIVE"), "FUTURE").when(t == "NONE", "NON_FUTURE_OR_NONE").otherwise("NON_FUTURE")
    return events.select("doc_id", "id", t.alias("tense"), a.alias("aspect"), time.alias("time"))


def low_support(events: DataFrame, supports: dict[str, DataFrame], at_least: int = 1) -> DataFrame:
    """EV-SUPPORT, EV-LOWCONF: how many sources support each event; few mark it as low in confidence.

    Every entry of ``supports`` has event_id.
    """
    every = None
    for name, df in supports.items():
        one = df.select(F.col("event_id").alias("id"), F.lit(name).alias("source")).distinct()
        every = one if every is None else every.unionByName(one)
    n = every.groupBy("id").agg(F.count("*").alias("sources"))
    return events.join(n, "id", "left").select("doc_id", "id", F.coalesce("sources", F.lit(0).cast("long")).alias("sources"), (F.coalesce("sources", F.lit(0)) < at_least).alias("low_confidence"))


def standalone_frames(frames: DataFrame, events: DataFrame) -> DataFrame:
    """GA-15: frames without an event on their head, as low-confidence events."""
    e = events.select("doc_id", F.col("start_tok").alias("head_tok"))
    return frames.join(e, ["doc_id", "head_tok"], "left_anti").select("doc_id", F.concat(F.lit("shadow_"), F.col("id")).alias("id"), "head_tok", (F.col("confidence") * 0.5).alias("confidence"))


def uncovered_arguments(arguments: DataFrame, timexes: DataFrame, role: str = "ARGM-TMP") -> DataFrame:
    """TMP-SRLCAND: temporal arguments that no time expression covers, as candidates."""
    covered = timexes.select("doc_id", F.explode(F.sequence("start_tok", "end_tok")).alias("head_tok")).distinct()
    return arguments.where(F.col("role") == role).join(covered, ["doc_id", "head_tok"], "left_anti").select("doc_id", "head_tok", "head").distinct()


def reconciled(candidates: DataFrame, timexes: DataFrame) -> DataFrame:
    """TMP-RECON: candidates (doc_id, id, start_tok, end_tok) confirmed by a shared token, or for review."""
    tok = candidates.select("doc_id", "id", F.explode(F.sequence("start_tok", "end_tok")).alias("tok"))
    hit = tok.join(timexes.select("doc_id", F.explode(F.sequence("start_tok", "end_tok")).alias("tok")).distinct(), ["doc_id", "tok"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return candidates.join(hit, "id", "left").select("doc_id", "id", F.when(F.col("hit"), "confirmed").otherwise("needs_review").alias("status"))


def covering_mentions(arguments: DataFrame, mentions: DataFrame) -> DataFrame:
    """LNK-FA-VIA-EM: the shortest mention over the head of an argument, then the first id."""
    tok = mentions.select("doc_id", F.col("span_id").alias("mention_id"), (F.col("end_tok") - F.col("start_tok")).alias("width"), F.explode(F.sequence("start_tok", "end_tok")).alias("head_tok"))
    met = arguments.select("doc_id", F.col("id").alias("argument_id"), "head_tok").join(tok, ["doc_id", "head_tok"])
    return top1(met, ["argument_id"], F.col("width"), F.col("mention_id")).select("doc_id", "argument_id", "mention_id", "width")


def specificity(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """ENT-SPEC: class of a span by the words in it: NEG, then SPC, USP and GEN."""
    from ..plans.prims import span_tokens

    word = F.lower("text")
    rank = F.when(word.isin("no", "none", "neither", "nicht", "kein"), 0).when(word.isin("the", "this", "that", "these", "those", "der", "die", "das", "la", "le", "el"), 1).when(word.isin("a", "an", "some", "any", "ein", "eine", "un", "une", "una"), 2).otherwise(3)
    best = span_tokens(spans, tokens).groupBy("doc_id", "span_id").agg(F.min(rank).alias("rank"))
    return best.select("doc_id", "span_id", F.element_at(F.array(*map(F.lit, ("NEG", "SPC", "USP", "GEN"))), F.col("rank") + 1).alias("specificity"))


def preposition_timex_relation(preposition: Column, kind: Column, tense: Column) -> Column:
    """TL-05: relation of an event to a time expression behind a preposition, else VAGUE."""
    p, past = F.lower(preposition), tense == "PAST"
    span = kind.isin("TIME", "DATE", "DURATION")
    return (F.when((kind == "DURATION") & (p == "for") & tense.isin("PAST", "PRESENT"), "MEASURE").when((kind == "DATE") & (p == "since"), "BEGUN_BY").when((kind == "DURATION") & p.isin("in", "during"), "IS_INCLUDED")
            .when((kind == "DATE") & p.isin("by", "until") & past, "ENDED_BY").when(kind.isin("DATE", "TIME") & (p == "by"), "BEFORE").when(span & (p == "before"), "BEFORE").when(span & (p == "after"), "AFTER")
            .when((kind == "TIME") & (p == "at"), "SIMULTANEOUS").when(span & p.isin("on", "in"), "IS_INCLUDED").otherwise("VAGUE"))
