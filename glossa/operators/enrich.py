"""Event enrichment by word lists, dependency rules for time expressions, and link upkeep."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prims import top1
from .rules import dateline
from .tlinks import usable

# Word lists of the rules.
WEAK_VERBS = (
    "be", "is", "was", "are", "were", "been", "being", "have", "has", "had", "having", "do", "does", "did", "done", "doing", "become", "becomes",
    "became", "becoming", "remain", "remains", "remained", "remaining", "seem", "seems", "seemed", "seeming", "look", "looks", "looked", "looking",
    "appear", "appears", "appeared", "appearing", "continue", "continues", "continued", "continuing", "indicate", "indicates", "indicated", "indicating",
    "accord", "accords", "accorded", "according", "follow", "follows", "followed", "following", "say", "says", "said", "saying", "tell", "tells", "told",
    "telling", "report", "reports", "reported", "reporting", "suggest", "suggests", "suggested", "suggesting", "state", "states", "stated", "stating",
    "think", "thinks", "thought", "thinking", "find", "finds", "found", "finding", "expect", "expects", "expected", "expecting", "believe", "believes",
    "believed", "believing", "know", "knows", "knew", "known", "knowing", "consider", "considers", "considered", "considering",
)
WEAK_NOUNS = (
    "market", "markets", "index", "indexes", "indices", "inflation", "power", "powers", "job", "jobs", "number", "numbers", "system", "systems", "value",
    "values", "price", "prices", "percent", "percentage", "percentages", "share", "shares", "fund", "funds", "point", "points", "level", "levels", "rate",
    "rates", "record", "records", "economy", "economies", "growth", "month", "months", "year", "years", "day", "days", "week", "weeks", "exchange",
    "exchanges",
)
LIGHT_VERBS = ("make", "take", "have", "give", "do", "cause", "hold", "set", "get", "keep", "put", "leave", "find", "bring")
REPORTING_VERBS = ("report", "say", "state", "announce", "note", "tell", "reveal")
CAUSAL = {
    "CAUSE": (0.63, (
        "cause", "lead", "trigger", "result", "produce", "generate", "create", "bring", "force", "make", "drive", "prompt", "spur", "give", "yield", "induce",
        "provoke", "spark", "precipitate", "contribute", "stem",
    )),
    "ENABLE": (0.58, ("allow", "enable", "permit", "let", "support", "help", "facilitate", "encourage", "ensure", "guarantee", "provide", "offer")),
    "PREVENT": (0.60, ("prevent", "stop", "block", "ban", "prohibit", "restrict", "limit", "hinder", "hamper", "impede", "obstruct", "avoid", "deter")),
}
SUBORDINATING = {
    "EVIDENTIAL": (0.62, (
        "say", "report", "announce", "state", "note", "claim", "tell", "confirm", "deny", "insist", "warn", "suggest", "argue", "mention", "indicate",
        "reveal", "predict", "promise", "propose", "assert", "allege", "acknowledge", "admit", "emphasize", "stress", "observe", "reiterate", "repeat",
        "respond", "reply", "counter", "think", "believe", "expect", "assume", "consider", "suppose", "suspect", "guess", "conclude", "speculate", "estimate",
    )),
    "FACTIVE": (0.68, ("know", "realize", "discover", "notice", "find", "learn", "understand", "recognize", "remember", "recall", "establish", "prove", "determine")),
    "MODAL": (0.60, ("want", "hope", "plan", "intend", "decide", "attempt", "try", "seek", "need", "wish", "fail", "manage", "agree", "refuse")),
}
FRAME_CLASSES = {
    "REPORTING": (
        "say", "announce", "report", "tell", "claim", "declare", "state", "note", "indicate", "reveal", "predict", "promise", "propose", "assert", "allege",
        "acknowledge", "admit", "emphasize", "stress", "confirm", "deny", "insist", "warn", "suggest", "argue", "mention", "observe", "reiterate", "respond",
        "reply", "counter",
    ),
    "I_STATE": (
        "know", "believe", "think", "feel", "understand", "assume", "realize", "discover", "notice", "find", "learn", "establish", "prove", "determine",
        "remember", "recall",
    ),
    "I_ACTION": ("want", "hope", "plan", "intend", "decide", "attempt", "try", "seek", "need", "wish", "fail", "manage", "agree", "refuse"),
    "ASPECTUAL": ("begin", "start", "continue", "end", "finish", "stop", "cease", "resume", "complete"),
    "STATE": ("be", "have", "remain", "become", "exist", "stay", "seem", "appear", "look"),
}
TIME_DEPENDENCIES = ("nmod", "nmod:poss", "compound", "tmod", "nummod", "advmod", "obl", "obl:tmod", "nmod:tmod", "npadvmod")
PURGED_RULES = ("case6_dct_anchor", "transitive_closure", "inverse_consistency", "case17a_timex_same_value")
SEED_RULE, SEED_TYPES = "xml_e2e_seed", ("BEFORE", "AFTER", "VAGUE")
INVERSES = {"BEFORE": "AFTER", "IBEFORE": "IAFTER", "INCLUDES": "IS_INCLUDED", "BEGINS": "BEGUN_BY", "ENDS": "ENDED_BY", "DURING": "DURING_INV"}


def is_core(pred: Column, pos: Column, verbs: Sequence[str] = WEAK_VERBS, nouns: Sequence[str] = WEAK_NOUNS) -> Column:
    """EV-CORE: false where the first word of the predicate is on the list of its part of speech."""
    first = F.split(F.lower(F.coalesce(pred, F.lit(""))), " ")[0]
    p = F.coalesce(pos, F.lit(""))
    return ~((p.startswith("VB") & first.isin(list(verbs))) | (p.startswith("NN") & first.isin(list(nouns))))


def core_events(mentions: DataFrame, verbs: Sequence[str] = WEAK_VERBS, nouns: Sequence[str] = WEAK_NOUNS) -> DataFrame:
    """EV-CORE: an event is core if one of its mentions (doc_id, event_id, pred, pos) is."""
    return mentions.groupBy("doc_id", "event_id").agg(F.bool_or(is_core(F.col("pred"), F.col("pos"), verbs, nouns)).alias("is_core"))


def light_verbs(mentions: DataFrame, deps: DataFrame, lemmas: DataFrame, words: Sequence[str] = LIGHT_VERBS, verbs: Sequence[str] = WEAK_VERBS, nouns: Sequence[str] = WEAK_NOUNS) -> DataFrame:
    """EV-LIGHT: events of light verbs go into the core event that is their object.

    ``mentions`` has doc_id, event_id, start_tok, pred, pos, tense and aspect.  The object takes the
    verb's tense and aspect where it has none.
    """
    d = deps.where("type in ('dobj', 'obj', 'pobj') and head_tok <> dep_tok").select("doc_id", F.col("head_tok").alias("verb_tok"), F.col("dep_tok").alias("noun_tok"))
    light = lemmas.where(F.lower("lemma").isin(list(words))).select("doc_id", F.col("tok_index_doc").alias("verb_tok"))
    side = lambda df, name: df.select("doc_id", F.col("start_tok").alias(f"{name}_tok"), F.col("event_id").alias(f"{name}_id"), F.col("tense").alias(f"{name}_tense"), F.col("aspect").alias(f"{name}_aspect"))
    core = mentions.where(is_core(F.col("pred"), F.col("pos"), verbs, nouns))
    met = d.join(light, ["doc_id", "verb_tok"]).join(side(mentions, "verb"), ["doc_id", "verb_tok"]).join(side(core, "noun"), ["doc_id", "noun_tok"])
    return met.select("doc_id", F.col("verb_id").alias("event_id"), F.col("noun_id").alias("merged_into"), F.coalesce("noun_tense", "verb_tense").alias("tense"), F.coalesce("noun_aspect", "verb_aspect").alias("aspect"))


def canonical_participants(participants: DataFrame, merged: DataFrame) -> DataFrame:
    """EV-CANON: participants of a merged event also become those of the event it went into.

    ``participants`` has src, event_id, type and confidence; ``merged`` has id, merged and
    merged_into.  Edges that stand already are left; of several new ones the most confident stays.
    """
    head = merged.where(~F.coalesce("merged", F.lit(False))).select(F.col("id").alias("merged_into"))
    gone = merged.where("merged and merged_into is not null").select(F.col("id").alias("event_id"), "merged_into").join(head, "merged_into", "left_semi")
    moved = participants.join(gone, "event_id").select("src", F.col("merged_into").alias("event_id"), "type", (F.coalesce("confidence", F.lit(0.65)) * 0.95).alias("confidence"), F.col("event_id").alias("transferred_from"))
    new = moved.join(participants.select("src", "event_id"), ["src", "event_id"], "left_anti")
    return top1(new, ["src", "event_id"], F.col("confidence").desc(), F.col("transferred_from"), F.col("type"))


def predicate_links(frames: DataFrame, arguments: DataFrame, argument_tokens: DataFrame, events: DataFrame, classes: Mapping[str, tuple[float, Sequence[str]]]) -> DataFrame:
    """EV-CLINK-PRED, EV-SLINK-PRED: from the event of a classed predicate to the nearest event in its argument.

    ``frames`` has the predicate's lemma as ``pred``; ``argument_tokens`` has argument_id and tok.
    Equal distances go to the earlier token; a pair with several classes keeps the first by name.
    """
    kind, weight = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (confidence, words) in classes.items():
        hit = F.lower("pred").isin(list(words))
        kind, weight = F.when(hit, name).otherwise(kind), F.when(hit, confidence).otherwise(weight)
    live = events.where(~F.coalesce("merged", F.lit(False)))
    f = frames.where("framework = 'PROPBANK'").select("doc_id", F.col("id").alias("frame_id"), F.col("head_tok").alias("start_tok"), kind.alias("link_type"), weight.alias("confidence")).where("link_type is not null")
    main = f.join(live.select("doc_id", "start_tok", F.col("id").alias("event_id")), ["doc_id", "start_tok"]).drop("start_tok")
    a = arguments.where("role in ('ARG1', 'ARG2')").select("frame_id", F.col("id").alias("argument_id"), "head_tok")
    sub = live.select("doc_id", F.col("start_tok").alias("tok"), F.col("id").alias("sub_id"))
    met = main.join(a, "frame_id").join(argument_tokens, "argument_id").join(sub, ["doc_id", "tok"]).where("sub_id <> event_id")
    near = top1(met, ["argument_id", "event_id"], F.abs(F.col("tok") - F.col("head_tok")), F.col("tok"), F.col("sub_id"))
    first = F.min(F.struct("link_type", "confidence")).alias("k")
    return near.groupBy("doc_id", "event_id", "sub_id").agg(first).select("doc_id", "event_id", "sub_id", "k.link_type", "k.confidence")


def event_class(frames: DataFrame, described: DataFrame, events: DataFrame, classes: Mapping[str, Sequence[str]] = FRAME_CLASSES) -> DataFrame:
    """GA-03: the class of events without one, from the first sense of a frame's predicate.

    Of several frames the first by name counts; other frames give OCCURRENCE.
    """
    named = described.join(frames.where("frame is not null").select(F.col("id").alias("frame_id"), "frame"), "frame_id")
    bare = events.where("class is null").select("doc_id", F.col("id").alias("event_id"))
    value = F.lit("OCCURRENCE")
    for name, words in classes.items():
        value = F.when(F.col("frame").isin([f"{w}.01" for w in words]), name).otherwise(value)
    return named.join(bare, ["doc_id", "event_id"]).groupBy("doc_id", "event_id").agg(F.min("frame").alias("frame")).select("doc_id", "event_id", value.alias("event_class"))


def nominal_without_verb(events: DataFrame, tokens: DataFrame, eventive: DataFrame) -> DataFrame:
    """GA-02B: nominal events whose lemma has no verb behind it lose confidence."""
    nouns = tokens.where("pos in ('NN', 'NNS')").select("doc_id", F.col("tok_index_doc").alias("start_tok"), "lemma")
    e = events.where(~F.coalesce("low_confidence", F.lit(False)) & F.col("pos").startswith("NN")).select("doc_id", "id", "start_tok", "confidence")
    return e.join(nouns, ["doc_id", "start_tok"]).join(eventive.select("lemma").distinct(), "lemma", "left_anti").select("doc_id", F.col("id").alias("event_id"), (F.coalesce("confidence", F.lit(0.5)) * 0.6).alias("confidence"))


def alignment_gaps(frames: DataFrame, described: DataFrame, aligned: DataFrame) -> DataFrame:
    """GA-06: verbal and nominal frames of one event and head lemma that are not aligned yet."""
    f = described.select("doc_id", "frame_id", "event_id").join(frames.where("pred is not null").select(F.col("id").alias("frame_id"), "pred", "framework"), "frame_id")
    side = lambda kind, name: f.where(F.col("framework") == kind).select("doc_id", "event_id", "pred", F.col("frame_id").alias(name))
    met = side("PROPBANK", "verb_frame").join(side("NOMBANK", "noun_frame"), ["doc_id", "event_id", "pred"])
    return met.select("doc_id", "verb_frame", "noun_frame").distinct().join(aligned, ["verb_frame", "noun_frame"], "left_anti").select("doc_id", "verb_frame", "noun_frame", F.lit(0.7).alias("confidence"))


def unlinked(pairs: DataFrame, links: DataFrame, first: str, second: str, both_ways: bool = True) -> DataFrame:
    """Pairs without a link (src, dst), in either direction or from first to second only."""
    known = links.select(F.col("src").alias(first), F.col("dst").alias(second))
    return pairs.join(known.union(links.select("dst", "src")) if both_ways else known, [first, second], "left_anti")


def _below(events: DataFrame, deps: DataFrame, timexes: DataFrame, types: Sequence[str]) -> DataFrame:
    """Events and the time expressions that depend on them by some types."""
    d = deps.where(F.col("type").isin(list(types)) & (F.col("head_tok") != F.col("dep_tok"))).select("doc_id", F.col("head_tok").alias("event_tok"), F.col("dep_tok").alias("timex_tok"))
    e = events.select("doc_id", F.col("start_tok").alias("event_tok"), F.col("id").alias("event_id"))
    t = timexes.select("doc_id", F.col("start_tok").alias("timex_tok"), F.col("id").alias("timex_id"))
    return d.join(e, ["doc_id", "event_tok"]).join(t, ["doc_id", "timex_tok"])


def _linked(pairs: DataFrame, rel: str, confidence: float) -> DataFrame:
    return pairs.select("doc_id", "event_id", "timex_id").distinct().select("*", F.lit(rel).alias("rel"), F.lit(confidence).alias("confidence"))


def governing_timex(events: DataFrame, deps: DataFrame, timexes: DataFrame, links: DataFrame) -> DataFrame:
    """TL-20A: a date, set or time that governs an event includes it, where the two are not linked."""
    turned = deps.where(F.col("type").isin(list(TIME_DEPENDENCIES))).select("doc_id", F.col("dep_tok").alias("head_tok"), F.col("head_tok").alias("dep_tok"), "type")
    met = _below(usable(events), turned, timexes.where("type in ('DATE', 'SET', 'TIME')"), TIME_DEPENDENCIES)
    return _linked(unlinked(met, links, "event_id", "timex_id"), "INCLUDES", 0.75)


def adverbial_timex(events: DataFrame, deps: DataFrame, timexes: DataFrame, links: DataFrame) -> DataFrame:
    """TL-24: a calendar date that modifies an event as an adverb includes it."""
    dated = timexes.where(F.col("value").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"))
    return _linked(unlinked(_below(usable(events), deps, dated, ["advmod"]), links, "event_id", "timex_id", both_ways=False), "IS_INCLUDED", 0.85)


def last_week_timex(events: DataFrame, deps: DataFrame, timexes: DataFrame, links: DataFrame) -> DataFrame:
    """TL-27: an event before "last ..." with the value of a week, as a noun that modifies it, lies in it."""
    weeks = timexes.where(F.lower(F.coalesce("text", F.lit(""))).startswith("last") & F.coalesce("value", F.lit("")).contains("-W"))
    met = _below(usable(events), deps, weeks, ["npadvmod"]).where("event_tok < timex_tok")
    return _linked(unlinked(met, links, "event_id", "timex_id"), "IS_INCLUDED", 0.85)


def _both_ways(pairs: DataFrame, event_timex: str, timex_event: str, confidence: float) -> DataFrame:
    ways = F.explode(F.array(*(F.struct(F.lit(w).alias("direction"), F.lit(r).alias("rel")) for w, r in (("event_timex", event_timex), ("timex_event", timex_event))))).alias("k")
    return pairs.select("doc_id", "event_id", "timex_id").distinct().select("doc_id", "event_id", "timex_id", ways).select("doc_id", "event_id", "timex_id", "k.direction", "k.rel", F.lit(confidence).alias("confidence"))


def nominal_preposition_timex(events: DataFrame, deps: DataFrame, tokens: DataFrame, timexes: DataFrame, links: DataFrame, words: Sequence[str] = ("in", "on", "at", "of")) -> DataFrame:
    """TL-26: a nominal event lies in the date or time that a preposition below it governs; both directions."""
    step = lambda kind, a, b: deps.where((F.col("type") == kind) & (F.col("head_tok") != F.col("dep_tok"))).select("doc_id", F.col("head_tok").alias(a), F.col("dep_tok").alias(b))
    word = tokens.where(F.col("lemma").isin(list(words))).select("doc_id", F.col("tok_index_doc").alias("mid"))
    e = events.where(~F.coalesce("low_confidence", F.lit(False)) & F.col("pos").isin("NN", "NNS", "NNP", "NNPS")).select("doc_id", F.col("start_tok").alias("event_tok"), F.col("id").alias("event_id"))
    t = timexes.where("type in ('DATE', 'TIME')").select("doc_id", F.col("start_tok").alias("timex_tok"), F.col("id").alias("timex_id"))
    met = e.join(step("prep", "event_tok", "mid"), ["doc_id", "event_tok"]).join(word, ["doc_id", "mid"]).join(step("pobj", "mid", "timex_tok"), ["doc_id", "mid"]).join(t, ["doc_id", "timex_tok"])
    return _both_ways(unlinked(met, links, "event_id", "timex_id"), "IS_INCLUDED", "INCLUDES", 0.78)


def reporting_dateline(events: DataFrame, timexes: DataFrame, dct: DataFrame, lemmas: DataFrame, links: DataFrame, last_token: int = 103) -> DataFrame:
    """TL-25: finite reporting verbs behind the dateline, in the lead of a document, lie in its day; both directions."""
    said = lemmas.where(F.lower("lemma").isin(list(REPORTING_VERBS)) & F.col("pos").isin("VBD", "VBZ", "VBP", "VB")).select("doc_id", F.col("tok_index_doc").alias("start_tok"))
    e = events.where(F.col("start_tok") <= last_token).select("doc_id", "start_tok", F.col("id").alias("event_id")).join(said, ["doc_id", "start_tok"])
    met = e.join(dateline(timexes, dct), "doc_id").where("start_tok > line_end")
    return _both_ways(unlinked(met, links, "event_id", "timex_id"), "IS_INCLUDED", "INCLUDES", 0.68)


def purge_counts(links: DataFrame, rules: Sequence[str] = PURGED_RULES, seed: str = SEED_RULE, types: Sequence[str] = SEED_TYPES) -> DataFrame:
    """GA-12, GA-14 as P-SHADOW: links of each rule that would go and stay; nothing is changed."""
    goes = F.coalesce(purged(F.col("rule_id"), F.col("rel_type"), rules, seed, types), F.lit(False))
    return links.groupBy("rule_id").agg(F.count(F.when(goes, 1)).alias("purged"), F.count(F.when(~goes, 1)).alias("kept"))


def purged(rule: Column, rel: Column, rules: Sequence[str] = PURGED_RULES, seed: str = SEED_RULE, types: Sequence[str] = SEED_TYPES) -> Column:
    """GA-12, GA-14: whether a link's rule, or its seed rule and type, is given up."""
    return rule.isin(list(rules)) | ((rule == seed) & rel.isin(list(types)))


def relation_key(relations: DataFrame) -> DataFrame:
    """EVAL-RELKEY: links with kinds and positions in one direction: event before time, else the earlier end first.

    Turned links take the inverse type; types without an inverse stay.
    """
    both = INVERSES | {b: a for a, b in INVERSES.items()}
    rel = F.upper(F.trim(F.coalesce("rel_type", F.lit(""))))
    inverse = F.coalesce(F.create_map(*(F.lit(x) for kv in both.items() for x in kv))[rel], rel)
    mixed = (F.col("src_kind") == "timex") & (F.col("dst_kind") == "event")
    turn = mixed | ((F.col("src_kind") == F.col("dst_kind")) & (F.col("src_tok") > F.col("dst_tok")))
    pick = lambda a, b, name: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(name)
    return relations.select("doc_id", pick("src_kind", "dst_kind", "src_kind"), pick("src_tok", "dst_tok", "src_tok"), pick("dst_kind", "src_kind", "dst_kind"), pick("dst_tok", "src_tok", "dst_tok"), F.when(turn, inverse).otherwise(rel).alias("rel_type"))


def orphan_mentions(mentions: DataFrame, coreferences: DataFrame) -> DataFrame:
    """ENT-ORPHAN: pronouns and nominals without a coreference are not core; other mentions are left out."""
    held = coreferences.select(F.col("src").alias("id")).union(coreferences.select("dst")).distinct().withColumn("held", F.lit(True))
    m = mentions.where("syntactic_type in ('pro', 'nom', 'NOMINAL', 'PRONOUN')")
    return m.join(held, "id", "left").select("doc_id", "id", F.coalesce("held", F.lit(False)).alias("is_core"))
