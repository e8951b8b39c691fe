"""Temporal links: normalisation, inverses, contradictions, closure and inference.

An edge table has src, dst, rel (canonical), confidence, suppressed and a unique edge_id that
orders edges where the confidence does not.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeml
from ..plans.pointers import components
from ..plans.prims import case_map, top1


def edges(tlinks: DataFrame) -> DataFrame:
    """TL-NORM: canonical relation beside the original, and the edge's identifier."""
    return tlinks.select(
        "src", "dst", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "src", "dst").alias("edge_id"), timeml.relation_type(F.col("rel_type")).alias("rel"),
        "rel_type", "confidence", "rule_id", "evidence_source", F.coalesce("suppressed", F.lit(False)).alias("suppressed"))


def live(e: DataFrame) -> DataFrame:
    return e.where(~F.col("suppressed"))


def contradictions(e: DataFrame) -> DataFrame:
    """rel_type_1, rel_type_2, conflict_count of contradictory live links on the same ends.

    Counted by running sums over each pair of ends in edge order, so that parallel links cost their
    number and not its square.
    """
    w = Window.partitionBy("src", "dst").orderBy("edge_id").rowsBetween(Window.unboundedPreceding, -1)
    contrary = live(e).where(F.col("rel").isin(*timeml.CONTRADICTS))
    before = F.lit(0)
    for r, o in timeml.CONTRADICTS.items():
        before = F.when(F.col("rel") == r, F.coalesce(F.count(F.when(F.col("rel") == o, 1)).over(w), F.lit(0))).otherwise(before)
    return (contrary.select("rel", before.alias("n")).where("n > 0").groupBy(timeml.opposite(F.col("rel")).alias("rel_type_1"), F.col("rel").alias("rel_type_2"))
            .agg(F.sum("n").alias("conflict_count")))


def contradiction_losers(e: DataFrame) -> DataFrame:
    """TL-SUPPRESS: live edges that a more confident, or else earlier, contradictory edge beats.

    An edge loses to some edge if and only if it loses to the best one of the opposite type.
    """
    contrary = live(e).where(F.col("rel").isin(*timeml.CONTRADICTS)).withColumn("c", F.coalesce("confidence", F.lit(0.0)))
    most = contrary.groupBy("src", "dst", "rel").agg(F.max("c").alias("best_c"))
    best = (contrary.join(most, ["src", "dst", "rel"]).where("c = best_c").groupBy("src", "dst", "rel", "best_c").agg(F.min("edge_id").alias("best_id"))
            .select("src", "dst", timeml.opposite(F.col("rel")).alias("rel"), F.col("rel").alias("winner_rel"), "best_c", "best_id"))
    beaten = (F.col("best_c") > F.col("c")) | ((F.col("best_c") == F.col("c")) & (F.col("best_id") < F.col("edge_id")))
    return contrary.join(best, ["src", "dst", "rel"]).where(beaten).select("edge_id", "src", "dst", "rel", "winner_rel")


def bidirectional_losers(e: DataFrame) -> DataFrame:
    """TL-SOLVE-BI: live directional edges that an edge of the same type back beats."""
    directed = live(e).where(F.col("rel").isin(*timeml.CONTRADICTS)).withColumn("c", F.coalesce("confidence", F.lit(0.0)))
    most = directed.groupBy("src", "dst", "rel").agg(F.max("c").alias("best_c"))
    best = directed.join(most, ["src", "dst", "rel"]).where("c = best_c").groupBy("src", "dst", "rel", "best_c").agg(F.min("edge_id").alias("best_id"))
    back = best.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "best_c", "best_id")
    beaten = (F.col("best_c") > F.col("c")) | ((F.col("best_c") == F.col("c")) & (F.col("best_id") < F.col("edge_id")))
    return directed.join(back, ["src", "dst", "rel"]).where(beaten).select("edge_id", "src", "dst", "rel")


def reciprocal_cycles(e: DataFrame) -> DataFrame:
    """rel_type, cycle_count: pairs of live edges of one directional type that run both ways."""
    directed = live(e).where(F.col("rel").isin(*timeml.CONTRADICTS))
    sides = directed.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "rel").agg(F.count(F.when(F.col("src") < F.col("dst"), 1)).alias("forth"), F.count(F.when(F.col("src") > F.col("dst"), 1)).alias("back"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("own"))
    pairs = F.col("forth") * F.col("back") + (F.col("own") * (F.col("own") - 1) / 2).cast("long")
    return sides.select("rel", pairs.alias("n")).where("n > 0").groupBy(F.col("rel").alias("rel_type")).agg(F.sum("n").alias("cycle_count"))


def inverse_candidates(e: DataFrame, inverses: dict[str, str]) -> DataFrame:
    """Reversed live edges of the types in ``inverses`` with the inverse type."""
    return live(e).where(F.col("rel").isin(*inverses)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), case_map(F.col("rel"), inverses).alias("rel"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("rel").alias("derived_from"))


def missing_inverses(e: DataFrame) -> DataFrame:
    """TL-SOLVE-INV: inverses of nine types that no edge states, with the highest confidence."""
    wanted = inverse_candidates(e, timeml.SOLVER_INVERSES).groupBy("src", "dst", "rel").agg(F.max("confidence").alias("confidence"))
    return wanted.join(e.select("src", "dst", "rel").distinct(), ["src", "dst", "rel"], "left_anti")


def sweep_inverses(e: DataFrame) -> DataFrame:
    """TL-INV: for each reversed pair the most confident inverse, and whether it makes or replaces a link."""
    wanted = top1(inverse_candidates(e, timeml.SWEEP_INVERSES), ["src", "dst"], F.col("confidence").desc(), F.col("rel"), F.col("derived_from"))
    there = e.groupBy("src", "dst").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("present"))
    action = F.when(F.col("present").isNull(), "create").when(F.col("present") < F.col("confidence"), "replace").otherwise("keep")
    return wanted.join(there, ["src", "dst"], "left").select("src", "dst", "rel", "confidence", "derived_from", action.alias("action"))


def identity_closure(e: DataFrame, rounds: int = 3) -> DataFrame:
    """TL-CLOSURE: links inferred by IDENTITY before or after any relation.

    (src, dst, rel, confidence, closure_round).  A round composes live links with identities, both
    reduced to the most confident link per ends and type; only links that are not there yet are
    added, and a round without any ends the search.
    """
    known = live(e).groupBy("src", "dst", "rel").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    stated = e.select("src", "dst", "rel").distinct()
    out = None
    for r in range(1, rounds + 1):
        same = known.where("rel = 'IDENTITY'")
        left, right = same.select("src", F.col("dst").alias("mid"), F.col("confidence").alias("c1")), known.select(F.col("src").alias("mid"), "dst", "rel", F.col("confidence").alias("c2"))
        first = left.join(right, "mid").select("src", "dst", "rel", "c1", "c2")
        left, right = known.select("src", F.col("dst").alias("mid"), "rel", F.col("confidence").alias("c1")), same.select(F.col("src").alias("mid"), "dst", F.col("confidence").alias("c2"))
        second = left.join(right, "mid").select("src", "dst", "rel", "c1", "c2")
        made = (first.unionByName(second).where("src <> dst").groupBy("src", "dst", "rel").agg(F.max(F.round((F.col("c1") + F.col("c2")) / 2, 3)).alias("confidence"))
                .join(stated, ["src", "dst", "rel"], "left_anti"))
        new = made.withColumn("closure_round", F.lit(r))
        out = new if out is None else out.unionByName(new)
        stated = stated.unionByName(made.select("src", "dst", "rel"))
        known = known.unionByName(made)
    return out


def anchor_flags(e: DataFrame) -> DataFrame:
    """TL-ANCHOR: consistency of each edge's ends; a self-link is inconsistent and suppressed."""
    bad = F.col("src") == F.col("dst")
    return e.select("edge_id", "src", "dst", "rel", (~bad).alias("anchor_consistency"), F.when(bad, "self_link").alias("anchor_consistency_reason"),
                    (F.col("suppressed") | bad).alias("suppressed"), F.when(bad & ~F.col("suppressed"), "tlink_anchor_consistency_filter").alias("suppressed_by"))


def compose(e: DataFrame, first: str, second: str, result: str) -> DataFrame:
    """GA-01: ends joined by ``first`` and then ``second`` without a link of the result yet."""
    pairs = live(e).select("src", "dst", "rel").distinct()
    a, b = pairs.where(F.col("rel") == first).select("src", F.col("dst").alias("mid")), pairs.where(F.col("rel") == second).select(F.col("src").alias("mid"), "dst")
    made = a.join(b, "mid").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("paths"))
    return made.join(pairs.where(F.col("rel") == result).select("src", "dst"), ["src", "dst"], "left_anti").withColumn("rel", F.lit(result))


def usable(events: DataFrame) -> DataFrame:
    """The endpoint guard of the rules: of the core, not low in confidence, not merged into another event.

    An event of which one of these is not known passes, and so do all where the column is missing.
    """
    says = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in events.columns else F.lit(default)
    return events.where(says("is_timeml_core", True) & ~says("low_confidence", False) & ~says("merged", False))


def same_value_timexes(timexes: DataFrame) -> DataFrame:
    """TL-17A as groups: value classes of a document with their first member and their links.

    Every two time expressions of a document with one value are simultaneous; a class of n is
    returned as its representative and its n * (n - 1) / 2 links instead of all pairs.
    """
    first = F.min_by("id", F.col("start_tok")).alias("representative")
    return timexes.groupBy("doc_id", "value").agg(F.count("*").alias("members"), first).where("members > 1").select("doc_id", "value", "members", "representative", (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("links"))


def nominal_in_sentence(events: DataFrame, timexes: DataFrame, at_most: int = 8) -> DataFrame:
    """TL-09: nominal event and every date, time and set of its sentence close by -> IS_INCLUDED.

    ``events`` are those that nominal frames gave.  An untyped time expression counts as well.
    """
    e = usable(events).select("doc_id", "sent_idx", F.col("id").alias("event_id"), F.col("start_tok").alias("event_tok"))
    t = timexes.where(F.coalesce("type", F.lit("")).isin("DATE", "TIME", "SET", "")).select("doc_id", "sent_idx", F.col("id").alias("timex_id"), F.col("start_tok").alias("timex_tok"))
    distance = F.abs(F.col("event_tok") - F.col("timex_tok"))
    near = e.join(t, ["doc_id", "sent_idx"]).where((F.col("event_tok") != F.col("timex_tok")) & (distance <= at_most))
    return near.groupBy("doc_id", "event_id", "timex_id").agg(F.min(distance).alias("distance")).select("*", F.lit("IS_INCLUDED").alias("rel"), F.lit(0.6).alias("confidence"))


def unanchored(events: DataFrame, anchored: DataFrame) -> DataFrame:
    """TL-20B: usable events without a link to a time expression -> IS_INCLUDED in the document's date."""
    left = usable(events).join(anchored.select(F.col("event_id").alias("id")).distinct(), "id", "left_anti")
    return left.select("doc_id", F.col("id").alias("event_id"), F.concat(F.lit("dct_"), F.col("doc_id").cast("string")).alias("timex_id"), F.lit("IS_INCLUDED").alias("rel"), F.lit(0.55).alias("confidence"))


def dct_relation(tense: Column, aspect: Column) -> Column:
    """TL-06: the relation of a verbal event to the document's date; a plain present says nothing."""
    return (F.when(tense == "FUTURE", "AFTER").when((tense == "PRESENT") & (aspect == "PROGRESSIVE"), "IS_INCLUDED")
            .when((tense == "PAST") | ((tense == "PRESENT") & (aspect == "PERFECTIVE")), "BEFORE").otherwise("VAGUE"))


def duration_in_date(timexes: DataFrame, at_most: int = 10) -> DataFrame:
    """TL-17B: a duration and the dates of its sentence close by -> IS_INCLUDED."""
    d = timexes.where("type = 'DURATION'").select("doc_id", "sent_idx", F.col("id").alias("duration_id"), F.col("start_tok").alias("a"))
    t = timexes.where("type = 'DATE'").select("doc_id", "sent_idx", F.col("id").alias("date_id"), F.col("start_tok").alias("b"))
    return d.join(t, ["doc_id", "sent_idx"]).where(F.abs(F.col("a") - F.col("b")) <= at_most).select("doc_id", "duration_id", "date_id", F.abs(F.col("a") - F.col("b")).alias("distance"))


def identity_classes(e: DataFrame) -> DataFrame:
    """TL-CLOSURE: (node, representative) of all ends of live IDENTITY links, whatever their direction."""
    same = live(e).where("rel = 'IDENTITY'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return components(same).select("node", F.col("root").alias("representative"))


def class_links(e: DataFrame, classes: DataFrame) -> DataFrame:
    """TL-CLOSURE between classes: (src, dst, rel, confidence, links): live links with their ends at representatives.

    Whatever holds between two members holds between all, so this is the closure without a row for
    each pair of members; links within a class are left out.
    """
    at = lambda df, c: df.join(classes.select(F.col("node").alias(c), "representative"), c, "left").withColumn(c, F.coalesce("representative", c)).drop("representative")
    moved = at(at(live(e).where("rel <> 'IDENTITY'").select("src", "dst", "rel", "confidence"), "src"), "dst")
    return moved.where("src <> dst").groupBy("src", "dst", "rel").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("links"))
