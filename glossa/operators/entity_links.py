"""Frame arguments and the entities that they mean: links over heads, complements, pronouns and numbers, with new entities.

Arguments have doc_id, id, role, head_tok, head_pos, head, syntactic_type, complement_tok, complement,
complement_text, start_tok and end_tok; entities of the text (``named``) doc_id, id, type, head_tok,
start_tok and end_tok; links argument_id, target_id and target_kind.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.prims import top1

# Roles, parts of speech, kinds of targets, types of numbers.
CORE = ("ARG0", "ARG1", "ARG2", "ARG3", "ARG4")
PRONOUNS = ("PRP", "PRP$")
CANONICAL = ("Entity", "TEvent", "TIMEX")
NUMERIC = ("MONEY", "QUANTITY", "PERCENT")


def _links(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select("argument_id", "target_id").distinct().withColumn("target_kind", F.lit(kind))


def complement_entities(arguments: DataFrame, named: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LNK-FA-POBJ-ENT: entities for complements that no named entity heads, and the links to them.

    Only core arguments that mean no named entity yet.  Entities are told apart by the letters and
    digits of the complement's text, whatever the document; the first complement gives the head.
    """
    meant = links.where("target_kind = 'NamedEntity'").select(F.col("argument_id").alias("id"))
    headed = named.select("doc_id", F.col("head_tok").alias("complement_tok"))
    free = arguments.where(F.col("role").isin(*CORE) & F.col("complement_tok").isNotNull()).join(meant, "id", "left_anti").join(headed, ["doc_id", "complement_tok"], "left_anti")
    key = F.concat(F.lit("entity_"), F.regexp_replace(F.lower(F.coalesce("complement_text", F.lit(""))), r"[^\p{L}\p{N}]", ""))
    made = free.select(F.col("id").alias("argument_id"), key.alias("target_id"), "doc_id", "complement", "complement_tok")
    entities = top1(made, ["target_id"], F.col("doc_id"), F.col("complement_tok"), F.col("complement")).select(F.col("target_id").alias("id"), F.lit("NOMINAL").alias("type"), F.col("complement").alias("head"), F.col("complement_tok").alias("head_tok"))
    return entities, _links(made, "Entity")


def pronoun_links(arguments: DataFrame, mentions: DataFrame, chains: DataFrame, antecedents: DataFrame) -> DataFrame:
    """LNK-FA-PRO: pronouns mean the named entities of their antecedents.

    ``mentions`` are coreferent ones (doc_id, id, head_tok), ``chains`` pair mention_id with
    antecedent_id, ``antecedents`` antecedent_id with the named entity's target_id.
    """
    a = arguments.where(F.col("head_pos").isin(*PRONOUNS)).select("doc_id", F.col("id").alias("argument_id"), "head_tok")
    m = mentions.select("doc_id", F.col("id").alias("mention_id"), "head_tok")
    return _links(a.join(m, ["doc_id", "head_tok"]).join(chains.select("mention_id", "antecedent_id"), "mention_id").join(antecedents.select("antecedent_id", "target_id"), "antecedent_id"), "NamedEntity")


def new_entities(arguments: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LNK-FA-NEWENT: nominal entities for core arguments whose head no named entity has, and the links to them.

    Pronouns, arguments of no known type and prepositions are left out.  Arguments of one span share
    an entity; the smallest one is its source.
    """
    headed = named.select("doc_id", "head_tok")
    free = arguments.where(F.col("role").isin(*CORE) & (F.col("syntactic_type") != "PRO") & (F.coalesce("head_pos", F.lit("")) != "IN")).join(headed, ["doc_id", "head_tok"], "left_anti")
    start, end = F.coalesce("start_tok", "head_tok"), F.coalesce("end_tok", "head_tok")
    key = F.concat_ws("_", F.lit("nominal"), F.col("doc_id").cast("string"), start.cast("string"), end.cast("string"))
    made = free.select(F.col("id").alias("argument_id"), key.alias("target_id"), "doc_id", "head", "head_tok", start.alias("start_tok"), end.alias("end_tok"))
    entities = top1(made, ["target_id"], F.col("argument_id")).select(F.col("target_id").alias("id"), F.lit("NOMINAL").alias("type"), "doc_id", "head", "head_tok", "start_tok", "end_tok", F.col("argument_id").alias("source_argument"))
    return entities, _links(made, "Entity")


def antecedent_links(antecedents: DataFrame, named: DataFrame) -> DataFrame:
    """LNK-ANT-NE: (antecedent_id, target_id) of antecedents and named entities with one head."""
    return antecedents.select("doc_id", F.col("id").alias("antecedent_id"), "head_tok").join(named.select("doc_id", F.col("id").alias("target_id"), "head_tok"), ["doc_id", "head_tok"]).select("antecedent_id", "target_id").distinct()


def numeric_links(arguments: DataFrame, named: DataFrame, values: DataFrame, links: DataFrame) -> DataFrame:
    """LNK-FA-NUM: arguments whose head is part of an amount mean its value, or the amount where it has none.

    ``values`` pair a named entity's id with its value_id.  Arguments that mean an entity already are left.
    """
    meant = links.where("target_kind = 'Entity'").select("argument_id")
    tok = named.where(F.col("type").isin(*NUMERIC) & (F.col("end_tok") >= F.col("start_tok"))).select("doc_id", F.col("id").alias("ne_id"), F.explode(F.sequence("start_tok", "end_tok")).alias("head_tok"))
    met = arguments.select("doc_id", F.col("id").alias("argument_id"), "head_tok").join(meant, "argument_id", "left_anti").join(tok, ["doc_id", "head_tok"]).join(values.select(F.col("id").alias("ne_id"), "value_id"), "ne_id", "left")
    return met.select("argument_id", F.coalesce("value_id", "ne_id").alias("target_id"), F.when(F.col("value_id").isNotNull(), "VALUE").otherwise("NamedEntity").alias("target_kind")).distinct()


def flattened(links: DataFrame, entity_of: DataFrame) -> DataFrame:
    """LNK-FA-VIA-NE: links with those to the entities (id, entity_id) of the named entities that arguments mean."""
    via = links.where("target_kind = 'NamedEntity'").join(entity_of.select(F.col("id").alias("target_id"), "entity_id"), "target_id").select("argument_id", F.col("entity_id").alias("target_id"))
    return links.select("argument_id", "target_id", "target_kind").unionByName(_links(via, "Entity")).distinct()


def cleaned(links: DataFrame) -> DataFrame:
    """LNK-CLEAN: links without those to named entities of arguments that mean something canonical."""
    sure = links.where(F.col("target_kind").isin(*CANONICAL)).select("argument_id").distinct().withColumn("_sure", F.lit(True))
    return links.join(sure, "argument_id", "left").where("target_kind <> 'NamedEntity' OR _sure IS NULL").select(*links.columns)
