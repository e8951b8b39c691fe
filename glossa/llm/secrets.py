"""Secret scans: patterns, and multipart credentials linked within scopes.

Strong parts (assignments, access identifiers, long hex runs) are always reported.  Weak parts are
account names, tokens of mixed characters and endpoints; one is reported only if a complementary
part stands in its scope: a secret needs an identifier or an endpoint, and these need a secret.
Parts are joined by intervals: each is put into a bucket as wide as the scope, the parts of a
bucket are reduced to their outermost positions, and a weak part looks into its own bucket and the
two beside it.  DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, joined, materialise, sized, text_key, text_or_empty

BASE = ("assign", "access", "hex")
WEAK = ("account", "mixed", "endpoint")
_SAID = r"""["']?\x20*+[:=]\x20*+["']?"""
_TOKEN = "[A-Za-z0-9+/_=-]"
PATTERNS = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){_SAID}[A-Za-z0-9+/_.=-]++",
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "(?<![0-9a-f])[0-9a-f]{24,}+",
    "account": rf"(?i)(?<![a-z0-9])(?:user|username|user_id|login|account|client_id|access_key_id){_SAID}[a-z0-9_.@+-]{{3,}}+",
    "mixed": rf"(?<!{_TOKEN}){_TOKEN}{{20,}}+",
    "endpoint": r"(?i)(?<![a-z0-9])(?:https?|ftp|jdbc:[a-z]++|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]++",
}
#: Which part of a credential a kind is.
ROLE = {"assign": "secret", "hex": "secret", "mixed": "secret", "access": "name", "account": "name", "endpoint": "name"}
#: Characters between two parts of one credential at most.
SCOPE = 200


def _holds(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_extract(value, rf"(?s)^[A-Za-z_]+{_SAID}(.*)$", 1)) >= 6
    if kind == "mixed":
        return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    found = F.transform(F.filter(find_spans(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"])), lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    guard = {"access": F.contains(text, F.lit("AKIA")), "endpoint": F.contains(text, F.lit("://"))}.get(kind)
    return F.coalesce(found if guard is None else F.when(guard, found), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of ``parts`` (text_key, kind, start, end) that have a complement in scope.

    Two parts are in scope if at most ``scope`` characters lie between them; a part that overlaps
    the other counts too.
    """
    role = F.lit(None).cast("string")
    for kind, r in ROLE.items():
        role = F.when(F.col("kind") == kind, F.lit(r)).otherwise(role)
    # Each part stands in the bucket of its start; its reach covers long parts as well.
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / scope))
    ends = parts.select("text_key", F.col("role").alias("other"), "start", "end", F.explode(F.sequence("bucket", F.floor(F.col("end") / scope))).alias("there"))
    # Outermost positions of a role in a bucket, cut to the bucket: within it any two parts are in scope.
    outer = (ends.groupBy("text_key", "other", "there").agg(
        F.min(F.greatest("start", F.col("there") * scope)).alias("first"), F.max(F.least("end", (F.col("there") + 1) * scope)).alias("last"))
        .select(F.col("text_key").alias("other_key"), "other", "there", "first", "last"))
    weak = parts.where(F.col("kind").isin(*WEAK)).select("text_key", "kind", "start", "end", "role", F.explode(F.sequence(F.col("bucket") - 1, F.floor(F.col("end") / scope) + 1)).alias("at"))
    gap = F.greatest(F.col("first") - F.col("end"), F.col("start") - F.col("last"))
    return (weak.join(outer, (F.col("text_key") == F.col("other_key")) & (F.col("at") == F.col("there")) & (F.col("role") != F.col("other")) & (gap <= scope))
            .groupBy("text_key", "kind", "start", "end").agg(F.count("*").alias("met")).drop("met"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, weak), a row for each row of ``docs``, both array<struct<kind, start, end>> by start, then kind.

    Positions are code points, the end exclusive.  A null text is empty and has no spans; repeated
    rows and null ids stay; an empty table gives an empty result; further columns are ignored.  A
    weak part that meets a base span is left out, since it is reported already.
    """
    text = text_or_empty(text_col)
    order = {k: i for i, k in enumerate(BASE + WEAK)}

    def by_start(spans: Column) -> Column:
        rank = lambda k: F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), k)
        return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
                           lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("h"), by_start(F.concat(*(kind_spans(text, k) for k in BASE))).alias("base"), F.concat(*(kind_spans(text, k) for k in WEAK)).alias("maybe"))
    clear = F.filter("maybe", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    found = materialise(found.select("doc_id", "h", "base", clear.alias("maybe")))
    texts = found.where(F.size("maybe") > 0).select(F.col("h").alias("text_key"), F.concat("base", "maybe").alias("parts")).dropDuplicates(["text_key"])
    parts = texts.select("text_key", F.explode("parts").alias("p")).select("text_key", "p.*")
    weak = linked(parts, scope).groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    return (found.join(sized(materialise(weak)), F.col("h") == F.col("text_key"), "left")
            .select("doc_id", "base", F.coalesce(by_start(F.col("weak")), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("weak")))


def digest(spans: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    starts = F.array_sort(F.transform(F.concat("base", "weak"), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, BASE + WEAK)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return spans.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(starts).alias("spans"))
