"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments.  If two fingerprints differ in
at most ``max_bits`` bits, one segment differs in at most one of them.  Every segment is indexed once
for each of its bits with that bit wiped out; fingerprints meet by equality of such a key and are
then compared in full.  A pair is kept only under the first key that the two have in common.

The fingerprint itself is made in Arrow batches (64 bit counts of each shingle have no cheap column
form); index, join, verification and components are DataFrame operations.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Memo, discard, materialise, sized, text_key, text_or_empty
from .components import connected_components

BITS = 64
#: Shingles that are hashed and counted at a time, so that a very long text takes little memory.
_BATCH = 1 << 14
_SEED = 42
#: Texts of an Arrow batch that are looked at together.
_ROWS = 512
#: Rows of a table of one long that are broadcast at most.
_IDS = 500_000
#: Fingerprints from which keys take in more bits.
_MANY = 1 << 23
#: A fingerprint is hot if it has more than this part of all rows.
_HOT = 10_000
#: Texts, about, whose shingles tell which are frequent, and such shingles at most.
_SAMPLE, _FREQUENT = 10_000, 100_000


def fingerprint_of(text: str | None, shingle_words: int, distinct: bool = False) -> int:
    """Majority bits over the XXH64 of the word shingles; 0 without words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    shingles: list[str] | Iterator[str] = words if shingle_words == 1 else [" ".join(words[i:i + shingle_words]) for i in range(n)]
    if distinct:
        shingles = list(dict.fromkeys(shingles))
        n = len(shingles)
    counts, digest = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BATCH):
        h = np.array([digest(s, _SEED) for s in shingles[at:at + _BATCH]], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle_words: int = 4, distinct: bool = False) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle_words, distinct) for t in texts], dtype="int64")
    return of(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; one of them differs in at most one bit."""
    m = max_bits // 2 + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(first: int, width: int) -> int:
    m = ((1 << width) - 1) << first
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _wiped(a: Column, parts: list[tuple[int, int]], tag: int, also: Column, extra: Column) -> list[Column]:
    """Keys of one long: for each segment and each of its bits the segment without that bit, beside ``also``."""
    return [F.struct(F.lit(tag + s * 100 + j).cast("long").alias("wiped"), a.bitwiseAND(F.lit(_mask(*parts[s]) & ~_mask(parts[s][0] + j, 1))).bitwiseOR(also).alias("rest"), extra.alias("part"))
            for s in range(len(parts)) for j in range(parts[s][1])]


def links(fps: DataFrame, max_bits: int = 4, inner: bool = False) -> DataFrame:
    """All pairs (a < b) of the distinct longs in column ``fp`` that differ in at most ``max_bits`` bits.

    With ``inner`` every key also holds one of ``max_bits + 1`` equal parts of the other bits, of
    which one must be the same in both: as many more keys, but far fewer meet by chance.  It pays
    for tables so large that a key of one segment is shared by many.
    """
    parts = segments(max_bits)
    zero = F.lit(0).cast("long")
    if inner:
        keys = []
        for s, (low, width) in enumerate(parts):
            others = [b for b in range(BITS) if not low <= b < low + width]
            for p in range(max_bits + 1):
                here = others[len(others) * p // (max_bits + 1):len(others) * (p + 1) // (max_bits + 1)]
                bits = sum(1 << b for b in here)
                also = F.col("fp").bitwiseAND(F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits))
                keys += _wiped(F.col("fp"), [parts[s]], 1000 * p + 100 * s, also, F.lit(p))
    else:
        keys = _wiped(F.col("fp"), parts, 0, zero, F.lit(0))
    # The planner takes the index to be as small as the table it is made from, so it may not be broadcast.
    index = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.wiped", "k.rest").hint("merge")
    a, b = index.select(F.col("fp").alias("a"), "wiped", "rest"), index.select(F.col("fp").alias("b"), "wiped", "rest")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(-1)  # the first key that both have
    for s in reversed(range(len(parts))):
        low, width = parts[s]
        here = differing.bitwiseAND(F.lit(_mask(low, width)))
        bit = F.lit(0)
        for j in range(1, width):
            bit = F.when(here == F.lit(_mask(low + j, 1)), j).otherwise(bit)
        first = F.when(F.bit_count(here) <= 1, F.lit(s * 100) + bit).otherwise(first)
    close = (F.col("a") < F.col("b")) & (F.bit_count(differing) <= max_bits) & (F.pmod(a["wiped"], F.lit(1000)) == first)
    met = a.join(b, (a["wiped"] == b["wiped"]) & (a["rest"] == b["rest"]) & close).select("a", "b")
    return met.distinct() if inner else met


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4, distinct: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Two texts are linked if their fingerprints differ in at most ``max_bits`` bits; component_id is
    the smallest id that links lead to.  Exact copies share a fingerprint and enter the search once.
    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay; a
    null id never becomes a component_id unless its component has no other; an empty table gives an
    empty result.  Further columns of ``docs`` are ignored.
    """
    marked = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle_words, distinct).alias("fp")))
    least = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    n_fps, n_rows = least.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = connected_components(links(least.select("fp"), max_bits, n_fps > _MANY))
    linked = least.join(roots, least["fp"] == roots["node"]).select("fp", "root", "least")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    inner = linked.join(smallest, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    by_fp = materialise(least.join(inner, F.col("fp") == F.col("linked_fp"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("component_id", "least").alias("component_id"), "copies"))
    # Fingerprints with many copies are looked up where the rows are: there are at most _HOT of them.
    hot = F.col("copies") > n_rows // _HOT
    often = F.broadcast(by_fp.where(hot).select(F.col("of_fp").alias("hot_fp"), F.col("component_id").alias("hot_component")))
    split = marked.join(often, F.col("fp") == F.col("hot_fp"), "left")
    seldom = split.where(F.col("hot_fp").isNull()).join(by_fp.where(~hot), F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")
    whole = seldom.unionByName(split.where(F.col("hot_fp").isNotNull()).select("doc_id", "fp", F.col("hot_component").alias("component_id")))
    return whole.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts and sets beside Arrow's own."""
    for b in batches:
        for low in range(0, b.num_rows, _ROWS):
            yield b.slice(low, _ROWS)


def shingles_of(text: str | None, shingle_words: int) -> np.ndarray:
    """The sorted hashes of the distinct word shingles."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    n = max(1, len(words) - shingle_words + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + shingle_words]), _SEED) for i in range(n)], dtype=np.uint64)).view(np.int64)


def least_common(size: int | Column, similarity: float) -> int | Column:
    """Shingles that a set has in common at least with any that is so similar."""
    share = size * similarity - 1e-9
    return F.ceil(share) if isinstance(size, Column) else math.ceil(share)


def frequent_shingles(texts: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, ascending, and in how many; they only order the keys."""
    n = texts.count()
    sample = texts.where(F.pmod(F.xxhash64(text_or_empty()), F.lit(1_000_000)) < F.lit(max(1, 1_000_000 * _SAMPLE // max(n, 1))))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"shingle": shingles_of(t, shingle_words)})
    rows = sample.select("text").distinct().mapInPandas(explode, "shingle long").groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(_FREQUENT).toPandas()  # _FREQUENT rows at most
    rows = rows.sort_values("shingle")
    return rows["shingle"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)


def majority_bits(hashes: np.ndarray) -> int:
    """Fingerprint of a set of hashes, as a signed long; 0 for an empty one."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BATCH):
        counts += np.unpackbits(hashes[at:at + _BATCH].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def parity_bits(hashes: np.ndarray) -> int:
    """Bit i is the parity of the hashes that are i modulo 64, as a signed long.

    Two sets differ in at least as many members as their parities differ in bits.
    """
    odd = np.bincount((hashes.view(np.uint64) % BITS).astype(np.int64), minlength=BITS) & 1
    return int.from_bytes(np.packbits(odd.astype(bool)).tobytes(), "big", signed=True)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, max_bits: int = 28, small: int = 100, near_bits: int = 4) -> DataFrame:
    """(doc_id, component_id): groups of texts whose word shingles are similar, by the smallest id.

    Sets of shingles with a Jaccard similarity of at least ``similarity`` are linked: of each set the
    rarest shingles, as many as it may lack in a similar one and one more, are its keys, and similar
    sets share a key.  A pair is looked at only if what follows the key in both sets is enough, which
    holds for the first key that a similar pair shares.  Pairs of sets of ``small`` shingles and more
    are also held against their fingerprints, which may differ in ``max_bits`` bits: at a similarity
    of 0.8 and 100 shingles the mean is 10 and one pair in ten million differs in more than 28.
    Of smaller sets all are looked at whose parities differ in no more bits than similar sets have
    members apart, which loses none.  First of all come the pairs that the index of deletion variants
    finds within ``near_bits`` bits; what it leaves in different groups is left to the keys.  Pairs are verified by the whole sets of their texts, each made once: each text against the one it shares most keys
    with, then against the least of each key, and what that leaves in different groups pair by pair.  Nulls, empty texts, repeated rows
    and empty tables are treated as in ``near_duplicates``.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle_words))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.forget()
        seen, often = shared.value
        for b in _slices(batches):
            rows = []
            for t in b["text"]:
                own = shingles_of(t.as_py(), shingle_words)
                keep = len(own) - least_common(len(own), similarity) + 1 if len(own) else 0
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
                    order = np.lexsort((own, np.where(seen[at] == own, often[at], 0)))
                else:
                    order = np.arange(len(own))
                rows.append((xxhash.xxh3_128_hexdigest(own.tobytes(), _SEED), majority_bits(own), parity_bits(own), len(own), own[order[:keep]]))
            digest, fp, parity, size, keys = zip(*rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(digest, pa.string()), pa.array(fp, pa.int64()), pa.array(parity, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "digest", "fp", "parity", "size", "keys"])

    marked = materialise(texts.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(mark, f"doc_id {dict(texts.dtypes)['doc_id']}, text_key string, digest string, fp long, parity long, size int, keys array<long>"))
    # Equal sets are one node; its number is short, and stable because it is written down.
    sets = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.min("fp").alias("fp"), F.min("parity").alias("parity"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = materialise(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "text_key", "fp", "parity", "size", "keys"))
    rows = materialise(marked.select("doc_id", "digest"))
    discard(marked)
    shared.unpersist()
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("at", "key"))
    packed = F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")
    hubs = materialise(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.min_by(packed, "node").alias("packed")).where("n > 1")
                       .select(F.col("key").alias("hub_key"), "hub", F.shiftright("packed", 32).cast("int").alias("hub_size"), F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("hub_at")))
    fp_of = lambda x: nodes.select(F.col("node").alias(f"{x}_of_fp"), F.struct("fp", "parity").alias(f"{x}_fp"))
    shared_keys = keyed.join(hubs, F.col("key") == F.col("hub_key")).drop("hub_key")
    members = materialise(shared_keys.join(fp_of("node"), F.col("node") == F.col("node_of_fp")).drop("node_of_fp").join(fp_of("hub"), F.col("hub") == F.col("hub_of_fp")).drop("hub_of_fp"))

    def may(a: str, a_at: str, a_fp: str, b: str, b_at: str, b_fp: str) -> Column:
        """Whether two sets may be similar by their sizes, what follows a key in both, their parities and fingerprints."""
        both = (F.col(a) + F.col(b)) * (similarity / (1 + similarity)) - 1e-6
        apart = (F.col(a) + F.col(b)) * ((1 - similarity) / (1 + similarity)) + 1e-6  # members that only one of two similar sets has, at most
        differing = lambda bits: F.bit_count(F.col(f"{a_fp}.{bits}").bitwiseXOR(F.col(f"{b_fp}.{bits}")))
        return ((F.least(a, b) >= least_common(F.greatest(a, b), similarity)) & (F.least(F.col(a) - F.col(a_at), F.col(b) - F.col(b_at)) >= both)
                & (differing("parity") <= apart) & ((F.least(a, b) < small) | (differing("fp") <= max_bits)))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.forget()
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([shingles_of(t.as_py(), shingle_words) for t in b["text"]], pa.list_(pa.int64()))], ["node", "set"])

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs of nodes (a, b) that are similar."""
        pairs = materialise(pairs.distinct())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
        keys = sized(materialise(wanted.join(nodes, F.col("wanted") == F.col("node")).select("node", F.col("text_key").alias("wanted_key"))), _IDS)
        held = materialise(texts.join(keys, text_key() == F.col("wanted_key")).select("node", "text").dropDuplicates(["node"]).mapInArrow(shingled, "node long, set array<long>"))
        side = lambda x: held.select(F.col("node").alias(x), F.col("set").alias(f"{x}_set"))
        # The sets of a pair meet once, and what they share is counted beside the join.
        common = F.size(F.array_intersect("a_set", "b_set"))
        least = similarity - 1e-9
        similar = common * (1 + least) >= (F.size("a_set") + F.size("b_set")) * least
        found = materialise(pairs.join(side("a"), "a").join(side("b"), "b").where(similar).select("a", "b"))
        discard(held, pairs, keys)
        return found

    def still_open(found: DataFrame) -> DataFrame:
        """The members of keys that more than one group of linked nodes shares, with their group."""
        roots = connected_components(found).withColumnRenamed("node", "linked")
        rooted = members.join(roots, F.col("node") == F.col("linked"), "left").select("key", "node", "size", "at", "node_fp", "hub", "hub_size", "hub_at", "hub_fp", F.coalesce("root", "node").alias("root"))
        several = rooted.groupBy(F.col("key").alias("open_key")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("open_key")
        left = materialise(rooted.join(several, F.col("key") == F.col("open_key"), "left_semi"))
        discard(roots)
        return left

    to_hub = members.where((F.col("node") != F.col("hub")) & may("size", "at", "node_fp", "hub_size", "hub_at", "hub_fp"))
    best = to_hub.groupBy("node", "hub").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("hub", "n").alias("hub"))
    # Sets whose fingerprints are equal or linked by the index meet by the least set of each fingerprint.
    by_fp = materialise(nodes.groupBy(F.col("fp").alias("at_fp")).agg(F.min("node").alias("at_node")))
    near = links(by_fp.select(F.col("at_fp").alias("fp")), near_bits, by_fp.count() > _MANY)
    end = lambda x: by_fp.select(F.col("at_fp").alias(x), F.col("at_node").alias(f"{x}_node"))
    near = near.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = nodes.join(by_fp, F.col("fp") == F.col("at_fp")).where("node <> at_node").select(F.col("node").alias("a"), F.col("at_node").alias("b"))
    found = alike(near.union(same).union(best.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    open_ = still_open(found)
    roots_of = open_.select(F.col("node").alias("hub_node"), F.col("root").alias("hub_root")).distinct()
    apart = open_.join(roots_of, F.col("hub") == F.col("hub_node")).where((F.col("root") != F.col("hub_root")) & may("size", "at", "node_fp", "hub_size", "hub_at", "hub_fp"))
    first, more = found, alike(apart.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    found = first.union(more)
    discard(open_)
    open_ = still_open(found)
    groups = open_.select("key", "root").distinct()
    crossed = groups.select("key", F.col("root").alias("a_root")).join(groups.select("key", F.col("root").alias("b_root")), "key").where("a_root < b_root")
    side = lambda x: open_.select("key", F.col("root").alias(f"{x}_root"), F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("at").alias(f"{x}_at"), F.col("node_fp").alias(f"{x}_fp"))
    rest = crossed.join(side("a"), ["key", "a_root"]).join(side("b"), ["key", "b_root"]).where(may("a_size", "a_at", "a_fp", "b_size", "b_at", "b_fp")).select("a", "b")
    last = alike(rest)
    roots = connected_components(found.union(last))
    linked = nodes.select("node", "digest", "least").join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_digest = linked.join(by_root, "root").select(F.col("digest").alias("of_digest"), "component_id")
    named = materialise(rows.join(by_digest, F.col("digest") == F.col("of_digest")).select("doc_id", "component_id"))
    discard(rows, nodes, hubs, members, by_fp, open_, first, more, last, roots)
    return named
