"""Quality rules: base counts, and the divergence of a text from its language.

The character-class histogram and the common-word histogram of each text are compared with the
histograms of the languages, which are the sums over all texts of the corpus that pass the base
rules.  The distance is the square root of the Jensen-Shannon divergence in bits; short histograms
are not judged.  DataFrame functions only.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, text_or_empty, total, words_of

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "im", "ist", "nicht", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "qui", "dans", "par", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "las", "un", "por", "con", "no", "una", "del"),
}
#: Classes of characters, taken away one after the other; what is left are symbols.
CLASSES = ("[a-z]+", r"[\x20\x09-\x0D]+", r"[^\x00-\x7F]+", "[A-Z]+", "[0-9]+", r"""[.,;:!?'"()-]+""")
SYMBOLS = "#*$%&|<>"
#: Bits of a sort key that hold the position of a window.
_POSITION = 28


@dataclass(frozen=True)
class QualityLimits:
    min_words: int = 50
    #: Characters and words from which a histogram is judged.
    min_chars: int = 200
    min_judged_words: int = 150
    max_char_distance: float = 0.28
    max_word_distance: float = 0.30
    languages: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COMMON_WORDS))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more.

    Windows are sorted by a hash that carries their position; windows that share a hash are
    compared as text, so the count is exact.
    """
    low = (1 << _POSITION) - 1
    key = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    high = lambda x: F.shiftright(x, _POSITION)
    shared = lambda s: F.filter(s, lambda x, i: F.coalesce(high(F.get(s, i + 1)) == high(x), F.lit(False)) | F.coalesce((i > 0) & (high(F.get(s, F.greatest(i - 1, F.lit(0)))) == high(x)), F.lit(False)))
    spelled = lambda w, s: F.array_sort(F.transform(s, lambda x: let(x.bitwiseAND(F.lit(low)).cast("int"), lambda p: F.struct(
        F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("s"), p.alias("p")))))
    same = lambda t: F.filter(t, lambda x, i: F.coalesce(F.get(t, i + 1)["s"] == x["s"], F.lit(False)) | F.coalesce((i > 0) & (F.get(t, F.greatest(i - 1, F.lit(0)))["s"] == x["s"]), F.lit(False)))
    covered = lambda p: total(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long")))
    exact = lambda w: let(F.sort_array(key(w)), lambda s: let(shared(s), lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(
        let(spelled(w, c), lambda t: let(F.sort_array(F.transform(same(t), lambda x: x["p"])), covered)))))
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(exact(w)))


def _removed(text: Column, word: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")


def features(docs: DataFrame, limits: QualityLimits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    vocabulary = sorted({w for ws in limits.languages.values() for w in ws})
    length = lambda c: F.char_length(c).cast("long")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    df = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), text_or_empty(text_col).alias("t0"))
    for i, c in enumerate(CLASSES):
        df = df.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", c, ""))
    left = f"t{len(CLASSES)}"
    df = df.select(
        "doc_id", "lang", "t0", F.array(*(length(f"t{i}") - length(f"t{i + 1}") for i in range(len(CLASSES))), length(left)).alias("chars"),
        (length(left) - length(F.translate(left, SYMBOLS, ""))).alias("n_symbols"), words_of(F.col("t0")).alias("words"))
    lines = F.filter(F.split("t0", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    common = F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", F.lower), lambda w: w.isin(*vocabulary)), "  "), F.lit(" "))
    df = df.select(
        "doc_id", "lang", "chars", F.size("words").cast("long").alias("n_words"), (total(F.col("chars")) - F.get("chars", F.lit(1))).alias("word_chars"), "n_symbols",
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), common.alias("common"))
    return df.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars",
        let(F.col("common"), lambda c: F.array(*(_removed(c, w) for w in vocabulary))).alias("commons"),
        ((F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))


def js_distance(p: Column, q: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of an array of shares from fixed ones."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: let((a + b) / 2, lambda m: (part(a, m) + part(b, m)) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judge(docs: DataFrame, limits: QualityLimits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A row for each row of ``docs``.  Both distances are to the nearest language; a text with fewer
    than ``min_chars`` characters or ``min_judged_words`` words is not judged by that histogram
    (null), nor is any where no language has a reference.  Null and empty texts have no words and
    fail the base rules.  Without a column lang, or for other languages, no reference is learned
    but texts are judged.  Further columns are ignored; an empty table gives an empty result.
    """
    limits = limits or QualityLimits()
    vocabulary = sorted({w for ws in limits.languages.values() for w in ws})
    made = materialise(features(docs, limits, id_col, text_col))
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in (("chars", len(CLASSES) + 1), ("commons", len(vocabulary))) for i in range(n)]
    learned = made.where(~F.col("base_failed") & F.col("lang").isin(*limits.languages)).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect()  # a row for each configured language

    def nearest(c: str, n: int, whole: Column, guard: Column, rest: bool) -> Column:
        shares = F.transform(c, lambda x: x / whole)
        if rest:
            shares = F.concat(shares, F.array(1 - total(F.col(c)) / whole))
        found = []
        for r in learned:
            counts = [r[f"{c}{i}"] for i in range(n)]
            base = r["n"] if rest else sum(counts)
            if base:
                q = [x / base for x in counts]
                found.append(js_distance(shares, q + [1 - sum(q)] if rest else q))
        return F.when(guard, F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double"))

    chars = total(F.col("chars"))
    distances = made.withColumns({
        "char_distance": nearest("chars", len(CLASSES) + 1, chars, chars >= limits.min_chars, False),
        "word_distance": nearest("commons", len(vocabulary), F.col("n_words"), F.col("n_words") >= limits.min_judged_words, True)})
    far = F.coalesce(F.col("char_distance") > limits.max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > limits.max_word_distance, F.lit(False))
    return distances.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")
