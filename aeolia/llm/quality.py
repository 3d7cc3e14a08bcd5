"""Quality rules by distribution divergence, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows. A text that
passes them is then compared with the reference of its language: the Jensen-Shannon distance
(base 2, from 0 to 1) of its character-class histogram and of its common-word histogram to
those of all base-passing texts of that language. A distance counts only for texts of a
minimum length, as short texts are far from any reference by chance.

Nulls: a null text is empty, has no words and fails the base rules; a null language is a
language of its own. A language of which no text passes has no reference and rejects nothing.
Repeated rows get equal results. The input may have columns of any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import shared_folder, table, written

MIN_WORDS = 50
MOST_REPEATED = 50
#: Distances beyond which a text is rejected, and lengths from which they count.
MOST_CLASS_DISTANCE, MIN_CHARS = 0.28, 200
MOST_WORD_DISTANCE, MIN_COMMON = 0.31, 100

# Common function words by language; any other language uses all of them.
COMMON = {
    "en": "the of and to in a is that for it was on with as be by at this are or from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
ALL = sorted({w for ws in COMMON.values() for w in ws})
SLOTS = max(len(ALL), *(len(ws) for ws in COMMON.values())) + 1
CLASSES = ("lower", "space", "upper", "digit", "mark", "other")
WORD, SPACE, MARKS, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[.,;:!?'\"()\-]+", r"[#*$%&|<>]+"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chars_", "classes", "common")


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The same rows with one more column ``_q`` that holds FEATURES."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct("*").alias("_row"), text.alias("t"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"))
    gone = lambda c, pattern: F.regexp_replace(c, F.lit(pattern), F.lit(""))
    # Each class is taken from what the former left.
    df = df.withColumns({"w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "r0": gone("t", r"\p{Ll}+")})
    df = df.withColumn("r1", gone("r0", SPACE)).withColumn("r2", gone("r1", r"\p{Lu}+")).withColumn("r3", gone("r2", r"\p{N}+")).withColumn("r4", gone("r3", MARKS))
    left = [F.length(c).cast("long") for c in ("t", "r0", "r1", "r2", "r3", "r4")]
    classes = F.array(*(a - b for a, b in zip(left, left[1:], strict=False)), left[-1])
    n = F.size("w")
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "_row", "lang", "w", n.cast("long").alias("n_words"), left[0].alias("n_chars_"), classes.alias("classes"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (left[5] - F.length(gone("r4", SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.filter("w", lambda x: x.isin(ALL)).alias("hits"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).alias("win"),
    )
    repeats = F.size(F.array_distinct(F.transform("win", lambda x: x["h"]))) < F.size("win")
    df = df.withColumn("sorted", F.when(repeats, F.sort_array("win")))
    twice = F.filter("sorted", lambda x, i: F.get("sorted", i - 1)["h"].eqNullSafe(x["h"]) | F.get("sorted", i + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    covered = F.transform("at", lambda p, i: F.coalesce(F.least(F.get("at", i + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
    listed = F.coalesce(*(F.when(F.col("lang") == k, _strings(ws)) for k, ws in COMMON.items()), _strings(ALL))
    counts = F.transform(listed, lambda c: F.size(F.filter("hits", lambda x: x == c)).cast("long"))
    df = df.withColumns({
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.coalesce(_total(covered), F.lit(0)).cast("long"),
        "counts": counts,
    })
    common = F.array_append("counts", F.col("n_words") - _total(F.col("counts")))
    df = df.withColumns({"common": common, "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))})
    return df.select("_row", F.struct("lang", *FEATURES).alias("_q"))


def references(found: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_common): summed histograms of all base-passing texts by language."""
    good = found.where(~F.col("_q.base_failed"))
    sums = [F.sum(F.coalesce(F.get(f"_q.{c}", F.lit(i)), F.lit(0))).alias(f"{c}{i}") for c, k in (("classes", len(CLASSES)), ("common", SLOTS)) for i in range(k)]
    out = good.groupBy(F.col("_q.lang").alias("ref_lang")).agg(*sums)
    return out.select("ref_lang", F.array(*(f"classes{i}" for i in range(len(CLASSES)))).alias("ref_classes"), F.array(*(f"common{i}" for i in range(SLOTS))).alias("ref_common"))


def histogram_total(c: str) -> Column:
    return F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x)


def distance(a: str, b: str, total_a: str, total_b: str) -> Column:
    """Jensen-Shannon distance of two histograms of counts, whose totals are columns; null if either is empty."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(x: Column, y: Column) -> Column:
        p, q = F.coalesce(x, F.lit(0)) / F.col(total_a), F.coalesce(y, F.lit(0)) / F.col(total_b)
        return part(p, (p + q) / 2) + part(q, (p + q) / 2)

    sums = F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.col(total_a) > 0) & (F.col(total_b) > 0), F.sqrt(F.greatest(F.lit(0.0), sums / 2)))


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """``found`` with js_classes, js_common and kept. There are as many references as languages."""
    q = found.select("_row", "_q.*").join(refs, F.col("lang") == F.col("ref_lang"), "left")
    kinds = ("classes", "common")
    # Once for each row, not for each entry of the histograms.
    q = q.withColumns({f"total_{c}": histogram_total(c) for k in kinds for c in (k, f"ref_{k}")})
    q = q.withColumns({f"js_{k}": distance(k, f"ref_{k}", f"total_{k}", f"total_ref_{k}") for k in kinds})
    far = (F.col("n_chars_") >= MIN_CHARS) & (F.col("js_classes") > MOST_CLASS_DISTANCE)
    far_words = (F.col("n_words") >= MIN_COMMON) & (F.col("js_common") > MOST_WORD_DISTANCE)
    return q.withColumn("kept", ~(F.col("base_failed") | F.coalesce(far, F.lit(False)) | F.coalesce(far_words, F.lit(False))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folder: str | None = None) -> DataFrame:
    """One row per text: its id, the base counts, both distances and the verdict ``kept``."""
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = features(few).select(F.struct(F.col("_row.id").alias("id")).alias("_row"), "_q")
    folder = folder or shared_folder(docs.sparkSession)
    found = written(found, folder, "quality")
    # Written too, so that their size is known and the texts need not move by language.
    out = judged(found, written(references(found), folder, "references"))
    return out.select(F.col("_row.id").alias(id_col), *FEATURES[:6], "kept", F.round("js_classes", 6).alias("js_classes"), F.round("js_common", 6).alias("js_common"))


def keep_good(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns.

    Rows are written once with their counts; a filter on top of the counts' own expressions
    would be pushed through them and repeat them many times over in the plan.
    """
    folder = folder or shared_folder(docs.sparkSession)
    found = written(features(docs), folder, "quality")
    return judged(found, written(references(found), folder, "references")).where("kept").select("_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
