"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Everything is computed inside the row: no shuffle, no Python, one scan. The measures of a text are columns of the
projection, and each row of the threshold table becomes one comparison, so that adding a rule adds an expression.

Cases: a null text counts as an empty one (no words: it fails ``min_words``). Null in any other column is carried
along. Repeated rows are judged one by one. A clashing column of the input is replaced by the measure of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, packed, table, words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "a al an and are as at au aux avec be by con das dans de del dem den der des die du ein eine el elle en es est et "
    "for from he ich il in is ist it la las le les lo los mit nicht of on or ou par pas pour que qui se sich sie su sur "
    "that the this to un und une von was wh with y zu"
).split()

#: Words in a window of which a second occurrence counts as a repeat.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``100 * part / whole`` is over ``most`` or under ``least``; without ``whole``, ``part`` itself counts.

    ``from_words``: the rule holds for texts of at least so many words.
    """

    name: str
    part: str
    whole: str | None = None
    least: float | None = None
    most: float | None = None
    from_words: int = 0

    def broken(self) -> Column:
        value = F.col(self.part).cast("double")
        if self.whole:
            value = 100.0 * value / F.greatest(F.col(self.whole), F.lit(1))
        wrong = F.lit(False)
        if self.least is not None:
            wrong = wrong | (value < self.least)
        if self.most is not None:
            wrong = wrong | (value > self.most)
        return wrong & (F.col("n_words") >= self.from_words)


#: The rules whose failure is settled by the contract.
BASE = (Rule("min_words", "n_words", least=20), Rule("repeats", "n_repeat_words", "n_words", most=30))

#: The further rules: length, symbol, stop-word and line ratios.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=25),
    Rule("stop_words", "n_stop_words", "n_words", least=2, from_words=40),
    Rule("capitals", "n_upper", "word_chars", most=50),
    Rule("dup_lines", "n_dup_lines", "n_lines", most=50),
)


def repeated_words(w: Column, repeats: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of ``width`` words that occur at least twice in the array ``w``, the first included.

    ``repeats``: whether two windows have equal hashes; only then the windows themselves are built and sorted, so that
    the count is exact.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(width))).alias("k"), i.alias("i")),
    )

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
        gap = lambda p: F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(width)), F.lit(width)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), lambda p: F.aggregate(gap(p), F.lit(0), lambda a, b: a + b))

    return F.when(repeats, let(F.sort_array(windows), covered)).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of its column ``text`` as long columns.

    One projection follows another, so that each array is made once and stays inside generated code. Window hashes
    are made by doubling: of two words, of four, of eight.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))
    doubled = lambda c, by: F.zip_with(c, F.slice(c, by + 1, F.size(c)), lambda x, y: F.xxhash64(x, y))
    w, lines, h = F.col("_w"), F.col("_lines"), F.col("_h")
    out = docs.withColumns(
        {
            "n_symbols": without(f"[{SYMBOLS}]+"),
            "n_upper": without("[A-ZÀ-ÖØ-Þ]+"),
            "_w": words(F.col("text")),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "_h": F.transform(w, lambda x: F.xxhash64(x)),
        }
    )
    for by in (1, 2, 4):
        out = out.withColumn("_h", doubled(h, by))
    # the last hashes, which reach over the end, are cut off
    out = out.withColumn("_h", F.slice(h, 1, F.greatest(F.size(h) - WINDOW + 1, F.lit(0))))
    out = out.withColumn("_again", F.size(F.array_distinct(h)) < F.size(h))
    out = out.withColumn("n_repeat_words", repeated_words(w, F.col("_again")))
    names = ("n_symbols", "n_upper", "n_words", "word_chars", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
    return out.withColumns({k: F.col(k).cast("long") for k in names}).drop("_w", "_lines", "_h", "_again")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``failed`` (names of the broken rules) and ``kept``."""
    out = measures(docs)
    broken = F.lit(False)
    for r in base:
        broken = broken | r.broken()
    failed = F.array_compact(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in (*base, *rules))))
    return out.withColumns({"base_failed": broken, "failed": failed}).withColumn("kept", F.size("failed") == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep every rule, with their own columns."""
    judged = judge(docs.select(packed(docs).alias("_row"), F.col("text")))
    # a filter would be pushed below the projections and repeat them all
    kept = judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return kept.select("_row.*")
