"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a Column that is true where a text fails it. On a seeded random sample of about `sample_rows` rows every rule is timed on
its own, warm and less the time of a rule that does nothing, and its rejection rate is counted; rules then run in descending
order of rejections per unit of cost, and one CASE expression stops at the first that rejects: no later rule is evaluated for that
row. The order changes the cost alone: the verdict is the same in any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import SPACE, WORD, col, let, written

SYMBOLS = "[#*$%&|<>]"
BULLET = rf"^{SPACE}*[-*\u2022]"


def words(text: Column) -> Column:
    """Array of the words; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.coalesce(F.length(F.regexp_replace(text, f"{SPACE}+", "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(word_array: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that the text has twice or more.

    Windows are told apart by 64-bit hashes of their words in order. A text whose hashes are all distinct is
    done; else the hashes are sorted with their places, repeated ones kept, and the union of their windows measured: n log n.
    """

    def windows(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    def union(hashes):
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s):
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        def measure(p):
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)

        return let(let(placed, repeated), measure)

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(union(h))
    return let(word_array, lambda w: F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(windows(w), counted))).cast("long")


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """`<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`; null texts have no words.

    `keep` adds the text and its words as `__sq_text, __sq_words`, for rules that look at them.
    """
    text = col(text_col).cast("string")
    out = docs.select(col(id_col).alias(id_col), text.alias("__sq_text"), words(text).alias("__sq_words"))
    t, w = F.col("__sq_text"), F.col("__sq_words")
    return out.select(col(id_col), F.size(w).cast("long").alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"), *([t, w] if keep else []))


def further_rules(text: Column, word_array: Column, n: Column, chars: Column) -> dict[str, Column]:
    """Rules beyond the measures, over a text, its words, their number and their code points."""
    lines = F.split(text, "\n")
    return {
        "shouting": F.regexp_count(text, F.lit("[A-Z]")) * 2 > chars,
        "exclaiming": F.regexp_count(text, F.lit("[!?]")) * 4 > n,
        "digits": F.regexp_count(text, F.lit("[0-9]")) * 2 > chars,
        "long_word": text.rlike(WORD + "{200}"),
        "bullets": F.size(F.filter(lines, lambda x: x.rlike(BULLET))) * 10 > F.size(lines) * 9,
        "few_distinct": F.size(F.array_distinct(word_array)) * 10 < n,
    }


#: Rules over a text: true where it fails. Each stands alone and computes what it needs.
def text_rules(text: Column) -> dict[str, Column]:
    n = n_words(text)
    return {
        "few_words": n < 20,
        "word_length": ~let(n, lambda k: word_chars(text).between(k * 2, k * 16)),
        "symbols": let(n, lambda k: n_symbols(text) * 4 > k),
        "repeated_lines": n_dup_lines(text) * 10 > n,
        "repeated_words": let(words(text), lambda w: n_repeat_words(w) * 100 > F.size(w) * 30),
        **further_rules(text, words(text), n, word_chars(text)),
    }


#: The same rules over `measures`, for tables that have them; with `keep`, the further rules as well.
def measured_rules(keep: bool = False) -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 20,
        "word_length": ~c("word_chars").between(n * 2, n * 16),
        "symbols": c("n_symbols") * 4 > n,
        "repeated_lines": c("n_dup_lines") * 10 > n,
        "repeated_words": c("n_repeat_words") * 100 > n * 30,
        **(further_rules(c("__sq_text"), c("__sq_words"), n, c("word_chars")) if keep else {}),
    }


def sampled(docs: DataFrame, rows: int, seed: int = 1) -> DataFrame:
    """Each row with the same chance, about `rows` in all; the same ones in each run over the same files."""
    n = docs.count()
    return docs.sample(False, rows / n, seed) if n > rows else docs


def rank_rules(sample: DataFrame, rules: dict[str, Column], *, repeats: int = 3, clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, float, float]]:
    """(name, seconds, rejection rate) of each rule on the sample, in the cascade's order.

    Each rule runs once to warm up and then `repeats` times, of which the fastest counts, less what a rule that does nothing takes.
    Ties keep the given order. Only numbers reach the driver.
    """
    sample = written(sample.repartition(1), "quality-sample")  # the scan stays as wide as it is
    rows = sample.count()

    def timed(fails: Column) -> tuple[float, int]:
        job = sample.select(F.sum(F.coalesce(fails, F.lit(False)).cast("int")))
        rejected, best = job.first()[0] or 0, float("inf")
        for _ in range(repeats):
            began = clock()
            job.first()
            best = min(best, clock() - began)
        return best, rejected

    idle, found = timed(F.lit(False))[0], []
    for name, fails in rules.items():
        seconds, rejected = timed(fails)
        found.append((name, max(1e-4, seconds - idle), rejected / rows if rows else 0.0))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = F.when(F.coalesce(rules[order[0]], F.lit(False)), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return out


def judge(docs: DataFrame, *, text_col: str = "text", rules: dict[str, Column] | None = None, sample_rows: int = 1000, seed: int = 1, verdict_col: str = "rejected_by") -> DataFrame:
    """`docs` with the name of a rule that rejects the text, null for texts to keep.

    Null and empty texts fail `few_words`. Which of several failed rules is named depends on the measured order; whether one is
    named does not. `verdict_col` replaces a column of that name; other columns stay.
    """
    rules = rules or text_rules(col(text_col).cast("string"))
    order = [name for name, _, _ in rank_rules(sampled(docs, sample_rows, seed), rules)]
    return docs.withColumn(verdict_col, cascade(rules, order))


def measured_and_judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple[str, ...] = ("few_words", "repeated_words"), sample_rows: int = 1000, seed: int = 1) -> DataFrame:
    """`measures` with `base_failed` (a rule of `base` rejects the text) and `kept`.

    The other rules are a cascade in measured order that only texts past the base enter, each as far as its first rejection.
    """
    rules = measured_rules(keep=True)
    failed = F.lit(False)
    for name in base:
        failed = failed | F.coalesce(rules[name], F.lit(False))
    rest = {name: fails for name, fails in rules.items() if name not in base}
    few = measures(sampled(docs, sample_rows, seed), id_col=id_col, text_col=text_col, keep=True)
    order = [name for name, _, _ in rank_rules(few.where(~failed), rest)]
    out = measures(docs, id_col=id_col, text_col=text_col, keep=True)
    kept = F.when(failed, F.lit(False)).otherwise(cascade(rest, order).isNull())
    return out.select(*(col(c) for c in out.columns if not c.startswith("__sq_")), failed.alias("base_failed"), kept.alias("kept"))
