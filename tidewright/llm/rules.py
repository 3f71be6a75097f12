"""Quality rules as a ledger of failure bits, with DataFrame functions only.

Every document is measured once and every rule evaluated once; the ledger keeps the measurements and one bit a rule in a
long.  A policy is a version of a set of rules and the number of failures it lets pass: its verdict is a mask and a bit
count over the ledger, so a new version costs no second look at a text.  `ablation` folds the ledger to its distinct bit
patterns (at most two to the number of rules, folded before the exchange) and tells for each policy and rule how many
documents the rule alone drops; `profile` joins the bits of groups by bitwise aggregates.

All measures are whole numbers and all limits are compared in whole numbers.  Words are what ASCII white space separates.
A text is handled inside its own row, so nothing but the reports is shuffled.  `measure` alone is lazy: write its result
before filtering on a measure, since Spark would move such a filter, with all it is made from, below the measuring.

Defined results: null text counts as empty; a text without words fails `few_words` only; rows that repeat an id, or have a
null one, are rows of their own; an empty table gives an empty ledger and empty reports; columns of the input are kept
unless the ledger has a column of that name, which then replaces it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, write_table

NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window whose repetition counts.
WINDOW = 3
#: What is measured, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capitals", "n_digits", "n_bullets", "n_ellipses")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger and the condition under which a document fails, in SQL over the measures."""

    name: str
    fails: str


# Limits of the rules, in per cent where they are shares.  A rule's place is its bit, so rules are only appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("few_letters", "100 * n_letter_words < 50 * n_words"),
    Rule("capitals", "100 * n_capitals > 40 * word_chars"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
    Rule("bullets", "100 * n_bullets > 90 * n_lines"),
    Rule("ellipses", "100 * n_ellipses > 30 * n_lines"),
)


@dataclass(frozen=True)
class Policy:
    """A version of a policy: the rules that count and how many of them a document may fail."""

    name: str
    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << k for k, r in enumerate(RULES) if r.name in self.rules)

    def keeps(self, failed: str = "failed") -> Column:
        return F.bit_count(F.col(failed).bitwiseAND(F.lit(self.mask).cast("long"))) <= self.allowed


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("web", 1, tuple(r.name for r in RULES))
#: The current policy: any rule drops a document.
CURRENT = Policy("web", 2, tuple(r.name for r in RULES if r.name not in ("bullets", "ellipses")))
POLICIES = (BASE, STRICT, CURRENT)


def _repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words in windows that the text holds twice or more.

    Windows are numbered and sorted by their words, equal neighbours are what repeats, and their places, in order again,
    cover up to WINDOW words each.  Texts without any repeated window skip the sort.
    """
    n = F.size(words)
    window = lambda w, i: F.concat_ws(" ", w, *[F.get(F.col(words), i + k) for k in range(1, WINDOW)])
    spans = F.when(n >= WINDOW, F.transform(F.slice(words, F.lit(1), n - (WINDOW - 1)), window)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_spans", spans)
    again = F.size(F.array_distinct("_spans")) < F.size("_spans")
    numbered = F.transform("_spans", lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(again, F.sort_array(numbered)))
    same = lambda x, i, k: F.coalesce(F.get(F.col("_sorted"), i + k)["s"] == x["s"], F.lit(False))
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i, 1) | same(x, i, -1)), lambda x: x["i"])))
    after = F.concat(F.slice("_places", F.lit(2), F.size("_places")), F.array(F.element_at("_places", -1) + WINDOW))
    cover = F.aggregate(F.zip_with("_places", after, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(F.when(F.col("_sorted").isNotNull(), cover), F.lit(0)).cast("long")).drop("_spans", "_sorted", "_places")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of df and the MEASURES, all long."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {m.lower() for m in (*MEASURES, "failed")}]
    inner = [f"_c{k}" for k in range(len(kept))]  # so that no column of the input meets one of ours
    out = df.select(*[c.alias(a) for c, a in zip(kept, inner)], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    out = out.withColumn("_words", F.array_remove(F.split("_text", f"{SPACE}+"), ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    out = _repeats(out, "_words", "n_repeat_words")
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    like = lambda column, pattern: F.size(F.filter(column, lambda x: x.rlike(pattern)))
    values = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": count(SYMBOLS),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_letter_words": like("_words", r"\p{L}"),
        "n_capitals": count(r"\p{Lu}"),
        "n_digits": count("[0-9]"),
        "n_bullets": like("_lines", rf"^{SPACE}*[-*•]"),
        "n_ellipses": like("_lines", rf"(\.\.\.|…){SPACE}*$"),
    }
    return out.select(*[F.col(a).alias(name) for a, name in zip(inner, [c for c in df.columns if c.lower() not in {m.lower() for m in (*MEASURES, "failed")}])], *[values[m].cast("long").alias(m) for m in MEASURES])


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of df without the text, the MEASURES, and failed: bit k is set where rule k is broken.

    The ledger is written to the shared folder, so whatever is asked of it later looks at no text again.
    """
    out = measure(df, text_col)
    failed = F.lit(0).cast("long")
    for k, r in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return write_table(out.withColumn("failed", failed).drop(text_col), "ledger")


def apply_policies(book: DataFrame, policies: Iterable[Policy] = POLICIES) -> DataFrame:
    """The ledger with one verdict a policy version: kept_<name>_v<version>."""
    return book.withColumns({f"kept_{p.name}_v{p.version}": p.keeps() for p in policies})


def ablation(book: DataFrame, policies: Iterable[Policy] = POLICIES) -> DataFrame:
    """policy, version, rule, n_docs, n_failed (break the rule), n_kept, n_kept_without (the policy without it), n_only (dropped by
    it alone), words_only (their words).  A row for each rule of each policy; none for an empty ledger."""
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))  # 2 ** rules rows at most
    grid = [(p.name, p.version, r.name, 1 << k, p.mask, p.allowed) for p in policies for k, r in enumerate(RULES) if r.name in p.rules]
    grid = book.sparkSession.createDataFrame(grid, "policy string, version int, rule string, bit long, mask long, allowed int")
    pair = patterns.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(RULES))])).alias("_k")).withColumn("bit", F.expr("shiftleft(1L, _k)")).join(F.broadcast(grid), "bit")
    broken = F.col("failed").bitwiseAND(F.col("mask"))
    kept = F.bit_count(broken) <= F.col("allowed")
    without = F.bit_count(broken.bitwiseAND(F.bitwise_not(F.col("bit")))) <= F.col("allowed")
    total = lambda cond, of="n": F.coalesce(F.sum(F.when(cond, F.col(of))), F.lit(0))
    return pair.groupBy("policy", "version", "rule").agg(F.sum("n").alias("n_docs"), total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(kept).alias("n_kept"), total(without).alias("n_kept_without"), total(without & ~kept).alias("n_only"), total(without & ~kept, "words").alias("words_only"))


def profile(book: DataFrame, *by: str) -> DataFrame:
    """Per group: n_docs, any_failed (bits that some document breaks), all_failed (bits that all break), and the documents a rule."""
    rules = [F.count_if(F.getbit(F.col("failed"), F.lit(k)) == 1).alias(f"n_{r.name}") for k, r in enumerate(RULES)]
    return book.groupBy(*by).agg(F.count("*").alias("n_docs"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), *rules)
