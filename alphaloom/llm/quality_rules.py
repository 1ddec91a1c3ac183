"""Quality rules under weak supervision, in DataFrame operations only.

Rules look at counts of a text and vote for good (1) or bad (0), or abstain (null) where their
count says little. Nobody tells which rules are right: expectation-maximisation estimates, from how
the votes of all documents agree, each rule's chance to vote good on good and on bad documents and
the share of good documents. The posterior probability of being good replaces a filter that every
rule must pass. The estimation works on counts of vote patterns, of which there are at most
3 ** rules, whatever the number of documents.

Counts are made inside each row, so that no word leaves its document.

Defined results: a null text has no words, is judged by the same rules and fails the base check;
repeated rows are judged alike; a null id is kept; an empty table gives an empty table; other
columns of ``judge`` are kept, but for those with the names that it adds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import GAP, WORD, stored


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio of two counts: bad outside of ``bad_below`` and ``bad_above``, good inside the narrower two."""

    name: str
    part: str
    whole: str
    good_from: float
    good_to: float
    bad_below: float
    bad_above: float

    def vote(self) -> Column:
        """1 good, 0 bad, null abstains; a whole of nothing abstains."""
        ratio = F.try_divide(F.col(self.part).cast("double"), F.col(self.whole).cast("double"))
        inside = F.when((F.col(self.whole) > 0) & ((ratio < self.bad_below) | (ratio > self.bad_above)), 0)
        return inside.when((F.col(self.whole) > 0) & ratio.between(self.good_from, self.good_to), 1)


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 3.0, 9.0, 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.02, 0.0, 0.1),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.1, 0.0, 0.4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.05, 0.0, 0.3),
    Rule("capitals", "n_capitals", "n_letters", 0.0, 0.08, 0.0, 0.3),
    Rule("letters", "n_letters", "word_chars", 0.93, 1.0, 0.88, 1.0),
    Rule("words_without_letters", "n_wordless", "n_words", 0.0, 0.05, 0.0, 0.2),
    Rule("distinct_words", "n_distinct", "n_words", 0.2, 1.0, 0.05, 1.0),
    Rule("marks_in_a_row", "n_mark_runs", "n_words", 0.0, 0.02, 0.0, 0.2),
)
MIN_WORDS = 50
ROUNDS = 25
#: Estimated chances stay this far from 0 and 1.
MARGIN = 0.01
GOOD = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "n_distinct", "n_mark_runs", "n_wordless")


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the counts that the rules look at; columns with the names of counts give way.

    Repeated words are those in windows of three that occur twice or more in the text. Windows are
    sorted with their places, so that equal ones are neighbours; a repeated window then covers its
    own start and the two words behind it, or as many as come before the next repeated window.
    """
    # All columns travel in one, so that their names clash with none here.
    kept = [c for c in df.columns if c not in COUNTS]
    own = [F.col("_d")]
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = df.select(F.struct(F.lit(None).cast("int").alias("_none"), *kept).alias("_d"), whole.alias("_t"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("_w"))
    # A window is one string, its words apart by a blank, which no word holds.
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    lines = F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(WORD))
    parts = parts.select(*own, "_t", "_w", lines.alias("_l"), F.when(F.size("_w") >= 3, window).otherwise(F.array().cast("array<string>")).alias("_3"))
    sorted_ = F.array_sort(F.transform("_3", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    parts = parts.select(*own, "_t", "_w", "_l", F.when(F.size("_3") > F.size(F.array_distinct("_3")), sorted_).alias("_p"))

    def repeated(p: Column, k: Column) -> Column:
        twin = F.get("_p", k - 1)["w"].eqNullSafe(p["w"]) | F.get("_p", k + 1)["w"].eqNullSafe(p["w"])
        return F.when(twin, p["i"])

    starts = F.array_sort(F.filter(F.transform("_p", repeated), lambda i: i.isNotNull()))
    parts = parts.select(*own, "_t", "_w", "_l", starts.alias("_h"))
    covered = F.transform("_h", lambda i, k: F.least(F.coalesce(F.get("_h", k + 1) - i, F.lit(3)), F.lit(3)))
    left = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    return parts.select(
        *(F.col("_d")[c].alias(c) for c in kept),
        F.size("_w").cast("long").alias("n_words"),
        left(GAP).alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, n: a + n), F.lit(0)).cast("long").alias("n_repeat_words"),
        left(r"\P{Lu}+").alias("n_capitals"),
        left(r"\P{L}+").alias("n_letters"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count("_t", F.lit(r"[!?#*$%&|<>]{2,}")).cast("long").alias("n_mark_runs"),
        F.regexp_count("_t", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_wordless"),
    )


@dataclass(frozen=True)
class Estimate:
    """Share of good documents, and each rule's chance to vote good on good and on bad documents."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for vote, good, bad in zip(votes, self.on_good, self.on_bad):
            odds = odds + F.when(vote == 1, F.lit(math.log(good / bad))).when(vote == 0, F.lit(math.log((1 - good) / (1 - bad)))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation over the counts of vote patterns."""
    patterns = stored(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes")
    now = Estimate(0.7, (0.9,) * len(names), (0.4,) * len(names))
    bound = lambda x: min(max(x, MARGIN), 1 - MARGIN)
    for _ in range(rounds):
        good = now.posterior([F.col(c) for c in names]) * F.col("n")
        bad = F.col("n") - good
        sums = [F.sum("n").alias("n"), F.sum(good).alias("good")]
        for k, c in enumerate(names):
            for label, weight in (("g", good), ("b", bad)):
                sums.append(F.sum(F.when(F.col(c) == 1, weight)).alias(f"{label}{k}"))
                sums.append(F.sum(F.when(F.col(c).isNotNull(), weight)).alias(f"{label}{k}_all"))
        s = patterns.agg(*sums).first()
        if not s["n"]:
            return now
        # One vote as at the start keeps rules that nearly always abstain in place.
        rate = lambda label, k, start: bound(((s[f"{label}{k}"] or 0.0) + start) / ((s[f"{label}{k}_all"] or 0.0) + 1))
        new = Estimate(bound(s["good"] / s["n"]), tuple(rate("g", k, 0.9) for k in range(len(names))), tuple(rate("b", k, 0.4) for k in range(len(names))))
        moved = max(abs(x - y) for x, y in zip((new.share, *new.on_good, *new.on_bad), (now.share, *now.on_good, *now.on_bad)))
        now = new
        if moved < 1e-6:
            break
    return now


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns but the text, the counts, base_failed, the posterior of being good, and kept."""
    added = ("base_failed", "posterior", "kept")
    columns = [c for c in df.columns if c not in (*COUNTS, *added, text)]
    own = df.select(F.struct(F.lit(None).cast("int").alias("_none"), *columns).alias("_d"), F.col(text).alias("_text"))
    names = [f"vote_{r.name}" for r in rules]
    counted = counts(own, "_text").drop("_text")
    voted = stored(counted.select("*", *(r.vote().alias(c) for r, c in zip(rules, names))), "quality-votes")
    posterior = estimate(voted, names).posterior([F.col(c) for c in names])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("posterior", posterior)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= GOOD))
    return judged.select(*(F.col("_d")[c].alias(c) for c in columns), *COUNTS, *added)
