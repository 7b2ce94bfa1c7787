"""Quality rules as weak supervision (op 4). DataFrame functions only.

Each rule looks at a few figures of a text and votes good, bad or nothing. Expectation-maximisation over the table
of vote patterns (whose size depends on the rules only) estimates how often documents are good, in which ways others are
bad, and how each rule votes on each class; the posterior probability that a document is good takes the place of passing
all rules: a bad vote that others bear out rejects, one of a rule that votes at random doesn't.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, store

#: word: (figure, bad at or above, good at or below) or, with the bounds exchanged, bad at or below, good at or above.
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("symbols", "n_symbols / n_words", 0.10, 0.01),
    ("repeats", "n_repeat_words / n_words", 0.50, 0.20),
    ("duplicate_lines", "n_dup_lines / n_lines", 0.40, 0.05),
    ("word_chars", "word_chars / n_words", 12.0, 9.0),
    ("short_words", "word_chars / n_words", 2.0, 3.0),
    ("alphabetic", "n_alpha_words / n_words", 0.60, 0.80),
    ("distinct", "n_distinct_words / n_words", 0.15, 0.30),
)
LOW_IS_BAD = frozenset({"short_words", "alphabetic", "distinct"})
#: Bad votes of two rules go together if they do so this many times as often as by chance.
LIFT = 3.0
#: What is believed before data: weight (as a share of all documents) and the rate of bad votes on good documents.
BELIEF = (0.1, 0.005)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_distinct_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by a 64-bit hash; each is sorted
    with its place, so that equal ones are neighbours, and places of repeated ones are measured for overlap."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(F.slice(words, 1, n), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s):
        def repeated(x, i):
            return F.coalesce((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), F.lit(False))

        return F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    return _let(F.array_sort(windows), lambda s: _let(places(s), covered))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def figures(docs: DataFrame, *, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds FIGURES of each whole text, as longs. Null text has no words. No shuffle: everything is per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, WORD_SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    made = docs.withColumn("_words", words).withColumn("_lines", lines)
    f = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.regexp_replace(t, WORD_SPACE, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_alpha_words": F.size(F.filter("_words", lambda w: F.regexp_like(w, F.lit(r"\p{L}")))),
        "n_distinct_words": F.size(F.array_distinct("_words")),
    }
    return made.withColumns({prefix + k: F.coalesce(v, F.lit(0)).cast("long") for k, v in f.items()}).drop("_words", "_lines")


def vote(name: str, figure: str, bad: float, good: float) -> Column:
    """1 good, -1 bad, 0 nothing (also without words or lines)."""
    value = F.expr(figure.replace(" / n_lines", " / nullif(n_lines, 0)").replace(" / n_words", " / nullif(n_words, 0)"))
    low = name in LOW_IS_BAD
    is_bad, is_good = (value <= bad, value >= good) if low else (value >= bad, value <= good)
    return F.when(is_bad, -1).when(is_good, 1).otherwise(0).cast("int")


def votes() -> Column:
    return F.array(*[vote(*r) for r in RULES])


class LabelModel:
    """A latent class of good documents and several of bad ones, rules independent given the class. ``prior``: the share
    of each class; ``rates``: by class, then rule, the probability of each vote. Class 0 is the good one."""

    def __init__(self, prior: list[float], rates: list[list[dict[int, float]]]):
        self.prior, self.rates = prior, rates

    @staticmethod
    def kinds(patterns: dict[tuple[int, ...], int]) -> list[list[int]]:
        """Rules whose bad votes fall together far more often than by chance, in groups: each is a way to be bad. How
        good a rule is shows in its agreement with others only, so one that agrees with none has no class."""
        n, total = len(next(iter(patterns), ())), sum(patterns.values())
        bad = [sum(c for p, c in patterns.items() if p[r] < 0) for r in range(n)]
        group = list(range(n))
        for r in range(n):
            for s in range(r):
                both = sum(c for p, c in patterns.items() if p[r] < 0 and p[s] < 0)
                chance = bad[r] * bad[s] / max(1, total)
                if both >= LIFT * chance and both - chance > 3 * math.sqrt(chance + 1):
                    group = [group[s] if g == group[r] else g for g in group]
        return [m for g in sorted(set(group)) if len(m := [r for r in range(n) if group[r] == g]) > 1]

    @classmethod
    def fit(cls, patterns: dict[tuple[int, ...], int], rounds: int = 500) -> LabelModel:
        """Expectation-maximisation over counted vote patterns, in plain arithmetic: shares of classes and vote rates of
        all rules are learnt. It starts from documents with a bad vote of a group being of its class. That good documents
        get few bad votes is a prior (BELIEF), which much data overrule; a bad class's rules vote bad on it at least as
        often as on good documents. Patterns in equal shares give equal results at any size."""
        groups, total = cls.kinds(patterns), sum(patterns.values())
        n, classes = len(next(iter(patterns), ())), 1 + len(groups)
        post = {}
        for p in patterns:
            hits = [sum(p[r] < 0 for r in g) for g in groups]
            some = 0.95 if any(hits) else 0.0
            post[p] = [1 - some, *(some * h / max(1, sum(hits)) for h in hits)]
        weight, alarm = BELIEF
        model = cls([1.0, *[0.0] * len(groups)], [[{-1: alarm, 0: 0.5 * (1 - alarm), 1: 0.5 * (1 - alarm)}] * n] * classes)
        for _ in range(rounds if groups else 0):
            mass = [sum(c * post[p][k] for p, c in patterns.items()) for k in range(classes)]
            rates = []
            for k in range(classes):
                row = []
                for r in range(n):
                    seen = {v: sum(c * post[p][k] for p, c in patterns.items() if p[r] == v) for v in (-1, 0, 1)}
                    prior = {-1: alarm, 0: 0.5 * (1 - alarm), 1: 0.5 * (1 - alarm)} if k == 0 else dict.fromkeys((-1, 0, 1), 1 / 3)
                    strength = weight * total if k == 0 else weight * mass[k] * 0.01
                    seen = {v: x + strength * prior[v] + 1e-9 for v, x in seen.items()}
                    if k and r in groups[k - 1]:
                        least = rates[0][r][-1] * sum(seen.values())
                        seen[-1] = max(seen[-1], least)
                    row.append({v: x / sum(seen.values()) for v, x in seen.items()})
                rates.append(row)
            model = cls([m / total for m in mass], rates)
            fresh = {p: model.posteriors(p) for p in patterns}
            if max(abs(x - y) for p in patterns for x, y in zip(fresh[p], post[p], strict=True)) < 1e-9:
                break
            post = fresh
        return model

    def posteriors(self, p: tuple[int, ...]) -> list[float]:
        logs = [math.log(max(m, 1e-300)) + sum(math.log(max(row[r][v], 1e-300)) for r, v in enumerate(p)) for m, row in zip(self.prior, self.rates, strict=True)]
        top = max(logs)
        each = [math.exp(x - top) for x in logs]
        return [x / sum(each) for x in each]

    def posterior(self, p: tuple[int, ...]) -> float:
        """The probability that a document with these votes is good."""
        return self.posteriors(p)[0]

    def column(self) -> Column:
        """``posterior`` of the column ``votes``."""

        def log_odds(k):
            out = F.lit(math.log(max(self.prior[k], 1e-300) / max(self.prior[0], 1e-300)))
            for r, (bad, good) in enumerate(zip(self.rates[k], self.rates[0], strict=True)):
                w = {v: math.log(max(bad[v], 1e-300) / max(good[v], 1e-300)) for v in (-1, 0, 1)}
                v = F.get("votes", F.lit(r))
                out = out + F.when(v < 0, w[-1]).when(v > 0, w[1]).otherwise(w[0])
            return out

        return 1 / sum((F.exp(log_odds(k)) for k in range(1, len(self.prior))), F.lit(1.0))


def quality(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of docs with FIGURES, votes, p_good, base_failed and kept. One row per row of ``docs``; a kept
    column with one of those names gives way to it.

    Null or empty text has no words and so fails the base rules. Figures are computed once and written to the shared
    folder; the vote patterns (at most 3 to the number of rules) come to the driver. An empty table gives no rows.
    """
    keep = [c for c in keep if c not in (*FIGURES, "votes", "p_good", "base_failed", "kept", "_text")]
    rows = docs.select(F.col(text).alias("_text"), *keep)
    seen = store(figures(rows, text="_text").drop("_text").withColumn("votes", votes()), "figures")
    patterns = {tuple(r.votes): r.n for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = LabelModel.fit(patterns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.withColumn("p_good", model.column()).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= threshold))


def filter_quality(docs: DataFrame, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Columns may have any names."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))
    return quality(inner, text="_text", threshold=threshold, keep=("_row",)).where("kept").select("_row.*")
