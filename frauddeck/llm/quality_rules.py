"""Quality rules as weak supervision, in DataFrame functions alone.

Rules look at counts of a whole text and vote good (1), bad (-1) or abstain (0). How often each
rule calls a bad and a good text bad, when it votes, and the share of bad texts are estimated
by expectation-maximisation without labels: the rows needed are the distinct vote patterns with
their counts (3**rules at most, whatever the input). A text's posterior probability of being
good replaces the demand that it pass every rule.

Texts that fail the base rule anyway take no part. Every step of the estimation is one aggregate
over the pattern table. Weak priors (``PRIOR`` pseudo-counts) say that a bad vote is rare, and much
likelier for a bad text than for a good one, of which a rule finds some only; steps stop when no
estimate moves by over ``SETTLED``, or after ``ROUNDS``.

Defined results: null and empty texts have no words, so every count is 0 and the base rule
fails them. Ids may be null or repeat; each row is judged by itself. An empty table estimates
the priors and returns no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frauddeck.session import ensure_checkpoint_dir

SPACES = r"\x20\x09-\x0D"
ROUNDS, SETTLED, PRIOR, KEEP = 25, 1e-4, 4.0, 0.5
BAD_WHEN_BAD, BAD_WHEN_GOOD, BAD_SHARE = 0.2, 0.005, 0.1
MIN_WORDS, MAX_REPEAT = 50, 50


def counts(docs: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """The ``passed`` columns (default ``doc_id``) and the counts of each whole text."""
    passed = ["doc_id"] if passed is None else passed
    names = [f"c{i}" for i in range(len(passed))]
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for x, c in zip(names, passed)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole"))
    rows = rows.withColumn("words", F.regexp_extract_all("whole", F.lit(f"[^{SPACES}]+"), F.lit(0)))
    n = F.size("words")
    word = lambda i: F.get(F.col("words"), i)
    three = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i")))
    # windows in order of their words, so that equal ones are neighbours
    rows = rows.withColumn("windows", F.when(n >= 4, F.array_sort(three)))
    w = F.col("windows")

    def twice(x, j):
        return (x["w"] == F.get(w, j - 1)["w"]) | (x["w"] == F.get(w, j + 1)["w"])
    found = F.filter(w, lambda x, j: F.coalesce(twice(x, j), (F.get(w, j - 1)["w"] == x["w"]), (F.get(w, j + 1)["w"] == x["w"]), F.lit(False)))
    rows = rows.withColumn("at", F.array_sort(F.transform(found, lambda x: x["i"])))
    at = F.col("at")
    # a window covers three words, less what the next one covers
    covered = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
    rows = rows.withColumn("lines", F.filter(F.split("whole", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    without = lambda signs: F.length("whole") - F.length(F.regexp_replace("whole", signs, ""))
    return rows.select(
        *[F.col(x).alias(c) for x, c in zip(names, passed)],
        n.cast("long").alias("n_words"),
        total(F.transform("words", F.length)).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(total(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]+").cast("long").alias("n_capitals"),
        without(r"[.!?]+").cast("long").alias("n_stops"),
        F.size(F.filter("words", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` does, else abstains."""
    name: str
    bad: str
    good: str


#: The rules, over the columns of ``counts``.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 100"),
    Rule("repetition", "n_repeat_words * 10 > n_words * 3", "n_repeat_words * 10 < n_words"),
    Rule("symbols", "n_symbols * 20 > word_chars", "n_symbols * 200 < word_chars"),
    Rule("lines", "n_dup_lines * 10 > n_lines * 3", "n_lines >= 2 and n_dup_lines = 0"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    Rule("capitals", "n_capitals * 10 > word_chars * 3", "n_capitals * 10 < word_chars"),
    Rule("short_words", "n_words >= 50 and n_short * 50 < n_words", "n_short * 10 between n_words and 7 * n_words"),
    Rule("sentences", "n_stops * 2 > n_words or (n_words >= 100 and n_stops = 0)", "n_stops * 3 < n_words and n_stops * 60 > n_words"),
)


def votes(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return rows.withColumns({f"v_{r.name}": F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules})


@dataclass(frozen=True)
class Model:
    """The share of bad texts, and each rule's rate of bad votes on bad and on good texts."""
    bad: float
    rates: dict[str, tuple[float, float]]


def posterior(model: Model) -> Column:
    """The probability that a text with columns ``v_<rule>`` is good."""
    from math import log
    odds = F.lit(log((1 - model.bad) / model.bad))
    for name, (a, b) in model.rates.items():
        v = F.col(f"v_{name}")
        odds = odds + F.when(v < 0, log(b / a)).when(v > 0, log((1 - b) / (1 - a))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the vote patterns of all rows."""
    ensure_checkpoint_dir(voted.sparkSession)
    names = [r.name for r in rules]
    patterns = voted.groupBy(*[f"v_{x}" for x in names]).agg(F.count("*").alias("n")).coalesce(1).checkpoint()  # 3**rules rows at most
    model = Model(BAD_SHARE, {x: (BAD_WHEN_BAD, BAD_WHEN_GOOD) for x in names})
    for _ in range(rounds):
        good, bad, v = F.col("n") * F.col("good"), F.col("n") * (1 - F.col("good")), lambda x: F.col(f"v_{x}")
        sums = [F.sum("n").alias("all"), F.sum(bad).alias("bad")]
        for x in names:
            sums += [F.sum(F.when(v(x) < 0, bad).otherwise(0.0)).alias(f"bb_{x}"), F.sum(F.when(v(x) != 0, bad).otherwise(0.0)).alias(f"b_{x}"),
                     F.sum(F.when(v(x) < 0, good).otherwise(0.0)).alias(f"gb_{x}"), F.sum(F.when(v(x) != 0, good).otherwise(0.0)).alias(f"g_{x}")]
        s = {k: float(x or 0) for k, x in patterns.withColumn("good", posterior(model)).agg(*sums).first().asDict().items()}
        rate = lambda hit, seen, prior: (hit + PRIOR * prior) / (seen + PRIOR)
        new = Model(rate(s["bad"], s["all"], BAD_SHARE), {x: (rate(s[f"bb_{x}"], s[f"b_{x}"], BAD_WHEN_BAD), rate(s[f"gb_{x}"], s[f"g_{x}"], BAD_WHEN_GOOD)) for x in names})
        moved = max([abs(new.bad - model.bad)] + [abs(p - q) for x in names for p, q in zip(new.rates[x], model.rates[x])])
        model = new
        if moved < SETTLED:
            break
    return model


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``good_probability`` of each document.

    ``good_probability`` is the posterior probability of a good text; ``kept`` is false where
    ``base_failed`` is true (under 50 words, or over half of them repeated), else it tells
    whether that probability reaches ``keep``.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    voted = votes(counts(docs), rules).checkpoint()  # numbers only; read by the estimation and the result
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    model = estimate(voted.where(~failed), rules)  # of the texts that the verdict is for
    rows = voted.withColumn("good_probability", posterior(model)).withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & (F.col("good_probability") >= keep)).alias("kept"), "good_probability")
