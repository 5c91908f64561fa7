"""Quality rules that vote, and a label model that weighs their votes.

Each rule looks at counts of a text and votes good (+1), bad (-1) or abstains
(0). Expectation-maximisation over the vote patterns of all documents estimates
how often each rule votes good, votes bad and abstains for good documents and for
bad ones, and from that the posterior probability that a document is good. That
probability replaces the usual demand that all rules pass. Abstaining counts as
evidence too, as far as it is more frequent in one of the classes.

The classes are what several rules agree on. So that there is something to agree
on, symbols are looked at in two ways, per word and per character.
"""

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import WORD_BREAK, word_list
from linkloom.operators.storage import RunFolder

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
LONG_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _hash_windows(words: Column) -> Column:
    """One hash for each window of five words."""
    def window(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= WINDOW, F.transform(starts, window)).otherwise(none)


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; linear but for one sort.

    Windows are sorted by hash, so equal ones are neighbours; the places of those
    that have a neighbour are sorted, and each adds the words up to the next.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        def has_equal(x: Column, k: Column) -> Column:
            before = F.get(ordered, k - 1)["h"] == x["h"]
            after = F.get(ordered, k + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, has_equal), lambda x: x["i"]))

    def spans(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        def add(acc: Column, p: Column) -> Column:
            step = F.least(p - acc["last"], F.lit(WINDOW))
            return F.struct((acc["n"] + step).alias("n"), p.alias("last"))
        return F.aggregate(places, start, add, lambda acc: acc["n"])

    # As a lambda's argument the sorted array is made once, not once per use.
    return F.get(F.transform(F.array(placed), lambda ordered: spans(repeated(ordered))), F.lit(0))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``LONG_COUNTS``; a null text has no words or lines."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumn("_words", word_list(body)).withColumn("_lines", lines)
    staged = staged.withColumn("_windows", _hash_windows(F.col("_words")))
    no_repeat = F.size(F.array_distinct("_windows")) == F.size("_windows")
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.regexp_replace(body, WORD_BREAK, "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(no_repeat, 0).otherwise(_covered(F.col("_windows"))),
        "n_lines": F.size("_lines"),
    }
    counted = staged.withColumns({k: v.cast("long") for k, v in counts.items()})
    return counted.drop("_words", "_lines", "_windows")


@dataclass(frozen=True)
class VotingRule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds; SQL conditions."""

    name: str
    bad: str
    good: str


RULES = (
    VotingRule("length", "n_words < 20", "n_words >= 100"),
    VotingRule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words", "2 * word_chars >= 9 * n_words AND word_chars <= 6 * n_words"),
    VotingRule("symbols", "10 * n_symbols > n_words", "n_symbols = 0"),
    VotingRule("symbol_share", "20 * n_symbols > word_chars", "100 * n_symbols <= word_chars"),
    VotingRule("repetition", "10 * n_dup_lines > 3 * n_lines OR 10 * n_repeat_words > n_words", "n_repeat_words = 0 AND n_dup_lines = 0"),
    VotingRule("line_length", "n_words > 500 * n_lines OR n_words < 2 * n_lines", "n_words >= 5 * n_lines AND n_words <= 100 * n_lines"),
)
ITERATIONS = 60
VOTES = (-1, 0, 1)
#: Rates of voting bad, abstaining and voting good that estimation starts from, for
#: bad and for good documents. They say which of the hidden classes is the good one.
START = ((0.4, 0.3, 0.3), (0.1, 0.2, 0.7))
START_PRIOR = 0.8
#: Documents that are added to each count, so that no rate is zero.
SMOOTHING = 1.0
KEEP_FROM = 0.5
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and per class (bad, good) and rule the rates of ``VOTES``."""

    prior: float
    rates: tuple[tuple[tuple[float, ...], ...], ...]

    def weight(self, rule: int, vote: int) -> float:
        """What a rule's vote adds to the log-odds of a good document."""
        bad, good = (of_class[rule][VOTES.index(vote)] for of_class in self.rates)
        return math.log(good) - math.log(bad)

    @property
    def accuracies(self) -> tuple[float, ...]:
        """How often each rule is right when it votes."""
        of_rules = zip(*self.rates)
        votes = (((1 - self.prior) * bad[0], self.prior * good[2], (1 - self.prior) * bad[2] + self.prior * good[0]) for bad, good in of_rules)
        return tuple((right_bad + right_good) / (right_bad + right_good + wrong) for right_bad, right_good, wrong in votes)

    @property
    def start(self) -> float:
        return math.log(self.prior) - math.log(1 - self.prior)

    def log_odds(self, votes) -> float:
        return self.start + sum(self.weight(rule, vote) for rule, vote in enumerate(votes))

    def posterior(self, votes: list[Column]) -> Column:
        """The same as a column over vote columns."""
        total = F.lit(self.start)
        for rule, vote in enumerate(votes):
            weights = F
            for v in VOTES:
                weights = weights.when(vote == v, F.lit(self.weight(rule, v)))
            total = total + weights
        return 1 / (1 + F.exp(-total))


def fit_label_model(patterns: Mapping[tuple[int, ...], int], rules: int) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    Without documents the model keeps its start.
    """
    model = LabelModel(START_PRIOR, tuple((of_class,) * rules for of_class in START))
    total = sum(patterns.values())
    for _ in range(ITERATIONS if total else 0):
        good = 0.0
        counts = [[[SMOOTHING] * len(VOTES) for _ in range(rules)] for _ in START]
        for votes, count in sorted(patterns.items()):
            p = 1 / (1 + math.exp(-model.log_odds(votes)))
            good += count * p
            for rule, vote in enumerate(votes):
                at = VOTES.index(vote)
                counts[0][rule][at] += count * (1 - p)
                counts[1][rule][at] += count * p
        rates = tuple(tuple(tuple(n / sum(of_rule) for n in of_rule) for of_rule in of_class) for of_class in counts)
        model = LabelModel((good + SMOOTHING) / (total + 2 * SMOOTHING), rates)
    return model


def vote_columns(rules: tuple[VotingRule, ...]) -> list[Column]:
    return [
        F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"vote_{r.name}") for r in rules
    ]


def judge_quality(counted: DataFrame, rules: tuple[VotingRule, ...] = RULES) -> DataFrame:
    """``counted`` with ``quality``, the posterior probability of a good document.

    ``counted`` should be a stored table, as it is read twice. Only the counts of
    vote patterns, at most three to the power of the number of rules, reach the
    driver.
    """
    votes = vote_columns(rules)
    rows = counted.groupBy(*votes).count().collect()
    model = fit_label_model({tuple(r)[:-1]: r["count"] for r in rows}, len(rules))
    return counted.withColumn("quality", model.posterior(votes))


def quality_filter(docs: DataFrame, keys: list[str], text: str = "text", rules: tuple[VotingRule, ...] = RULES) -> DataFrame:
    """``keys``, counts, ``base_failed``, ``quality`` and ``kept`` for every row of ``docs``.

    Repeated rows are judged one by one and an empty table gives an empty result.
    Null and blank texts have no words and fail the base rules.
    """
    run = RunFolder(docs.sparkSession, "quality")
    body = docs.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").alias("_text"))
    counted = run.keep(text_counts(body, "_text").drop("_text"), "counts")
    failed = F.expr(BASE_FAILED)
    return judge_quality(counted, rules).withColumns(
        {"base_failed": failed, "kept": ~failed & (F.col("quality") >= KEEP_FROM)}
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts, base verdict and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_filter(docs, ["doc_id"]).select(
        "doc_id", *LONG_COUNTS[:5], "base_failed", "kept"
    )


def _sql() -> str:
    n = len(RULES)
    cases = [f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in RULES]
    votes = ", ".join(f"{c} AS v{i}" for i, c in enumerate(cases))
    names = ", ".join(f"v{i}" for i in range(n))
    # Column b0_1, z0_1, g0_1: rates of rule 0 to vote bad, abstain and vote good for good documents (1).
    weights = "".join(
        f" + CASE v{i} WHEN -1 THEN ln(b{i}_1) - ln(b{i}_0) WHEN 0 THEN ln(z{i}_1) - ln(z{i}_0) ELSE ln(g{i}_1) - ln(g{i}_0) END"
        for i in range(n)
    )
    p = f"(1 / (1 + exp(-(ln(pi) - ln(1 - pi){weights}))))"
    of_class = {0: "c * (1 - p)", 1: "c * p"}
    rates = ", ".join(
        f"({SMOOTHING} + sum(CASE WHEN v{i} = {v} THEN {of_class[k]} ELSE 0 END)) / ({len(VOTES) * SMOOTHING} + sum({of_class[k]})) AS {letter}{i}_{k}"
        for i in range(n) for k in (0, 1) for letter, v in zip("bzg", VOTES)
    )
    start = ", ".join(
        f"CAST({START[k][v]} AS DOUBLE) AS {letter}{i}_{k}" for i in range(n) for k in (0, 1) for v, letter in enumerate("bzg")
    )
    blank = r"[ \t\n\x0b\f\r]"
    return f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT id, doc_id, text,
  list_filter(regexp_split_to_array(text, '{blank}+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS lines FROM src),
wins AS (SELECT id, i, w[i:i+{WINDOW - 1}] AS win FROM (SELECT id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM listed WHERE len(w) >= {WINDOW})),
twice AS (SELECT id, i, count(*) OVER (PARTITION BY id, win) AS n FROM wins),
covered AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + {WINDOW})) AS p FROM twice WHERE n > 1) GROUP BY id),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines
  FROM listed LEFT JOIN covered c USING (id)),
voted AS (SELECT *, {votes} FROM counted),
patterns AS (SELECT {names}, count(*) AS c FROM voted GROUP BY ALL),
em AS (
  SELECT 0 AS it, CAST({START_PRIOR} AS DOUBLE) AS pi, {start}
  UNION ALL
  SELECT it + 1, (sum(c * p) + {SMOOTHING}) / (sum(c) + {2 * SMOOTHING}) AS pi, {rates}
  FROM (SELECT em.it, patterns.*, {p} AS p FROM em, patterns WHERE em.it < {ITERATIONS}) GROUP BY it),
model AS (SELECT * FROM em WHERE it = {ITERATIONS})
SELECT doc_id, {', '.join(LONG_COUNTS[:5])}, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND {p} >= {KEEP_FROM} AS kept
FROM voted, model
"""


QUALITY_SQL = _sql()
