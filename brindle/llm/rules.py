"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every text gets the base counts.  The verdict is a cascade: on a sample each rule's cost
(seconds a row) and selectivity (share of rows it rejects) are measured, and the rules are
chained in the order of rejection per cost; CASE stops at the first rule that rejects, so a
dear rule only sees what the cheap ones left.  The order changes the cost, never the verdict.

Defined results: a null, empty or blank text has no words and fails the base test; very long
texts cost n log n; repeated rows give repeated results; an empty table gives an empty table;
other columns are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD

#: Fixed values of the base test.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: The sample that orders the rules: about so many rows.
SAMPLE_ROWS = 2000
#: Times that a rule is tested on each row of the sample in a timed job, and runs of that job.
TIMES, RUNS = 5, 3


@dataclass(frozen=True)
class Rule:
    """A named test on text and base counts that is true where a row is to be rejected."""

    name: str
    sql: str


RULES = (
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("exclamations", "(length(text) - length(replace(text, '!', ''))) * 5 > n_words"),
    Rule("repeated_lines", "n_dup_lines * 2 > n_lines"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
    Rule("digits", "length(translate(text, '0123456789', '')) * 2 < length(text)"),
    Rule("capitals", r"regexp_count(text, '\\p{Lu}') * 2 > word_chars"),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the list."""
    hashes = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(ordered, marked)

    def marked(s: Column) -> Column:
        n = F.size(s)
        up = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return let(F.array_sort(F.array_distinct(F.flatten(up))), spread)

    def spread(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(repeats)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed).

    ``n_lines`` counts lines with a word.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = src.select("id", "text", counted.alias("w"), lined.alias("l")).select(
        "id",
        "text",
        F.col("w.n").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("l.d").alias("n_dup_lines"),
        F.col("l.n").alias("n_lines"),
        F.col("w.r").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumnRenamed("id", id_col)


def seconds(sample: DataFrame, sql: str) -> float:
    """The least time of a job that tests every row of the sample TIMES times."""
    tested = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(TIMES)))).agg(F.sum(F.expr(f"({sql}) AND again > 0").cast("int")))
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        tested.first()
        took.append(time.perf_counter() - began)
    return min(took)


def arranged(rules, costs: list[float], patterns: list[tuple[int, tuple[bool, ...]]]) -> list[Rule]:
    """By rejection per cost among the rows that the rules before leave; patterns: (rows, which rules reject)."""
    left, ordered = list(range(len(rules))), []
    while left:
        gain = lambda k: sum(n for n, hit in patterns if hit[k]) / costs[k]
        best = max(left, key=lambda k: (gain(k), -costs[k], -k))
        ordered.append(rules[best])
        left.remove(best)
        patterns = [(n, hit) for n, hit in patterns if not hit[best]]
    return ordered


def cascade(sample: DataFrame, rules=RULES) -> list[Rule]:
    """The rules in the order of rejection per cost, measured on ``sample`` (with the base counts).

    Cost is a rule's own time: that of a job with it less that of a job with an empty test.
    Selectivity is conditional, over the rows that the base test and the rules before leave.
    """
    passed = sample.where("NOT base_failed")
    tests = [F.coalesce(F.expr(r.sql), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    # At most one row for each combination of rules.
    patterns = [(r["count"], tuple(r[:-1])) for r in passed.select(*tests).groupBy(*(f"r{k}" for k in range(len(rules)))).count().collect()]
    empty = seconds(passed, "text IS NULL")
    return arranged(rules, [max(seconds(passed, r.sql) - empty, 1e-4) for r in rules], patterns)


def verdict(ordered: list[Rule]) -> Column:
    """True where no rule rejects; rules after the first that does are not evaluated."""
    return reduce(lambda rest, rule: F.when(F.expr(rule.sql), F.lit(False)).otherwise(rest), reversed(ordered), F.lit(True))


def sample_of(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base counts of about ``rows`` rows from a few partitions, computed once."""
    n = docs.count()
    part = docs.sample(False, min(1.0, 4 * rows / max(1, n)), 7).limit(rows)
    return measure(part, id_col, text_col).coalesce(1).persist()  # ``rows`` rows at most


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``measure`` with ``kept``: false if the base test fails, else the cascade's verdict."""
    sample = sample_of(docs, id_col, text_col)
    sample.count()  # persisted now, so that no rule's time includes reading and counting
    ordered = cascade(sample, rules)
    sample.unpersist()
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(ordered))
    return measure(docs, id_col, text_col).withColumn("kept", kept)


def result(docs: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs).select("doc_id", *names)


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), win AS (
    SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS s
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), twice AS (
    SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1
), cover AS (
    SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win SEMI JOIN twice USING (doc_id, s))
    GROUP BY doc_id
), counts AS (
    SELECT doc_id, text, len(words)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cover USING (doc_id)
), base AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words
            OR (length(text) - length(replace(text, '!', ''))) * 5 > n_words
            OR n_dup_lines * 2 > n_lines
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words
            OR length(regexp_replace(text, '[0-9]', '', 'g')) * 2 < length(text)
            OR length(regexp_replace(text, '\P{Lu}', '', 'g')) * 2 > word_chars) AS kept
FROM base
"""
