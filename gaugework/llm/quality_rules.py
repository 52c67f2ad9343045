"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every document gets the counts of :func:`with_counts`. A rule is a condition that rejects; the
cascade measures each rule's running time and share of rejected rows on a sample, sorts the rules
by rejection per second and becomes one ``CASE`` expression, so that a document is tested only
until the first rule that rejects it. The order changes the work, never the verdict.

Defined results: a null text counts as empty and fails; a text without words fails; repeated rows
are judged one by one; extra columns are kept by the operator and ignored by the rules; over an
empty table the rules keep their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import narrowed, table, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5
#: Rows that the cost and selectivity of the rules are estimated on; the verdict uses all rows.
SAMPLE_ROWS = 2_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; a lambda would compute an outer expression
    anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(hashes: Column) -> Column:
    """How many positions the windows of ``hashes`` cover that occur twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        def start(k: Column) -> Column:
            same = lambda j: F.coalesce(F.get(p, j)["h"] == F.get(p, k)["h"], F.lit(False))
            before = F.when(k > 0, same(k - 1)).otherwise(F.lit(False))
            return F.when(before | same(k + 1), F.get(p, k)["i"])

        found = F.transform(F.sequence(F.lit(0), F.size(p) - 1), start)
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct(
        (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")
    )
    return F.aggregate(let(pairs, starts), none, step, lambda acc: acc["n"])


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that a text holds twice or more. Windows are
    compared by 64-bit hash; only a text that has a repeated one is sorted."""

    def hashes(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window)

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h))
    one_by_one = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, 0).otherwise(let(let(one_by_one, hashes), counted))


def duplicate_lines(text: Column) -> Column:
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    lines = F.filter(F.split(text, "\n"), worded)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def with_counts(documents: DataFrame) -> DataFrame:
    """``documents`` with words, counts and ``base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.withColumn("words", words_of(F.col("text"))).withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(without(text, SPACES)).cast("long"),
            "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": duplicate_lines(text).cast("long"),
            "n_repeat_words": repeated_words(F.col("words")).cast("long"),
        }
    )
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the condition that throws a document out, over the counted columns."""

    name: str
    rejects: Callable[[], Column]


def _upper() -> Column:
    return 2 * F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\p{Lu}")) > F.col("word_chars")


def _unlettered() -> Column:
    bare = F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}")))
    return 10 * bare > 2 * F.col("n_words")


RULES = (
    Rule("capitals", _upper),
    Rule("words_without_letters", _unlettered),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.size(F.split("text", "\n"))),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(
        "word_length",
        lambda: (F.col("word_chars") < 2 * F.col("n_words"))
        | (F.col("word_chars") > 14 * F.col("n_words")),
    ),
)


def ordered(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), the most rejection per second first, measured on at most
    ``SAMPLE_ROWS`` rows."""
    sample = counted.limit(SAMPLE_ROWS).persist()
    try:
        rows = sample.count()
        if not rows:
            return [(rule, 0.0, 0.0) for rule in rules]
        found = []
        for rule in rules:
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(rule.rejects())).first()[0]
            found.append((rule, time.perf_counter() - began, rejected / rows))
        return sorted(found, key=lambda x: -x[2] / max(x[1], 1e-6))
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.rejects(), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with their counts, ``base_failed``, ``rejected_by`` and ``kept``."""
    counted = with_counts(documents)
    best = [rule for rule, _, _ in ordered(counted.where(~F.col("base_failed")), rules)]
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(best))
    return counted.withColumn("rejected_by", verdict).withColumn(
        "kept", F.col("rejected_by").isNull()
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return judge(documents).select("doc_id", *COLUMNS, "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
pos AS (SELECT k, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
win AS (SELECT pos.k, i, array_to_string(list_slice(words, i, i + 4), ' ') AS win FROM pos JOIN w USING (k)),
rep AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, win) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT k, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM rep) GROUP BY k),
c AS (
  SELECT doc_id, text, words, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > word_chars
    OR 10 * len(list_filter(words, lambda x: NOT regexp_matches(x, '\p{L}'))) > 2 * n_words
    OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
    OR 10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM f
"""
