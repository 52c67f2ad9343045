"""F2 of round 4: each text is cut once, and an edited text takes over the paragraphs it keeps."""

import random

from pyspark.sql import functions as F
from test_llm import EDGES, SF, frame

from gaugework.llm import fingerprints


def odd_texts(n, seed):
    r = random.Random(seed)
    parts = [*"ned.xy$\\\0é日", "\n", "\n\n", " ", "  ", "\t", "\x0b", "\f", "\r", "\x1c", "\x85", "\xa0", "$0", "word ", "end. "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_leaves_are_those_of_the_pattern(spark):
    lines = [(0, x.replace("\n", " ")) for x in odd_texts(500, 1)] + [(0, "n" * 50_000), (0, "x" * 50_000 + " "), (0, "")]
    found = frame(spark, lines).select(
        fingerprints._leaves_of(F.col("text")).alias("a"),
        F.regexp_extract_all("text", F.lit(fingerprints._LEAF), F.lit(0)).alias("b"),
    )
    assert found.where("a <> b").count() == 0 and found.where("size(b) > 3").count() > 100


def test_edited_texts_have_the_paragraphs_of_their_own(spark):
    rows = [(i, x) for i, x in enumerate(odd_texts(400, 2))] + EDGES
    met = fingerprints.with_edited(fingerprints.with_successor(frame(spark, rows), fingerprints._with_tree))
    wrong = met.where(
        (F.col("edited_paragraphs") != fingerprints.paragraphs(F.col("edited")))
        | (F.col("next_fingerprint") != fingerprints.fingerprint(F.col("next_text")))
    )
    assert met.count() == len(rows) and wrong.count() == 0


def test_a_text_is_cut_once(spark):
    plan = fingerprints.op5_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Once for all lines of a text, once for the new lines of an edited one; before: three whole texts.
    assert plan.count(fingerprints._MARKS) == 2
    # The trees are made behind the shuffle and sorted rows stay so: one sort of texts.
    assert plan.count("Sort [range") == 1 and plan.count("hashpartitioning(range") == 1
