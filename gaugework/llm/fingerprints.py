"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections, in DataFrame
functions only.

A paragraph is a line, a leaf is a clause of it (words up to one that ends in a mark), a
section is a run of paragraphs that ends after a paragraph whose digest falls into a quarter of
all digests, so that an insertion moves no later border. The tree is written as one string,

    root : leaf , leaf / leaf ; leaf ...

with ``,`` between leaves, ``/`` after a paragraph and ``;`` after the last paragraph of a
section. Inner nodes are SHA-256 digests of what stands below them, so equal roots mean equal
texts; sections and paragraphs that differ locate an edit.

Defined results: a null text counts as empty, which has a tree of one paragraph without leaves;
equal texts have equal fingerprints and likeness 1; an empty text and another one have likeness 0;
for the successor, rows without id come last, rows that share an id are ordered by text hash and
text, a single row succeeds itself; extra columns are ignored by the query, kept by
:func:`with_fingerprint`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm.common import narrowed, table
from gaugework.llm.quality_rules import let

LEAF_DIGITS = 12
#: A leaf ends with white space behind one of these characters; the letters keep leaves short in
#: texts without punctuation.
_MARKS = r"ned.!?;:,|*$%&#"
_LEAF = rf"[\s\S]*?[{_MARKS}](?:\s+|\z)|[\s\S]+"
#: Rows per group when texts meet their successors, and the most groups.
GROUP_ROWS, MOST_GROUPS = 2_000, 65_536


def _leaves_of(line: Column) -> Column:
    """What ``_LEAF`` finds in a line, which has no line feed: one is put behind each leaf. Lazy
    matching took three times as long."""
    marked = F.regexp_replace(line, rf"[{_MARKS}]\s+", "$0\n")
    return F.array_remove(F.split(marked, "\n"), "")


def _paragraph(line: Column) -> Column:
    digest = lambda leaf: F.substring(F.sha2(leaf, 256), 1, LEAF_DIGITS)
    leaves = F.transform(_leaves_of(line), digest)
    closes = lambda s: F.substring(F.sha2(s, 256), 1, 1).isin(*"0123")
    end = lambda s: F.concat(s, F.when(closes(s), F.lit(";")).otherwise(F.lit("/")))
    return let(F.array_join(leaves, ","), end)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text as its tree has them, each with what ends it."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _paragraph)


def _tree(parts: Column) -> Column:
    """The tree over paragraphs, root first."""
    nodes = lambda s: F.transform(F.split(s, ";"), lambda x: F.sha2(x, 256))
    root = lambda s: F.substring(F.sha2(F.array_join(nodes(s), ","), 256), 1, 32)
    return let(F.array_join(parts, ""), lambda s: F.concat(root(s), F.lit(":"), s))


def fingerprint(text: Column) -> Column:
    """The tree of a text, root first."""
    return _tree(paragraphs(text))


def root(tree: Column) -> Column:
    return F.substring(tree, 1, 32)


def _body(tree: Column) -> Column:
    return F.substring(tree, F.lit(34), F.length(tree))


def leaves(tree: Column) -> Column:
    """The different leaf digests."""
    return F.array_remove(F.array_distinct(F.split(_body(tree), "[,;/]+")), "")


def _likeness(a: Column, x: Column, b: Column, y: Column) -> Column:
    """:func:`likeness` of the trees ``a`` and ``b``, whose leaves are ``x`` and ``y``."""
    both = F.size(x) + F.size(y)
    shared = F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)
    return F.when(root(a) == root(b), 1.0).otherwise(shared)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the shared leaves over the leaves of both (0 to 1)."""
    return let(leaves(a), lambda x: let(leaves(b), lambda y: _likeness(a, x, b, y)))


def changed_sections(before: Column, after: Column) -> Column:
    """Positions (from 0) of the sections of ``after`` that ``before`` lacks."""

    def positions(old: Column, new: Column) -> Column:
        at = F.transform(new, lambda s, i: F.when(~F.array_contains(old, s), i))
        return F.filter(at, lambda i: i.isNotNull())

    compare = let(F.split(_body(before), ";"), lambda x: let(F.split(_body(after), ";"), lambda y: positions(x, y)))
    none = F.array().cast("array<int>")
    return F.when(root(before) == root(after), none).otherwise(compare)


def changed_paragraphs(before: Column, after: Column) -> Column:
    """Positions (from 0) of the paragraphs of ``after`` that ``before`` lacks, looked for only
    where roots differ."""

    def positions(old: Column, new: Column) -> Column:
        at = F.transform(new, lambda s, i: F.when(~F.array_contains(old, s), i))
        return F.filter(at, lambda i: i.isNotNull())

    cut = lambda t: F.split(F.regexp_replace(_body(t), "[;/]$", ""), "[;/]")
    compare = let(cut(before), lambda x: let(cut(after), lambda y: positions(x, y)))
    return F.when(root(before) == root(after), F.array().cast("array<int>")).otherwise(compare)


def with_fingerprint(documents: DataFrame, column: str = "fingerprint") -> DataFrame:
    return documents.withColumn(column, fingerprint(F.col("text")))


def with_successor(documents: DataFrame, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(doc_id, text, next_text): each document beside the next one in descending doc_id. Columns
    that ``derive`` adds to the rows come along, those of the next document as ``next_...``; they
    are made behind the shuffle, so they do not move, and once for a text.

    Ids are cut into ranges; each range is sorted on its own, and the first rows of a range are
    also dealt to the end of the range before it (those of the first to the last), so texts move
    once. What the driver sees are the cuts; what is broadcast is one row per range, at most
    ``MOST_GROUPS``. Ids are taken to be nearly unique: rows that share one stay in one range.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = documents.select(F.col("doc_id"), text)
    ids = rows.where(F.col("doc_id").isNotNull()).select("doc_id")
    n = ids.count()
    groups = min(MOST_GROUPS, max(1, n // GROUP_ROWS))
    cuts = []
    if groups > 1:
        levels = [i / groups for i in range(1, groups)]
        cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", levels, 0.1 / groups)})
    steps = F.expr(f"array({', '.join(str(1 << k) for k in reversed(range(max(1, len(cuts).bit_length()))))})")
    cut = F.expr(f"array({', '.join(f'{c}L' for c in cuts) or 'cast(null as long)'})")
    below = lambda p, s: F.coalesce(F.get(cut, p + s - 1) <= F.col("doc_id"), F.lit(False))
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when(below(p, s), p + s).otherwise(p))
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place)
    heads = documents.select("doc_id", place.alias("own")).groupBy("own").agg(
        F.max("doc_id").alias("head")
    )
    down = Window.orderBy(F.desc("own"))  # one row per range
    first_of = F.last("own").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("before", F.coalesce(F.lag("own").over(down), first_of))
    place_of = lambda c, guest: F.struct(F.col(c).alias("range"), F.lit(guest).alias("guest"))
    dealt = (
        rows.withColumn("own", place)
        .join(F.broadcast(heads), "own")
        .withColumn(
            "to",
            F.when(
                F.col("doc_id").eqNullSafe(F.col("head")),
                F.array(place_of("own", 0), place_of("before", 1)),
            ).otherwise(F.array(place_of("own", 0))),
        )
        .select("doc_id", "text", F.inline("to"))
    )
    order = ["guest", F.desc_nulls_last("doc_id"), "tie", "text"]
    sorted_rows = dealt.withColumn("tie", F.xxhash64("text")).repartition("range").sortWithinPartitions("range", *order)
    derived = derive(sorted_rows)
    names = ["text", *(c for c in derived.columns if c not in sorted_rows.columns)]
    after = Window.partitionBy("range").orderBy(*order)
    met = derived.withColumns({f"next_{c}": F.lead(c).over(after) for c in names})
    return met.where("guest = 0").select("doc_id", *names, *(f"next_{c}" for c in names))


def _with_tree(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("paragraphs", paragraphs(F.col("text")))
    rows = rows.withColumn("fingerprint", _tree(F.col("paragraphs")))
    return rows.withColumn("leaves", leaves(F.col("fingerprint")))


def with_edited(met: DataFrame) -> DataFrame:
    """``met`` with ``edited``, the text whose last third is replaced by as many characters of the
    next one, and its ``edited_paragraphs``. Lines that both texts give whole have their paragraphs
    already; only the one where they meet and the last one are new."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    met = met.withColumns(
        {"head": F.substring("text", F.lit(1), n - third), "tail": F.substring("next_text", F.lit(1), third)}
    ).withColumns({"head_lines": F.split("head", "\n"), "tail_lines": F.split("tail", "\n")})
    whole = F.size("head_lines") - 1
    breaks = F.size("tail_lines") - 1
    joint = F.concat(F.element_at("head_lines", -1), F.element_at("tail_lines", 1))
    lines = F.when(breaks > 0, F.array(joint, F.element_at("tail_lines", -1))).otherwise(F.array(joint))
    return met.withColumn("fresh", F.transform(lines, _paragraph)).withColumns(
        {
            "edited": F.concat("head", "tail"),
            "edited_paragraphs": F.concat(
                F.slice("paragraphs", 1, whole),
                F.slice("fresh", 1, 1),
                F.slice("next_paragraphs", 2, F.greatest(breaks - 1, F.lit(0))),
                F.slice("fresh", 2, 1),
            ),
        }
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = narrowed(table(spark, sf_dir, "documents"), "doc_id", "text")
    trees = with_edited(with_successor(documents, _with_tree))
    trees = trees.withColumn("edited_fingerprint", _tree(F.col("edited_paragraphs")))
    trees = trees.withColumn("edited_leaves", leaves(F.col("edited_fingerprint")))
    like = lambda name: _likeness(*map(F.col, ("fingerprint", "leaves", f"{name}_fingerprint", f"{name}_leaves")))
    changed = F.filter("edited_paragraphs", lambda p: ~F.array_contains("paragraphs", p))
    same = root(F.col("fingerprint")) == root(F.col("edited_fingerprint"))
    return trees.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        like("edited").alias("near_edited"),
        like("next").alias("near_next"),
        F.when(same, 0).otherwise(F.size(changed)).alias("n_changed_paragraphs"),
    )


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS k FROM documents),
e AS (
  SELECT doc_id, k, text, coalesce(lead(text) OVER (ORDER BY k), first_value(text) OVER (ORDER BY k)) AS next_text FROM d),
t AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM e),
b AS (
  SELECT k, v, array_to_string(list_transform(string_split(x, chr(10)), lambda l:
      array_to_string(list_transform(regexp_extract_all(l, '{_LEAF}'), lambda y: substr(sha256(y), 1, {LEAF_DIGITS})), ',')), '/') AS joined
  FROM (SELECT k, 'a' AS v, text AS x FROM t UNION ALL SELECT k, 'b', edited FROM t UNION ALL SELECT k, 'c', next_text FROM t)),
s AS (
  SELECT k, v, array_to_string(list_transform(string_split(joined, '/'), lambda p:
      p || CASE WHEN substr(sha256(p), 1, 1) IN ('0', '1', '2', '3') THEN ';' ELSE '/' END), '') AS body FROM b),
f AS (
  SELECT k, v, body, substr(sha256(array_to_string(list_transform(string_split(body, ';'), lambda x: sha256(x)), ',')), 1, 32) AS root,
    list_filter(list_distinct(regexp_split_to_array(body, '[,;/]+')), lambda x: x <> '') AS leaves,
    regexp_split_to_array(regexp_replace(body, '[;/]$', ''), '[;/]') AS paragraphs FROM s)
SELECT t.doc_id, length(t.text)::BIGINT AS n_chars, sha256(t.edited) AS edited_sha256,
  a.root || ':' || a.body AS fingerprint, b.root || ':' || b.body AS edited_fingerprint,
  CASE WHEN a.root = b.root THEN 1.0::DOUBLE WHEN len(a.leaves) + len(b.leaves) = 0 THEN 0.0
    ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, b.leaves)) / (len(a.leaves) + len(b.leaves)) END AS near_edited,
  CASE WHEN a.root = c.root THEN 1.0::DOUBLE WHEN len(a.leaves) + len(c.leaves) = 0 THEN 0.0
    ELSE 2.0::DOUBLE * len(list_intersect(a.leaves, c.leaves)) / (len(a.leaves) + len(c.leaves)) END AS near_next,
  len(list_filter(b.paragraphs, lambda x: a.root <> b.root AND NOT list_contains(a.paragraphs, x)))::INT AS n_changed_paragraphs
FROM t JOIN f a ON a.k = t.k AND a.v = 'a' JOIN f b ON b.k = t.k AND b.v = 'b' JOIN f c ON c.k = t.k AND c.v = 'c'
"""
