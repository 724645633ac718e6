"""What each of several filters removes in every order of applying them, and its exact Shapley share, with DataFrame functions.

1. One pass turns a document into a failure mask (a bit a filter), its part, its id and the digest of its text. Copies are found by
   the smallest id of each digest; rows of one digest are first summed by task, so a frequent text moves as a few rows.
2. Each part's documents are counted by mask, and the counts summed to a table of all coalitions: what a set of filters removes.
3. A step that adds filter i to the set S removes v(S + i) - v(S): every step count of every order is a difference of coalitions.
4. Shapley shares minimise the sum over coalitions of kernel weight x (v(S) - sum of shares in S)^2 with all shares adding up to
   v(all). The normal equations do not depend on v, so they are solved once in rationals, for all v: shares are whole multiples of
   coalition values over the number of orders.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: The filters, in the order of their bits; the last one, repeated texts, looks at the whole table.
FILTERS = "ABCDE"
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """``matrix`` x = ``right`` for each column of ``right``, by elimination in rationals."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """For each of ``n`` filters the whole numbers c with: share x n! = sum over coalitions S of c[S] v(S).

    Coalitions are bit sets. Stationarity and efficiency give, with weights w and indicator rows z of the proper coalitions, the
    system [Z'WZ 1; 1' 0] (shares, multiplier) = (Z'Wv, v(all)).
    """
    every, full = range(1 << n), (1 << n) - 1
    weight = [Fraction(n - 1, comb(n, b) * b * (n - b)) if 0 < (b := s.bit_count()) < n else Fraction(0) for s in every]
    one = Fraction(1)
    matrix = [[sum((weight[s] for s in every if s >> i & s >> j & 1), Fraction(0)) for j in range(n)] + [one] for i in range(n)]
    matrix.append([one] * n + [Fraction(0)])
    right = [[weight[s] if s >> i & 1 else Fraction(0) for s in every] for i in range(n)]
    right.append([Fraction(s == full) for s in every])
    scaled = [[x * factorial(n) for x in row] for row in solved(matrix, right)[:n]]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def text_failures(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``mask``, the filters A to D that each text fails, for a column ``text`` without nulls."""
    words = docs.withColumn("words", F.array_remove(F.split(text, SPACES), ""))
    n_words, n_chars = F.size("words"), F.length(text)
    fails = [
        n_words < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n_words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * n_chars,
        F.col(text).rlike(SYMBOLS),
    ]
    return words.withColumn("mask", reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])).drop("words")


def failure_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents by the set of filters that they fail.

    A row fails E if a row with a smaller id has the same text (null text is empty); a null id is smaller than none and no id is
    smaller than a null one. Rows that repeat an id are not copies of each other. A null part counts as the empty one. An id
    labelled more than once is good or toxic if any of its labels says so; unlabelled documents are neither.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = text_failures(rows, "text").select("doc_id", "part", "mask", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = materialise(rows)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id meet no label and stay out of the join, where they would all have one key
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("doc_id", "part", "mask", "digest", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    kinds = ["digest", "part", "mask", "good", "toxic"]
    each = known.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    summed = materialise(each.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first_id"), F.min_by("n", "doc_id").alias("n_first")))
    first = summed.groupBy("digest").agg(F.min("first_id").alias("least_id"))
    both = summed.join(first, "digest").withColumn("kept", F.when(F.col("first_id") == F.col("least_id"), F.col("n_first")).otherwise(0))
    bit = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    dated = both.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    undated = rows.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", "n")
    counted = dated.unionByName(undated).groupBy("part", "mask")
    return counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of ``filters`` on the documents that ``counts`` (``part, mask, n, n_good, n_toxic``) has.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, one row for each part,
    order and step, zeros included. ``mask`` has bit k set for documents that fail ``filters[k]``.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    # the coalition table: for every set of filters the documents that it removes
    removed = {c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)) for s in range(full + 1)]) for c in ("n", "n_good", "n_toxic")}
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), *[v.alias(f"v_{c}") for c, v in removed.items()])
    shares = [reduce(lambda a, b: a + b, [F.lit(c) * F.get("v_n", F.lit(s)) for s, c in enumerate(row) if c]) for row in shapley_weights(n)]
    parts = parts.withColumn("shares", F.array(*shares))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append(f"struct('{''.join(filters[k] for k in order)}' AS filter_order, {step} AS step, {i} AS i, {before} AS before, {before | 1 << i} AS after)")
            before |= 1 << i
    wide = parts.select("part", "total", "v_n", "v_n_good", "v_n_toxic", "shares", F.explode(F.expr(f"array({', '.join(steps)})")).alias("s"))
    at = lambda values, place: F.get(F.col(values), place)
    i, before, after = F.col("s.i"), F.col("s.before"), F.col("s.after")
    own = F.expr("shiftleft(1, s.i)")
    gone = at("v_n", after) - at("v_n", before)
    return wide.select(
        "part",
        F.col("s.filter_order").alias("filter_order"),
        F.col("s.step").alias("step"),
        (F.col("total") - at("v_n", after)).alias("kept"),
        gone.alias("removed"),
        (at("v_n", own) - gone).alias("redundant"),
        (at("v_n", F.lit(full)) - at("v_n", F.lit(full) - own)).alias("unique_fails"),
        (at("v_n_good", after) - at("v_n_good", before)).alias("good_lost"),
        (at("v_n_toxic", after) - at("v_n_toxic", before)).alias("toxic_lost"),
        at("shares", i).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of filters A to E on whole texts: A under 200 words, B under half of the words distinct, C over 2 % capitals,
    D a symbol, E an earlier document's text. An empty table gives an empty result; other columns of ``docs`` are ignored."""
    return audit(failure_counts(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
