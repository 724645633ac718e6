"""Near-duplicates by b-bit MinHash: candidates from bands, an estimate from packed low bits, a check on full shingle sets.

One pass over the texts gives each document the size and a digest of its shingle set, the hashes of its bands, and the two low
bits of every minimum, packed into bit planes. Documents with equal sets form a class; only class representatives go on.

Representatives that share a band are candidates. Only connections between different texts matter for the groups, so pairs are
never written out for a whole bucket. The leader of a bucket is the member with the fewest shingles of its own (found in no
other candidate), the one nearest to what the bucket's texts have in common. First each representative is checked against its
most promising leader, then against all leaders outside its group. A pair is checked on full sets when the collision-corrected
estimate from bit counts does not rule it out.

In buckets that still hold several groups, the members outside the bucket's largest group are then checked against all members of
other groups, unless their own shingles alone prove that no link is possible: shingles found in no other candidate count in the
union only. A frequent bucket is split into cells of bounded size on both sides, so no task compares more than a cell; a pair is
looked at in its first shared bucket, by its estimate and then by its sets, and only links are written out.
Groups are connected components, found by rounds of minimum labels over written tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_texts, materialise, unused
from ._words import U, Words, mix

LOW_BITS = 2
#: Share of the rows above which a class of equal sets is handled apart.
HEAVY_SHARE = 0.001
#: Members of a bucket on each side of a cell; a cell is compared in one task.
CELL = 4_096


@dataclass(frozen=True)
class NearParams:
    """``100 * intersection >= percent * union`` links two sets of ``shingle``-word shingles.

    ``bands`` x ``rows`` minima: at 85 % and 32 x 8 a linked pair shares no band once in 26,000, at 80 % and 40 x 6 once in
    190,000. ``slack`` is how far below the threshold an estimate may lie for a pair to be checked on full sets, more than five
    standard errors.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    slack: float = 0.15
    lower: bool = True
    cell: int = CELL


CONTRACT = NearParams(shingle=3, percent=85, bands=32, rows=8)


def shingle_sets(texts: list[bytes | None], p: NearParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the text of each; fewer words give one shingle."""
    w = Words(texts, lower=p.lower)
    hashes = w.word_hashes()
    at, keys = w.windows(hashes, p.shingle)
    doc = w.doc[at]
    few = np.flatnonzero((w.n_words > 0) & (w.n_words < p.shingle))
    if len(few):
        short = np.zeros(len(few), U)
        for k in range(p.shingle - 1):
            more = w.n_words[few] > k
            short[more] = mix(short[more] + hashes[w.first_word[few[more]] + k])
        keys, doc = np.concatenate([keys, mix(short + w.n_words[few].astype(U))]), np.concatenate([doc, few])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], doc[new]


def signatures(texts: list[bytes | None], p: NearParams) -> dict[str, object]:
    """Per text: set size, two digests, band hashes, and the low-bit planes of the minima."""
    keys, doc = shingle_sets(texts, p)
    n = len(texts)
    sizes = np.bincount(doc, minlength=n)
    filled = np.flatnonzero(sizes)
    begin = np.cumsum(sizes)[filled] - sizes[filled]
    count = p.bands * p.rows
    seeds = mix(np.arange(1, 2 * count + 1, dtype=U))
    minima = np.zeros((count, len(filled)), U)
    one, two = np.zeros(n, U), np.zeros(n, U)
    if len(keys):
        for k in range(count):
            minima[k] = np.minimum.reduceat((keys * (seeds[2 * k] | U(1)) + seeds[2 * k + 1]) >> U(20), begin)
        one[filled] = np.add.reduceat(mix(keys ^ U(1)), begin)
        two[filled] = np.add.reduceat(mix(keys ^ U(2)), begin)
    bands = np.zeros((len(filled), p.bands), U)
    for b in range(p.bands):
        total = np.full(len(filled), b + 1, U)
        for m in minima[b * p.rows : (b + 1) * p.rows]:
            total = mix(total + m)
        bands[:, b] = total
    width = -(-count // 64) * 8
    planes = [np.zeros((len(filled), width), np.uint8) for _ in range(LOW_BITS)]
    for bit, plane in enumerate(planes):
        packed = np.packbits(((minima >> U(bit)) & U(1)).astype(bool).T, axis=1)
        plane[:, : packed.shape[1]] = packed
    place = np.full(n, -1)
    place[filled] = np.arange(len(filled))
    rows = lambda table: [table[i] if i >= 0 else np.zeros(0, np.int64) for i in place]
    return {"n_shingles": sizes, "one": one.view(np.int64), "two": two.view(np.int64), "bands": rows(bands.view(np.int64)), **{f"low{b}": rows(plane.view(np.int64)) for b, plane in enumerate(planes)}}


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).view(np.int64)))


def _sign(rows: DataFrame, p: NearParams) -> DataFrame:
    def work(texts: list[bytes | None]) -> dict[str, object]:
        made = signatures(texts, p)
        return made | {c: _lists(made[c]) for c in ("bands", "low0", "low1")}

    return map_texts(rows, ["doc_id", "text_hash"], {"n_shingles": "long", "one": "long", "two": "long", "bands": "array<long>", "low0": "array<long>", "low1": "array<long>"}, work)


def _sets(rows: DataFrame, p: NearParams) -> DataFrame:
    def work(texts: list[bytes | None]) -> dict[str, object]:
        keys, doc = shingle_sets(texts, p)
        return {"items": _lists(np.split(keys.view(np.int64), np.searchsorted(doc, np.arange(1, len(texts)))))}

    return map_texts(rows, ["id"], {"items": "array<long>"}, work)


def _estimate(p: NearParams) -> Column:
    """Collision-corrected similarity of the planes a0, a1 and b0, b1: agreeing minima less those that agree by chance."""
    plane = lambda name, i: F.get(name, F.lit(i))
    words = range(-(-p.bands * p.rows // 64))
    differ = reduce(Column.__add__, [F.bit_count(plane("a0", i).bitwiseXOR(plane("b0", i)).bitwiseOR(plane("a1", i).bitwiseXOR(plane("b1", i)))) for i in words])
    chance = 2.0**-LOW_BITS
    return (1 - differ / (p.bands * p.rows) - chance) / (1 - chance)


def connected(edges: DataFrame) -> DataFrame:
    """``id, group`` (smallest id reachable) of every id in ``edges(a, b)``; written tables between rounds.

    Each round gives every id the least label among its own and its neighbours', then replaces labels by their labels.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("group")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("m"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("group").alias("was"), F.least("group", "m").alias("group"))
        far = labels.select(F.col("id").alias("g"), F.col("group").alias("top"))
        new = materialise(new.join(far, F.col("group") == F.col("g")).select("id", "was", F.least("group", "top").alias("group")))
        if new.where("was <> group").isEmpty():
            return new.select("id", "group")
        labels = new.select("id", "group")


def near_groups(docs: DataFrame, params: NearParams = NearParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash``, one row per row of ``docs``.

    Ids are integers. ``component_id`` is the smallest id among the rows that links reach, the row itself included; ``kept`` says
    that it is the row's own. Rows that share an id are judged each by its own text. A null id is a row of its own (component
    null, kept). Texts without words have no shingles and are linked with nothing. Equal sets are linked. ``text_hash``
    is the row's ``xxhash64`` of the text. An empty table gives an empty result. Other columns are ignored.
    """
    p = params
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = materialise(_sign(narrow, p))

    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["one", "two", "n_shingles"]
    # a class is known by a number of its own, as several rows may share an id
    best = F.min_by(F.struct("doc_id", "text_hash", "bands", "low0", "low1"), F.struct("doc_id", "text_hash")).alias("rep")
    reps = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), best)
    reps = materialise(reps.select(*keys, "size", "rep.*", F.monotonically_increasing_id().alias("id")))

    banded = reps.select("id", F.posexplode("bands").alias("k", "band"))
    several = banded.groupBy("band").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("band")
    shared = materialise(banded.join(several, "band", "left_semi"))

    bits = reps.select("id", "low0", "low1")
    wanted = reps.join(shared.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_hash")
    # rows that repeat id and text come twice here
    sets = materialise(_sets(narrow.join(wanted, ["doc_id", "text_hash"]).select("id", "text"), p))
    single = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    core = sets.select("id", F.size("items").alias("n")).join(single.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "id", "left")
    core = materialise(core.distinct().select("id", "n", F.coalesce("own", F.lit(0)).alias("own")))
    shared = shared.join(core.select("id", "own"), "id")
    leaders = shared.groupBy("band").agg(F.min_by("id", F.struct("own", "id")).alias("leader"))

    def estimated(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose estimated similarity comes near the threshold."""
        both = pairs.join(bits.select(F.col("id").alias("a"), F.col("low0").alias("a0"), F.col("low1").alias("a1")), "a")
        both = both.join(bits.select(F.col("id").alias("b"), F.col("low0").alias("b0"), F.col("low1").alias("b1")), "b")
        return both.select("a", "b", _estimate(p).alias("estimate")).where(F.col("estimate") >= p.percent / 100 - p.slack)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are linked, by their full sets."""
        both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(100 * common >= p.percent * (F.size("x") + F.size("y") - common)).select("a", "b")

    def labelled(rows: DataFrame, groups: DataFrame, id_name: str, group_name: str) -> DataFrame:
        found = groups.select(F.col("id").alias(id_name), F.col("group").alias("__g"))
        return rows.join(found, id_name, "left").withColumn(group_name, F.coalesce("__g", id_name)).drop("__g")

    starred = materialise(estimated(shared.join(leaders, "band").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()))
    best = starred.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a"))
    links = materialise(confirmed(best))
    groups = connected(links)

    apart = labelled(labelled(starred, groups, "a", "ga"), groups, "b", "gb").where("ga <> gb")
    links = links.unionByName(materialise(confirmed(apart)))
    groups = connected(links)

    # only what its shingles do not rule out alone goes on: a link needs an intersection of percent of its set
    able = core.where(100 * (F.col("n") - F.col("own")) >= p.percent * F.col("n"))
    members = labelled(shared.select("id", "k", "band").join(able, "id"), groups, "id", "group")
    members = materialise(members.join(reps.select("id", "bands", "low0", "low1"), "id"))
    sizes = members.groupBy("band", "group").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("band").agg(F.max_by("group", F.struct("size", "group")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("all"), F.max("size").alias("most"))
    cells = lambda n: F.ceil(n / p.cell).cast("int")
    mixed = mixed.where("kinds > 1").select("band", "main", cells(F.col("all") - F.col("most")).alias("rows"), cells(F.col("all")).alias("columns"))
    members = members.join(mixed, "band").join(sets, "id")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    side = lambda x: [F.col("id").alias(x), F.col("group").alias(f"g{x}"), (F.col("n") - F.col("own")).alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("low0").alias(f"{x}0"), F.col("low1").alias(f"{x}1"), F.col("items").alias(f"i{x}"), F.slice("bands", F.lit(1), F.col("k")).alias(f"e{x}")]
    left = members.where("group <> main").select("band", "main", place(F.col("rows")).alias("row"), every(F.col("columns")).alias("column"), *side("a"))
    right = members.select("band", place(F.col("columns")).alias("column"), every(F.col("rows")).alias("row"), *side("b"))
    most, both = F.least("ca", "cb"), F.size(F.array_intersect("ia", "ib"))
    linked_sets = lambda common: (100 + p.percent) * common >= p.percent * (F.col("na") + F.col("nb"))
    # a pair that shares several bands is looked at in the first of them only (band hashes differ between positions)
    first = ~F.arrays_overlap("ea", "eb")
    # of two outsiders one side is enough; all tests are part of the join condition, so that only links are written out
    once = (F.col("gb") == F.col("main")) | (F.col("ga") < F.col("gb"))
    same = reduce(Column.__and__, [left[c] == right[c] for c in ("band", "row", "column")])
    cross = left.join(right, same & (F.col("ga") != F.col("gb")) & once & linked_sets(most) & (_estimate(p) >= p.percent / 100 - p.slack) & first & linked_sets(both))
    links = links.unionByName(materialise(cross.select("a", "b").distinct()))
    groups = connected(links)

    # classes with more than HEAVY_SHARE of the rows, at most 1 / HEAVY_SHARE of them, are looked up map-side
    of_class = labelled(reps.select("id", "doc_id", "size", *keys), groups, "id", "group")
    least = of_class.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_class = materialise(of_class.join(least, "group").select(*keys, "size", "component_id"))
    total = signed.agg(F.count(F.lit(1)).alias("total"))
    heavy = materialise(of_class.crossJoin(F.broadcast(total)).where(F.col("size") > HEAVY_SHARE * F.col("total")).drop("total", "size"), partitions=1)
    narrowed = signed.select("doc_id", "text_hash", *keys)
    hot = narrowed.join(F.broadcast(heavy), keys)
    rest = narrowed.join(F.broadcast(heavy), keys, "left_anti")
    no_words = rest.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long"))
    out = hot.unionByName(no_words).unionByName(rest.where("n_shingles > 0").join(of_class.drop("size"), keys, "left"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def drop_near_copies(docs: DataFrame, params: NearParams = NearParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_groups`` keeps: one document of each group, the one with the smallest id.

    Rows that repeat id and text stay or go together.
    """
    kept = near_groups(docs, params, id_col=id_col, text_col=text_col).where("kept")
    own, text = unused("__id", docs.columns), unused("__hash", docs.columns)
    kept = kept.select(F.col("doc_id").alias(own), F.col("text_hash").alias(text))
    return docs.join(kept, docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text_col]) == F.col(text)), "left_semi")
