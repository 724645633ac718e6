"""Secret scan with DataFrame functions only: three fixed patterns, and a randomness test battery for what they miss.

Long tokens that no pattern claims are tested for randomness. The likeliest encoding (decimal, hexadecimal, base 32, base 64) is
inferred from a token's characters; against it stand a chi-squared test of uniformity over the alphabet, one over its character
classes, a runs test around the alphabet's middle and a lag-one serial correlation. Their squared scores add up to a statistic
that is small for random strings (chi-squared with four degrees of freedom). A token becomes a finding when randomness is not
rejected and the expected share of false findings is small: the rate at which ordinary long words of the same length class
score as low, taken over the whole corpus, is the null distribution for a Benjamini-Hochberg cut per class.
Tokens of letters only are those words: they are the null sample and never findings, however random they look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: The patterns of the base kinds, their least lengths applied afterwards or inside, kinds in listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED = 6

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order of inference: name, pattern, alphabet.
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6]),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
)
#: Randomness is rejected above this value: the upper 0.1 % point of chi-squared with four degrees of freedom.
REJECT_ABOVE = 18.47
FALSE_DISCOVERY = 0.01
#: Ordinary words assumed besides those of the corpus in each length class, one of them in the lowest bin.
PRIOR_WORDS = 1000
#: Lower ends of the length classes.
LENGTH_CLASSES = (20, 24, 32, 48, 64, 128)
BINS_PER_UNIT = 4
MAX_BIN = 80


def _occurrences(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _gaps(text: Column, pattern: str, matches: Column) -> Column:
    """Characters between successive matches."""
    return F.when(F.size(matches) > 0, F.transform(F.split(text, pattern, -1), F.length))


def _statistic(token: Column) -> Column:
    """The summed squared scores of the battery for a token (without padding)."""
    alphabet, size, body = F.lit(ENCODINGS[-1][2]), F.lit(float(len(ENCODINGS[-1][2]))), F.translate(F.rtrim(F.translate(token, "=", " ")), "-_", "+/")
    for _, pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
        size = F.when(token.rlike(pattern), F.lit(float(len(letters)))).otherwise(size)
    body = F.when(token.rlike(ENCODINGS[1][1]), F.lower(body)).otherwise(body)
    parts = F.struct(body.alias("s"), alphabet.alias("alphabet"), size.alias("a"), F.length(body).cast("double").alias("n"))

    def score(p: Column) -> Column:
        s, a, n = p["s"], p["a"], p["n"]
        letters = F.split(s, "")
        squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
        uniform = F.greatest((squares * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1)), F.lit(0.0))
        classes = F.lit(0.0)
        for letters_of in (DIGITS, LOWER, UPPER):
            share = (F.length(p["alphabet"]) - F.length(F.translate(p["alphabet"], letters_of, ""))) / a
            seen = n - F.length(F.translate(s, letters_of, ""))
            classes = classes + F.when(share > 0, F.pow(seen - n * share, F.lit(2.0)) / (n * share)).otherwise(0.0)
        by_class = F.greatest((classes - 2) / 2, F.lit(0.0))
        ranks = F.transform(letters, lambda c: F.instr(p["alphabet"], c).cast("double"))
        return F.struct(ranks.alias("r"), a.alias("a"), n.alias("n"), (uniform * uniform + by_class * by_class).alias("sum"))

    def order(p: Column) -> Column:
        r, a, n = p["r"], p["a"], p["n"]
        mean = F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x) / n
        pairs = F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        spread = F.aggregate(r, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        serial = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["x"] - mean) * (q["y"] - mean))
        serial = F.coalesce(F.try_divide(serial, spread), F.lit(1.0)) * F.sqrt(n)
        high = F.aggregate(r, F.lit(0.0), lambda acc, x: acc + F.when(x > a / 2, 1.0).otherwise(0.0))
        runs = F.aggregate(pairs, F.lit(1.0), lambda acc, q: acc + F.when((q["x"] > a / 2) != (q["y"] > a / 2), 1.0).otherwise(0.0))
        both = 2 * high * (n - high)
        expected, variance = both / n + 1, both * (both - n) / (n * n * (n - 1))
        runs = F.coalesce(F.when(variance > 0, (runs - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9)))), F.sqrt(n))
        return p["sum"] + serial * serial + runs * runs

    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  evaluates c once
    return once(once(parts, score), order)


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_discovery: float = FALSE_DISCOVERY) -> tuple[DataFrame, DataFrame]:
    """Rows (``row, doc_id``) and their findings (``row, kind, start, end``); code points, end exclusive."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.select("row", "doc_id", "text", *(_occurrences(F.col("text"), p).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)))
    narrow = found.select(
        "row", "doc_id", *KINDS,
        F.when(F.size("assign") > 0, _occurrences(F.col("text"), ASSIGN, 2)).alias("assigned"),
        *(_gaps(F.col("text"), p, F.col(k)).alias(f"{k}_gaps") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)),
    )
    narrow = materialise(narrow)

    def spans(kind: str) -> DataFrame:
        part = F.col("assigned") if kind == "assign" else F.col(kind)
        each = narrow.where(F.size(kind) > 0).select("row", F.posexplode(F.arrays_zip(F.col(f"{kind}_gaps").alias("gap"), F.col(kind).alias("match"), part.alias("part"))).alias("k", "m"))
        each = each.select("row", "k", "m.*").where("match IS NOT NULL")
        order = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("gap") + F.length("match")).over(order)
        return each.select("row", F.lit(kind).alias("kind"), (end - F.length("match")).alias("start"), end.alias("end"), "match", "part")

    base = spans("assign").where(F.length("part") >= MIN_ASSIGNED).unionByName(spans("access")).unionByName(spans("hex")).select("row", "kind", "start", "end")

    tokens = spans("random").withColumn("word", F.col("match").rlike("^[A-Za-z]+$"))
    klass = F.lit(LENGTH_CLASSES[0])
    for low in LENGTH_CLASSES[1:]:
        klass = F.when(F.length("match") >= low, low).otherwise(klass)
    scored = tokens.select("row", "start", "end", "word", klass.alias("class"), _statistic(F.col("match")).alias("score"))
    scored = materialise(scored.withColumn("bin", F.least(F.lit(MAX_BIN), F.floor(BINS_PER_UNIT * F.log1p("score"))).cast("int")))
    # at most len(LENGTH_CLASSES) * (MAX_BIN + 1) rows from here to the cut
    counts = scored.groupBy("class", "bin").agg(F.count_if("word").alias("words"), F.count_if(~F.col("word")).alias("tested"))
    up_to, whole = Window.partitionBy("class").orderBy("bin"), Window.partitionBy("class")
    rate = (F.sum("words").over(up_to) + 1) / (F.sum("words").over(whole) + PRIOR_WORDS)
    expected = rate * F.sum("tested").over(whole) / F.greatest(F.sum("tested").over(up_to), F.lit(1))
    cuts = counts.withColumn("expected", expected).where(F.col("expected") <= false_discovery).groupBy("class").agg(F.max("bin").alias("cut"))
    random = scored.where(~F.col("word") & (F.col("score") <= REJECT_ABOVE)).join(F.broadcast(cuts), "class").where("bin <= cut").select("row", "start", "end")

    claimed = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    random = random.join(claimed, (F.col("row") == F.col("r")) & (F.col("s") < F.col("end")) & (F.col("e") > F.col("start")), "left_anti")
    return narrow.select("row", "doc_id"), base.unionByName(random.withColumn("kind", F.lit("random")).select("row", "kind", "start", "end"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one row per row of ``docs``.

    ``spans`` lists ``kind:start:end`` by start, then kind (assign, access, hex, random); ``base_sha256`` is the digest of that
    list without the random ones. Null and empty texts have no spans (empty string, its digest). Rows may repeat; each is
    scanned by itself. An empty table gives an empty result.
    """
    rows, spans = find_spans(docs, id_col=id_col, text_col=text_col, false_discovery=false_discovery)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("all"))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda kind: F.coalesce(F.size(F.filter("all", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    none = F.coalesce("all", F.expr("cast(array() as array<struct<start: bigint, rank: bigint, end: bigint, kind: string>>)"))
    return rows.join(per_row, "row", "left").withColumn("all", none).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(text(F.filter("all", lambda x: x["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("all")).alias("spans"),
    )
