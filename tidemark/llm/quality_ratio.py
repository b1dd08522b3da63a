"""Quality by a hashed n-gram likelihood ratio, in DataFrame functions alone.

Two multinomials over hashed one- and two-word grams are estimated: one on trusted documents, one on the whole raw corpus. A
document's verdict is its mean log-ratio over its grams against a threshold that is the same for every document. Fixed base
rules on length and repetition come first.

Texts are read once, and the buckets of their grams written. Grams are counted and scored in the task that reads their document:
only counts for each bucket, and one sum for each document, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, whole

#: Buckets that one- and two-word grams are hashed to; the table of their log-ratios, as long, is broadcast.
BUCKETS = 1 << 14
#: Trusted rows that the target multinomial is estimated on, at most; chosen by hash of the id.
TRUSTED_ROWS = 20_000
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "")


def shapes_of(text: Column) -> Column:
    """The text with its words reduced to shapes: runs of small letters to a, of capitals to A or AA, of other letters to o, of
    digits to 0, and runs of one mark to two. So grams tell how a text is written, whatever it says and in any language."""
    for pattern, to in (("\\p{Ll}+", "a"), ("\\p{Lu}{2,}", "AA"), ("[\\p{Lo}\\p{Lt}\\p{Lm}]+", "o"), ("\\p{N}+", "0"), ("([^\\p{L}\\p{N}\\s])\\1+", "$1$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = whole(text)
    words = F.col("__words")
    n = F.size(words)
    line_kinds = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("__hashes")[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    out = docs.withColumn("__words", words_of(body)).withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    out = out.withColumn("__grams", grams).withColumn("__lines", line_kinds)
    # Words in windows that occur again: the windows' places in order of hash show which have an equal neighbour, and the sum
    # over those places, ascending, of what each adds beyond the one before is the number of words covered.
    placed = F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = F.array_sort(
        F.filter(
            F.transform(F.col("__sorted"), lambda x, k: F.when(((k > 0) & (F.col("__sorted")[F.greatest(k - 1, F.lit(0))]["g"] == x["g"])) | ((k < F.size("__sorted") - 1) & (F.col("__sorted")[F.least(k + 1, F.size("__sorted") - 1)]["g"] == x["g"])), x["i"])),
            lambda i: i.isNotNull(),
        )
    )
    covered = F.aggregate(F.col("__again"), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda s, i: F.struct(i.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), i - s["last"])).alias("sum")), lambda s: s["sum"])
    repeated = F.size(F.array_distinct("__grams")) < F.size("__grams")
    out = out.withColumn("__sorted", F.when(repeated, placed)).withColumn("__again", F.when(repeated, again))
    return out.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_buckets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with __buckets, the buckets of a text's grams: each word's shape, and each pair of neighbouring shapes, hashed; bounded by its
    own words. Hashes are a column of their own, as an expression that occurs several times around lambdas is computed as often."""
    out = docs.withColumn("__shapes", F.transform(words_of(shapes_of(whole(text))), lambda w: F.xxhash64(w)))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    # The last shape is paired with the text's end, as hashes pass over null.
    pairs = F.zip_with("__shapes", F.slice("__shapes", F.lit(2), F.greatest(F.size("__shapes") - 1, F.lit(0))), lambda a, b: bucket(F.xxhash64(a, b)))
    return out.withColumn("__buckets", F.concat(F.transform("__shapes", bucket), pairs)).drop("__shapes")


def grams(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """What `log_ratios` and `judge` need of each row of docs, written, so that texts are read and their words hashed once: id, the base
    counts, and __buckets. Both take this table in place of docs."""
    return materialise(_grams(docs, id, text), "quality-grams")


def _grams(docs: DataFrame, id: str, text: str) -> DataFrame:
    if "__buckets" in docs.columns:
        return docs
    return with_buckets(base_counts(docs.select(F.col(id), whole(text).alias("text")))).select(id, *BASE, "__buckets")


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode("__buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def log_ratios(docs: DataFrame, trusted: DataFrame, id: str = "doc_id", text: str = "text", most: int = TRUSTED_ROWS) -> DataFrame:
    """bucket and ratio, the log of the trusted over the raw probability of a bucket, with one added to every count.

    trusted: ids of trusted rows; at most `most` of them are used. The raw counts cover all of docs.
    """
    spark = docs.sparkSession
    read = docs if "__buckets" in docs.columns else with_buckets(docs, text)
    rows = read.select(F.col(id).alias("__id"), "__buckets")
    chosen = trusted.select(F.col(id).alias("__id")).filter("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(most)
    target = _counts(rows.join(F.broadcast(chosen), "__id", "left_semi"), "target")
    raw = _counts(rows, "raw")
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(raw, "bucket", "left").join(target, "bucket", "left").fillna(0, ["raw", "target"])
    both = materialise(both, "quality-counts")  # BUCKETS rows
    total = both.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total.target:
        return both.select("bucket", F.lit(0.0).alias("ratio"))
    return both.select("bucket", (F.log((F.col("target") + 1.0) / float(total.target + BUCKETS)) - F.log((F.col("raw") + 1.0) / float(total.raw + BUCKETS))).alias("ratio"))


def judge(docs: DataFrame, ratios: DataFrame, threshold: float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, the base counts, log_ratio (mean over grams; null without any), base_failed, kept.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated windows. kept: not base_failed, and a mean
    log-ratio of at least `threshold`. Null text counts as empty, and so fails. Repeated rows stay rows.
    """
    table = F.broadcast(ratios)  # BUCKETS rows
    keyed = _grams(docs, id, text).withColumn("__row", F.monotonically_increasing_id())
    each = keyed.select(id, *BASE, "__row", F.explode_outer("__buckets").alias("bucket"))
    scored = each.join(table, "bucket", "left").groupBy("__row", id, *BASE).agg(F.avg("ratio").alias("log_ratio"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(id, *BASE, "log_ratio", failed.alias("base_failed"), (~failed & F.coalesce(F.col("log_ratio") >= threshold, F.lit(False))).alias("kept"))
