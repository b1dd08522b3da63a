"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A mask names which of a few neighbouring words are hashed and which may be anything. Test items and documents are hashed under
the same masks at every place; equal hashes give a place of the document at which an item may lie. There the words are compared
one by one, and a document is contaminated if a stretch of an item agrees with it up to a share of substituted words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import whole

#: Masks by the words of a stretch and how many of them may be substituted; 1 is a word that is hashed, 0 a word
#: that may be anything. However the substituted words lie, one of the masks fits between them (the tests try all).
MASKS = {
    (13, 3): ("111011", "1100001011", "110111"),
    (12, 3): ("111011", "110100011", "11001011", "110111"),
    (11, 2): ("1110111", "111001011", "1011111", "111111"),
    (10, 2): ("1111011", "11001111", "110110011", "11110101", "10101111"),
    (9, 2): ("111011", "1001111", "11010011", "111101"),
    (8, 2): ("11011", "1111", "1100011"),
    (7, 1): ("11111", "111011", "110111"),
    (6, 1): ("11111", "111101", "111011", "110111", "101111"),
    (5, 1): ("1111", "11101", "11011", "10111"),
    (4, 1): ("111", "1101", "1011"),
}
#: Words of the stretch that is compared (or the whole item, if shorter), and the percentage that must agree.
STRETCH, PERCENT = 13, 75
#: Seeds of test items up to which they are broadcast; beyond, document seeds are shuffled to them.
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words: lower case, without marks; runs of letters and digits as they stand."""
    bare = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]+", "")
    return F.transform(F.filter(F.split(bare, "\\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(words: int, percent: int = PERCENT) -> tuple[str, ...]:
    """Masks that find every stretch of so many words of which `percent` agree: without fixed ones, a run that must be left."""
    agree = max(-(-words * percent // 100), 1)
    return MASKS.get((words, words - agree)) or ("1" * -(-agree // (words - agree + 1)),)


def seeds(words: str, masks: tuple[str, ...]) -> Column:
    """Hashes under each mask at each place, mask by mask, as many for each mask; null where a mask runs over the end."""
    n = F.size(words) - min(map(len, masks)) + 1

    def at(mask: str):
        picked = [k for k, m in enumerate(mask) if m == "1"]
        return lambda i: F.when(i + len(mask) <= F.size(words), F.xxhash64(F.lit(int(mask, 2)), *[F.col(words)[i + k] for k in picked]))

    each = [F.transform(F.sequence(F.lit(0), n - 1), at(m)) for m in masks]
    return F.when(n > 0, F.concat(*each)).otherwise(F.array().cast("array<long>"))


def _placed(rows: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keys, hash and place of every seed."""
    n = F.size("words") - min(map(len, masks)) + 1
    out = rows.select(*keys, n.alias("n"), F.posexplode(seeds("words", masks)).alias("at", "hash")).filter("hash is not null")
    return out.select(*keys, (F.col("at") % F.col("n")).alias("place"), "hash")


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", stretch: int = STRETCH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: id, contaminated, n_items (items found in it), overlap (the largest share of words of a
    stretch that agree; 0 without a hit) and item_ids (ascending).

    A stretch is `stretch` neighbouring words of an item, or the whole item if it has fewer; items without a word are not
    searched for. Null texts count as empty and are clean; so is everything if there are no items. Rows with a null id
    are judged as others; repeated rows stay rows; items with equal ids are one item with several texts.
    """
    rows = docs.select(F.col(id), whole(text).alias("__text")).withColumn("__key", F.xxhash64(F.col(id), "__text"))
    doc_words = rows.select("__key", word_hashes(F.col("__text")).alias("words"))
    tests = items.select(F.col(item_id).alias("item"), word_hashes(whole(item_text)).alias("words")).filter(F.size("words") > 0).distinct()
    width = F.least(F.size("words"), F.lit(stretch))
    widths = sorted(r[0] for r in tests.select(width).distinct().collect()) or [stretch]  # at most `stretch` rows
    placed = reduce(DataFrame.union, [_placed(tests.filter(width == w), ["item", "words"], masks_for(w, percent)) for w in widths])
    masks = tuple(sorted({m for w in widths for m in masks_for(w, percent)}))
    test_seeds = placed.select("hash", "item", F.col("place").alias("item_place"), F.col("words").alias("item_words"))
    # Seeds carry a short name of their item's text; its words are joined again for verification only.
    named = test_seeds.withColumn("test", F.xxhash64("item", "item_words"))
    table = named.select("hash", "test", "item_place").distinct()
    texts = named.select("test", "item", "item_words").distinct()
    small = table.count() <= BROADCAST_SEEDS
    hits = _placed(doc_words, ["__key"], masks).join(F.broadcast(table) if small else table, "hash")
    hits = hits.select("__key", "test", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = hits.groupBy("__key").agg(F.collect_list(F.struct("test", "shift")).alias("hits"))
    held = doc_words.dropDuplicates(["__key"]).join(hits, "__key").select("__key", "words", F.explode("hits").alias("hit"))
    held = held.join(F.broadcast(texts) if small else texts, held.hit.test == texts.test)
    m, place = F.size("item_words"), lambda j: j + F.col("hit.shift")
    agree = F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.when((place(j) >= 0) & (place(j) < F.size("words")) & (F.get("words", place(j)) == F.col("item_words")[j]), 1).otherwise(0))
    held = held.select("__key", "item", F.least(F.lit(stretch), m).alias("w"), agree.alias("agree"))
    sums = F.transform(F.sequence(F.lit(0), F.size("agree") - F.col("w")), lambda s: F.aggregate(F.slice("agree", s + 1, F.col("w")), F.lit(0), lambda a, x: a + x))
    held = held.select("__key", "item", (F.array_max(sums) / F.col("w")).alias("share"))
    found = held.filter(F.col("share") * 100 >= percent).groupBy("__key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("share").alias("overlap"))
    out = rows.drop("__text").join(found, "__key", "left")
    ids = F.coalesce("item_ids", F.array().cast(f"array<{dict(items.dtypes)[item_id]}>"))
    return out.select(F.col(id), F.col("overlap").isNotNull().alias("contaminated"), F.size(ids).alias("n_items"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"), ids.alias("item_ids"))
