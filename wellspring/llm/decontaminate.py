"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

Words are runs of letters or digits, lower-cased.  A seed is the hash of the words under a fixed mask that
skips some places; seeds of test items meet seeds of the corpus in a hash join.  Around a hit the item is
laid along its diagonal of the document and words are compared place by place: the item leaks if some
window of ``WINDOW`` places (or the whole item, if shorter) agrees in at least ``AGREE`` of them, whatever
words were substituted between.  Masks go by the length of the item: with them every way to substitute as many
words as the threshold allows, in a window of 16 or in a shorter item whole, leaves a seed whole (tests try
all of them for 1 to 16 words), so verification sees every window that it would accept.  Text written
without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) counts each letter as a word.

How it scales.  Test items are few: their seeds (four numbers each) and, apart from them, each item's word
hashes once are broadcast if both together stay below ``BROADCAST_BYTES``; else both sides are shuffled by
seed and a salt, so that a common seed is spread over tasks.  The corpus gets seeds under those masks alone
that the lengths of the items at hand call for, which is two unless there are items of under nine words or of
ten.  Of a run of hits on one diagonal only the first is kept, by comparing the seed before it on both sides,
so a passage yields a row per item and document, not per word.  A document's word hashes ride along inside
one stage and are never shuffled on the broadcast path.

Defined results.  Null texts, ids or items yield nothing, nor do items without a word.  An item of one to
four words leaks where it stands verbatim.  Repeated rows of a document or item are
reported once.  Other columns are ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For windows of 16 words and for items of 9 and of 11 to 15.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 5, 7, 8))
#: For items of other lengths.
SHORT = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2), (0, 1, 3)), 6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 3, 4),), 8: ((0, 1, 3, 4),), 10: ((0, 1, 2, 3), (0, 1, 3, 4)),
}
_NUMBER = {m: i for i, m in enumerate(dict.fromkeys([*MASKS, *(m for masks in SHORT.values() for m in masks)]))}
WINDOW = 16
AGREE = 0.8
#: Bound of what is broadcast: seeds at SEED_BYTES each and word hashes at 8.
BROADCAST_BYTES = 64 << 20
SEED_BYTES = 48
#: Parts that a seed's documents are spread over where both sides are shuffled.
SALTS = 8


#: Letters of scripts written without spaces.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks whose seeds find every accepted window of an item of n words."""
    return SHORT.get(n, MASKS)


def _masked(mask: tuple[int, ...]):
    return lambda i: F.xxhash64(F.lit(_NUMBER[mask]), *[F.get("hs", i + k) for k in mask])


def _hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, hs (hash of each word; where no spaces are written, of each letter)."""
    spaced = F.regexp_replace(F.col(text), UNSPACED, " $0 ")
    return df.select(key, F.transform(words(spaced), lambda w: F.xxhash64(w)).alias("hs"))


def _seeded(hashed: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """Adds seeds: those of each mask in turn."""
    parts = []
    for mask in masks:
        n = F.size("hs") - mask[-1]
        parts.append(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), _masked(mask))).otherwise(F.array().cast("array<bigint>")))
    return hashed.withColumn("seeds", F.concat(*parts))


def _place(pos: Column, n: Column, masks: list[tuple[int, ...]]) -> Column:
    """Where a seed begins, from its place among all seeds of a text of n words."""
    out, starts = pos, F.lit(0)
    for mask in masks[:-1]:
        starts = starts + F.greatest(n - mask[-1], F.lit(0))
        out = F.when(pos >= starts, pos - starts).otherwise(out)
    return out


def _seed_at(seed):
    return lambda i: F.struct(seed(i).alias("b_seed"), F.when(i > 0, seed(i - 1)).alias("before"), i.alias("off"))


def _item_seeds(bench: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """item_id, item (which text of that id), b_seed, before (the seed one place before, under the same mask), off."""
    n = F.size("hs")
    parts = []
    for mask in masks:
        lengths = [k for k in range(1, WINDOW + 1) if mask in masks_for(k)]
        # the condition is also within the sequence, which may be computed for other rows too
        last = F.greatest(n - mask[-1] - 1, F.lit(0))
        parts.append(F.when(F.least(n, F.lit(WINDOW)).isin(lengths), F.transform(F.sequence(F.lit(0), last), _seed_at(_masked(mask)))))
    none = F.array().cast("array<struct<b_seed:bigint,before:bigint,off:int>>")
    return bench.select("item_id", "item", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("s")).select("item_id", "item", "s.*")


def _seeds(hashed: DataFrame, *keep: str) -> DataFrame:
    # an outer explode: else the optimiser would add a filter that computes the seeds once more
    return hashed.select(*keep, F.posexplode_outer("seeds").alias("pos", "seed"))


def best_window(agree: Column, n: Column) -> Column:
    """Most agreeing places in any window, from an array of 0 and 1 of length n."""
    size = F.least(F.lit(WINDOW), n)
    sums = lambda i: F.aggregate(F.slice(agree, i + 1, size), F.lit(0), lambda a, x: a + x)
    return F.array_max(F.transform(F.sequence(F.lit(0), n - size), sums))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, words (most agreeing in a window), window, start_word of each leak.

    docs: doc_id, text.  items: item_id, text.
    """
    bench = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t"))
    bench = _hashes(bench, "item_id", "t").dropDuplicates(["item_id", "hs"]).withColumn("item", F.xxhash64("hs"))
    n = F.size("hs")
    sizes = bench.where(n > 0).groupBy(F.least(n, F.lit(WINDOW)).alias("n")).agg(F.count("*").alias("items"), F.sum(n).alias("words")).collect()
    masks = list(dict.fromkeys(m for r in sorted(sizes) for m in masks_for(r["n"]))) or list(MASKS)
    seeds = sum(r["words"] - r["items"] * m[-1] for r in sizes for m in masks_for(r["n"]))
    small = SEED_BYTES * seeds + 8 * sum(r["words"] for r in sizes) <= BROADCAST_BYTES
    b = _item_seeds(bench, masks)
    whole = bench.select("item_id", "item", F.col("hs").alias("bw"))

    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    d = _seeded(_hashes(d, "doc_id", "t"), masks)
    s = _seeds(d, "doc_id", "hs", "seeds")
    prior = F.get("seeds", F.col("pos") - 1)
    if small:
        new_run = F.col("before").isNull() | prior.isNull() | (prior != F.col("before"))
        hits = s.join(F.broadcast(b), (s["seed"] == b["b_seed"]) & new_run)
        hits = hits.select("doc_id", "item_id", "item", "hs", (_place(F.col("pos"), F.size("hs"), masks) - F.col("off")).alias("diag"))
        hits = hits.join(F.broadcast(whole), ["item_id", "item"])
    else:  # ids and seeds alone are shuffled; word hashes join the hits later
        salt = F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).cast("int")
        thin = s.select("doc_id", "seed", prior.alias("prior"), _place(F.col("pos"), F.size("hs"), masks).alias("at"), salt.alias("salt"))
        b = b.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        new_run = F.col("before").isNull() | F.col("prior").isNull() | (F.col("prior") != F.col("before"))
        met = thin.join(b, (F.col("seed") == F.col("b_seed")) & (F.col("salt") == F.col("b_salt")) & new_run)
        met = met.select("doc_id", "item_id", "item", (F.col("at") - F.col("off")).alias("diag")).distinct()
        hits = met.join(d.select("doc_id", "hs"), "doc_id").join(whole, ["item_id", "item"])
    n = F.size("bw")
    agree = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when((F.col("diag") + j >= 0) & (F.get("hs", F.greatest(F.col("diag") + j, F.lit(0))) == F.get("bw", j)), 1).otherwise(0))
    laid = hits.select("doc_id", "item_id", "diag", n.alias("n"), agree.alias("agree"))
    # from a generator, so that the filter stays behind the join and the join keeps its generated code
    best = F.struct(best_window(F.col("agree"), F.col("n")).alias("words"), F.least(F.lit(WINDOW), F.col("n")).alias("window"), F.greatest(F.col("diag"), F.lit(0)).alias("start_word"))
    leaks = laid.select("doc_id", "item_id", F.explode_outer(F.array(best)).alias("b")).select("doc_id", "item_id", "b.*").where(F.col("words") >= F.ceil(F.col("window") * AGREE))
    top = F.max(F.struct("words", (-F.col("start_word")).alias("back"), "window"))
    return leaks.groupBy("doc_id", "item_id").agg(top.alias("t")).select("doc_id", "item_id", F.col("t.words").alias("words"), F.col("t.window").alias("window"), (-F.col("t.back")).alias("start_word"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` into which no item has leaked, null ids and texts included."""
    bad = overlaps(docs, items).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")
