r"""Filter interaction audit: how five filters remove documents in every order, from Walsh-Hadamard parity sums.

A document's mask has a bit for each filter that it fails. For each part (source) and label stratum, and each of the 32 subsets k of the filters, one signed
sum is aggregated over the documents: +1 for an even number of failures within k, -1 for an odd one. These 32 sums are the Walsh-Hadamard transform of how
many documents have each mask; the transform is its own inverse up to a factor of 32, so the cells come back as exact integers. Orders and
steps are sums of cells: a step removes the masks that hold its bit and none of an earlier step. Over all 120 orders a filter is the first failure
of a mask with m bits, itself among them, in 120 / m of them: the closed form of its Shapley value.

Filters (texts whole, a null one is empty; words are maximal `[^\x20\x09-\x0D]+`, case-sensitive): A under 200 words; B 100 * distinct < 50 * words; C 100 * `[A-Z]` > 2 * code points;
D any of `[#$%&*|]`; E identical to the text of any smaller doc_id.

Equal texts have equal A to D, so copies meet as one row for each text digest (SHA-256), part and stratum, summed before they are shuffled: a group of copies of any size costs a task its parts.
Python is not used.

Defined results: a null source is the part ''; a row without doc_id never fails E, gives no copy a smaller id and has no labels; rows of one id and text don't fail E for each other; an id
with several labels has quality 1 (or toxic 1) if any has; labels without a document count nowhere. Other columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> Column:
    """The mask of A to D: bit i for letter i."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n, distinct, capitals = F.size(words), F.size(F.array_distinct(words)), F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))


def _sign(mask: Column, subset: Column) -> Column:
    """+1 if the mask has an even number of bits of the subset, else -1."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(subset)) % 2)


def counted(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, good, toxic, early, first, again): documents of a part and stratum by their mask of A to D; first of them pass E, again fail it. Several rows for the same ones."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("early"))
    # rows without an id have no label; they are dealt by text and task, so that they don't meet under one key
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(0).cast("long")), "spread": F.when(F.col("id").isNull(), F.concat(F.hex("digest"), F.spark_partition_id().cast("string"))).otherwise(F.lit(""))})
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(known.withColumn("spread", F.lit("")), ["key", "spread"], "left").na.fill(False, ["good", "toxic"])
    kinds = ["digest", "early", "part", "good", "toxic"]
    # a row for each id of a text first, so that what meets by text alone are its parts and strata
    ids = rows.groupBy("key", "spread", "id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy(*kinds).agg(F.min("id").alias("least"), F.min_by("n", "id").alias("of_least"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("without_id"))
    over = groups.groupBy("digest").agg(F.min("least").alias("over_all"))
    first = F.col("without_id") + F.when(F.col("least") == F.col("over_all"), F.col("of_least")).otherwise(F.lit(0))
    return groups.join(over, "digest").select("part", "good", "toxic", "early", first.alias("first"), (F.col("n") - first).alias("again"))


def parities(documents: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, good, toxic, s0 to s31): the 32 signed sums of each part and stratum."""
    last = ALL >> 1
    rows = counted(documents, labels, **columns)
    sums = [F.sum(_sign(F.col("early"), F.lit(k)) * (F.col("first") + F.col("again") * (-1 if k & last else 1))).cast("long").alias(f"s{k}") for k in range(ALL)]
    return rows.groupBy("part", "good", "toxic").agg(*sums)


def cells(sums: DataFrame) -> DataFrame:
    """(part, good, toxic, cells): documents of each mask, from the inverse transform; cells[m] of mask m."""
    held = F.array(*[f"s{k}" for k in range(ALL)])
    back = f"transform(sequence(0, {ALL - 1}), m -> aggregate(sequence(0, {ALL - 1}), 0L, (sum, k) -> sum + sums[k] * (1 - 2 * (bit_count(m & k) % 2))) div {ALL})"
    return sums.select("part", "good", "toxic", held.alias("sums")).select("part", "good", "toxic", F.expr(back).alias("cells"))


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit of its filter, bits of the steps before) of all orders."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), i + 1, 1 << f, before))
            before |= 1 << f
    return out


def audit(documents: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    strata = cells(parities(documents, labels, **columns))
    held = [F.col("cells")[m] for m in range(ALL)]
    of = lambda when, name: F.array(*[F.coalesce(F.sum(F.when(when, c)), F.lit(0).cast("long")) for c in held]).alias(name)
    parts = strata.groupBy("part").agg(of(F.lit(True), "all"), of(F.col("good"), "good"), of(F.col("toxic"), "toxic"))
    step = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    every = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{i},"bit":{b},"before":{p}}}' for o, i, b, p in steps()) + "]"), step)
    rows = parts.withColumn("x", F.explode(every)).select("part", "all", "good", "toxic", "x.*")
    total = lambda of, when, value="c": F.expr(f"aggregate(transform({of}, (c, m) -> if({when}, {value}, 0L)), 0L, (a, c) -> a + c)")
    removed, orders = "(m & bit) > 0 and (m & before) = 0", len(steps()) // len(FILTERS)
    out = {
        "kept": total("all", "(m & (before | bit)) = 0"), "removed": total("all", removed), "redundant": total("all", "(m & bit) > 0 and (m & before) > 0"), "unique_fails": total("all", "m = bit"),
        "good_lost": total("good", removed), "toxic_lost": total("toxic", removed), "shapley": total("all", "(m & bit) > 0", f"c * ({orders} div bit_count(m))"),
    }
    return rows.select("part", "filter_order", "step", *[c.cast("long").alias(n) for n, c in out.items()])
