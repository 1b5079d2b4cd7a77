"""Building a labelled dataset: converted labels with provenance, manifest, audit, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import rules
from factloom.operators import curation
from factloom.operators.events import map_taxonomy
from factloom.session import materialize

UNMAPPED = "UNMAPPED_LEGACY"


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``index``, 0, 1, 2 ... in each group by the given order, without one task that holds a group.

    Rows are sorted by ranges; a row's index is its place in its range plus the counts of the group's ranges before.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id") - F.shiftleft("_range", 33))
    sizes = ranged.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("_group"), F.col("_range").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")
    )
    met = ranged.join(offsets, ranged[group].eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return met.withColumn("index", F.col("_place") + F.col("_offset")).drop("_id", "_range", "_place", "_group", "_of", "_offset")


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def convert_labels(rows: DataFrame, *order: str, prefix: str = "ds_v3", version: str = "2") -> DataFrame:
    """Labelled texts (split, text, event_type) under the canonical taxonomy, with where each came from.

    ``sample_id`` is split and place in it; a text's hash is the first 12 hex digits of its SHA-256. ``event_type``
    becomes the canonical type, or stays where there is none.
    """
    placed = map_taxonomy(numbered(rows, "split", *order)).withColumnRenamed("event_type", "original_event_type")
    provenance = F.struct(
        F.lit(version).alias("source_dataset_version"), F.col("split").alias("source_split"), F.col("index").alias("source_index"),
        F.substring(F.sha2("text", 256), 1, 12).alias("text_hash"),
    )
    return placed.select(
        F.concat(F.lit(f"{prefix}_"), F.col("split"), F.lit("_"), _padded(F.col("index") + 1, 4)).alias("sample_id"), provenance.alias("provenance"), "split", "text",
        "original_event_type", "canonical_event_type", "taxonomy_category", "is_canonical",
        F.coalesce("canonical_event_type", "original_event_type").alias("event_type"),
    )


def canonical_only(samples: DataFrame) -> DataFrame:
    return samples.where("is_canonical and canonical_event_type is not null")


def manifest(samples: DataFrame) -> DataFrame:
    """Counts of a converted dataset in one pass: dimension, split, value, samples, canonical ones.

    Dimensions: total, split, raw label, canonical label, category, and canonical label by split.
    """
    label = F.coalesce("canonical_event_type", F.lit(UNMAPPED))
    empty = F.lit("")
    keys = [
        ("total", empty, empty), ("split", F.col("split"), empty), ("raw", empty, F.col("original_event_type")), ("canonical", empty, label),
        ("category", empty, F.col("taxonomy_category")), ("split_canonical", F.col("split"), label),
    ]
    entries = F.array(*[F.struct(F.lit(d).alias("dimension"), s.alias("split"), v.alias("value")) for d, s, v in keys])
    counted = samples.select(F.inline(entries), "is_canonical")
    return counted.groupBy("dimension", "split", "value").agg(F.count(F.lit(1)).alias("samples"), F.count_if("is_canonical").alias("canonical"))


def manifest_with_leakage(samples: DataFrame) -> DataFrame:
    """The manifest and, as dimension ``leakage``, the texts that two splits share."""
    shared = curation.exact_leakage(samples.select("split", "text"))
    rows = shared.select(F.lit("leakage").alias("dimension"), F.col("split_a").alias("split"), F.col("split_b").alias("value"), F.col("texts").alias("samples"), F.lit(0).cast("long").alias("canonical"))
    return manifest(samples).unionByName(rows)


def audit(samples: DataFrame, tested: str = "test") -> DataFrame:
    """Broken rules of a converted dataset: check, violations; all from one aggregation.

    Ids are unique, texts aren't blank, negatives are negatives in all three labels, legacy rows have no canonical
    type and the legacy category, and the tested split holds every class.
    """
    negative, legacy = F.col("canonical_event_type") == rules.NO_EVENT, ~F.col("is_canonical")
    in_test = F.when((F.col("split") == tested) & F.col("is_canonical"), F.col("canonical_event_type"))
    checks = {
        "duplicate sample ids": F.count("sample_id") - F.count_distinct("sample_id"),
        "missing sample ids": F.count_if(F.col("sample_id").isNull()),
        "blank texts": F.count_if(F.trim(F.coalesce("text", F.lit(""))) == ""),
        "negative with another original label": F.count_if(negative & ~F.col("original_event_type").eqNullSafe(F.lit(rules.NO_EVENT))),
        "negative with another category": F.count_if(negative & ~F.col("taxonomy_category").eqNullSafe(F.lit("NEGATIVE_SAMPLE"))),
        "legacy with a canonical type": F.count_if(legacy & F.col("canonical_event_type").isNotNull()),
        "legacy with another category": F.count_if(legacy & ~F.col("taxonomy_category").eqNullSafe(F.lit("LEGACY_DISPUTE"))),
        "classes missing in the tested split": F.lit(len(rules.CLASSIFIER_CLASSES)) - F.count_distinct(in_test),
    }
    row = samples.agg(*[c.cast("long").alias(f"c{k}") for k, c in enumerate(checks.values())])
    named = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{k}").alias("violations")) for k, name in enumerate(checks)])
    return row.select(F.inline(named))


def _lot(seed: int, slot: str, choices: int) -> Column:
    """A choice for each ``sample`` and slot, the same on any partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), F.lit(slot)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % choices


def augment(rows: DataFrame, target: int, *order: str, seed: int = 42, prefix: str = "ds_ev") -> DataFrame:
    """The given texts and, up to ``target`` rows, copies with other order numbers, amounts and dates.

    rows(text, order_reference, amount, temporal): a copy's base and what replaces each slot that the base has are
    chosen by a hash of seed, number and slot. Columns: sample_id, text, order_reference, amount, temporal, base (its index).
    """
    columns = ["text", "order_reference", "amount", "temporal"]
    base = materialize(numbered(rows.withColumn("_all", F.lit(0)), "_all", *order).select("index", *columns), "base")
    count = base.count()
    own = base.select((F.col("index") + 1).alias("sample"), F.col("index").alias("base"), *columns)
    if not count or target <= count:
        made = own.limit(0)
    else:
        made = rows.sparkSession.range(count + 1, target + 1).withColumnRenamed("id", "sample")
        made = made.withColumn("base", _lot(seed, "base", count)).join(base.withColumnRenamed("index", "base"), "base")

    def chosen(slot: str, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (_lot(seed, slot, len(values)) + 1).cast("int"))

    new = {
        "order_reference": F.concat(chosen("prefix", rules.AUGMENT_ORDER_PREFIXES), (_lot(seed, "number", 90_000) + 10_000).cast("string")),
        "amount": chosen("amount", rules.AUGMENT_AMOUNTS), "temporal": chosen("date", rules.AUGMENT_DATES),
    }
    for slot, value in new.items():
        there = F.coalesce(F.col(slot) != "", F.lit(False))
        made = made.withColumn("_new", value).withColumn("text", F.when(there, F.replace("text", F.col(slot), F.col("_new"))).otherwise(F.col("text")))
        made = made.withColumn(slot, F.when(there, F.col("_new")).otherwise(F.col(slot))).drop("_new")
    out = own.unionByName(made)
    return out.select(F.concat(F.lit(f"{prefix}_"), _padded(F.col("sample"), 3)).alias("sample_id"), *columns, "base")
