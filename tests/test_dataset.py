import hashlib

from pyspark.sql import functions as F

from factloom import rules
from factloom.operators import dataset


def _rows(spark, n=60):
    labels = ["ORDER_PLACED", next(iter(rules.ALIASES)), rules.LEGACY_TYPES[0], rules.NO_EVENT]
    rows = [(k, ("train", "val", "test")[k % 3], f"Paid 5.00 for ORD-{k} on 2024-01-0{k % 9 + 1}.", labels[k % 4], f"ORD-{k}", "5.00" if k % 2 else "", None) for k in range(n)]
    return spark.createDataFrame(rows, "key long, split string, text string, event_type string, order_reference string, amount string, temporal string")


def test_index_and_provenance(spark):
    rows = _rows(spark)
    want = {k: i for s in range(3) for i, k in enumerate(range(s, 60, 3))}
    for parts in (1, 7):
        got = dataset.numbered(rows.repartition(parts), "split", "key").collect()
        assert {r.key: r["index"] for r in got} == want
    one = dataset.convert_labels(rows, "key").where("sample_id = 'ds_v3_val_0002'").first()
    assert one.provenance.asDict() == {
        "source_dataset_version": "2", "source_split": "val", "source_index": 1, "text_hash": hashlib.sha256(one.text.encode()).hexdigest()[:12],
    }
    assert one.text.startswith("Paid 5.00 for ORD-4 ") and one.event_type == "ORDER_PLACED"
    legacy = dataset.convert_labels(rows, "key").where("not is_canonical").first()
    assert legacy.event_type == rules.LEGACY_TYPES[0] and legacy.canonical_event_type is None
    assert dataset.canonical_only(dataset.convert_labels(rows, "key")).count() == 45
    assert dataset.numbered(rows.limit(0), "split", "key").count() == 0


def test_manifest_and_audit(spark):
    samples = dataset.convert_labels(_rows(spark), "key")
    counts = {(r.dimension, r.split, r.value): (r.samples, r.canonical) for r in dataset.manifest(samples).collect()}
    assert counts["total", "", ""] == (60, 45) and counts["split", "val", ""] == (20, 15)
    assert counts["canonical", "", dataset.UNMAPPED] == (15, 0) and sum(v[0] for k, v in counts.items() if k[0] == "split_canonical") == 60
    found = {r.check: r.violations for r in dataset.audit(samples).collect()}
    assert set(found.values()) == {0, len(rules.CLASSIFIER_CLASSES) - 3}
    broken = samples.withColumn("sample_id", F.lit("x")).withColumn("text", F.lit(" "))
    found = {r.check: r.violations for r in dataset.audit(broken).collect()}
    assert found["duplicate sample ids"] == 59 and found["blank texts"] == 60


def test_augmentation_is_the_same_on_any_partitioning(spark):
    rows = _rows(spark, 12)
    got = {tuple(r) for r in dataset.augment(rows, 40, "key").collect()}
    assert got == {tuple(r) for r in dataset.augment(rows.repartition(5), 40, "key").collect()} and len(got) == 40
    assert {g[0] for g in got} == {f"ds_ev_{k:03d}" for k in range(1, 41)}
    base = {r.key: r for r in rows.collect()}
    for name, text, order, amount, temporal, at in got:
        if int(name[-3:]) <= 12:
            assert text == base[at].text and order == base[at].order_reference
            continue
        want = base[at].text.replace(f"ORD-{at}", order)
        want = want.replace("5.00", amount) if base[at].amount else want
        assert text == want and order.split("-")[0] + "-" in rules.AUGMENT_ORDER_PREFIXES and temporal is None
        assert amount in rules.AUGMENT_AMOUNTS if base[at].amount else amount == base[at].amount
    assert {g[0] for g in got} != {tuple(r)[0] for r in dataset.augment(rows, 41, "key").collect()}
    assert dataset.augment(rows, 5, "key").count() == 12 and dataset.augment(rows.limit(0), 5, "key").count() == 0
