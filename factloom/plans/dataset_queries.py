"""Registered queries over labelled texts: one for each order, the label and the split by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import rules
from factloom.operators import curation, dataset, leakage
from factloom.plans import case_tables as ct

LABELS = [*rules.CANONICAL_TYPES, *rules.ALIASES, *rules.LEGACY_TYPES, rules.NO_EVENT]
#: Rows that augmentation makes for each one given.
TIMES = 3


def labelled(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    money, day = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    order = F.concat(F.lit("ORD-"), k.cast("string"))
    split = F.when(k % 10 < 7, "train").when(k % 10 == 7, "val").otherwise("test")
    return ct.table(spark, sf_dir, "orders").select(
        k.alias("key"), split.alias("split"), F.element_at(F.array(*map(F.lit, LABELS)), (k % len(LABELS) + 1).cast("int")).alias("event_type"),
        F.concat(F.lit("Paid "), money, F.lit(" for "), order, F.lit(" on "), day, F.lit(".")).alias("text"), order.alias("order_reference"),
        F.when(k % 3 != 0, money).alias("amount"), F.when(k % 4 != 0, day).alias("temporal"),
    )


def _listed(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


_CANONICAL = {t: t for t in rules.CANONICAL_TYPES} | rules.ALIASES | {rules.NO_EVENT: rules.NO_EVENT}
_CASE = "CASE " + " ".join(f"WHEN et='{a}' THEN '{b}'" for a, b in _CANONICAL.items()) + " END"
_IN = lambda types: "(" + ",".join(f"'{t}'" for t in types) + ")"
BASE = f"""
b AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey%10<7 THEN 'train' WHEN o_orderkey%10=7 THEN 'val' ELSE 'test' END AS split,
    ({_listed(LABELS)})[CAST(o_orderkey%{len(LABELS)}+1 AS BIGINT)] AS et,
    'Paid '||CAST(o_totalprice AS DECIMAL(18,2))||' for ORD-'||o_orderkey||' on '||strftime(o_orderdate,'%Y-%m-%d')||'.' AS text, 'ORD-'||o_orderkey AS order_reference,
    CASE WHEN o_orderkey%3<>0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount, CASE WHEN o_orderkey%4<>0 THEN strftime(o_orderdate,'%Y-%m-%d') END AS temporal
  FROM orders),
c AS (SELECT *, {_CASE} AS canon, CASE WHEN et IN {_IN(rules.CANONICAL_TYPES)} THEN 'CANONICAL' WHEN et IN {_IN(rules.ALIASES)} THEN 'COMPATIBILITY_ALIAS'
    WHEN et='{rules.NO_EVENT}' THEN 'NEGATIVE_SAMPLE' ELSE 'LEGACY_DISPUTE' END AS cat, row_number() OVER (PARTITION BY split ORDER BY key)-1 AS i FROM b)"""


def _flat(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "provenance.*", "split", "text", "original_event_type", "canonical_event_type", "taxonomy_category", "is_canonical", "event_type")


FLAT_SQL = """SELECT 'ds_v3_'||split||'_'||CASE WHEN i<9999 THEN lpad(CAST(i+1 AS VARCHAR),4,'0') ELSE CAST(i+1 AS VARCHAR) END AS sample_id, '2' AS source_dataset_version,
    split AS source_split, i AS source_index, substr(sha256(text),1,12) AS text_hash, split, text, et AS original_event_type, canon AS canonical_event_type, cat AS taxonomy_category,
    canon IS NOT NULL AS is_canonical, coalesce(canon, et) AS event_type FROM c"""


def _converted(spark, sf_dir) -> DataFrame:
    return dataset.convert_labels(labelled(spark, sf_dir), "key")


def _damaged(spark, sf_dir) -> DataFrame:
    """A converted dataset of which some rows are broken, to audit the audit."""
    n = F.col("provenance.source_index")
    d = _converted(spark, sf_dir)
    return (
        d.withColumn("sample_id", F.when(n % 50 == 7, "same").otherwise(F.col("sample_id"))).withColumn("text", F.when(n % 40 == 3, "  ").otherwise(F.col("text")))
        .withColumn("taxonomy_category", F.when(n % 30 == 1, "OTHER").otherwise(F.col("taxonomy_category")))
        .where("not (split = 'test' and canonical_event_type <=> 'ORDER_PLACED')")
    )


AUDIT_SQL = f"""WITH {BASE}, d AS (SELECT CASE WHEN i%50=7 THEN 'same' ELSE split||i END AS sid, CASE WHEN i%40=3 THEN '' ELSE text END AS t, CASE WHEN i%30=1 THEN 'OTHER' ELSE cat END AS cat, canon, et, split
    FROM c WHERE NOT (split='test' AND canon IS NOT NULL AND canon='ORDER_PLACED'))
  SELECT 'duplicate sample ids' AS "check", count(*)-count(DISTINCT sid) AS violations FROM d UNION ALL SELECT 'missing sample ids', 0
  UNION ALL SELECT 'blank texts', count(*) FILTER (t='') FROM d UNION ALL SELECT 'negative with another original label', count(*) FILTER (canon='{rules.NO_EVENT}' AND et<>'{rules.NO_EVENT}') FROM d
  UNION ALL SELECT 'negative with another category', count(*) FILTER (canon='{rules.NO_EVENT}' AND cat<>'NEGATIVE_SAMPLE') FROM d
  UNION ALL SELECT 'legacy with a canonical type', 0 UNION ALL SELECT 'legacy with another category', count(*) FILTER (canon IS NULL AND cat<>'LEGACY_DISPUTE') FROM d
  UNION ALL SELECT 'classes missing in the tested split', {len(rules.CLASSIFIER_CLASSES)}-count(DISTINCT canon) FILTER (split='test') FROM d"""


def _lot(slot: str, choices) -> str:
    return f"(CAST('0x'||substr(md5('42|'||k||'|{slot}'),1,8) AS BIGINT)%{choices})"


def _pick(slot: str, values) -> str:
    return f"({_listed(values)})[{_lot(slot, len(values))}+1]"


AUGMENT_SQL = f"""WITH {BASE}, n AS (SELECT row_number() OVER (ORDER BY key)-1 AS i, text, order_reference, amount, temporal FROM b), m AS (SELECT count(*) AS n FROM n),
  g AS (SELECT k, CAST('0x'||substr(md5('42|'||k||'|base'),1,8) AS BIGINT)%m.n AS base, {_pick('prefix', rules.AUGMENT_ORDER_PREFIXES)}||({_lot('number', 90000)}+10000) AS o,
      {_pick('amount', rules.AUGMENT_AMOUNTS)} AS a, {_pick('date', rules.AUGMENT_DATES)} AS d FROM (SELECT unnest(range(m.n+1, m.n*{TIMES}+1)) AS k FROM m), m),
  x AS (SELECT k, base, replace(text, order_reference, o) AS t1, o AS order_reference, amount, temporal, a, d FROM g JOIN n ON i=base),
  y AS (SELECT k, base, CASE WHEN amount IS NOT NULL THEN replace(t1, amount, a) ELSE t1 END AS t2, order_reference, CASE WHEN amount IS NOT NULL THEN a END AS amount, temporal, d FROM x),
  z AS (SELECT k, CASE WHEN temporal IS NOT NULL THEN replace(t2, temporal, d) ELSE t2 END AS text, order_reference, amount, CASE WHEN temporal IS NOT NULL THEN d END AS temporal, base FROM y
    UNION ALL SELECT i+1, text, order_reference, amount, temporal, i FROM n)
  SELECT 'ds_ev_'||CASE WHEN k<100 THEN lpad(CAST(k AS VARCHAR),3,'0') ELSE CAST(k AS VARCHAR) END AS sample_id, text, order_reference, amount, temporal, base FROM z"""


def _turns(spark, sf_dir) -> DataFrame:
    """Every turn of every conversation as a text, split by conversation; some come back in the next split, altered."""
    c = F.col("conv_id")
    split = lambda n: F.element_at(F.array(*map(F.lit, curation.SPLITS)), (n % 3 + 1).cast("int"))
    turns = ct.table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    altered = F.when(c % 20 == 0, F.col("text")).when(c % 20 == 5, F.replace("text", F.lit("th"), F.lit("ht"))).otherwise(F.replace("text", F.lit("an"), F.lit("o")))
    again = turns.where(c % 5 == 0).select(F.concat(F.lit("again "), F.col("key")).alias("key"), split(c + 1).alias("split"), altered.alias("text"))
    return turns.select("key", split(c).alias("split"), "text").unionByName(again)


def register(add) -> None:
    add("converted_labels", lambda s, p: _flat(_converted(s, p)), f"WITH {BASE} {FLAT_SQL}")
    add("canonical_samples", lambda s, p: dataset.canonical_only(_converted(s, p)).groupBy("split", "event_type").agg(F.count(F.lit(1)).alias("samples")),
        f"WITH {BASE} SELECT split, canon AS event_type, count(*) AS samples FROM c WHERE canon IS NOT NULL GROUP BY ALL")
    add("dataset_manifest", lambda s, p: dataset.manifest_with_leakage(_converted(s, p)), f"""WITH {BASE},
        e AS (SELECT 'total' AS dimension, '' AS split, '' AS value, canon FROM c UNION ALL SELECT 'split', split, '', canon FROM c UNION ALL SELECT 'raw', '', et, canon FROM c
          UNION ALL SELECT 'canonical', '', coalesce(canon,'{dataset.UNMAPPED}'), canon FROM c UNION ALL SELECT 'category', '', cat, canon FROM c
          UNION ALL SELECT 'split_canonical', split, coalesce(canon,'{dataset.UNMAPPED}'), canon FROM c)
        SELECT dimension, split, value, count(*) AS samples, count(canon) AS canonical FROM e GROUP BY ALL
        UNION ALL SELECT 'leakage', a.split, b.split, count(*), 0 FROM (SELECT DISTINCT split, lower(text) AS t FROM c) a JOIN (SELECT DISTINCT split, lower(text) AS t FROM c) b ON a.t=b.t AND a.split<b.split GROUP BY ALL""")
    add("dataset_audit", lambda s, p: dataset.audit(_damaged(s, p)), AUDIT_SQL)
    add("augmented_texts", lambda s, p: dataset.augment(labelled(s, p), TIMES * ct.table(s, p, "orders").count(), "key"), AUGMENT_SQL)
    add("near_leakage", lambda s, p: leakage.near_leakage(_turns(s, p), "key").withColumn("ratio", F.round("ratio", 6)))
    add("near_leakage_counts", lambda s, p: leakage.near_leakage_counts(leakage.near_leakage(_turns(s, p), "key")))
