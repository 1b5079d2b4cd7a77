"""The driver's commerce tables read as case files.

The tables hold no disputes, so cases, documents and events are derived row by
row from customers, orders and line items. ``PRELUDE`` states the same rules in
SQL for the oracle. Every row of the source tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session

#: Line items of one task. Each becomes about four events ten times as wide, which a join sorts in memory.
LINES_PER_TASK = 150_000

_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived input table, written once per application in the shared checkpoint folder.

    The engine's inputs are stored tables; several queries read the same ones.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = session.write_shared(build(spark, sf_dir), name)
    return spark.read.parquet(_written[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n):
    return F.timestamp_seconds(F.lit(1704067200) + n * 60)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("case_"), key.cast("string")).alias("case_id"),
        F.concat(F.lit("usr_"), F.col("c_nationkey").cast("string")).alias("user_id"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("Account in "), F.col("c_mktsegment")).alias("description"),
        F.when(key % 10 == 0, "REVIEW_NEEDED").when(key % 7 == 0, "PROCESSING").otherwise("READY").alias("status"),
        F.array(F.concat(F.lit(" "), F.col("c_mktsegment")), F.lower("c_mktsegment"), F.lit("Vip "), F.lit("")).alias("tags"),
        _minutes(key).alias("created_at"),
        _minutes(key).alias("updated_at"),
    )


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    return o.select(
        F.col("o_orderkey").alias("ok"),
        F.concat(F.lit("case_"), F.col("o_custkey").cast("string")).alias("case_id"),
        F.concat(F.lit("usr_"), F.col("c_nationkey").cast("string")).alias("user_id"),
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,4)").alias("total"),
        F.col("o_orderdate").cast("date").alias("odate"),
    )


def _source_lines(spark, sf_dir):
    """Line items under short names; what is derived from them is added after they have been shuffled."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"), "l_partkey",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
    )


def _dealt(spark, sf_dir, rows, by: str):
    """Rows dealt out by a column into tasks that follow the number of line items; as they are where the session has as many.

    Bytes don't tell how much a task has to hold: these are narrow rows that become many wide ones.
    """
    tasks = -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    return rows.repartition(tasks, by) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def _line_facts() -> dict:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    percent = F.round(F.col("l_discount") * 100).cast("bigint")
    refund_cents = F.floor((cents * (100 - percent)) / 100)
    return {
        "lid": F.concat_ws("_", "ok", "ln", "l_partkey", "sk", cents),
        "price": F.col("l_extendedprice").cast("decimal(18,4)"),
        "refund": (refund_cents.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,4)"),
        "sdate": F.col("l_shipdate").cast("date"),
    }


def _lines(spark, sf_dir):
    facts = {name: column.alias(name) for name, column in _line_facts().items()}
    return _source_lines(spark, sf_dir).select("ok", "sk", "ln", *facts.values(), "l_returnflag", "l_linestatus")


def _active_version(ok):
    return F.when(ok % 20 != 19, (1 + ok % 2).cast("int"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    # made distinct after the join, which has brought an order's lines together
    slips = _dealt(spark, sf_dir, _source_lines(spark, sf_dir).select("ok", "sk"), "ok").join(orders.select("ok", "case_id", "user_id"), "ok").distinct()
    ok, sk = F.col("ok"), F.col("sk")
    own = orders.select(
        "ok", "case_id", "user_id",
        F.concat(F.lit("evi_o_"), ok.cast("string")).alias("evidence_id"),
        F.concat(F.lit("order_"), ok.cast("string"), F.lit(".pdf")).alias("original_filename"),
        _minutes(ok).alias("created_at"),
    )
    slip = slips.select(
        "ok", "case_id", "user_id",
        F.concat_ws("_", F.lit("evi_s"), ok, sk).alias("evidence_id"),
        F.concat(F.lit("slip_"), ok.cast("string"), F.lit("_"), sk.cast("string"), F.lit(".png")).alias("original_filename"),
        F.timestamp_seconds(F.lit(1704067200) + ok * 60 + 1 + sk % 50).alias("created_at"),
    )
    status = (
        F.when(ok % 25 == 0, "REVIEW_NEEDED").when(ok % 25 == 1, "FAILED").when(ok % 25 == 2, "QUEUED")
        .when(ok % 25 == 3, "EXTRACTING").otherwise("READY")
    )
    return own.unionByName(slip).select(
        "case_id", "user_id", "evidence_id", "original_filename",
        F.when(F.col("original_filename").endswith(".png"), "image/png").otherwise("application/pdf").alias("media_type"),
        (1000 + ok * 37 % 100000).alias("file_size_bytes"),
        F.sha2(F.concat(F.lit("f"), (ok % 97).cast("string"), F.col("case_id")), 256).alias("sha256_hash"),
        status.alias("status"),
        _active_version(ok).alias("active_processing_version"),
        F.concat(F.lit("run_"), F.col("evidence_id")).alias("current_run_id"),
        F.when(ok % 2 == 0, F.col("created_at")).otherwise(F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("heartbeat_at"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_code"),
        F.struct(
            F.lit(1).alias("page_count"), F.lit(100).alias("character_count"), F.lit("PASS").alias("quality_state"),
            F.lit(0).alias("entities_extracted"),
            F.when(ok % 50 == 7, 0).otherwise(2).alias("events_extracted"),
            _active_version(ok).alias("processing_version"), F.lit(None).cast("string").alias("diagnostic"),
        ).alias("extraction_summary"),
        "created_at",
    )


def _currency(ok):
    return F.when(ok % 3 == 0, "USD").when(ok % 3 == 1, "INR").otherwise("EUR")


def events(spark: SparkSession, sf_dir: str, by: str = "evidence_id") -> DataFrame:
    """Current events plus the superseded copies that active reads must not see.

    Orders and lines are dealt out by the document that states them, or its case, before each becomes its events,
    so a join with documents needn't shuffle the events, which are several times as many and as wide.
    """
    ok, ln = F.col("ok"), F.col("ln")
    s = lambda c: c.cast("string")
    ord_ref, txn_ref = F.concat(F.lit("ORD-"), s(ok)), F.concat(F.lit("TXN-"), s(ok))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    orders = _orders(spark, sf_dir).where(ok % 50 != 7)
    own = orders.withColumn("evidence_id", F.concat(F.lit("evi_o_"), s(ok))).withColumn("_own", F.lit(True))
    lines = _dealt(spark, sf_dir, _source_lines(spark, sf_dir), "ok").join(orders.select("ok", "case_id", "user_id"), "ok")
    slips = lines.withColumn("evidence_id", F.concat_ws("_", F.lit("evi_s"), ok, F.col("sk"))).withColumn("_own", F.lit(False))
    stated = _dealt(spark, sf_dir, own.unionByName(slips, allowMissingColumns=True).repartition(by), by)
    settles = (ln == 1) & (F.col("l_linestatus") == "F")
    returns = ~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))
    kinds = F.when(F.col("_own"), F.array(F.lit("o"), F.lit("p"))).otherwise(
        F.filter(F.array(F.lit("l"), F.when(returns, "r"), F.when(settles, "m")), lambda k: k.isNotNull())
    )
    rows = stated.withColumns(_line_facts()).withColumn("_kind", F.explode(kinds))

    def by_kind(**of):
        """What each kind of event has here: o placed, p paid, l shipped, r refund, m settled; the rest has nothing."""
        column = F  # the first when is the module's own
        for kinds, value in of.items():
            column = column.when(F.col("_kind").isin(*kinds), value)
        return column

    share = lambda n: F.lit(0.5) + ((n % 50) / F.lit(100.0))
    current = rows.select(
        "ok", "case_id", "user_id", "evidence_id",
        F.concat(F.lit("evt_"), "_kind", F.lit("_"), F.when(F.col("_own"), s(ok)).otherwise(F.col("lid"))).alias("event_id"),
        by_kind(
            o=F.lit("ORDER_PLACED"),
            p=F.when(F.col("o_orderstatus") == "F", "PAYMENT_FAILED").when(F.col("o_orderstatus") == "O", "PAYMENT_MADE").otherwise("PAYMENT_SENT"),
            l=F.lit("ITEM_SHIPPED"),
            r=F.when(F.col("l_returnflag") == "R", "REFUND_REQUESTED").when(F.col("l_returnflag") == "A", "REFUND_COMPLETED").otherwise("REFUND_FAILED"),
            m=F.lit("PAYMENT_MADE"),
        ).alias("event_type"),
        by_kind(
            op=F.col("total"), l=F.when((ln % 3 == 0) | (ln == 5), F.col("price")), r=F.when(ln % 2 == 0, F.col("refund")), m=F.col("price"),
        ).alias("amount_value"),
        by_kind(
            o=_currency(ok), l=F.when(ln % 2 == 0, F.lit(None).cast("string")).when(ln % 5 == 0, "GBP").otherwise(_currency(ok)),
        ).alias("amount_currency"),
        by_kind(
            ro=ord_ref, p=F.when(ok % 4 != 0, ord_ref),
            l=F.when((ln == 4) & (ok % 10 == 3), F.lit(None).cast("string")).when(ln % 2 == 0, F.concat(F.lit(" ord_"), s(ok))).otherwise(ord_ref),
        ).alias("order_reference"),
        by_kind(prm=txn_ref).alias("transaction_reference"),
        by_kind(
            o=day(F.col("odate")), p=day(F.date_add("odate", (ok % 5).cast("int") - 1)),
            l=F.when(ln == 6, "soon").when(ln == 5, F.concat(day(F.col("sdate")), F.lit("T08:30:00Z"))).otherwise(day(F.col("sdate"))),
            r=day(F.date_add("sdate", 10)), m=day(F.date_add("sdate", 1)),
        ).alias("temporal_information"),
        by_kind(o=share(ok * 7), p=share(ok * 11), l=share(ok + ln * 3), r=share(ok * 3 + ln), m=share(ok * 13)).alias("model_confidence"),
        F.when((F.col("_kind") == "l") & (ln % 7 == 0), "NEGATED").otherwise("POSITIVE").alias("polarity"),
        by_kind(o=F.lit("Order placed"), l=F.lit("shipped"), r=F.lit("refund"), m=F.lit("paid")).alias("trigger_raw_text"),
        F.when(F.col("_own"), 0).otherwise(ln).alias("_line"),
    )
    version = F.coalesce(_active_version(ok), F.lit(1))
    # a superseded copy is the same row seen with version 1 and another amount
    copies = F.when(version == 2, F.array(F.lit(2), F.lit(1))).otherwise(F.array(version))
    out = current.withColumn("processing_version", F.explode(copies))
    old = F.col("processing_version") != version
    return out.select(
        "case_id", "user_id", "evidence_id",
        F.when(old, F.concat(F.lit("old_"), F.col("event_id"))).otherwise(F.col("event_id")).alias("event_id"),
        "processing_version",
        F.concat(F.lit("run_"), F.when(old, "old_").otherwise(""), F.col("evidence_id")).alias("processing_run_id"),
        F.lit(True).alias("is_active"), "event_type",
        F.when(F.col("model_confidence") < 0.6, "REVIEW_NEEDED").otherwise("VALIDATED").alias("decision_state"),
        "trigger_raw_text",
        (F.col("_line") * 10).alias("char_start"),
        F.when(F.col("_line") == 0, 0).otherwise(F.col("_line") * 10 + 12).alias("char_end"),
        (1 + F.col("_line") % 2).alias("page_number"),
        "order_reference", "transaction_reference", "temporal_information",
        F.when(old, F.col("amount_value") + 1).otherwise(F.col("amount_value")).cast("decimal(18,4)").alias("amount_value"),
        "amount_currency", "polarity", F.lit("ASSERTED").alias("modality"), F.lit("PAST").alias("tense"),
        F.when(F.col("_line") % 3 == 1, F.concat(F.lit("agent "), F.col("_line").cast("string"))).alias("actor"),
        "model_confidence", _minutes(ok).alias("created_at"),
    )


PRELUDE = """
o AS (SELECT o_orderkey AS ok, 'case_'||o_custkey AS case_id, 'usr_'||c_nationkey AS user_id, o_orderstatus,
        CAST(o_totalprice AS DECIMAL(18,4)) AS total, CAST(o_orderdate AS DATE) AS odate
      FROM orders JOIN customer ON o_custkey=c_custkey),
l AS (SELECT l_orderkey AS ok, case_id, user_id, l_suppkey AS sk, l_linenumber AS ln,
        l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey||'_'||CAST(round(l_extendedprice*100) AS BIGINT) AS lid,
        CAST(l_extendedprice AS DECIMAL(18,4)) AS price,
        CAST((CAST(round(l_extendedprice*100) AS BIGINT)*(100-CAST(round(l_discount*100) AS BIGINT)))//100 AS DECIMAL(16,0))*0.01 AS refund,
        l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS sdate
      FROM lineitem JOIN o ON l_orderkey=ok),
case_t AS (SELECT 'case_'||c_custkey AS case_id, 'usr_'||c_nationkey AS user_id, c_name AS title,
        'Account in '||c_mktsegment AS description,
        CASE WHEN c_custkey%10=0 THEN 'REVIEW_NEEDED' WHEN c_custkey%7=0 THEN 'PROCESSING' ELSE 'READY' END AS status,
        c_mktsegment, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS created_at
      FROM customer),
evi0 AS (SELECT ok, case_id, user_id, 'evi_o_'||ok AS evidence_id, 'order_'||ok||'.pdf' AS original_filename,
        TIMESTAMP '2024-01-01' + to_minutes(ok) AS created_at FROM o
      UNION ALL
      SELECT ok, case_id, user_id, 'evi_s_'||ok||'_'||sk, 'slip_'||ok||'_'||sk||'.png',
        TIMESTAMP '2024-01-01' + to_minutes(ok) + to_seconds(1+sk%50) FROM (SELECT DISTINCT ok, sk, case_id, user_id FROM l)),
evi AS (SELECT ok, case_id, user_id, evidence_id, original_filename,
        CASE WHEN original_filename LIKE '%.png' THEN 'image/png' ELSE 'application/pdf' END AS media_type,
        1000 + ok*37%100000 AS file_size_bytes, sha256('f'||(ok%97)||case_id) AS sha256_hash,
        CASE ok%25 WHEN 0 THEN 'REVIEW_NEEDED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'QUEUED' WHEN 3 THEN 'EXTRACTING' ELSE 'READY' END AS status,
        CASE WHEN ok%20=19 THEN NULL ELSE 1+ok%2 END AS active_processing_version, 'run_'||evidence_id AS current_run_id,
        CASE WHEN ok%2=0 THEN created_at ELSE created_at + INTERVAL 1 DAY END AS heartbeat_at,
        CASE WHEN ok%50=7 THEN 0 ELSE 2 END AS events_extracted, created_at
      FROM evi0),
ev0 AS (
  SELECT ok, case_id, user_id, 'evt_o_'||ok AS event_id, 'evi_o_'||ok AS evidence_id, 'ORDER_PLACED' AS event_type,
    total AS amount_value, CASE ok%3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'EUR' END AS amount_currency,
    'ORD-'||ok AS order_reference, CAST(NULL AS VARCHAR) AS transaction_reference, CAST(odate AS VARCHAR) AS temporal_information,
    0.5+((ok*7)%50)/100.0::DOUBLE AS model_confidence, 'POSITIVE' AS polarity, 'Order placed' AS trigger_raw_text, 0 AS line FROM o
  UNION ALL
  SELECT ok, case_id, user_id, 'evt_p_'||ok, 'evi_o_'||ok,
    CASE o_orderstatus WHEN 'F' THEN 'PAYMENT_FAILED' WHEN 'O' THEN 'PAYMENT_MADE' ELSE 'PAYMENT_SENT' END,
    total, NULL, CASE WHEN ok%4<>0 THEN 'ORD-'||ok END, 'TXN-'||ok, CAST(odate + CAST(ok%5-1 AS INTEGER) AS VARCHAR),
    0.5+((ok*11)%50)/100.0::DOUBLE, 'POSITIVE', NULL, 0 FROM o
  UNION ALL
  SELECT ok, case_id, user_id, 'evt_l_'||lid, 'evi_s_'||ok||'_'||sk, 'ITEM_SHIPPED', CASE WHEN ln%3=0 OR ln=5 THEN price END,
    CASE WHEN ln%2=0 THEN NULL WHEN ln%5=0 THEN 'GBP' ELSE CASE ok%3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'EUR' END END,
    CASE WHEN ln=4 AND ok%10=3 THEN NULL WHEN ln%2=0 THEN ' ord_'||ok ELSE 'ORD-'||ok END, NULL,
    CASE WHEN ln=6 THEN 'soon' WHEN ln=5 THEN CAST(sdate AS VARCHAR)||'T08:30:00Z' ELSE CAST(sdate AS VARCHAR) END,
    0.5+((ok+ln*3)%50)/100.0::DOUBLE, CASE WHEN ln%7=0 THEN 'NEGATED' ELSE 'POSITIVE' END, 'shipped', ln FROM l
  UNION ALL
  SELECT ok, case_id, user_id, 'evt_r_'||lid, 'evi_s_'||ok||'_'||sk,
    CASE l_returnflag WHEN 'R' THEN 'REFUND_REQUESTED' WHEN 'A' THEN 'REFUND_COMPLETED' ELSE 'REFUND_FAILED' END,
    CASE WHEN ln%2=0 THEN refund END, NULL, 'ORD-'||ok, 'TXN-'||ok, CAST(sdate+10 AS VARCHAR),
    0.5+((ok*3+ln)%50)/100.0::DOUBLE, 'POSITIVE', 'refund', ln FROM l WHERE NOT (l_returnflag='N' AND l_linestatus='O')
  UNION ALL
  SELECT ok, case_id, user_id, 'evt_m_'||lid, 'evi_s_'||ok||'_'||sk, 'PAYMENT_MADE', price, NULL, NULL, 'TXN-'||ok,
    CAST(sdate+1 AS VARCHAR), 0.5+((ok*13)%50)/100.0::DOUBLE, 'POSITIVE', 'paid', ln FROM l WHERE ln=1 AND l_linestatus='F'),
evt AS (SELECT case_id, user_id, evidence_id, CASE WHEN c=1 THEN 'old_' ELSE '' END||event_id AS event_id,
    CASE WHEN c=1 THEN 1 ELSE coalesce(CASE WHEN ok%20=19 THEN NULL ELSE 1+ok%2 END,1) END AS processing_version,
    'run_'||CASE WHEN c=1 THEN 'old_' ELSE '' END||evidence_id AS processing_run_id, event_type,
    CASE WHEN model_confidence<0.6 THEN 'REVIEW_NEEDED' ELSE 'VALIDATED' END AS decision_state, trigger_raw_text,
    line*10 AS char_start, CASE WHEN line=0 THEN 0 ELSE line*10+12 END AS char_end, 1+line%2 AS page_number,
    order_reference, transaction_reference, temporal_information, CAST(amount_value+c AS DECIMAL(18,4)) AS amount_value,
    amount_currency, polarity, CASE WHEN line%3=1 THEN 'agent '||line END AS actor, model_confidence,
    TIMESTAMP '2024-01-01' + to_minutes(ok) AS created_at
  FROM ev0, (VALUES (0),(1)) v(c) WHERE ok%50<>7 AND (c=0 OR (ok%20<>19 AND ok%2=1))),
act AS (SELECT e.*, d.original_filename AS source_name, upper(trim(coalesce(amount_currency,''))) AS currency,
    __NORM__(order_reference) AS okey, __NORM__(transaction_reference) AS tkey
  FROM evt e JOIN evi d ON e.evidence_id=d.evidence_id AND e.case_id=d.case_id AND e.user_id=d.user_id
    AND e.processing_version=d.active_processing_version)
"""


def _norm(expr: str) -> str:
    up = f"upper(trim({expr}))"
    clean = f"regexp_replace({up}, '[\\s_-]', '', 'g')"
    bad = "('N/A','NA','NONE','NULL','REF','ID','ORDER','PO','TXN','UNKNOWN')"
    return f"(CASE WHEN length({clean})>=3 AND {up} NOT IN {bad} THEN {clean} END)"


PRELUDE = PRELUDE.replace("__NORM__(order_reference)", _norm("order_reference")).replace(
    "__NORM__(transaction_reference)", _norm("transaction_reference")
)


def sql(body: str, extra: str = "") -> str:
    """Oracle text: the shared projection, optional further CTEs, and the query."""
    return "WITH " + PRELUDE + ("," + extra if extra else "") + " " + body
