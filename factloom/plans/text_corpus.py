"""Order documents rendered as chat-like texts, one per order, whole table.

The driver's prose has no amounts, references or triggers, so the extraction
operators run on sentences rendered from order columns; those columns are then
what the SQL side expects. ``CORPUS`` states the same rendering in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans import case_tables as ct


#: Rendered documents of one task; extraction takes milliseconds for each, however few bytes its order has.
DOCUMENTS_PER_TASK = 10_000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the rendered documents, by their number: that of the orders."""
    tasks = -(-ct.table(spark, sf_dir, "orders").count() // DOCUMENTS_PER_TASK)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)


def by_document(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows that lost their place dealt out by document, to where ``documents`` lie."""
    return rows.repartition(_tasks(spark, sf_dir), "evidence_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a document. Orders are dealt out by document before they become texts, which are many times as
    wide, so what is found in documents meets them again where they lie. Nothing is stored."""
    return _documents(spark, sf_dir)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ct.table(spark, sf_dir, "orders").withColumn("evidence_id", F.concat(F.lit("evi_o_"), F.col("o_orderkey").cast("string")))
    o = by_document(spark, sf_dir, o.select("evidence_id", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"))
    ok = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    pad = F.lpad(ok.cast("string"), 9, "0")
    txn = F.when(ok % 5 == 0, F.replace(pad, F.lit("0"), F.lit("O"))).otherwise(pad)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    c = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    s = lambda x: x.cast("string")
    lines = F.filter(
        F.array(
            c("Order ORD-", pad, " placed on ", F.date_format(day, "yyyy-MM-dd"), ". Total Due: ",
              F.when(ok % 3 == 0, "USD").when(ok % 3 == 1, "INR").otherwise("EUR"), " ", F.format_number(F.col("o_totalprice"), 2), "."),
            c("Payment ", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("successful"), ": Transaction ID: TXN-", txn,
              " Amount: INR ", s(ok % 9000 + 100), "."),
            c("Item shipped via FedEx on ", F.date_format(F.date_add(day, 3), "d MMMM yyyy"), "."),
            c("The refund of $", s(ok % 900 + 10), ".50 ",
              F.when(ok % 3 == 0, "was not").when(ok % 3 == 1, "will be").otherwise("may be"), " completed."),
            c("If approved, refund credited on ", F.date_format(F.date_add(day, 20), "dd/MM/yyyy"), "."),
            c(two(ok % 24), ":", two(ok % 60), " – Customer"),
            c("I contacted support yesterday from +91 98765", F.lpad(s(ok % 100000), 5, "0"), "."),
            c("Refund requested and item delivered for order ORD-", pad, "."),
            F.when(ok % 10 == 0, "This record is fictional and does not establish payment."),
        ),
        lambda x: x.isNotNull(),
    )
    return o.select(
        "evidence_id", ok.alias("ok"),
        F.array_join(lines, "\n").alias("text"),
        F.array_join(F.slice(lines, 1, 4), "\n").alias("page_one"),
        F.array_join(F.slice(lines, F.lit(5), F.size(lines)), "\n").alias("page_two"),
        F.when(ok % 2 == 0, F.date_format(day, "yyyy-MM-dd")).alias("anchor"),
        F.when(ok % 4 == 0, "IN").alias("country"),
    )


CORPUS = """
d0 AS (SELECT o_orderkey AS ok, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day, lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS pad,
    CASE o_orderkey%3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'EUR' END AS cur FROM orders),
d1 AS (SELECT *, CASE WHEN ok%5=0 THEN replace(pad,'0','O') ELSE pad END AS txn,
   ['January','February','March','April','May','June','July','August','September','October','November','December'] AS mn,
   day+3 AS sday, day+20 AS rday FROM d0),
d2 AS (SELECT *, 'evi_o_'||ok AS evidence_id,
   'Order ORD-'||pad||' placed on '||CAST(day AS VARCHAR)||'.' AS s1,
   'Total Due: '||cur||' '||format('{:,.2f}',o_totalprice)||'.' AS s2,
   'Payment '||CASE WHEN o_orderstatus='F' THEN 'failed' ELSE 'successful' END||': Transaction ID: TXN-'||txn||' Amount: INR '||(ok%9000+100)||'.' AS s3,
   'Item shipped via FedEx on '||day(sday)||' '||mn[month(sday)]||' '||year(sday)||'.' AS s4,
   'The refund of $'||(ok%900+10)||'.50 '||CASE ok%3 WHEN 0 THEN 'was not' WHEN 1 THEN 'will be' ELSE 'may be' END||' completed.' AS s5,
   'If approved, refund credited on '||strftime(rday,'%d/%m/%Y')||'.' AS s6,
   lpad(CAST(ok%24 AS VARCHAR),2,'0')||':'||lpad(CAST(ok%60 AS VARCHAR),2,'0') AS clock,
   'I contacted support yesterday from +91 98765'||lpad(CAST(ok%100000 AS VARCHAR),5,'0')||'.' AS s8,
   'Refund requested and item delivered for order ORD-'||pad||'.' AS s9,
   CASE WHEN ok%10=0 THEN 'This record is fictional and does not establish payment.' END AS s10,
   CASE WHEN ok%2=0 THEN CAST(day AS VARCHAR) END AS anchor, CASE WHEN ok%4=0 THEN 'IN' END AS country FROM d1),
doc AS (SELECT *, s1||' '||s2||chr(10)||s3||chr(10)||s4||chr(10)||s5 AS page_one,
   s6||chr(10)||clock||' – Customer'||chr(10)||s8||chr(10)||s9||coalesce(chr(10)||s10,'') AS page_two FROM d2),
txt AS (SELECT *, page_one||chr(10)||page_two AS text FROM doc)
"""


def sql(body: str, extra: str = "") -> str:
    return "WITH " + CORPUS + ("," + extra if extra else "") + " " + body
