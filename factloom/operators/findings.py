"""Cross-document findings for all cases at once.

Events of active document versions are grouped by normalised reference, then
compared across documents. Pairs are only built for discordant values
(``operators.skew``); advisories are aggregates and anti joins. All detectors
return the same flat columns (``FLAT``); ``case_findings`` adds citations, the
field difference struct and the active review.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import refs
from factloom.operators import skew
from factloom.operators.versions import active_events
from factloom.session import materialize

FLAT = [
    "case_id", "finding_id", "kind", "finding_type", "title", "summary", "severity", "conflict_state",
    "reference", "event_a", "event_b", "evidence_a", "evidence_b", "citations", "field", "value_a",
    "source_a", "value_b", "source_b", "model_confidence",
]
INCONSISTENCY, ADVISORY = "POTENTIAL_INCONSISTENCY", "MISSING_EVIDENCE_ADVISORY"
CONFLICT, CONTEXT = "POTENTIAL_CONFLICT", "INSUFFICIENT_CONTEXT"
GROUP = ["case_id", "ref_key"]


def _stated_time(active: DataFrame) -> Column:
    """What the text says about the time, or the event's own timestamp where it says nothing and the table has one."""
    said = refs.blank_to_null(F.col("temporal_information"))
    own = F.col("timestamp").cast("string") if "timestamp" in active.columns else F.lit(None).cast("string")
    return F.coalesce(said, own)


#: What the detectors read of an active event.
READ = [
    "case_id", "event_id", "evidence_id", "event_type", "decision_state", "trigger_raw_text", "char_start", "char_end",
    "page_number", "order_reference", "transaction_reference", "temporal_information", "timestamp", "amount_value",
    "amount_currency", "polarity", "model_confidence", "source_name", "created_at",
]


def _prepared(active: DataFrame) -> DataFrame:
    """Only the columns the detectors read, with the event order as one sortable value."""
    return active.select(
        "case_id",
        "event_id",
        "evidence_id",
        "event_type",
        "decision_state",
        "trigger_raw_text",
        "char_start",
        "char_end",
        "page_number",
        "order_reference",
        "transaction_reference",
        _stated_time(active).alias("temporal_information"),
        "amount_value",
        F.upper(F.trim(F.coalesce("amount_currency", F.lit("")))).alias("currency"),
        "polarity",
        "model_confidence",
        "source_name",
        F.struct("created_at", "event_id").alias("ord"),
        refs.normalize_reference(F.col("order_reference")).alias("order_key"),
        refs.normalize_reference(F.col("transaction_reference")).alias("txn_key"),
    )


def reference_index(active: DataFrame) -> DataFrame:
    """One row per (event, distinct normalised reference), order reference first."""
    ev = _prepared(active)
    order_entry = F.struct(
        F.col("order_key").alias("key"), F.lit(0).alias("pos"), F.trim("order_reference").alias("display")
    )
    txn_entry = F.struct(
        F.col("txn_key").alias("key"), F.lit(1).alias("pos"), F.trim("transaction_reference").alias("display")
    )
    same = F.col("order_key").eqNullSafe(F.col("txn_key"))
    entries = F.filter(
        F.when(same, F.array(order_entry)).otherwise(F.array(order_entry, txn_entry)),
        lambda r: r["key"].isNotNull(),
    )
    return (
        ev.withColumn("_ref", F.explode(entries))
        .withColumn("ref_key", F.col("_ref.key"))
        .withColumn("ref_pos", F.col("_ref.pos"))
        .withColumn("ref_display", F.col("_ref.display"))
        .drop("_ref")
    )


def reference_groups(index: DataFrame) -> DataFrame:
    """Per reference: size, first-seen spelling and rank, for references cited by two documents or more."""
    seen = F.struct("ord", "ref_pos")
    return (
        index.groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min_by("ref_display", seen).alias("display_ref"),
            F.min(seen).alias("group_rank"),
            F.min("evidence_id").alias("_lo"),
            F.max("evidence_id").alias("_hi"),
        )
        .where(F.col("_lo") < F.col("_hi"))
        .drop("_lo", "_hi")
    )


def comparable_events(active: DataFrame) -> DataFrame:
    """Reference index restricted to references that two documents share, with group facts attached.

    ``other_rank`` is the rank of the event's other reference, where two documents share that one, too.
    Events that lie by case stay where they are.
    """
    seen = F.struct("ord", "ref_pos")
    group = Window.partitionBy(*GROUP)
    both = Window.partitionBy("case_id", "order_key", "txn_key")
    facts = reference_index(active).withColumns({
        "group_size": F.count(F.lit(1)).over(group),
        "display_ref": F.min_by("ref_display", seen).over(group),
        "group_rank": F.min(seen).over(group),
        "_lo": F.min("evidence_id").over(group),
        "_hi": F.max("evidence_id").over(group),
    })
    shared = facts.where(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi")
    rank = lambda pos: F.max(F.when(F.col("ref_pos") == pos, F.col("group_rank"))).over(both)
    return shared.withColumn("other_rank", F.when(F.col("ref_pos") == 0, rank(1)).otherwise(rank(0)))


def stored_members(active: DataFrame) -> DataFrame:
    """Comparable events as a written table, for events that don't lie by case."""
    read = [c for c in READ if c in active.columns]
    return materialize(comparable_events(materialize(active.select(*read), "active")), "members")


def event_pair_counts(members: DataFrame) -> DataFrame:
    """How many pairs of events of two documents share a reference, by their two types.

    Counted from the events of each type in each document; no pair is built.
    """
    in_doc = members.groupBy(*GROUP, "evidence_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    in_ref = in_doc.groupBy(*GROUP, "event_type").agg(F.sum("n").alias("n"))

    def products(counts: DataFrame, keys: list[str]) -> DataFrame:
        a, b = skew.prefixed(counts, "a_", keys), skew.prefixed(counts, "b_", keys)
        both = a.join(b, keys).where("a_event_type <= b_event_type")
        # of n events of one type, n * (n - 1) / 2 pairs
        value = F.when(F.col("a_event_type") == F.col("b_event_type"), F.col("a_n") * (F.col("a_n") - 1) / 2)
        value = value.otherwise(F.col("a_n") * F.col("b_n")).cast("long")
        types = [F.col("a_event_type").alias("type_a"), F.col("b_event_type").alias("type_b")]
        return both.select(*GROUP, *types, value.alias("pairs"))

    inside = products(in_doc, [*GROUP, "evidence_id"]).withColumn("pairs", -F.col("pairs"))
    total = products(in_ref, GROUP).unionByName(inside)
    return total.groupBy(*GROUP, "type_a", "type_b").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def _pairs(members: DataFrame, keys: list[str], classes: list[str], differ: Column, block: int) -> DataFrame:
    other_document = F.col("a_evidence_id") != F.col("b_evidence_id")
    return skew.pairs_by_size(members, keys, classes, differ, other_document, "ord", block)


def _first_shared() -> Column:
    """Whether the pair's group is the first of the references that both events share."""
    other = F.when(F.col("a_ref_pos") == 0, F.col("a_txn_key")).otherwise(F.col("a_order_key"))
    shared = (other != F.col("ref_key")) & other.isin(F.col("b_order_key"), F.col("b_txn_key"))
    return ~F.coalesce(shared & (F.col("a_other_rank") < F.col("a_group_rank")), F.lit(False))


def _cite(side: str) -> Column:
    c = lambda name: F.col(f"{side}_{name}")
    return refs.citation(
        c("evidence_id"), c("source_name"), c("page_number"), c("char_start"), c("char_end"),
        c("trigger_raw_text"), c("event_id"),
    )


def _flat_pair(
    kind, discriminator, title, summary, severity, state, field, value_a, value_b,
    default_conf=None, with_page: bool = True, with_field: bool = True,
) -> list[Column]:
    default_conf = F.lit(1.0) if default_conf is None else default_conf
    conf = F.least(
        F.coalesce("a_model_confidence", default_conf), F.coalesce("b_model_confidence", default_conf)
    )
    source = lambda s: F.concat(
        F.col(f"{s}_source_name"), refs.page_suffix(F.col(f"{s}_page_number")) if with_page else F.lit("")
    )
    none = F.lit(None).cast("string")
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return [
        F.col("case_id"),
        refs.finding_id(
            F.col("case_id"), as_col(kind), discriminator, F.col("a_event_id"), F.col("b_event_id")
        ).alias("finding_id"),
        as_col(kind).alias("kind"),
        F.lit(INCONSISTENCY).alias("finding_type"),
        title.alias("title"),
        summary.alias("summary"),
        as_col(severity).alias("severity"),
        as_col(state).alias("conflict_state"),
        discriminator.alias("reference"),
        F.col("a_event_id").alias("event_a"),
        F.col("b_event_id").alias("event_b"),
        F.col("a_evidence_id").alias("evidence_a"),
        F.col("b_evidence_id").alias("evidence_b"),
        F.array(_cite("a"), _cite("b")).alias("citations"),
        (F.lit(field) if with_field else none).alias("field"),
        (value_a if with_field else none).alias("value_a"),
        (source("a") if with_field else none).alias("source_a"),
        (value_b if with_field else none).alias("value_b"),
        (source("b") if with_field else none).alias("source_b"),
        conf.alias("model_confidence"),
    ]


def _text(template: str, **parts: Column) -> Column:
    """Fill ``{name}`` slots of a sentence with columns; a NULL part reads as empty."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(parts[name].cast("string"), F.lit(""))]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _needs_review() -> Column:
    flagged = lambda s: F.coalesce(F.col(f"{s}_decision_state") == "REVIEW_NEEDED", F.lit(False))
    return flagged("a") | flagged("b")


def _is_uncertain() -> Column:
    low = lambda s: F.coalesce(f"{s}_model_confidence", F.lit(1.0)) < rules.UNCERTAIN_CONFIDENCE
    return _needs_review() | low("a") | low("b")


_VERIFY = "but extraction certainty is flagged for review. Manual verification is advised before evaluating inconsistency."


class Rule(NamedTuple):
    """A detector of pairs. ``stated`` and ``scope`` take a prefix: a row takes part, both are of one scope."""

    stated: Callable[[str], Column]
    scope: Callable[[str], Column] | None
    classes: list[str]
    differ: Column
    once: bool
    columns: Callable[[], list[Column]]

    def fires(self) -> Column:
        both = self.stated("a_") & self.stated("b_") & self.differ
        if self.scope is not None:
            both &= self.scope("a_") == self.scope("b_")
        return F.coalesce(both, F.lit(False))


VALUES = ["event_type", "domain", "currency", "amount_value", "polarity", "stated"]


def _with_values(members: DataFrame) -> DataFrame:
    """Members with what the rules compare besides stored columns: settlement domain and date text."""
    domain = F.coalesce(
        *[F.when(F.col("event_type").isin(*pair), label) for label, pair in rules.EXCLUSIVE_OUTCOMES.items()]
    )
    return members.withColumn("domain", domain).withColumn("stated", F.trim(F.coalesce("temporal_information", F.lit(""))))


def _found(members: DataFrame, rule: Rule, block: int) -> DataFrame:
    rows = _with_values(members).where(rule.stated(""))
    keys = list(GROUP)
    if rule.scope is not None:
        rows, keys = rows.withColumn("scope", rule.scope("")), [*keys, "scope"]
    pairs = _pairs(rows, keys, rule.classes, rule.differ, block)
    return (pairs.where(_first_shared()) if rule.once else pairs).select(*rule.columns())


def pair_findings(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """What all rules on pairs find, each pair built once."""
    each = list(_rules().values())
    some = reduce(operator.or_, [r.fires() for r in each])
    pairs = _pairs(_with_values(members), GROUP, VALUES, some, block)
    found = F.array(*[F.when(r.fires() & _first_shared() if r.once else r.fires(), F.struct(*r.columns())) for r in each])
    return pairs.select(F.inline(F.filter(found, lambda f: f.isNotNull())))


def _currency_columns() -> list[Column]:
    ref = F.col("a_display_ref")
    value = lambda s: F.concat_ws(" ", F.col(f"{s}_currency"), refs.money_text(F.col(f"{s}_amount_value")))
    return _flat_pair(
        "CURRENCY_MISMATCH", F.col("ref_key"),
        _text("Potential Inconsistency: Currency Denomination Mismatch on Reference {ref}", ref=ref),
        _text(
            "Reference '{ref}' is denominated in {ca} in {sa} and in {cb} in {sb}. "
            "Direct numeric comparison requires exchange rate verification.",
            ref=ref, ca=F.col("a_currency"), cb=F.col("b_currency"),
            sa=F.col("a_source_name"), sb=F.col("b_source_name"),
        ),
        "MEDIUM", CONFLICT, "Currency Denomination", value("a"), value("b"),
    )


def _amount_columns() -> list[Column]:
    gap = F.abs(F.col("a_amount_value") - F.col("b_amount_value"))
    symbol = F.coalesce(
        refs.blank_to_null(F.col("a_currency")), refs.blank_to_null(F.col("b_currency")), F.lit("$")
    )
    ref = F.col("a_display_ref")
    money = lambda c: F.concat(symbol, refs.money_text(c))
    parts = dict(
        ref=ref, d=money(gap), va=money(F.col("a_amount_value")), vb=money(F.col("b_amount_value")),
        ta=refs.spaced(F.col("a_event_type")), tb=refs.spaced(F.col("b_event_type")),
        sa=F.col("a_source_name"), sb=F.col("b_source_name"),
        note=F.when(
            F.col("a_event_type") != F.col("b_event_type"),
            "Differing stages allow for partial payments, adjustments, or fee structures.",
        ).otherwise(
            "Differing line items, tax inclusions, revisions, or partial milestones may account for this divergence."
        ),
    )
    return _flat_pair(
        F.when(_needs_review(), "MONETARY_DISCREPANCY_UNCERTAIN").otherwise("MONETARY_DISCREPANCY_POTENTIAL"),
        F.col("ref_key"),
        F.when(_needs_review(), _text("Uncertain Comparison: Amount Divergence on Reference {ref}", **parts)).otherwise(
            _text("Potential Inconsistency: Amount Divergence on Reference {ref}", **parts)
        ),
        F.when(
            _needs_review(), _text("Extracted amounts differ by {d} ({va} vs {vb}), " + _VERIFY, **parts)
        ).otherwise(_text("{ta} ({va} in {sa}) differs from {tb} ({vb} in {sb}) by {d}. {note}", **parts)),
        F.when(_needs_review(), "LOW").otherwise("MEDIUM"),
        F.when(_needs_review(), CONTEXT).otherwise(CONFLICT),
        "Amount", parts["va"], parts["vb"],
        default_conf=F.when(_needs_review(), 0.5).otherwise(1.0),
    )


def _polarity_columns() -> list[Column]:
    parts = dict(ref=F.col("a_display_ref"), t=refs.spaced(F.col("a_event_type")))
    return _flat_pair(
        "POLARITY_CONFLICT", F.col("ref_key"),
        F.when(_is_uncertain(), _text("Uncertain Comparison: Opposing Assertion on {t} ({ref})", **parts)).otherwise(
            _text("Potential Inconsistency: Opposing Assertion on {t} ({ref})", **parts)
        ),
        F.when(
            _is_uncertain(),
            _text(
                "One document asserts this milestone positively while another asserts negative polarity "
                "for reference '{ref}', " + _VERIFY, **parts,
            ),
        ).otherwise(
            _text(
                "One document asserts this milestone positively, while another document asserts negative "
                "polarity for reference '{ref}'. This indicates divergent factual claims regarding whether "
                "this event occurred.", **parts,
            )
        ),
        F.when(_is_uncertain(), "LOW").otherwise("MEDIUM"),
        F.when(_is_uncertain(), CONTEXT).otherwise(CONFLICT),
        "Assertion Polarity", F.col("a_polarity"), F.col("b_polarity"),
        default_conf=F.when(_is_uncertain(), 0.5).otherwise(1.0),
    )


def _outcome_columns() -> list[Column]:
    a_failed = F.contains(F.col("a_event_type"), F.lit("FAILED"))
    ts = lambda s: refs.explicit_timestamp(F.col(f"{s}_temporal_information"))
    failed_at = F.when(a_failed, ts("a")).otherwise(ts("b"))
    success_at = F.when(a_failed, ts("b")).otherwise(ts("a"))
    retry = F.coalesce(failed_at < success_at, F.lit(False))
    parts = dict(
        ref=F.col("a_display_ref"), dom=F.col("a_domain"),
        ta=refs.title_words(F.col("a_event_type")), tb=refs.title_words(F.col("b_event_type")),
        sa=F.col("a_source_name"), sb=F.col("b_source_name"),
        note=F.when(
            retry,
            " Chronological records indicate a failed attempt followed by a subsequent successful settlement (probable retry).",
        ).otherwise(
            " Chronology, retry attempts, or asynchronous gateway settlement latencies should be verified before "
            "inferring an operational conflict."
        ),
    )
    return _flat_pair(
        "OUTCOME_CONFLICT", F.col("ref_key"),
        F.when(_is_uncertain(), _text("Uncertain Comparison: Opposing Outcome on {dom} ({ref})", **parts)).otherwise(
            _text("Potential Inconsistency: Opposing Outcome on {dom} ({ref})", **parts)
        ),
        F.when(
            _is_uncertain(),
            _text("One document asserts '{ta}' while another asserts '{tb}' for reference '{ref}', " + _VERIFY, **parts),
        ).otherwise(
            _text(
                "One document asserts '{ta}' ({sa}) while another asserts '{tb}' ({sb}) for reference '{ref}'.{note}",
                **parts,
            )
        ),
        F.when(_is_uncertain() | retry, "LOW").otherwise("MEDIUM"),
        F.when(_is_uncertain(), CONTEXT).otherwise(CONFLICT),
        "Transaction Status", parts["ta"], parts["tb"],
        default_conf=F.when(_is_uncertain(), 0.5).otherwise(1.0),
    )


def _date_columns() -> list[Column]:
    parts = dict(
        ref=F.col("a_display_ref"), t=refs.title_words(F.col("a_event_type")),
        da=F.col("a_stated"), db=F.col("b_stated"), sa=F.col("a_source_name"), sb=F.col("b_source_name"),
    )
    return _flat_pair(
        "DATE_DISCREPANCY", F.col("ref_key"),
        _text("Potential Inconsistency: Event Date Discrepancy on {t} ({ref})", **parts),
        _text(
            "'{t}' is recorded on {da} in {sa} and on {db} in {sb} for reference '{ref}'. This indicates "
            "divergent chronological records regarding when this milestone occurred.", **parts,
        ),
        "MEDIUM", CONFLICT, "Event Date", F.col("a_stated"), F.col("b_stated"),
    )


def _comparable_amounts() -> Column:
    same = (F.col("a_currency") == F.col("b_currency")) | (F.col("a_currency") == "") | (F.col("b_currency") == "")
    gap = F.abs(F.col("a_amount_value") - F.col("b_amount_value"))
    return same & (gap > F.lit(rules.AMOUNT_TOLERANCE).cast("decimal(4,2)"))


def _differ(column: str) -> Column:
    return F.col(f"a_{column}") != F.col(f"b_{column}")


def _rules() -> dict[str, Rule]:
    amount = lambda x: F.col(f"{x}amount_value").isNotNull()
    kind = lambda x: F.col(f"{x}event_type")
    return {
        "CURRENCY_MISMATCH": Rule(lambda x: amount(x) & (F.col(f"{x}currency") != ""), None, ["currency"], _differ("currency"), False, _currency_columns),
        "MONETARY_DISCREPANCY": Rule(amount, None, ["currency", "amount_value"], _comparable_amounts(), False, _amount_columns),
        "POLARITY_CONFLICT": Rule(lambda x: F.coalesce(f"{x}polarity", F.lit("")) != "", kind, ["polarity"], _differ("polarity"), True, _polarity_columns),
        "OUTCOME_CONFLICT": Rule(lambda x: F.col(f"{x}domain").isNotNull(), lambda x: F.col(f"{x}domain"), ["event_type"], _differ("event_type"), True, _outcome_columns),
        "DATE_DISCREPANCY": Rule(lambda x: F.col(f"{x}stated") != "", kind, ["stated"], _differ("stated"), True, _date_columns),
    }


def currency_findings(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """Amounts on one reference stated in different currencies."""
    return _found(members, _rules()["CURRENCY_MISMATCH"], block)


def amount_findings(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """Amounts on one reference that differ by more than 0.01 in the same or an unstated currency."""
    return _found(members, _rules()["MONETARY_DISCREPANCY"], block)


def polarity_findings(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """One document asserts a milestone, another negates it."""
    return _found(members, _rules()["POLARITY_CONFLICT"], block)


def outcome_findings(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """Success and failure of the same settlement; a failure before a success is a probable retry."""
    return _found(members, _rules()["OUTCOME_CONFLICT"], block)


def date_findings(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """The same milestone stated with different date texts."""
    return _found(members, _rules()["DATE_DISCREPANCY"], block)


def finding_classes(members: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """The collapsed form of the pair findings: no pair of events is built.

    One row per reference, kind, scope (the milestone or settlement, else empty) and pair of values that
    disagree: how many pairs of events of different documents hold them, and one of those, the cited one.
    A pair that shares two references counts under both.
    """
    rows = _with_values(members)
    entries = []
    for kind, rule in _rules().items():
        value = F.struct(*[(F.col(c) if c in rule.classes else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in VALUES])
        scope = rule.scope("") if rule.scope is not None else F.lit("")
        entries.append(F.when(rule.stated(""), F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), value.alias("value"))))
    long = rows.select(*GROUP, "evidence_id", "event_id", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    keys = [*GROUP, "kind", "scope"]
    in_doc = materialize(long.groupBy(*keys, "value", "evidence_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id")), "values")
    cited = F.struct("evidence_id", "event_id")
    values = in_doc.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.min(cited).alias("lo"), F.max(cited).alias("hi"))
    values = materialize(values.select("*", *[F.col(f"value.{c}").alias(c) for c in VALUES]), "values")
    differ = F.coalesce(*[F.when(F.col("kind") == kind, r.differ) for kind, r in _rules().items()])
    met = skew.grid_pairs(values, keys, "value", differ, block)
    # pairs inside one document don't count
    a = in_doc.select(*keys, "evidence_id", F.col("value").alias("a_value"), F.col("n").alias("_a"))
    b = in_doc.select(*keys, "evidence_id", F.col("value").alias("b_value"), F.col("n").alias("_b"))
    inside = a.join(b, [*keys, "evidence_id"]).where("a_value < b_value").groupBy(*keys, "a_value", "b_value").agg(F.sum(F.col("_a") * F.col("_b")).alias("_inside"))
    doc = lambda x: F.col(f"{x}.evidence_id")
    pick = F.coalesce(*[
        F.when(doc(x) != doc(y), F.struct(F.col(f"{x}.event_id").alias("event_a"), F.col(f"{y}.event_id").alias("event_b")))
        for x, y in (("a_lo", "b_lo"), ("a_lo", "b_hi"), ("a_hi", "b_lo"))
    ])
    text = lambda x: F.concat_ws(" ", *[F.col(f"{x}_value.{c}").cast("string") for c in VALUES])
    counted = met.join(inside, [*keys, "a_value", "b_value"], "left").withColumn("pairs", F.col("a_n") * F.col("b_n") - F.coalesce("_inside", F.lit(0)))
    return counted.where("pairs > 0").select(*keys, text("a").alias("value_a"), text("b").alias("value_b"), "pairs", pick["event_a"].alias("event_a"), pick["event_b"].alias("event_b"))


def document_reference_sets(active: DataFrame) -> DataFrame:
    """Per document: its sorted set of order references and its first event that cites one."""
    ev = _prepared(active).where(F.col("order_key").isNotNull())
    payload = F.struct(
        "event_id", "page_number", "char_start", "char_end", "trigger_raw_text", "model_confidence"
    )
    return ev.groupBy("case_id", "evidence_id").agg(
        F.array_sort(F.collect_set("order_key")).alias("ref_set"),
        F.min("ord").alias("ord"),
        F.min_by(payload, "ord").alias("_first"),
        F.first("source_name").alias("source_name"),
    ).select("case_id", "evidence_id", "ref_set", "ord", "source_name", "_first.*")


def _disjoint() -> Column:
    return ~F.arrays_overlap(F.col("a_ref_set"), F.col("b_ref_set"))


def order_ref_divergence(active: DataFrame) -> DataFrame:
    """Collapsed form: disjoint pairs of distinct reference sets per case with their document counts.

    Grows with the distinct reference sets of a case, not with its documents.
    """
    sets = document_reference_sets(active).groupBy("case_id", "ref_set").agg(F.count(F.lit(1)).alias("documents"))
    sets = materialize(sets, "references")
    return skew.grid_pairs(sets, ["case_id"], "ref_set", _disjoint(), skew.PAIR_BLOCK).select(
        "case_id",
        F.array_join("a_ref_set", ",").alias("refs_a"),
        F.array_join("b_ref_set", ",").alias("refs_b"),
        F.col("a_documents").alias("documents_a"),
        F.col("b_documents").alias("documents_b"),
    )


def order_ref_findings(active: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """Document pairs of a case whose order references have nothing in common."""
    p = skew.pairs_by_size(
        document_reference_sets(active), ["case_id"], ["ref_set"], _disjoint(), F.lit(True), "ord", block
    )
    a_ref, b_ref = F.element_at("a_ref_set", 1), F.element_at("b_ref_set", 1)
    parts = dict(ra=a_ref, rb=b_ref, sa=F.col("a_source_name"), sb=F.col("b_source_name"))
    columns = _flat_pair(
        "ORDER_REFERENCE_MISMATCH", F.concat(a_ref, F.lit("_"), b_ref),
        _text("Potential Inconsistency: Divergent Order References Across Case Evidence ({ra} vs {rb})", **parts),
        _text(
            "Evidence '{sa}' cites order reference '{ra}', whereas evidence '{sb}' cites order reference '{rb}'. "
            "Multiple discordant order identifiers within a single dispute case may indicate mismatched "
            "documentation or unrelated transactions.", **parts,
        ),
        "MEDIUM", CONFLICT, "Order Reference", a_ref, b_ref, with_page=False,
    )
    return p.select(*columns)


def _flat_single(df: DataFrame, kind, discriminator, title, summary, severity, state, citation, conf, with_event=True):
    none = F.lit(None).cast("string")
    ids = [F.col("event_id")] if with_event else []
    return df.select(
        "case_id",
        refs.finding_id(F.col("case_id"), kind, discriminator, *ids).alias("finding_id"),
        kind.alias("kind"),
        F.lit(ADVISORY).alias("finding_type"),
        title.alias("title"),
        summary.alias("summary"),
        F.lit(severity).alias("severity"),
        F.lit(state).alias("conflict_state"),
        discriminator.alias("reference"),
        (F.col("event_id") if with_event else none).alias("event_a"),
        none.alias("event_b"),
        F.col("evidence_id").alias("evidence_a"),
        none.alias("evidence_b"),
        F.array(citation).alias("citations"),
        *[none.alias(c) for c in ("field", "value_a", "source_a", "value_b", "source_b")],
        conf.alias("model_confidence"),
    )


def zero_event_findings(evidence: DataFrame, active: DataFrame) -> DataFrame:
    """Documents without active events that need review or produced none; only in cases with an active document."""
    silent = evidence.join(active.select("case_id", "evidence_id").distinct(), ["case_id", "evidence_id"], "left_anti")
    live_cases = evidence.where(F.col("active_processing_version") > 0).select("case_id").distinct()
    due = F.coalesce(F.col("status") == "REVIEW_NEEDED", F.lit(False)) | F.coalesce(
        F.col("extraction_summary.events_extracted") == 0, F.lit(False)
    )
    docs = silent.where(due).join(live_cases, "case_id", "left_semi")
    name = F.coalesce(refs.blank_to_null(F.col("original_filename")), F.col("evidence_id"))
    review = F.coalesce(F.col("status") == "REVIEW_NEEDED", F.lit(False))
    diagnostic = refs.blank_to_null(F.col("extraction_summary.diagnostic"))
    cite = F.struct(
        F.col("evidence_id").alias("evidence_id"), name.alias("original_filename"), F.lit(1).alias("page_number"),
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"),
        F.lit(rules.ZERO_EVENT_TRIGGER_TEXT).alias("trigger_raw_text"), F.lit(None).cast("string").alias("event_id"),
    )
    return _flat_single(
        docs, F.lit("ZERO_EVENT_EXTRACTION_ADVISORY"), F.col("evidence_id"),
        F.when(
            review, _text("Extraction Advisory: Manual Review Required for Evidence ({n})", n=name)
        ).otherwise(_text("Extraction Advisory: Zero Actionable Events Extracted ({n})", n=name)),
        F.coalesce(
            diagnostic,
            F.when(
                review,
                _text(
                    "Evidence document '{n}' is flagged for manual review due to scan quality or low OCR "
                    "confidence. Manual verification is recommended before evaluating factual consistency.", n=name,
                ),
            ).otherwise(
                _text(
                    "Uploaded evidence document '{n}' produced zero validated business lifecycle events. The "
                    "document may consist of legal disclaimers, non-actionable text, or non-dispute content.", n=name,
                )
            ),
        ),
        "LOW", CONTEXT, cite, F.lit(1.0), with_event=False,
    )


def missing_corroboration(active: DataFrame, outgoing_types: list[str] | None = None) -> DataFrame:
    """Outgoing transactions that no *other* document of the case confirms for the same reference.

    Two smallest facts per reference decide: the least and the greatest confirming
    document. No pair of events is built.
    """
    ev = _prepared(active).withColumn("ref_key", F.coalesce("order_key", "txn_key")).where(
        F.col("ref_key").isNotNull()
    )
    confirmed = ev.where(F.col("event_type").isin(*rules.CONFIRMATION_TYPES)).groupBy(*GROUP).agg(
        F.min("evidence_id").alias("_lo"), F.max("evidence_id").alias("_hi")
    )
    out = ev.where(F.col("event_type").isin(*(outgoing_types or rules.OUTGOING_TYPES)))
    matched = out.join(confirmed, GROUP, "left")
    elsewhere = (F.col("_lo") != F.col("evidence_id")) | (F.col("_hi") != F.col("evidence_id"))
    lonely = matched.where(~F.coalesce(elsewhere, F.lit(False)))
    shown = F.trim(
        F.coalesce(
            refs.blank_to_null(F.col("order_reference")), refs.blank_to_null(F.col("transaction_reference")), F.lit("")
        )
    )
    approved = F.col("event_type") == "REFUND_APPROVED"
    claim = F.col("event_type").isin("REFUND_REQUESTED", "REFUND_INITIATED")
    return _flat_single(
        lonely, F.concat(F.lit("MISSING_CORROBORATION_"), F.col("event_type")), F.col("ref_key"),
        F.when(
            approved, _text("Unconfirmed Transaction Reference ({r}) - Approved Refund Awaiting Settlement", r=shown)
        ).otherwise(_text("Unconfirmed Transaction Reference ({r})", r=shown)),
        F.when(
            approved,
            "Refund approval is asserted in evidence, but no corresponding settlement, refund completion, or payout "
            "record is present in the case. This indicates an unsettled refund claim or documentation gap, not proof "
            "of a contradiction.",
        )
        .when(
            claim,
            "A refund request or claim is asserted in evidence, but no corresponding settlement, refund completion, "
            "or payout confirmation document is present in the case. This indicates an uncorroborated claim or "
            "documentation gap, not proof of a contradiction.",
        )
        .otherwise(
            "An outgoing transaction is asserted in evidence, but no corresponding settlement or confirmation "
            "document is present in the case. This indicates an uncorroborated claim or documentation gap, not proof "
            "of a contradiction."
        ),
        "MEDIUM", CONFLICT,
        refs.citation(
            F.col("evidence_id"), F.col("source_name"), F.col("page_number"), F.col("char_start"),
            F.col("char_end"), F.col("trigger_raw_text"), F.col("event_id"),
        ),
        F.coalesce("model_confidence", F.lit(0.90)),
    )


def _rule_roles(event_type: Column, precedence, side: int) -> Column:
    """Numbers of the precedence rules in which a type plays the given side."""
    roles: dict[str, list[int]] = {}
    for i, pair in enumerate(precedence):
        roles.setdefault(pair[side], []).append(i)
    lookup = F.create_map(
        *[x for t, ids in roles.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))]
    )
    return F.try_element_at(lookup, event_type)


SEQUENCE = ["case_id", "rule", "scope"]


CITED = ["event_type", "source_name", "page_number", "char_start", "char_end", "trigger_raw_text", "model_confidence"]


def _sequence(active: DataFrame, precedence, by_reference: bool, columns: list[str]) -> DataFrame:
    """Dated events in their roles: ``late`` or not in a rule, under a scope in which they are compared.

    Every event comes several times and is written, so ``columns`` names what its reader needs besides id and time.

    By reference there are three scopes: events of one reference; late events without a reference with all early
    ones; early ones without a reference with late ones that have one.
    """
    role = lambda late: F.transform(_rule_roles(F.col("event_type"), precedence, int(late)), lambda r: F.struct(F.lit(late).alias("late"), r.alias("rule")))
    none = F.array().cast("array<struct<late:boolean,rule:int>>")
    ev = (
        _prepared(active)
        .select(
            "case_id", "event_id", *dict.fromkeys([*columns, "event_type"]), F.coalesce("order_key", "txn_key").alias("ref_key"),
            refs.explicit_timestamp(F.col("temporal_information")).alias("at"),
        )
        .where("at is not null")
        .withColumn("_role", F.explode(F.concat(F.coalesce(role(False), none), F.coalesce(role(True), none))))
        .select("*", "_role.late", "_role.rule").drop("_role")
    )
    if "event_type" not in columns:
        ev = ev.drop("event_type")
    if not by_reference:
        return ev.drop("ref_key").withColumn("scope", F.lit(""))
    own, ref = F.concat(F.lit("= "), F.col("ref_key")), F.col("ref_key").isNotNull()
    early = F.when(ref, F.array(own, F.lit("late open"))).otherwise(F.array(F.lit("late open"), F.lit("early open")))
    late = F.when(ref, F.array(own, F.lit("early open"))).otherwise(F.array(F.lit("late open")))
    return ev.withColumn("scope", F.explode(F.when(F.col("late"), late).otherwise(early)))


def _crossing(rows: DataFrame) -> DataFrame:
    """The rows that can be part of an inversion: not later than every early row, or earlier than every late row, of their scope."""
    rows = materialize(rows, "sequence")
    at = lambda late: F.when(F.col("late") == late, F.col("at"))
    bounds = rows.groupBy(*SEQUENCE).agg(F.max(at(False)).alias("_max_early"), F.min(at(True)).alias("_min_late")).where("_min_late < _max_early")
    kept = rows.join(bounds, SEQUENCE).where(F.when(F.col("late"), F.col("at") < F.col("_max_early")).otherwise(F.col("at") > F.col("_min_late")))
    return materialize(kept.drop("_max_early", "_min_late"), "crossing")


def _inversions(rows: DataFrame) -> DataFrame:
    """Pairs (early a, late b) of a scope with the late one strictly before the early one."""
    kept = _crossing(rows)
    a = skew.prefixed(kept.where("not late"), "a_", SEQUENCE)
    b = skew.prefixed(kept.where("late"), "b_", SEQUENCE)
    return skew.grid_join(a, b, SEQUENCE, "a_event_id", "b_event_id", skew.PAIR_BLOCK * 10).where(F.col("b_at") < F.col("a_at"))


def temporal_findings(active: DataFrame) -> DataFrame:
    """A later milestone dated before an earlier one, in different documents.

    References must be equal where both have one; an event without reference is compared with the whole case.
    """
    p = _inversions(_sequence(active, rules.PRECEDENCE, True, ["evidence_id", *CITED])).where("a_evidence_id != b_evidence_id")
    disc = F.coalesce("a_ref_key", "b_ref_key", F.lit("CASE_SCOPE"))
    parts = dict(
        d=disc, tl=refs.spaced(F.col("b_event_type")), te=refs.spaced(F.col("a_event_type")),
        al=refs.iso_instant(F.col("b_at")), ae=refs.iso_instant(F.col("a_at")),
    )
    kind = F.concat_ws("_", F.lit("TEMPORAL_VIOLATION"), F.col("a_event_type"), F.col("b_event_type"))
    return p.select(*_flat_pair(
        kind, disc,
        _text("Potential Inconsistency: Temporal Sequence Anomaly ({d})", **parts),
        _text(
            "{tl} recorded at {al} precedes {te} recorded at {ae} for reference '{d}'. Differing timezones, "
            "retrospective logging, or batch entry delays may account for this chronological inversion.", **parts,
        ),
        "MEDIUM", CONFLICT, "", F.lit(""), F.lit(""), with_field=False,
    ))


def _inversion_counts(instants: DataFrame, keys: list[str]) -> DataFrame:
    """Number of pairs (early, late) of each key with the late one before the early one.

    ``instants`` is a stored table with the rows ``n_early`` and ``n_late`` of each instant. How many late ones come
    before an instant is how many come on earlier days, from counts by day, and on the same day before it: no task
    holds all instants of a key.
    """
    instants = instants.select(*keys, "at", "n_early", "n_late", F.to_date("at").alias("_day"))
    days = instants.groupBy(*keys, "_day").agg(F.sum("n_late").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_day").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = instants.withColumn("_inside", F.coalesce(F.sum("n_late").over(inside), F.lit(0)))
    return ranked.join(days, [*keys, "_day"]).groupBy(*keys).agg(F.sum(F.col("n_early") * (F.col("_before") + F.col("_inside"))).alias("pairs"))


def sequence_classes(active: DataFrame, precedence=None, distinct_documents: bool = True) -> DataFrame:
    """The collapsed form of the sequence findings: no pair is built.

    One row per case, rule and scope: how many pairs of a later milestone dated before an earlier one there are, and
    the pair that is furthest apart (then the one with the later early event; of equal times the greater early id and the smaller late id).
    Events are counted by instant (and document, where pairs inside one don't count) at once; all else reads those counts.
    """
    precedence = precedence or rules.PRECEDENCE
    doc = ["evidence_id"] if distinct_documents else []
    of = lambda late, c: F.when(F.col("late") == late, F.col(c))
    rows = _sequence(active, precedence, distinct_documents, doc)
    # few events of one reference are in the wrong order; of a whole case's, most have one that is
    instants = (_crossing(rows) if distinct_documents else rows).groupBy(*SEQUENCE, *doc, "at").agg(
        F.count_if(~F.col("late")).alias("n_early"), F.count_if("late").alias("n_late"),
        F.max(of(False, "event_id")).alias("early_id"), F.min(of(True, "event_id")).alias("late_id"),
    )
    instants = materialize(instants, "instants")
    side = lambda name: F.when(F.col(f"n_{name}") > 0, F.struct("at", F.col(f"{name}_id").alias("event_id"), *doc))
    ends = instants.groupBy(*SEQUENCE, *doc).agg(F.max(side("early")).alias("early"), F.min(side("late")).alias("late"))
    if distinct_documents:
        every = instants.groupBy(*SEQUENCE, "at").agg(F.sum("n_early").alias("n_early"), F.sum("n_late").alias("n_late"))
        inside = _inversion_counts(instants, [*SEQUENCE, *doc]).groupBy(*SEQUENCE).agg(F.sum("pairs").alias("_inside"))
        counts = _inversion_counts(materialize(every, "instants"), SEQUENCE).join(inside, SEQUENCE)
        counts = counts.select(*SEQUENCE, (F.col("pairs") - F.col("_inside")).alias("pairs"))
        # the best event of each side, and the best in another document, are enough to find the pair
        scope = Window.partitionBy(*SEQUENCE)
        best = None
        for name, order in (("early", F.desc("early")), ("late", F.asc("late"))):
            two = ends.where(F.col(name).isNotNull()).withColumn("_k", F.row_number().over(scope.orderBy(order))).where("_k <= 2")
            two = two.groupBy(*SEQUENCE).agg(*[F.max(F.when(F.col("_k") == k, F.col(name))).alias(f"{name}{k}") for k in (1, 2)])
            best = two if best is None else best.join(two, SEQUENCE)
    else:
        counts = _inversion_counts(instants, SEQUENCE)
        best = ends.select(*SEQUENCE, F.col("early").alias("early1"), F.col("late").alias("late1"))
    gap = lambda e, l: F.unix_micros(F.col(f"{e}.at")) - F.unix_micros(F.col(f"{l}.at"))
    met = [("early1", "late1"), ("early1", "late2"), ("early2", "late1")] if distinct_documents else [("early1", "late1")]
    offers = F.filter(F.array(*[
        F.when(
            (F.col(f"{e}.evidence_id") != F.col(f"{l}.evidence_id")) if distinct_documents else F.lit(True),
            F.struct((-gap(e, l)).alias("g"), (-F.unix_micros(F.col(f"{e}.at"))).alias("t"), F.lit(k).alias("k"), F.col(f"{e}.event_id").alias("event_a"), F.col(f"{l}.event_id").alias("event_b")),
        )
        for k, (e, l) in enumerate(met)  # noqa: E741
    ]), lambda o: o["g"].isNotNull())
    pair = F.array_min(offers)
    types = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in precedence]), F.col("rule") + 1)
    return counts.where("pairs > 0").join(best, SEQUENCE).select(
        "case_id", types(0).alias("type_early"), types(1).alias("type_late"), "scope", "pairs",
        pair["event_a"].alias("event_a"), pair["event_b"].alias("event_b"), (-pair["g"] / 1_000_000).cast("long").alias("seconds_apart"),
    )


def check_temporal(active: DataFrame) -> DataFrame:
    """First-generation sequence check: four rules, any documents, any references, HIGH."""
    p = _inversions(_sequence(active, rules.PRECEDENCE_V0, False, ["event_type"]))
    return p.select(
        "case_id",
        F.lit("Potential Inconsistency: Temporal Sequence Violation").alias("title"),
        _text(
            "{tl} recorded at {al} precedes {te} recorded at {ae}.",
            tl=F.col("b_event_type"), te=F.col("a_event_type"),
            al=refs.iso_instant(F.col("b_at")), ae=refs.iso_instant(F.col("a_at")),
        ).alias("summary"),
        F.lit("HIGH").alias("severity"),
        F.lit("DIRECT_CONTRADICTION").alias("conflict_state"),
        F.col("a_event_id").alias("event_a"),
        F.col("b_event_id").alias("event_b"),
    )


def compare_amounts(pairs: DataFrame, epsilon: float = 0.01) -> DataFrame:
    """Given amount pairs (label_a, amount_a, currency_a, ...): currency mismatch or divergence above epsilon."""
    ca, cb = F.upper(F.trim("currency_a")), F.upper(F.trim("currency_b"))
    a, b = F.col("amount_a"), F.col("amount_b")
    gap = F.round(F.abs(a - b), 2)
    mismatch = ca != cb
    parts = dict(
        la=F.col("label_a"), lb=F.col("label_b"), ca=ca, cb=cb, gap=refs.money_text(gap),
        hi=F.when(a > b, F.col("label_a")).otherwise(F.col("label_b")),
        lo=F.when(a > b, F.col("label_b")).otherwise(F.col("label_a")),
        hv=refs.money_text(F.greatest(a, b)), lv=refs.money_text(F.least(a, b)),
    )
    return pairs.where(mismatch | (gap > F.lit(epsilon))).select(
        *pairs.columns,
        F.when(mismatch, "Potential Inconsistency: Currency Mismatch")
        .otherwise("Potential Inconsistency: Amount Discrepancy").alias("title"),
        F.when(
            mismatch,
            _text(
                "{la} is denominated in {ca} while {lb} is in {cb}. Direct comparison requires exchange rate "
                "verification.", **parts,
            ),
        )
        .otherwise(_text("{hi} ({ca} {hv}) differs from {lo} ({cb} {lv}) by {ca} {gap}.", **parts))
        .alias("summary"),
        F.when(mismatch, "MEDIUM").otherwise("HIGH").alias("severity"),
        F.when(mismatch, CONFLICT).otherwise("DIRECT_CONTRADICTION").alias("conflict_state"),
    )


def compare_identifiers(pairs: DataFrame) -> DataFrame:
    """Given identifier pairs (id_a, label_a, id_b, label_b): those that differ after normalisation."""
    clean = lambda c: F.upper(F.translate(F.trim(c), " -", ""))
    return pairs.where(clean("id_a") != clean("id_b")).select(
        *pairs.columns,
        F.lit("Potential Inconsistency: Identifier Mismatch").alias("title"),
        _text(
            "{la} '{a}' does not match {lb} '{b}'.",
            la=F.col("label_a"), lb=F.col("label_b"), a=F.col("id_a"), b=F.col("id_b"),
        ).alias("summary"),
        F.lit("HIGH").alias("severity"),
        F.lit("DIRECT_CONTRADICTION").alias("conflict_state"),
    )


def refund_coverage(claims: DataFrame, events: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Subjective refund claims of cases without any settlement record from a bank or gateway.

    claims(case_id, claim_id, predicate, event_reference, modality), events(case_id,
    event_type, source_type), ranges(case_id, range_start, range_end) optional.
    """
    asserted = claims.where(
        (
            F.coalesce(F.col("predicate") == "ISSUED_REFUND", F.lit(False))
            | F.coalesce(F.col("event_reference") == "REFUND_PROCESSED", F.lit(False))
        )
        & (F.col("modality") == "SUBJECTIVE_ASSERTION")
    )
    settled = (
        events.where(
            F.col("event_type").isin("REFUND_RECEIVED", "REFUND_PROCESSED")
            & F.col("source_type").isin("BANK_STATEMENT", "PAYMENT_GATEWAY_RECEIPT")
        )
        .select("case_id")
        .distinct()
    )
    open_claims = asserted.join(settled, "case_id", "left_anti")
    base = "Supporting evidence for the refund transaction was not found in the uploaded evidence."
    summary = F.lit(base)
    if ranges is not None:
        open_claims = open_claims.join(ranges.select("case_id", "range_start", "range_end"), "case_id", "left")
        summary = F.when(
            F.col("range_start").isNotNull(),
            _text(
                base + " Uploaded financial records span {s} to {e}. Review recommended.",
                s=F.date_format("range_start", "MMM dd"), e=F.date_format("range_end", "MMM dd"),
            ),
        ).otherwise(F.lit(base))
    return open_claims.select(
        "case_id",
        "claim_id",
        F.lit(ADVISORY).alias("finding_type"),
        F.lit("Missing Evidence Advisory: Refund Transaction Record").alias("title"),
        summary.alias("summary"),
        F.lit("NOT_FOUND_IN_UPLOADED_EVIDENCE").alias("coverage_state"),
        F.lit("MEDIUM").alias("severity"),
    )


def severity_rank(severity: Column) -> Column:
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(s) for s in rules.SEVERITY_ORDER]), severity), F.lit(0)), F.lit(4)
    )


def all_findings(evidence: DataFrame, events: DataFrame, block: int = skew.PAIR_BLOCK) -> DataFrame:
    """Findings from the stored tables. Events that lie by case are compared there by every detector;
    neither active events nor the reference index are written."""
    active = active_events(events, evidence)
    members = comparable_events(active)
    return union_findings(evidence, active, members, block)


def union_findings(
    evidence: DataFrame, active: DataFrame, members: DataFrame, block: int = skew.PAIR_BLOCK
) -> DataFrame:
    """Union of every detector, one row per finding id."""
    parts = [
        zero_event_findings(evidence, active),
        pair_findings(members, block),
        order_ref_findings(active, block),
        missing_corroboration(active),
        temporal_findings(active),
    ]
    # ids are unique inside each detector by construction (kind, reference and
    # event pair are part of the hash), so the union needs no distinct
    out = parts[0].select(*FLAT)
    for part in parts[1:]:
        out = out.unionByName(part.select(*FLAT))
    return out


def attach_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Add the active review of each finding, if any."""
    active = reviews.where("is_active").select(
        "case_id",
        "finding_id",
        F.struct("review_id", "reviewer_id", "decision", "reason", "version", "created_at", "updated_at").alias(
            "active_review"
        ),
    )
    return findings.join(active, ["case_id", "finding_id"], "left")


def case_findings(
    cases: DataFrame, evidence: DataFrame, events: DataFrame, reviews: DataFrame | None = None,
    block: int = skew.PAIR_BLOCK, ordered: bool = True,
) -> DataFrame:
    """Findings of the given cases with review state, severe ones first within a case."""
    owned = cases.select("case_id", "user_id")
    mine = evidence.join(owned, ["case_id", "user_id"], "left_semi")
    found = all_findings(mine, events, block)
    if reviews is not None:
        found = attach_reviews(found, reviews)
    out = found.withColumn("severity_rank", severity_rank(F.col("severity")))
    return out.orderBy("case_id", "severity_rank", "finding_id") if ordered else out
