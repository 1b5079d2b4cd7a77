"""Events from text: sentences, triggers, nuances, argument binding, validation, consolidation.

Up to validation everything is a projection of the document row (no shuffle): the
texts are read in Arrow batches, with their mentions (``functions.event_search``).
Only the extracted events, never the texts, are shuffled for the consolidation
inside a document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import rules
from factloom.functions import arrow_rows, event_search, refs
from factloom.functions.spans import any_of, contains_any, guarded, quote

MARK = "\u0001"
SENTENCE = "struct<start:int,end:int,text:string>"
CANDIDATE = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("etype", pa.string()), ("polarity", pa.string()),
    ("confidence", pa.float64()),
])
TRIGGER = [
    ("sent_ix", pa.int32()), ("event_type", pa.string()), ("trigger_raw_text", pa.string()), ("char_start", pa.int32()),
    ("char_end", pa.int32()), ("polarity", pa.string()), ("modality", pa.string()), ("tense", pa.string()),
    ("model_confidence", pa.float64()), ("context_sentence", pa.string()),
]
#: The mentions that fill an event's slots.
PLACES = ["amount", "order", "transaction", "refund", "temporal", "actor"]
_PLACE = pa.struct([("etype", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SLOT_TYPES = [
    ("actor", pa.string()), ("participants", pa.map_(pa.string(), pa.string())), ("temporal_information", pa.string()),
    ("amount_value", pa.decimal128(18, 4)), ("amount_currency", pa.string()), ("order_reference", pa.string()),
    ("transaction_reference", pa.string()), ("refund_reference", pa.string()), ("places", pa.struct([(p, _PLACE) for p in PLACES])),
]
RESULT = [
    ("sent_ix", pa.int32()), ("label", pa.string()), ("model_confidence", pa.float64()), ("decision_state", pa.string()),
    ("has_event", pa.bool_()), ("unsure", pa.bool_()), ("review_reasons", pa.list_(pa.string())),
    ("validation_errors", pa.list_(pa.string())), ("is_compound_sentence", pa.bool_()), ("trigger_raw_text", pa.string()),
    ("char_start", pa.int32()), ("char_end", pa.int32()), ("polarity", pa.string()), ("modality", pa.string()),
    ("tense", pa.string()), ("context_sentence", pa.string()), *SLOT_TYPES,
]


def sentence_array(text: Column) -> Column:
    """Trimmed sentences with their offsets in the text."""
    pieces = F.split(F.regexp_replace(guarded(text), "(?dU)" + rules.SENTENCE_END, "$0" + MARK), MARK, -1)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SENTENCE}>").alias("out"))

    def step(acc, p):
        left = F.regexp_replace(p, r"(?U)^\s+", "")
        body = F.regexp_replace(left, r"(?U)\s+$", "")
        at = acc["pos"] + F.length(p) - F.length(left)
        found = F.struct(at.alias("start"), (at + F.length(body)).alias("end"), body.alias("text"))
        return F.struct(
            (acc["pos"] + F.length(p)).alias("pos"),
            F.when(body != "", F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def split_sentences(docs: DataFrame) -> DataFrame:
    """docs(evidence_id, text) -> one row per sentence."""
    return docs.select("evidence_id", F.posexplode(sentence_array(F.col("text"))).alias("sent_ix", "_s")).select(
        "evidence_id", "sent_ix", F.col("_s.start").alias("s_start"), F.col("_s.end").alias("s_end"),
        F.col("_s.text").alias("s_text"),
    )


def trigger_pattern(phrases: list[str]) -> str:
    """Longest phrase first; up to eight other tokens between the words of a phrase."""
    gap = rf"(?:\s++\S++){{0,{rules.MAX_INTERVENING_TOKENS}}}\s++"
    parts = []
    for phrase in sorted(phrases, key=len, reverse=True):
        parts.append(r"\b" + gap.join(quote(t) for t in phrase.split()) + r"\b")
    return "(?iU)(?:" + "|".join(parts) + ")"


def _first_words() -> str:
    words = sorted({p.split()[0] for phrases in rules.TRIGGERS.values() for p in phrases})
    return r"(?iU)\b(?:" + "|".join(words) + r")\b"


def is_disclaimer(lowered: Column) -> Column:
    """Does a lower-cased sentence say that it proves nothing."""
    hit = F.lit(False)
    for pattern in rules.DISCLAIMERS:
        hit = hit | lowered.rlike("(?U)" + pattern)
    return hit


def with_nuances(sentences: DataFrame) -> DataFrame:
    """Adds the cue flags of a sentence and its modality and tense."""
    low = F.lower("s_text")
    base = sentences.withColumns({
        "s_low": low, "disclaimer": is_disclaimer(low), "has_negation": low.rlike(any_of(rules.NEGATION_CUES)),
        "has_future": low.rlike(any_of(rules.FUTURE_CUES)), "has_condition": low.rlike(any_of(rules.CONDITIONAL_CUES)),
        "has_modal": low.rlike(any_of(rules.MODAL_CUES)),
    })
    return base.withColumns({
        "s_modality": F.when(F.col("has_condition"), "CONDITIONAL").when(F.col("has_modal"), "UNCERTAIN")
        .when(F.col("has_future"), "PLANNED").otherwise("ASSERTED"),
        "s_tense": F.when(F.col("has_future"), "FUTURE").otherwise("PAST"),
    })


def _fixed(triggers: dict[str, list[str]] | None) -> tuple | None:
    return None if triggers is None else tuple((etype, tuple(phrases)) for etype, phrases in triggers.items())


def with_candidates(sentences: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Sentences with nuances and ``candidates``: all triggers in text order, overlaps resolved in favour of the longer
    one; a disclaimer has none. Offsets are relative to the sentence."""
    chosen = _fixed(lexicon)

    def work(texts):
        lex = event_search.lexicon(chosen)
        return [None if t is None else lex.candidates(event_search.Sentence(t)) for t in texts.to_pylist()]

    return with_nuances(sentences).withColumn("candidates", arrow_rows.column(work, pa.list_(CANDIDATE), F.col("s_text")))


def detect_triggers(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per trigger candidate with document offsets and nuances."""
    chosen = _fixed(lexicon)

    def work(texts):
        lex = event_search.lexicon(chosen)
        return [None if t is None else event_search.triggers_of(t, lex) for t in texts.to_pylist()]

    found = arrow_rows.column(work, pa.list_(pa.struct([*TRIGGER, ("s_start", pa.int32()), ("s_end", pa.int32())])), F.col("text"))
    return docs.select("evidence_id", F.inline(found))


SLOTS = [
    "actor", "participants", "temporal_information", "amount_value", "amount_currency", "order_reference",
    "transaction_reference", "refund_reference", "argument_provenance",
]
EVENT = [
    "evidence_id", "event_id", "sent_ix", "event_type", "trigger_raw_text", "char_start", "char_end", "polarity", "modality",
    "tense", "model_confidence", "context_sentence", *SLOTS,
]


def _event_id() -> Column:
    return refs.natural_id("evt_", F.col("evidence_id"), F.col("event_type"), F.col("char_start"), F.col("char_end"))


def _provenance(places: Column) -> Column:
    """Ids of the mentions that fill the slots."""
    of = lambda m: F.when(m.isNotNull(), refs.natural_id("ent_", F.col("evidence_id"), m["etype"], m["start"], m["end"]))
    return F.struct(*[of(places[name]).alias(f"{name}_entity_id") for name in PLACES])


def _rows(docs: DataFrame, work, kind: pa.DataType, *inputs: Column) -> DataFrame:
    """What ``work`` finds in the text and the mentions of each document, a row each."""
    found = arrow_rows.column(work, pa.list_(kind), F.col("text"), F.col("mentions"), *inputs)
    return docs.select("evidence_id", F.inline(found)).withColumn("argument_provenance", _provenance(F.col("places"))).drop("places")


def extract_events(annotated: DataFrame) -> DataFrame:
    """Rules only: every trigger becomes an event with its nearest arguments. Needs ``mentions``."""

    def work(texts, mentions):
        lex = event_search.lexicon()
        known = arrow_rows.fields(mentions, *event_search.MENTION_FIELDS)
        return [None if t is None else event_search.events_of(t, m or [], lex) for t, m in zip(texts.to_pylist(), known)]

    return _rows(annotated, work, pa.struct([*TRIGGER, *SLOT_TYPES])).withColumn("event_id", _event_id()).select(*EVENT)


def classify_sentences(sentences: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Label per sentence (columns of ``with_candidates``): the given prediction, else the first rule candidate, else NO_EVENT.

    predictions(evidence_id, sent_ix, label, confidence) come from any model, for
    example ``score_sentences``.
    """
    first = F.try_element_at("candidates", F.lit(1))
    label = F.coalesce(first["etype"], F.lit(rules.NO_EVENT))
    conf = F.coalesce(first["confidence"], F.lit(1.0))
    if predictions is None:
        return sentences.withColumns({"label": label, "label_confidence": conf})
    p = predictions.select("evidence_id", "sent_ix", F.col("label").alias("_l"), F.col("confidence").alias("_p"))
    joined = sentences.join(p, ["evidence_id", "sent_ix"], "left")
    return joined.withColumns({"label": F.coalesce("_l", label), "label_confidence": F.coalesce("_p", conf)}).drop("_l", "_p")


def score_sentences(sentences: DataFrame, predict_batch) -> DataFrame:
    """Run a Python model over sentences in Arrow batches: predict_batch(Series) -> DataFrame(label, confidence)."""

    def run(batches):
        for batch in batches:
            out = predict_batch(batch["s_text"])
            yield batch[["evidence_id", "sent_ix"]].assign(label=list(out["label"]), confidence=list(out["confidence"]))

    return sentences.select("evidence_id", "sent_ix", "s_text").mapInPandas(
        run, "evidence_id string, sent_ix int, label string, confidence double"
    )


def lifecycle_conflict(label: Column, lowered: Column) -> Column:
    """Reason of the first life-cycle guard that fires, else NULL."""
    out = F.lit(None).cast("string")
    for etype, cues, unless, reason in reversed(rules.LIFECYCLE_GUARDS):
        fires = (label == etype) & contains_any(lowered, cues)
        if unless:
            fires = fires & ~contains_any(lowered, unless)
        out = F.when(fires, reason).otherwise(out)
    return out


def check_grounding(spans_df: DataFrame, docs: DataFrame) -> DataFrame:
    """For externally given spans(evidence_id, start, end, raw): are offsets legal and the text identical."""
    j = spans_df.join(docs.select("evidence_id", "text"), "evidence_id", "left")
    start, end = F.col("start"), F.col("end")
    legal = (start >= 0) & (end <= F.length("text")) & (start < end)
    actual = F.substr("text", start + 1, end - start)
    return j.select(
        *spans_df.columns,
        F.when(F.col("text").isNull(), "Missing required SourceReference")
        .when(~legal, F.concat(F.lit("Invalid trigger offsets: ["), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("].")))
        .when(actual != F.col("raw"), F.concat(F.lit("Trigger mismatch: expected '"), F.col("raw"), F.lit("', found '"), actual, F.lit("'.")))
        .alias("grounding_error"),
    )


def grounding_errors(predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """All that is wrong with externally predicted events(evidence_id, sentence, start, end, raw): adds ``errors``.

    The sentence must stand in the document as it is, the document must exist, and the trigger must be what
    stands at its offsets.
    """
    j = check_grounding(predicted, docs.select("evidence_id", "text")).join(docs.select("evidence_id", "text"), "evidence_id", "left")
    verbatim = F.coalesce(F.contains("text", F.col("sentence")), F.lit(False))
    found = F.array(
        F.when(~verbatim, "Sentence text does not exist verbatim in EvidenceText raw text."), F.col("grounding_error")
    )
    return j.select(*predicted.columns, F.filter(found, lambda e: e.isNotNull()).alias("errors"))


def decision_state(errors: Column, reasons: Column, confidence: Column) -> Column:
    soft = F.exists(errors, lambda e: e.rlike("verbatim|mismatch|Missing required SourceReference"))
    return (
        F.when((F.size(errors) > 0) & soft, "REVIEW_NEEDED")
        .when(F.size(errors) > 0, "REJECTED")
        .when(F.size(reasons) > 0, "REVIEW_NEEDED")
        .when(confidence < rules.MIN_VALIDATION_CONFIDENCE, "REVIEW_NEEDED")
        .otherwise("VALIDATED")
    )


def validate_sentences(annotated: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """One result row per sentence: label, decision, reasons and the event with its arguments.

    The label is that of ``classify_sentences``; predictions are brought to their documents.
    """
    label = "array<struct<sent_ix:int,label:string,confidence:double>>"
    docs = annotated.select("evidence_id", "text", "mentions")
    if predictions is None:
        docs = docs.withColumn("_given", F.lit(None).cast(label))
    else:
        given = F.collect_list(F.struct(F.col("sent_ix").cast("int").alias("sent_ix"), "label", F.col("confidence").cast("double").alias("confidence")))
        docs = docs.join(predictions.groupBy("evidence_id").agg(given.alias("_given")), "evidence_id", "left")

    def work(texts, mentions, labels):
        lex = event_search.lexicon()
        known = arrow_rows.fields(mentions, *event_search.MENTION_FIELDS)
        labelled = arrow_rows.fields(labels, "sent_ix", "label", "confidence")
        return [None if t is None else event_search.results_of(t, m or [], g, lex) for t, m, g in zip(texts.to_pylist(), known, labelled)]

    unsure = F.format_string(
        f"Model classification confidence (%.4f) below validation threshold ({rules.MIN_VALIDATION_CONFIDENCE}).",
        F.col("model_confidence"),
    )
    only = lambda c: F.when(F.col("has_event"), c)
    return _rows(docs, work, pa.struct(RESULT), F.col("_given")).withColumns({
        "review_reasons": F.when(F.col("unsure"), F.array(unsure)).otherwise(F.col("review_reasons")),
        "event_type": only(F.col("label")), "argument_provenance": only(F.col("argument_provenance")),
    }).withColumn("event_id", only(_event_id())).select(
        "evidence_id", "sent_ix", "label", "model_confidence", "decision_state", "has_event", "review_reasons", "validation_errors",
        "is_compound_sentence", "event_type", "trigger_raw_text", "char_start", "char_end", "polarity", "modality", "tense",
        "context_sentence", *SLOTS, "event_id",
    )


def _is_clock(t: Column) -> Column:
    return F.contains(t, F.lit(":")) & ~F.contains(t, F.lit("-"))


def _is_day(t: Column) -> Column:
    return F.contains(t, F.lit("-")) & ~F.contains(t, F.lit(":"))


def _compatible(a: Column, b: Column) -> Column:
    """May two mentions of one type describe the same event: equal or missing in every stated field."""
    alike = lambda f: F.coalesce(a[f] == b[f], F.lit(True))
    ta, tb = a["temporal_information"], b["temporal_information"]
    times = F.coalesce((ta == tb) | (_is_clock(ta) & _is_day(tb)) | (_is_day(ta) & _is_clock(tb)), F.lit(True))
    return (
        (a["polarity"] == b["polarity"]) & (a["modality"] == b["modality"]) & alike("order_reference")
        & alike("transaction_reference") & times & alike("amount_value")
    )


def richness(e: Column) -> Column:
    """How much an event mention states."""
    t = e["temporal_information"]
    pts = lambda c, n: F.when(c.isNotNull(), n).otherwise(0)
    return (
        pts(e["order_reference"], 20) + F.when(F.contains(t, F.lit("-")), 25).when(t.isNotNull(), 10).otherwise(0)
        + pts(e["amount_value"], 20) + pts(e["transaction_reference"], 20)
        + F.length(e["trigger_raw_text"]) + F.length(e["context_sentence"])
    )


_CLUSTER_FIELDS = [
    "char_start", "sent_ix", "event_id", "event_type", "trigger_raw_text", "char_end", "polarity", "modality", "tense",
    "model_confidence", "context_sentence", "actor", "temporal_information", "amount_value", "amount_currency",
    "order_reference", "transaction_reference", "refund_reference", "decision_state", "review_reasons",
]


def consolidate_events(results: DataFrame) -> DataFrame:
    """Merge mentions of one event inside a document.

    Mentions of a (document, type) are walked in text order; each joins the first
    cluster whose lead it is compatible with. The richest member of a cluster
    becomes the event and takes missing fields from the others. The group is the
    events of one document, which is bounded by the document itself.
    """
    live = results.where(F.col("has_event") & F.col("decision_state").isin("VALIDATED", "REVIEW_NEEDED"))
    grouped = live.groupBy("evidence_id", "event_type").agg(
        F.array_sort(F.collect_list(F.struct(*_CLUSTER_FIELDS))).alias("items")
    )
    item = "struct<" + ",".join(
        f"{f.name}:{f.dataType.simpleString()}" for f in live.select(*_CLUSTER_FIELDS).schema.fields
    ) + ">"
    start = F.struct(
        F.array().cast(f"array<{item}>").alias("leads"), F.array().cast("array<int>").alias("ids")
    )

    def assign(acc, e):
        # position of the first compatible lead, 0 when there is none
        at = F.array_position(F.transform(acc["leads"], lambda lead: _compatible(lead, e)), True).cast("int")
        return F.struct(
            F.when(at == 0, F.concat(acc["leads"], F.array(e))).otherwise(acc["leads"]).alias("leads"),
            F.concat(acc["ids"], F.array(F.when(at == 0, F.size(acc["leads"]) + 1).otherwise(at))).alias("ids"),
        )

    clustered = grouped.withColumn("ids", F.aggregate("items", start, assign, lambda acc: acc["ids"]))
    rows = clustered.select(
        "evidence_id", "event_type", F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("ids").alias("cluster")))
    ).withColumnsRenamed({"items": "item", "ids": "cluster"})
    ranked = F.struct((-richness(F.col("item"))).alias("rank"), F.col("item.char_start").alias("pos"), F.col("item").alias("e"))
    merged = rows.groupBy("evidence_id", "event_type", "cluster").agg(F.array_sort(F.collect_list(ranked)).alias("m"))
    m = merged.withColumn("m", F.transform("m", lambda r: r["e"]))
    lead = F.element_at("m", 1)
    first_of = lambda f: F.element_at(F.filter(F.transform("m", lambda e: e[f]), lambda v: v.isNotNull()), 1)
    safe_first = lambda f: F.when(F.exists("m", lambda e: e[f].isNotNull()), first_of(f))
    stated = F.aggregate(
        F.transform("m", lambda e: e["temporal_information"]),
        F.lit(None).cast("string"),
        lambda acc, t: F.when(acc.isNull(), t).when(_is_clock(acc) & F.contains(t, F.lit("-")), t).otherwise(acc),
    )
    amount = F.filter("m", lambda e: e["amount_value"].isNotNull())
    reasons = F.array_distinct(F.flatten(F.transform("m", lambda e: e["review_reasons"])))
    others = F.transform(
        F.slice("m", F.lit(2), F.size("m")),
        lambda e: F.struct(
            e["trigger_raw_text"].alias("trigger_text"), e["char_start"].alias("char_start"), e["char_end"].alias("char_end"),
            e["context_sentence"].alias("context_sentence"), e["temporal_information"].alias("temporal_information"),
            e["order_reference"].alias("order_reference"), e["polarity"].alias("polarity"), e["modality"].alias("modality"),
        ),
    )
    keep = lambda f: lead[f].alias(f)
    return m.select(
        "evidence_id", "event_type", keep("event_id"), keep("sent_ix"), keep("trigger_raw_text"), keep("char_start"), keep("char_end"),
        keep("polarity"), keep("modality"), keep("tense"), keep("model_confidence"), keep("context_sentence"), keep("decision_state"),
        safe_first("actor").alias("actor"), stated.alias("temporal_information"),
        F.try_element_at(amount, F.lit(1))["amount_value"].alias("amount_value"),
        F.try_element_at(amount, F.lit(1))["amount_currency"].alias("amount_currency"),
        safe_first("order_reference").alias("order_reference"), keep("transaction_reference"), keep("refund_reference"),
        reasons.alias("review_reasons"), others.alias("corroborating_mentions"),
    )


def run_cascade(annotated: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Sentences to consolidated events of every document."""
    return consolidate_events(validate_sentences(annotated, predictions))


def validated_events(results: DataFrame) -> DataFrame:
    return results.where(F.col("decision_state") == "VALIDATED")


def to_event_rows(events: DataFrame, docs: DataFrame, version: Column, run_id: Column) -> DataFrame:
    """Stored form of consolidated events; docs(evidence_id, case_id, user_id) give the owner."""
    owner = docs.select("evidence_id", "case_id", "user_id", version.alias("processing_version"), run_id.alias("processing_run_id"))
    return events.join(owner, "evidence_id").select(
        "case_id", "user_id", "evidence_id", "event_id", "processing_version", "processing_run_id",
        F.lit(True).alias("is_active"), "event_type", "decision_state", "review_reasons",
        F.coalesce("trigger_raw_text", "context_sentence").alias("trigger_raw_text"),
        F.coalesce("char_start", F.lit(0)).alias("char_start"), F.coalesce("char_end", F.lit(0)).alias("char_end"),
        "actor", "temporal_information", "amount_currency", F.col("amount_value").cast("decimal(18,4)").alias("amount_value"),
        "order_reference", "transaction_reference", "polarity", "modality", "tense", "model_confidence",
    )


def map_taxonomy(rows: DataFrame, label: str = "event_type") -> DataFrame:
    """Adds canonical type, category and flag of a raw label by literal lookup (no join)."""
    canonical = {t: t for t in rules.CANONICAL_TYPES} | rules.ALIASES | {rules.NO_EVENT: rules.NO_EVENT}
    category = (
        {t: "CANONICAL" for t in rules.CANONICAL_TYPES} | {t: "COMPATIBILITY_ALIAS" for t in rules.ALIASES}
        | {t: "LEGACY_DISPUTE" for t in rules.LEGACY_TYPES} | {rules.NO_EVENT: "NEGATIVE_SAMPLE"}
    )
    look = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col(label))
    return rows.withColumns({
        "canonical_event_type": look(canonical), "taxonomy_category": look(category),
        "is_canonical": look(canonical).isNotNull(),
    })


def taxonomy_summary(rows: DataFrame, label: str = "event_type") -> DataFrame:
    """Distinct labels and rows per mapping category."""
    return map_taxonomy(rows, label).groupBy("taxonomy_category").agg(
        F.countDistinct(label).alias("labels"), F.count(F.lit(1)).alias("rows")
    )


def event_category(label: Column) -> Column:
    pairs = [F.lit(x) for cat, types in rules.EVENT_CATEGORIES.items() for t in types for x in (t, cat)]
    return F.try_element_at(F.create_map(*pairs), label)
