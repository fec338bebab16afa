"""Text predicates and rewriting as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Document types by title, first match wins.
DOC_TYPES = (
    ("test_plan", r"test\s*plan|test\s*cases?\b|\bqa\s*plan\b|\bregression\s*suite\b"),
    ("implementation_plan", r"implementation\s*plan|impl\.?\s*plan\b"),
    ("tech_doc", r"tech\s*doc|\btechdoc\b|tech(nical)?\s*design|technical\s*document|\bhld\b|\blld\b|architecture\b"),
    ("release_note", r"release\s*notes?|\bv\d+\.\d+(\.\d+)?\b|\bchangelog\b|\bhotfix\b"),
    ("meeting_note", r"\bgrooming\b|meeting\s*notes?|\bstand[-\s]?up\b|\bretro(spective)?\b|\bsync\s*notes?\b|\bplanning\b|\b(daily|weekly|monthly|quarterly)\s+(review|update)\b"),
    ("prd", r"\bprds?\b|product\s*requirement|\bbrd\b|\bfrd\b|requirement\s*document"),
)
# Headings that hold no requirement.
META_HEADINGS = (
    r"why (this )?change\b", r"success (looks like|criteria)\s*$", r"success metrics\s*$", r"introduction\s*$", r"rationale\s*$", r"appendix\b", r"glossary\s*$",
    r"open questions?\s*$", r"out of scope\s*$", r"(timeline|rollout)\b", r"methodology\s*$", r"hypothesis\b", r"budget\s*$", r"current (flow|process|system)\s*$",
    r"process flow\s*$", r"mitigation (plan|strategy)\s*$", r"scaling strategy\s*$", r"pilot scope\s*$", r"(monthly|quarterly|annual) review\s*$", r"background\s*$",
    r"context\s*$", r"background (and|&) context\s*$", r"risk register\s*$", r"document history\s*$", r"executive summary\s*$",
)
# Stems, one of which the reason of a removal names.
REMOVAL_STEMS = ("remov", "replac", "obsolet", "discontinu", "no longer", "deleted", "delete", "dropped", "retired", "superseded")
# Instructions hidden in documents.
INJECTIONS = (
    r"(?i)IGNORE\s+(?:ALL\s+)?(?:PREVIOUS|PRIOR|ABOVE)\s+INSTRUCTIONS",
    r"(?i)DISREGARD\s+(?:ALL\s+)?(?:PREVIOUS|PRIOR|ABOVE)\s+INSTRUCTIONS",
    r"(?i)<\|\s*(?:system|user|assistant|im_start|im_end)\s*\|>",
    r"(?is)\[INST\].*?\[/INST\]",
    r"(?im)^\s*#{1,6}\s*(?:System|Human|Assistant)\s*:",
    r"(?im)^\s*-{3,}\s*SYSTEM\s*:",
)
HEADING_PREFIX = r"^\s*(?:[\d.]+[\).\s]+|[\d.]+\s+|(?:§|•|-)\s*)*"
HEADING_TAIL = r"[\s:;.\-–—•]+$"
WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda x: x != "")


def doc_type(title: Column) -> Column:
    found = F.lit("other")
    for name, pattern in reversed(DOC_TYPES):
        found = F.when(title.rlike(f"(?i)(?:{pattern})"), name).otherwise(found)
    return found


def normalized_heading(heading: Column) -> Column:
    """Heading without numbering, inner runs of white space and trailing separators, lower-cased."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(heading, F.lit(""))), HEADING_PREFIX, ""))
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), HEADING_TAIL, "")))


def is_meta_heading(heading: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(heading, F.lit(""))), HEADING_PREFIX, ""))
    return bare.rlike(f"(?i)^(?:{'|'.join(META_HEADINGS)})")


def sanitized(text: Column) -> Column:
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, pattern, "[FILTERED]")
    return text


def reason_problem(action: Column, reason: Column) -> Column:
    """Why a decision's reason is not acceptable, or null."""
    text = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    return F.when(F.length(text) < 30, "too_short").when((action == "deprecate") & ~text.rlike("|".join(REMOVAL_STEMS)), "no_removal_named")


def confidence(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("high", "medium", "low"), low)


def test_case_text(summary: Column, module: Column, labels: Column, description: Column, steps: Column) -> Column:
    """One labelled line for each part that is there."""
    parts = [("Summary", summary), ("Module", module), ("Labels", labels), ("Description", description), ("Steps", steps)]
    return F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in parts])


def token_count(text: Column) -> Column:
    """Four characters a token, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def without_think(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<(think|thinking|reasoning|thought)>.*?</\1>", ""))


def cited(text: Column, most: Column | int) -> Column:
    """Distinct numbers cited as [n], from 1 to ``most``, ascending."""
    most = F.lit(most) if isinstance(most, int) else most
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= most))))


def folder_module(path: Column) -> Column:
    """The first segment of a folder path, or null."""
    return F.nullif(F.get(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/"), 0), F.lit(""))


def chunk_text(heading: Column, text: Column, most: int = 8000) -> Column:
    """A chunk under its heading, cut to what is embedded."""
    return F.substring(F.concat(F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit("["), heading, F.lit("]\n"))).otherwise(""), text), 1, most)
