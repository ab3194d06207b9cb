"""Grades on an ordinal scale, and predicates over reviewers and tiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades from the most to the least secret, and which count as high.
GRADES = ("TS", "S1", "S2", "S3")
HIGH = ("TS", "S1")
#: How the reviewer ids of machines start.
MACHINE_PREFIXES = ("llm_judge", "ai_assist", "codex", "model", "machine", "public_gold", "auto")
#: Reviewer ids that name nobody.
PLACEHOLDERS = ("", "human", "reviewer", "tbd", "-", "n/a", "na", "system", "ai", "ai_assist", "claude", "unknown", "none", "auto", "bot", "llm")
#: The tiers, the label sources of the legal floor, and those of candidates.
TIERS = ("locked_gold_eval", "legal_floor", "gold_candidate", "silver_train")
LEGAL_SOURCES = ("public_definitive", "koipa_case_based", "nkt_designated", "codex_review")
CANDIDATE_SOURCES = ("rule_llm_agreement",)
#: Older factor codes and the ones that stand for them.
FACTORS = {"NON_PUBLICITY": "SECRECY", "ECONOMIC_VALUE": "VALUE", "LEAK_IMPACT": "VALUE", "MANAGEMENT_LEVEL": "MANAGEMENT"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order(grade: Column | str, default: int = 99) -> Column:
    """1 for the most secret grade to 4; default for any other value or null."""
    g = col(grade)
    out = F.lit(default)
    for k in range(len(GRADES), 0, -1):
        out = F.when(g == GRADES[k - 1], k).otherwise(out)
    return out


def grade_of(level: Column | str) -> Column:
    """The grade of an order 1 to 4, else null."""
    return F.try_element_at(F.array(*[F.lit(g) for g in GRADES]), F.when(col(level).between(1, 4), col(level).cast("int")).otherwise(9))


def is_high(grade: Column | str) -> Column:
    return col(grade).isin(*HIGH)


def direction(old: Column, new: Column) -> Column:
    """underclass where the new order is smaller (the old grade was too low), overclass where larger, confirm where equal, lateral where either is unknown."""
    known = old.between(1, 4) & new.between(1, 4)
    return F.when(~F.coalesce(known, F.lit(False)), "lateral").when(new < old, "underclass").when(new > old, "overclass").otherwise("confirm")


def more_secret(a: Column, b: Column) -> Column:
    return F.when(order(a) <= order(b), a).otherwise(b)


def is_human(reviewer: Column | str) -> Column:
    """A reviewer id that isn't empty and doesn't start as a machine's does."""
    r = F.lower(F.trim(F.coalesce(col(reviewer), F.lit(""))))
    return (r != "") & ~r.rlike("^(" + "|".join(MACHINE_PREFIXES) + ")")


def is_machine_strict(reviewer: Column | str) -> Column:
    r = F.lower(F.trim(F.coalesce(col(reviewer), F.lit(""))))
    return r.isin(*PLACEHOLDERS) | r.contains("assist") | r.rlike("^(ai|llm|gpt|claude|bot|auto)[_-]")


def admissible(reviewer: Column | str, status: Column | str) -> Column:
    """A human's correction in a final status."""
    return is_human(reviewer) & col(status).isin("confirmed", "corrected")


def tier(label_source: Column | str, reviewer: Column | str, review_status: Column | str) -> Column:
    """locked for labels that a human signed, the legal floor for those of legal sources, candidates that passed the automatic gate, silver for the rest. The label's source comes first."""
    source = col(label_source)
    return (
        F.when((source == "human_review") & is_human(reviewer), TIERS[0])
        .when(source.isin(*LEGAL_SOURCES), TIERS[1])
        .when(source.isin(*CANDIDATE_SOURCES) | (col(review_status) == "gold_candidate"), TIERS[2])
        .otherwise(TIERS[3])
    )


def folded_factor(code: Column | str) -> Column:
    c = col(code)
    out = c
    for old, new in FACTORS.items():
        out = F.when(c == old, new).otherwise(out)
    return out
