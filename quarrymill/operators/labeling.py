"""Rule labels, votes, consensus and routing, as expressions over rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import grades, stats, text
from quarrymill.functions.grades import GRADES


def rule_scores(t: Column, seeds: list[tuple[str, str, float]], boosts: list[tuple[str, str, float]] = ()) -> Column:
    """array<struct<grade, score>> in the order of GRADES: occurrences of a grade's seeds times their weights, and the boosts of matching patterns (in either case). seeds (grade, keyword, weight), boosts (grade, pattern, weight)."""
    out = []
    for g in GRADES:
        terms = [text.occurrences(t, k) * F.lit(w) for x, k, w in seeds if x == g]
        terms += [F.when(t.rlike("(?i)" + p), w).otherwise(0.0) for x, p, w in boosts if x == g]
        out.append(F.struct(F.lit(g).alias("grade"), reduce(lambda a, b: a + b, terms, F.lit(0.0)).alias("score")))
    return F.array(*out)


def rule_label(scores: Column) -> Column:
    """struct<grade, confidence>: the largest score, ties to the more secret grade; S3 with confidence 0 where nothing matched."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x["score"])
    best = F.array_max(F.transform(scores, lambda x, i: F.struct(x["score"].alias("s"), (-i).alias("i"), x["grade"].alias("g"))))
    return F.struct(F.when(total > 0, best["g"]).otherwise(GRADES[-1]).alias("grade"), F.when(total > 0, F.bround(best["s"] / total, 4)).otherwise(0.0).alias("confidence"))


def svm_grade(s: Column, v: Column, m: Column) -> Column:
    """Secrecy, value and management (0 to 2 each) to a grade."""
    product = s * v * m
    return F.when((s == 2) & (v == 2), F.when(product >= 4, "TS").otherwise("S1")).when(product >= 1, "S2").otherwise("S3")


#: The levels of secrecy, value and management that stand for a grade.
LEVELS = {"TS": (2, 2, 2), "S1": (2, 2, 0), "S2": (1, 1, 1), "S3": (0, 0, 0)}


def guarded_grade(content: Column, public: Column, managed: Column) -> Column:
    """struct<grade, svm, secrecy, value, management>: the levels that a content grade, public marks and signs of management give, their grade, and the more secret of this and the content's. Where that isn't the levels' own grade, the levels shown are those of the final one."""
    strong, least = grades.is_high(content), content == GRADES[-1]
    s = F.when(public | least, 0).when(strong, 2).otherwise(1)
    v = F.when(least, 0).when(strong, 2).otherwise(1)
    m = F.when(managed, 2).when(least | (content == "S1"), 0).otherwise(1)
    svm = svm_grade(s, v, m)
    final = grades.more_secret(svm, content)
    shown = [F.when(svm == final, own).otherwise(F.element_at(F.create_map(*[F.lit(x) for g in GRADES for x in (g, LEVELS[g][k])]), final)) for k, own in enumerate((s, v, m))]
    return F.struct(final.alias("grade"), svm.alias("svm"), *[c.alias(n) for n, c in zip(("secrecy", "value", "management"), shown, strict=True)])


def scaled(v: Column, highest: Column) -> Column:
    """A score on a scale of five, two places."""
    return F.when(highest > 0, F.bround(F.least(F.lit(5.0), v / highest * 5), 2)).otherwise(0.0)


def merged_label(rule: Column, rule_confidence: Column, judged: Column) -> Column:
    """The judge's grade only where the rule's confidence is under .3 and the judge's is more secret."""
    return F.when((rule_confidence < 0.3) & (grades.order(judged) < grades.order(rule)), judged).otherwise(rule)


def majority(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """(item, label, self_consistency, n): the commonest valid vote, ties to the more secret; votes that aren't grades don't count."""
    n = votes.where(F.col(vote).isin(*GRADES)).groupBy(item, vote).agg(F.count("*").alias("c"))
    g = n.groupBy(item).agg(F.max_by(vote, F.struct("c", -grades.order(vote))).alias("label"), F.max("c").alias("top"), F.sum("c").alias("n"))
    return g.select(item, "label", (F.col("top") / F.col("n")).alias("self_consistency"), "n")


def adaptive_vote(items: DataFrame, item: str, ask: Callable[[DataFrame], DataFrame], first: int = 3, most: int = 5) -> DataFrame:
    """(item, label, self_consistency, n, asked) of every item: the commonest valid vote of the first samples, and of further ones up to most where those differ (a vote that is no grade differs from grades). ask: rows (item, k) to rows (item, k, vote). An item without a valid vote is S3 with 0.

    Only items whose first samples are split are asked again. The votes should come
    from a table or a repeatable model, as plans may read them twice.
    """
    rows = items.select(item).distinct()
    early = ask(rows.select(item, F.explode(F.sequence(F.lit(1), F.lit(first))).alias("k"))).select(item, F.when(F.col("vote").isin(*GRADES), F.col("vote")).otherwise("").alias("vote"))
    split = early.groupBy(item).agg(F.min("vote").alias("_low"), F.max("vote").alias("_high")).where("_low <> _high").select(item)
    votes = early
    if most > first:
        votes = early.unionByName(ask(split.select(item, F.explode(F.sequence(F.lit(first + 1), F.lit(most))).alias("k"))).select(item, "vote"))
    asked = votes.groupBy(item).agg(F.count("*").alias("asked"))
    told = rows.join(majority(votes, item, "vote"), item, "left").join(asked, item, "left")
    none = F.col("label").isNull()
    return told.select(item, F.coalesce("label", F.lit("S3")).alias("label"), F.when(none, 0.0).otherwise(F.col("self_consistency")).alias("self_consistency"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("asked", F.lit(0)).alias("asked"))


def consensus(rule: Column, judge: Column, self_consistency: Column, evidence: Column, shadow: Column | None = None, airgap: Column | bool = False, confidence: Column | float = 0.0, least_consistency: float = 0.67, require_evidence: bool = True) -> Column:
    """struct<status, label_source, review_status, is_gold, flags, priority>: whether rule and judge agree well enough for a gold candidate; confidence only orders the reviews.

    The first reason that holds gives the status: a voice (rule, judge, shadow) is a high
    grade and the judge's is less secret; no evidence; the grades differ; few of the
    judge's samples agree; a high grade without a second judge (airgap); the shadow, where
    there is one, differs from the judge.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    shadow = F.lit(None).cast("string") if shadow is None else shadow
    high, rank = judge.isin(*grades.HIGH), grades.order(judge)
    lowered = reduce(lambda a, b: a | b, [F.coalesce(v.isin(*grades.HIGH) & (grades.order(v) < rank), F.lit(False)) for v in (rule, judge, shadow)])
    suspect = shadow.isNotNull() & ~shadow.eqNullSafe(judge)
    low, lonely, bare = self_consistency < least_consistency, lit(airgap) & high, ~evidence
    reason = F.when(lowered, "ts_downgrade")
    for name, test in (("no_evidence", bare & F.lit(require_evidence)), ("disagree", ~rule.eqNullSafe(judge)), ("low_agreement", low), ("airgap_upper", lonely), ("production_suspect", suspect)):
        reason = reason.when(test, name)
    flags = (("ts_downgrade_suspect", lowered), ("production_suspect", suspect), ("low_agreement", low), ("no_evidence", bare), ("airgap_upper", lonely))
    weight = lambda test, w: F.when(test, w).otherwise(0.0)
    priority = weight(lowered, 100.0) + weight(high, 10.0) + weight(suspect, 5.0) + 2.0 * (1.0 - self_consistency) + (1.0 - lit(confidence))
    passed = reason.isNull()
    return F.struct(
        F.when(passed, "gold_candidate").otherwise(F.concat(F.lit("needs_review_"), reason)).alias("status"),
        F.when(passed, "rule_llm_agreement").otherwise("needs_review").alias("label_source"),
        F.when(passed, "gold_candidate").otherwise("needs_review").alias("review_status"),
        passed.alias("is_gold"),
        F.array_compact(F.array(*[F.when(t, n) for n, t in flags])).alias("flags"),
        priority.alias("priority"),
    )


#: The grade that a marking stands for, and the least secret grade that goes with a restricted scope.
MARKINGS = {"top_secret": "TS", "secret": "S1", "confidential": "S2"}
SCOPES = {"approved_only": "S1", "designated": "S2", "department": "S2"}


def metadata_floor(grade: Column, marking: Column, scope: Column) -> Column:
    """struct<grade, raised, conflict>: a marking raises a less secret grade to its own; without one, a restricted scope and a grade less secret than goes with it are a conflict. Nothing is lowered."""
    known = lambda values, key: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)
    m, s = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (marking, scope))
    floor, least = known(MARKINGS, m), known(SCOPES, s)
    raised = F.coalesce(grades.order(floor) < grades.order(grade), F.lit(False)) & floor.isNotNull()
    conflict = m.isin("", "none") & least.isNotNull() & (grades.order(grade) > grades.order(least))
    return F.struct(F.when(raised, floor).otherwise(grade).alias("grade"), raised.alias("raised"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def chunk_probabilities(chunks: DataFrame, item: str, weight: str, grade_columns: list[str]) -> DataFrame:
    """Length-weighted mean of each grade's probability over an item's chunks; for the high grades the largest chunk's if that is more."""
    out = []
    for c in grade_columns:
        mean = stats.ratio(F.sum(F.col(c) * F.col(weight)), F.sum(weight))
        out.append((F.greatest(mean, F.max(c)) if c in ("p_ts", "p_s1") else mean).alias(c))
    return chunks.groupBy(item).agg(*out)


def escalated(probabilities: list[Column], tau: float) -> Column:
    """The most secret high grade with probability tau or more, else the likeliest grade, ties to the more secret."""
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-k).alias("k"), F.lit(GRADES[k]).alias("g")) for k, p in enumerate(probabilities)]))["g"]
    return F.when(probabilities[0] >= tau, "TS").when(probabilities[1] >= tau, "S1").otherwise(best)


def overridden(grade: Column, ts: Column, s1: Column, s2: Column) -> Column:
    """A rule score over its grade's limit raises a less secret label."""
    ruled = F.when(ts >= 3.0, "TS").when(s1 >= 2.2, "S1").when(s2 >= 1.6, "S2")
    return F.when(ruled.isNotNull() & (grades.order(ruled) < grades.order(grade)), ruled).otherwise(grade)


def capped_public(grade: Column, confidence: Column, public: Column) -> Column:
    """Public sources are S3 with confidence .7 at most; conflict where that lowers a high grade."""
    return F.struct(F.when(public, "S3").otherwise(grade).alias("grade"), F.when(public, F.least(confidence, F.lit(0.7))).otherwise(confidence).alias("confidence"), (public & grades.is_high(grade)).alias("conflict"))


def routed(confidence: Column, conflict: Column, sparse: Column, limit: float = 0.7) -> Column:
    """struct<status, reasons>."""
    reasons = F.array_compact(F.array(F.when(confidence < limit, "low_confidence"), F.when(conflict, "conflict"), F.when(sparse, "sparse_evidence")))
    return F.struct(F.when(F.size(reasons) > 0, "needs_review").otherwise("staging").alias("status"), reasons.alias("reasons"))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def best_temperature(df: DataFrame, logits: str, truth: str, steps: int = 201) -> DataFrame:
    """(temperature, nll): the smallest mean negative log-likelihood over a grid from .05 to 10.05 and 1; the first of equals."""
    grid = F.array(*[F.lit(0.05 + 0.05 * k) for k in range(steps)], F.lit(1.0))
    rows = df.select(logits, truth, F.explode(grid).alias("temperature"))
    nll = -F.ln(F.greatest(F.get(softmax(F.col(logits), F.col("temperature")), F.col(truth)), F.lit(1e-12)))
    means = rows.groupBy("temperature").agg(F.avg(nll).alias("nll"))
    return means.agg(F.min_by("temperature", F.struct(F.round("nll", 9), "temperature")).alias("temperature"), F.round(F.min("nll"), 6).alias("nll"))


def reused_label(rows: DataFrame, key: str, source_priority: dict[str, int]) -> DataFrame:
    """The label of each key's best source, ties to the smaller doc_id."""
    order = F.create_map(*[x for k, v in source_priority.items() for x in (F.lit(k), F.lit(v))])
    p = F.coalesce(F.try_element_at(order, F.col("label_source")), F.lit(99))
    return rows.groupBy(key).agg(F.min_by(F.struct("doc_id", "label", "label_source"), F.struct(p, F.col("doc_id"))).alias("r")).select(key, "r.*")
