"""From candidates to findings by fixed rules. No function here takes a model or a client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..config import DEFAULT, Settings
from ..functions import text as T
from ..tables import materialize
from .index import r4


def select(candidates: DataFrame) -> DataFrame:
    """Candidates that share a word with their theme."""
    return candidates.filter(F.arrays_overlap(T.content_words(F.col("theme"), L.REVIEW_STOP), T.words(F.lower("text"), "[a-z]+")))


def score(selected: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds lexical, final_score and tier; definitions weigh less and are never strong."""
    df = selected.withColumn("_lex", T.lexical_overlap(F.col("theme"), F.col("text")))
    if "evidence_type" not in df.columns:
        df = df.withColumn("evidence_type", T.evidence_type(F.col("text"), F.col("source_document")))
    raw = cfg.weight_semantic * F.col("semantic_similarity") + cfg.weight_lexical * F.col("_lex") + cfg.weight_rank * F.col("retrieval_rank_score")
    df = df.withColumn("_raw", raw).withColumn("lexical", r4(F.col("_lex")))
    tier = F.when(F.col("_raw") >= cfg.strong_span, "strong").when(F.col("_raw") >= cfg.weak_span, "weak").otherwise("discard")
    is_def = (F.col("evidence_type") == "Definition") & F.lit(cfg.is_enabled("definition_downweight"))
    lowered = F.least(r4(r4(F.col("_raw")) * cfg.definition_factor), F.lit(cfg.definition_cap))
    df = df.withColumn("final_score", F.when(is_def, lowered).otherwise(r4(F.col("_raw"))))
    def_tier = F.when(F.col("final_score") < cfg.definition_discard, "discard").otherwise("weak")
    return df.withColumn("tier", F.when(is_def, def_tier).otherwise(tier)).drop("_lex", "_raw")


def review_answers(theme: Column, text: Column) -> Column:
    """Struct q1, q2, q3: does the span speak of the theme, does the theme reach beyond it, is it a whole sentence."""
    wanted, there = T.content_words(theme, L.REVIEW_STOP), F.array_distinct(T.words(F.lower(text), "[a-z]+"))
    both, missing = F.size(F.array_intersect(wanted, there)), F.size(F.array_except(wanted, there))
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    whole = (F.length(text) > 25) & F.substring(T.trim(text), -1, 1).isin(".", "!", "?")
    return F.struct(yes(both > 0).alias("q1"), yes((F.size(wanted) > 0) & (missing > both)).alias("q2"), yes(whole).alias("q3"))


def review_result(answers: Column) -> Column:
    """Missing answers count against the span."""
    q1, q2, q3 = (F.coalesce(answers[f"q{i}"], F.lit(d)) for i, d in ((1, "NO"), (2, "YES"), (3, "NO")))
    return F.when(q1 != "YES", "Reject").when((q2 != "YES") & (q3 == "YES"), "Pass").otherwise("Weak")


def review(scored: DataFrame) -> DataFrame:
    """Adds adversarial and adversarial_result to spans that aren't discarded; null for the others."""
    asked = F.when(F.col("tier") != "discard", review_answers(F.col("theme"), F.col("text")))
    df = scored.withColumn("adversarial", asked)
    return df.withColumn("adversarial_result", F.when(F.col("tier") != "discard", review_result(F.col("adversarial"))))


def is_valid() -> Column:
    return F.coalesce((F.col("tier") != "discard") & (F.col("adversarial_result") != "Reject"), F.lit(False))


def strength(value: Column, cfg: Settings = DEFAULT) -> Column:
    def badge(label: str, emoji: str, level: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(emoji).alias("emoji"), F.lit(level).alias("level"))

    low, mid, top = badge("Weak Evidence", "🔴", "weak"), badge("Moderate Evidence", "🟡", "moderate"), badge("Strong Evidence", "🟢", "strong")
    return F.when(value >= cfg.badge_strong, top).when(value >= cfg.badge_moderate, mid).otherwise(low)


def consistency(up: Column, down: Column, cfg: Settings = DEFAULT) -> Column:
    """How far the directions of a theme's spans agree, from how many rise and how many fall."""
    agreed = F.when(up + down >= 2, cfg.consistency_agreed).when(up + down == 1, cfg.consistency_single).otherwise(cfg.consistency_none)
    return F.when((up > 0) & (down > 0), 0.0).otherwise(agreed)


def confidence(reviewed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per theme with a candidate selected: counts, contradiction, score, band and breakdown over its valid spans."""
    ok = is_valid()
    pol = F.col("polarity") if "polarity" in reviewed.columns else T.polarity(F.col("text"))
    df = reviewed.withColumn("_ok", ok).withColumn("_pol", F.when(F.col("_ok"), pol))
    agg = df.groupBy("theme_id").agg(
        F.count(F.lit(1)).alias("n_selected"), F.count_if("_ok").alias("n_valid"),
        F.count_if((F.col("adversarial_result") == "Pass") & F.col("_ok")).alias("n_pass"),
        F.avg(F.when(F.col("_ok"), F.col("semantic_similarity"))).alias("_sem"), F.avg(F.when(F.col("_ok"), F.col("lexical"))).alias("_lex"),
        F.count_if(F.col("_pol") == "positive").alias("_up"), F.count_if(F.col("_pol") == "negative").alias("_down"),
        F.count_distinct(F.when(F.col("_ok"), F.nullif(F.col("source_document"), F.lit("")))).alias("_src"),
    )
    steady = consistency(F.col("_up"), F.col("_down"), cfg)
    sources = F.greatest(F.col("_src"), F.lit(1))
    diverse = F.when(sources >= 3, cfg.diversity_three).when(sources == 2, cfg.diversity_two).otherwise(0.0)
    if not cfg.is_enabled("source_diversity_bonus"):
        diverse = F.lit(0.0)
    some = F.col("n_valid") > 0
    parts = {
        "semantic": cfg.conf_semantic * F.col("_sem"), "lexical": cfg.conf_lexical * F.col("_lex"), "consistency": cfg.conf_consistency * steady,
        "span_count": cfg.conf_span_count * F.least((F.col("n_valid") - 1) * cfg.per_extra_span, F.lit(1.0)), "source_diversity": cfg.conf_source_diversity * diverse,
    }
    agg = agg.withColumns({f"c_{k}": F.when(some, v).otherwise(F.lit(0.0)) for k, v in parts.items()})
    total = sum((F.col(f"c_{k}") for k in parts), F.lit(0.0))
    agg = agg.withColumn("_score", F.least(total * cfg.calibration, F.lit(1.0)))
    band = (
        F.when(~some, "None").when(F.col("_score") >= cfg.band_high, "High").when(F.col("_score") >= cfg.band_medium, "Medium")
        .when(F.col("_score") >= cfg.band_moderate, "Moderate").when(F.col("_score") >= cfg.band_weak, "Weak").otherwise("Very Low")
    )
    return agg.select(
        "theme_id", "n_selected", "n_valid", "n_pass", ((F.col("_up") > 0) & (F.col("_down") > 0)).alias("contradiction"),
        F.when(some, r4(F.col("_score"))).otherwise(F.lit(0.0)).alias("score"), band.alias("band"), *(r4(F.col(f"c_{k}")).alias(f"c_{k}") for k in parts),
    )


def status(n_retrieved: Column, n_selected: Column, n_valid: Column, n_pass: Column, band: Column, contradiction: Column) -> Column:
    return (
        F.when(n_retrieved == 0, "INSUFFICIENT EVIDENCE").when((n_selected == 0) | (n_valid == 0), "BLOCKED").when(contradiction, "CONFLICTING EVIDENCE")
        .when(band.isin("High", "Medium") & (n_pass > 0), "VERIFIED").when(band == "Moderate", "PARTIALLY SUPPORTED")
        .when(band == "Weak", "WEAK EVIDENCE").when(band == "Very Low", "BLOCKED").otherwise("PARTIALLY SUPPORTED")
    )


def partial_strength(score_: Column, n_pass: Column, cfg: Settings = DEFAULT) -> Column:
    return (
        F.when((score_ >= cfg.partial_strong) & (n_pass >= 1), "Strong partial").when(score_ >= cfg.partial_moderate, "Moderate partial").otherwise("Weak partial")
    )


def decimal(x: Column) -> Column:
    """A score as text: up to four decimals, one at least."""
    return F.regexp_replace(F.format_string("%.4f", x), r"(\.[0-9]+?)0+$", "$1")


def decide(themes: DataFrame, candidates: DataFrame, reviewed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """A row per theme: counts, confidence, status, partial_strength. Themes without candidates stay."""
    zero = ("n_retrieved", "n_selected", "n_valid", "n_pass")
    counted = candidates.groupBy("theme_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    df = themes.join(counted, "theme_id", "left").join(confidence(reviewed, cfg), "theme_id", "left").na.fill(0, list(zero))
    df = df.na.fill(0.0, ["score", *(c for c in df.columns if c.startswith("c_"))]).na.fill("None", ["band"]).na.fill(False, ["contradiction"])
    df = df.withColumn("status", status(*(F.col(c) for c in (*zero, "band", "contradiction"))))
    df = df.withColumn("percent", F.bround(F.col("score") * 100, 0).cast("int"))
    return df.withColumn("partial_strength", F.when(F.col("status") == "PARTIALLY SUPPORTED", partial_strength(F.col("score"), F.col("n_pass"), cfg)))



def audit(decided: DataFrame, reviewed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Adds audit_trail, up to five stages, and reason. ``decided`` as decide() gives it."""
    q = lambda n: F.coalesce(F.col(f"adversarial.q{n}"), F.lit("?"))
    line = F.concat(F.col("span_id"), F.lit(": "), decimal(F.col("final_score")), F.lit(" ("), F.col("tier"), F.lit(")"))
    asked = F.concat("span_id", F.lit(": "), "adversarial_result", F.lit(" (Q1 "), q(1), F.lit(", Q2 "), q(2), F.lit(", Q3 "), q(3), F.lit(")"))
    fault = (
        F.when(F.col("adversarial.q1") == "NO", "Q1 (no direct support)").when(F.col("adversarial.q2") == "YES", "Q2 (over-interpretation)")
        .when(F.col("adversarial.q3") == "NO", "Q3 (context not preserved)")
    )
    seen = F.col("adversarial_result").isNotNull()
    notes = reviewed.groupBy("theme_id").agg(
        F.collect_list(F.struct("retrieval_rank", line.alias("s"))).alias("_lines"),
        F.collect_list(F.when(seen, F.struct("retrieval_rank", asked.alias("s")))).alias("_asked"),
        F.count_if(F.col("tier") != "discard").alias("_kept"),
        F.min(F.when(F.col("tier") == "discard", F.col("final_score"))).alias("_lowest"),
        F.count_if(F.col("adversarial_result") == "Reject").alias("_rejected"),
        F.array_sort(F.collect_set(F.when(F.col("adversarial_result") == "Reject", fault))).alias("_faults"),
    )
    df = decided.join(notes, "theme_id", "left")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.col(c)), lambda x: x["s"]), "; ")

    def stage(name: str, good: Column, detail: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("stage"), F.when(good, "pass").otherwise("fail").alias("outcome"), detail.alias("detail")))

    got, chosen = F.col("n_retrieved") > 0, (F.col("n_retrieved") > 0) & (F.col("n_selected") > 0)
    trail = F.array(
        stage("1 · Evidence retrieval", got, F.when(got, F.concat(F.col("n_retrieved").cast("string"), F.lit(f" candidate span(s) above relevance floor ({cfg.min_score})")))
              .otherwise("No spans met the relevance floor — theme not addressed in the document(s)."), F.lit(True)),
        stage("2 · Span selection (Hard Evidence Lock)", chosen, F.when(chosen, F.concat(F.col("n_selected").cast("string"), F.lit(" span(s) selected from the closed candidate set.")))
              .otherwise("No candidate span was selected as supporting the theme."), got),
        stage("3 · Weighted scoring", F.col("_kept") > 0, F.concat(text("_lines"), F.lit(f"  ·  thresholds: strong ≥ {cfg.strong_span}, weak ≥ {cfg.weak_span}")), chosen),
        stage("4 · Adversarial review", F.col("n_valid") > 0, text("_asked"), chosen & (F.size("_asked") > 0)),
        stage("5 · Contradiction scan", ~F.col("contradiction"), F.when(F.col("contradiction"), "Opposing conclusions detected across validated spans.")
              .otherwise("No contradictions among validated spans."), chosen & (F.col("n_valid") > 0)),
    )
    low = F.when(F.col("_lowest").isNotNull(), F.concat(F.lit("semantic/score too low (lowest "), decimal(F.col("_lowest")), F.lit(f" < {cfg.weak_span} weak floor)")))
    failed = F.when(F.size("_faults") > 0, F.concat(F.lit("adversarial review failed: "), F.array_join("_faults", ", "))).otherwise("adversarial review rejected the evidence")
    causes = F.concat_ws("; ", low, F.when(F.col("_rejected") > 0, failed))
    blocked = F.concat(F.lit("BLOCKED — "), F.when(causes == "", "selected evidence did not pass verification").otherwise(causes), F.lit("."))
    s = F.col("status")
    reason = (
        F.when(~got, "INSUFFICIENT EVIDENCE — the theme is not addressed anywhere in the uploaded document(s).")
        .when(~chosen, "BLOCKED — candidates were retrieved, but none were selected as genuinely supporting the theme.")
        .when(s == "BLOCKED", blocked)
        .when(s == "CONFLICTING EVIDENCE", "CONFLICTING EVIDENCE — validated spans support opposing conclusions for this theme.")
        .when(s == "VERIFIED", "VERIFIED — at least one span passed all checks with sufficient confidence.")
        .when(s == "PARTIALLY SUPPORTED", "PARTIALLY SUPPORTED — evidence exists but is weak or low-confidence.")
        .when(s == "WEAK EVIDENCE", "WEAK EVIDENCE — some relevant evidence, but weak and low-confidence.")
        .otherwise(s)
    )
    extra = [c for c in df.columns if c.startswith("_")]
    return df.withColumn("audit_trail", F.filter(trail, lambda x: x.isNotNull())).withColumn("reason", reason).drop(*extra)


def findings(themes: DataFrame, candidates: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One nested finding per theme: status, confidence, evidence, reason, audit_trail."""
    # A few rows a theme, written once: deciding, the audit and the evidence all read them
    reviewed = materialize(review(score(select(candidates), cfg)))
    decided = audit(decide(themes, candidates, reviewed, cfg), reviewed, cfg)
    kind = F.struct(F.col("evidence_type").alias("label"), T.evidence_emoji(F.col("evidence_type")).alias("emoji"))
    breakdown = F.struct(F.col("semantic_similarity").alias("semantic"), "lexical", F.col("retrieval_rank_score").alias("rank"))
    item = F.struct(
        "retrieval_rank", F.col("text").alias("span_text"), "page_number", "source_document", T.source_label(F.col("source_document"), F.col("page_number")).alias("source_label"),
        F.col("final_score").alias("span_score"), strength(F.col("final_score"), cfg).alias("strength"), kind.alias("evidence_type"),
        breakdown.alias("score_breakdown"), "adversarial", "adversarial_result",
    )
    proof = reviewed.filter(is_valid()).groupBy("theme_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    conf = F.struct("band", "score", "percent", "partial_strength", F.struct(*(F.col(f"c_{k}").alias(k) for k in ("semantic", "lexical", "consistency", "span_count", "source_diversity"))).alias("breakdown"))
    kind_of = proof.schema["evidence"].dataType
    return decided.join(proof, "theme_id", "left").select(
        "theme_id", "theme", "status", conf.alias("confidence"), F.coalesce("evidence", F.array().cast(kind_of)).alias("evidence"), "reason", "audit_trail"
    )
