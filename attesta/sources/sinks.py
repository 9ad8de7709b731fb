"""Writers of findings: JSON, Excel and Word. Flattening is a plan; a report file is a theme list long."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import office

COLUMNS = ["Theme", "Status", "Confidence Band", "Confidence %", "Partial Strength", "Reason", "Evidence", "Evidence Type", "Source Document", "Page", "Span Score", "Audit Result"]
INTERNAL = ("pdf_path_map",)


def flat(findings: DataFrame) -> DataFrame:
    """A row per evidence span under COLUMNS, with place; a finding without evidence is one row with blanks."""
    rows = findings.select("theme_id", "theme", "status", "confidence", "reason", F.posexplode_outer("evidence").alias("place", "e"))
    values = (
        F.col("theme"), F.col("status"), F.col("confidence.band"), F.col("confidence.percent"), F.coalesce("confidence.partial_strength", F.lit("")), F.col("reason"),
        F.coalesce("e.span_text", F.lit("")), F.coalesce("e.evidence_type.label", F.lit("")), F.coalesce("e.source_document", F.lit("")),
        F.col("e.page_number"), F.col("e.span_score"), F.coalesce("e.adversarial_result", F.lit("")),
    )
    return rows.select("theme_id", F.coalesce("place", F.lit(0)).alias("place"), *(v.alias(c) for v, c in zip(values, COLUMNS, strict=True)))


def to_json_rows(findings: DataFrame) -> DataFrame:
    """theme_id and json, pretty-printed, without internal fields; Unicode is kept."""
    kept = [c for c in findings.columns if c not in INTERNAL]
    return findings.select("theme_id", F.to_json(F.struct(*kept), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def to_json(summary: DataFrame, findings: DataFrame) -> str:
    """One document: the run's summary with its findings, indented by two."""
    head = summary.first().asDict(recursive=True)
    rows = [r.asDict(recursive=True) for r in findings.orderBy("theme_id").toLocalIterator()]
    return json.dumps({k: v for k, v in (head | {"findings": rows}).items() if k not in INTERNAL}, indent=2, ensure_ascii=False)


def to_xlsx(findings: DataFrame) -> bytes:
    rows = flat(findings).orderBy("theme_id", "place").select(*COLUMNS).toLocalIterator()
    return office.write_xlsx("Findings", [COLUMNS, *(list(r) for r in rows)])


def report_paragraphs(findings: DataFrame) -> DataFrame:
    """theme_id, place, style, text: the report's paragraphs of each finding."""
    para = lambda style, text: F.struct(F.lit(style).alias("style"), text.alias("text"))
    conf = F.concat(F.lit("Confidence: "), "confidence.band", F.lit(" ("), F.col("confidence.percent").cast("string"), F.lit("%)"))
    conf = F.concat(conf, F.coalesce(F.concat(F.lit(" · "), "confidence.partial_strength"), F.lit("")))
    head = F.array(para("Heading1", F.col("theme")), para("", F.concat(F.lit("Status: "), "status")), para("", conf), para("", F.concat(F.lit("Reason: "), "reason")))
    quote = lambda e: F.concat(F.lit("["), e["evidence_type"]["label"], F.lit('] "'), e["span_text"], F.lit('"  ('), F.coalesce(e["source_document"], F.lit("")), F.lit(" Page "), e["page_number"].cast("string"), F.lit(")"))
    quotes = F.transform("evidence", lambda e: para("IntenseQuote", quote(e)))
    stage = lambda s: F.concat(F.lit("["), F.upper(s["outcome"]), F.lit("] "), s["stage"], F.lit(" — "), s["detail"])
    trail = F.concat(F.array(para("Heading3", F.lit("Audit trail:"))), F.transform("audit_trail", lambda s: para("ListBullet", stage(s))))
    rows = findings.select("theme_id", F.posexplode(F.concat(head, quotes, trail)).alias("place", "p"))
    return rows.select("theme_id", "place", "p.style", "p.text")


def to_docx(findings: DataFrame, sources: list[str]) -> bytes:
    body = [(r["style"], r["text"]) for r in report_paragraphs(findings).orderBy("theme_id", "place").toLocalIterator()]
    head = [("Title", "Findings Report"), ("", f"Source document(s): {', '.join(sources)}"), ("", "Golden Rule: No Evidence = No Claim")]
    return office.write_docx([*head, *body])
