"""Words, markers and patterns that decide results.

But for GLUED_STEPS, patterns are written without look-around, so that any SQL engine's regular expressions take them.
"""

from __future__ import annotations

POSITIVE = (
    "increase", "increased", "increases", "increasing", "rise", "rises", "rising", "rose", "grew", "grow", "growth", "growing", "improved", "improve",
    "improvement", "higher", "more", "expand", "expanded", "up", "gain", "gained", "exceed", "exceeds", "exceeded", "climbed", "climb", "soared", "soar",
    "jumped", "jump", "surged", "surge", "doubled",
)
NEGATIVE = (
    "decrease", "decreased", "decreases", "decreasing", "fall", "falls", "fell", "falling", "decline", "declined", "declining", "reduced", "reduce",
    "reduction", "lower", "less", "fewer", "shrank", "shrink", "down", "drop", "dropped", "worsened", "worsen", "deteriorate", "stable", "stabilise",
    "stabilize", "unchanged", "dipped", "dip", "slipped", "slip", "plunged", "plunge", "sank", "sink", "halved",
)

LEXICAL_STOP = ("the", "a", "an", "of", "to", "in", "on", "and", "or", "for", "with", "is", "are", "this", "that", "by", "as", "at", "from")
REVIEW_STOP = (*LEXICAL_STOP, "impact", "outcomes", "report")

METADATA_MARKERS = (
    "see annex", "see table", "see figure", "annex table", "annex tables", "underlying data", "data are presented", "presented in annex",
    "base:", "bases:", "note:", "notes:", "source:", "sources:", "figure ", "table ", "fig.", "chart ",
)
THEME_BLACKLIST = (
    "annex", "annex table", "table", "tables", "figure", "figures", "chart", "base", "bases", "note", "notes", "source", "sources",
    "english housing survey", "headline report", "report", "survey", "chapter", "section", "appendix", "document", "documents",
    "data", "dataset", "statistics", "respondent", "respondents", "underlying data", "underlying data presented", "acknowledgements",
    "contents", "references", "bibliography", "introduction", "methodology", "glossary", "foreword", "summary",
)
THEME_FORBIDDEN = ("underlying data", "annex", "appendix", "acknowledgement", "contents", "references", "bibliography", "table", "figure", "presented")
GENERIC = (
    "report", "study", "data", "table", "figure", "section", "page", "chapter", "introduction", "conclusion", "summary", "results", "analysis", "method",
    "methods", "findings", "discussion", "appendix", "reference", "references", "number", "percent", "percentage", "total", "average", "year", "years",
    "however", "therefore", "overall", "based", "using", "include", "including", "various", "different", "several", "many", "also", "well", "within",
    "interview", "quote", "category", "respondent", "participant", "id", "row", "column", "code", "theme", "comment", "response", "answer", "name",
)
BROAD = (
    "households", "household", "people", "respondents", "respondent", "individuals", "individual", "residents", "resident", "persons", "person", "adults",
    "children", "families", "family", "group", "groups",
)
STEM_SUFFIXES = ("ing", "ed", "es", "ers", "er", "s")

PDF_INTERNALS = ("endobj", "endstream", "flatedecode", "/type", "/filter", "/contents", "structparents", "xref", "startxref")
SECTION_HEADERS = r"Abstract|Introduction|Background|Methods?|Methodology|Results?|Findings|Discussion|Conclusions?|Summary|References|Acknowledgements?|Overview|Executive Summary"
ABBREVIATIONS = r"e\.g|i\.e|etc|vs|Mr|Mrs|Dr|No|Fig|Ref"
#: (pattern, replacement): where extraction glued a heading in capitals, an axis or a section's name to the next sentence, in this order.
GLUED_STEPS = (
    (r"\b([A-Z][A-Z&]+\s+[A-Z][A-Z&]+(?:\s+[A-Z][A-Z&]+)++)\s+(?=[A-Z][a-z])", r"\1. "),
    (r"((?:\b\d{1,3}\b[ ]++){4,}+(?:[a-z][a-z ]+?)?)(?=[A-Z][a-z])", r"\1. "),
    (rf"(^|(?<=[.!?])\s)({SECTION_HEADERS})\s+(?=[A-Z][a-z])", r"\1\2. "),
)

WORD = r"[A-Za-z0-9%]+"
_REFERENCE_WORDS = r"annex\s+tables?|annexe?s?|appendix|appendices|figures?|fig\.?|tables?|charts?"
_REFERENCE_NUMBER = r"\s*(?:\d+(?:\.\d+)*[a-z]?|[A-Z]\b)"
#: A numbered or lettered reference; the keyword's case doesn't count, and so neither does the letter's.
REFERENCE = rf"(?:see\s+)?(?:{_REFERENCE_WORDS}){_REFERENCE_NUMBER}"
REFERENCE_OR_PAGE = rf"\b(?:see\s+)?(?:{_REFERENCE_WORDS}|page){_REFERENCE_NUMBER}"
LABEL = r"\b(?:source|notes?|bases?)\s*:"
CUT_MARKER = r"\b(?:see\s+)?(?:annex|appendix|figure|fig\.?|table|chart)\b|\b(?:source|notes?|bases?)\s*:"
DANGLING = r"[\s,;:.\-]*(?:\band\b|\bor\b)?\s*$"
LABEL_SENTENCE = r"^(?:source|notes?|bases?)\s*:"
LABEL_START = r"^(?:base|bases|note|notes|source|sources)\s*[:.]"
NUMBERED_POINTER = r"\b(?:annex\s+table|annex|figure|table|chart|fig\.?)\s*\d"
ANALYTICAL = r"\b(?:increase|decrease|rose|fell|grew|declined|higher|lower|proportion|percent|%|million|estimated|compared)\b"
#: (pattern, replacement): references are taken out of a sentence in this order. "A" in front: any case.
STRIP_STEPS = (
    ("A", r"[,;.]?\s*(?:source|notes?|bases?)\s*:\s*.*$", "."),
    ("", r"\s*\[\s*\d{1,3}\s*\]", ""),
    ("A", r"\(\s*" + REFERENCE + r"\s*\)", ""),
    ("A", r",?\s*as (?:shown|set out|presented|illustrated|reported) in\s+" + REFERENCE, ""),
    ("A", r"[,;(]?\s*(?:and\s+|,\s*)?" + REFERENCE + r"\s*", " "),
    ("A", r"\s+(?:and|,)\s+" + REFERENCE, ""),
    ("", r"\(\s*\)", ""),
    ("", r"\s*[()]\s*", " "),
    ("", r"\s+", " "),
    ("", r"^\s+|\s+$", ""),
    ("", r"\s+([.,;])", r"\1"),
    ("", r"[,;]\s*\.", "."),
    ("", r"\s*[,;]\s*$", ""),
    ("", r"^\s+|\s+$", ""),
)

AUXILIARY = (
    r"\b(?:is|are|was|were|be|been|being|has|have|had|do|does|did|rose|fell|grew|grown|made|found|saw|seen|ran|run|"
    r"will|would|can|could|may|might|must|should|shall)\b"
)
INFLECTED = r"\b\w+(?:ed|ing)\b"
PLURAL_OR_VERB = r"\b\w{3,}(?:es|s)\b"
PRESENT = (
    r"\b(?:rise|rises|fall|falls|increase|increases|decrease|decreases|vary|varies|differ|differs|account|accounts|report|reports|"
    r"remain|remains|include|includes|exceed|exceeds|face|faces|show|shows|need|needs|live|lives|worsen|worsens|improve|improves)\b"
)
NUMBER_FRAGMENT = r"^[\d,\.]+\s+\w+(?:\s+\w+){0,3}\.?$"
NUMERIC_TOKEN = r"^[£$]?\d+(?:[.,]\d+)?%?$"
AXIS = r"(?:^|\s)(?:\d+%?\s+){3}\d+%?(?:\s|$)"

LIMITATION = r"\b(?:limitation|caveat|caution|should not be|cannot be|not statistically significant|small sample|may not)\b"
DEFINITION = (
    r"\b(?:is defined as|are defined as|defined as|refers to|is the|are those|as with chapter|this chapter|this section|in this report|"
    r"means that|is a measure of|describes|is a means-tested|is a type of|is a form of|is a benefit|is a scheme|is a category|"
    r"is an? \w+ (?:benefit|payment|scheme|allowance|measure|indicator|status|tenure)|includes (?:households|people|those|anyone|all)|"
    r"comprises|consists of|encompasses|is categorised|are categorised|is classified|are classified)\b"
)
TREND = r"\b(?:increase|increased|decrease|decreased|rose|fell|grew|declined|trend|over time|year on year|compared to|since \d{4})\b"
QUANTITY = r"\d|\bpercent\b|%|\bmillion\b|\bthousand\b"
STATISTIC = r"\d+(?:\.\d+)?\s*(?:%|percent)|\b\d{3,}\b|\bmillion\b|\bbillion\b"
POLICY = r"\b(?:policy|government|legislation|standard|regulation|strategy|scheme|act|reform|must|should|requirement)\b"
#: Of these patterns: parts of which a text that matches has one.
PARTS = {
    LIMITATION: ("limitation", "caveat", "caution", "should not be", "cannot be", "not statistically", "small sample", "may not"),
    DEFINITION: (
        "defined as", "refers to", "is the", "are those", "as with chapter", "this chapter", "this section", "in this report", "means that", "is a", "describes",
        "includes ", "comprises", "consists of", "encompasses", "are categorised", "is categorised", "are classified", "is classified",
    ),
    TREND: ("increase", "decrease", "rose", "fell", "grew", "declined", "trend", "over time", "year on year", "compared to", "since "),
    POLICY: ("policy", "government", "legislation", "standard", "regulation", "strategy", "scheme", "act", "reform", "must", "should", "requirement"),
}
EVIDENCE_EMOJI = {
    "Limitation": "⚠️", "Definition": "📜", "Statistical trend": "📈", "Trend": "📈", "Statistical finding": "📊",
    "Interview quote": "🗣️", "Policy statement": "📄", "General statement": "📝",
}
THEME_STRUCTURAL = r"\b(?:annex|figure|table|appendix)\b"
THEME_LEADING = r"^(?:base|bases|note|notes|source|sources|figure|table)\b"

STATUS_STYLE = {
    "VERIFIED": ("🟢", "#1b7f3b", "#e7f6ec"),
    "PARTIALLY SUPPORTED": ("🟡", "#9a6700", "#fff8e1"),
    "WEAK EVIDENCE": ("🟠", "#b5651d", "#fff3e6"),
    "INSUFFICIENT EVIDENCE": ("🔍", "#5a5a5a", "#f0f0f0"),
    "BLOCKED": ("🔴", "#b32424", "#fdecec"),
    "CONFLICTING EVIDENCE": ("⚡", "#6f42c1", "#f3effb"),
}
SUPPORTED = ("VERIFIED", "PARTIALLY SUPPORTED", "WEAK EVIDENCE", "CONFLICTING EVIDENCE")
