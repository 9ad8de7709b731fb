"""Theme names by a model that the caller brings: what it is asked, and what is taken from its reply."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

# Chunks and characters of the sample that a request shows.
SAMPLE_CHUNKS, SAMPLE_CHARS = 20, 4000

log = logging.getLogger(__name__)


def sample(chunks: DataFrame, key: str = "chunk_id") -> list[str]:
    """Texts of the first chunks; none is taken to the driver beyond the characters that a request may show."""
    rows = chunks.select(key, F.left(F.coalesce("text", F.lit("")), F.lit(SAMPLE_CHARS)).alias("_text")).orderBy(key).limit(SAMPLE_CHUNKS)
    return [r["_text"] for r in rows.collect()]


def request(phrases: list[str], texts: list[str], count: int) -> tuple[str, str]:
    """The instruction and the message that ask for ``count`` names."""
    shown = " ".join(texts[:SAMPLE_CHUNKS])[:SAMPLE_CHARS]
    rule = f"Name {count} research themes as short noun phrases. Leave out titles of documents and references to tables, figures and annexes. Reply with a JSON array of {count} strings only."
    return rule, f"Phrases found: {', '.join(phrases)}\n\nExcerpt:\n{shown}"


def names(reply: str | None) -> list[str] | None:
    """The names of a reply: its array from the first opening to the last closing bracket, whatever stands around it. None
    if there isn't one that can be read; blank names are left out."""
    text = reply or ""
    try:
        found = json.loads(text[text.index("[") : text.rindex("]") + 1])
    except ValueError:
        return None
    return [name for x in found if (name := str(x).strip())]


def by_asking(ask: Callable[[str, str], str], cfg: Settings = DEFAULT) -> Callable[[list[str], list[str]], list[str] | None]:
    """A namer for discover_themes. ask(instruction, message) gives the reply, on the driver; if it raises, or its reply can't be
    read, the phrases found stay."""

    def namer(phrases: list[str], texts: list[str]) -> list[str] | None:
        if not phrases:
            return None
        try:
            return names(ask(*request(phrases, texts, cfg.themes)))
        except Exception as e:
            log.warning("themes keep the phrases found: %s", e)
            return None

    return namer
