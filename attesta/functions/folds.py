"""The two order-dependent folds of segmentation: pages and chunks of bounded size.

They run as Arrow-batched functions over arrays that built-in expressions have already split, one
document per row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..shipping import bounded_batches, ship
from . import text as T


#: Texts that a worker holds at once: as arrays of arrays each takes many times its bytes.
PACKED_ROWS = 250


def pack_sentences(paragraphs: Iterable[Sequence[str]], most: int, flush: int) -> list[str]:
    """Sentences joined to chunks of ``most`` characters at most, none cut. A paragraph's end closes a
    chunk that has ``flush`` characters; a shorter one goes on with the next paragraph."""
    chunks: list[str] = []
    open_: list[str] = []
    size = 0
    for sents in paragraphs:
        for s in sents:
            if open_ and size + 1 + len(s) > most:
                chunks.append(" ".join(open_))
                open_, size = [], 0
            size += len(s) + (1 if open_ else 0)
            open_.append(s)
        if size >= flush:
            chunks.append(" ".join(open_))
            open_, size = [], 0
    return [*chunks, " ".join(open_)] if open_ else chunks


def pack_paragraphs(parts: Sequence[str], most: int, whole: str, spaces: str | None = None) -> list[str]:
    """Paragraphs joined by blank lines to pages of ``most`` characters at most; a longer one is a page. spaces: what is trimmed."""
    pages: list[str] = []
    page = ""
    for p in parts:
        if len(page) + len(p) + 2 <= most:
            page = f"{page}\n\n{p}".strip(spaces)
            continue
        if page:
            pages.append(page)
        page = p
    if page:
        pages.append(page)
    return pages or [whole]


def chunk_texts(pages: Column, cfg: Settings = DEFAULT, ascii_only: bool = False) -> Column:
    """For an array of page texts, an array of the chunk texts of each. ascii_only: see functions.text.mode."""
    ship()
    bounded_batches(rows=PACKED_ROWS)
    most, flush = cfg.chunk_chars, cfg.chunk_flush

    @F.pandas_udf("array<array<string>>")
    def pack(col: pd.Series) -> pd.Series:
        return col.map(lambda doc: [pack_sentences(page, most, flush) for page in doc] if doc is not None else None)

    # Not deterministic by name, so that no filter on its result repeats it below
    return pack.asNondeterministic()(F.transform(pages, lambda p: F.transform(T.paragraphs(F.coalesce(p, F.lit("")), ascii_only), lambda x: T.sentences(x, ascii_only))))


def pages_by_size(text: Column, cfg: Settings = DEFAULT, ascii_only: bool = False) -> Column:
    """Pages of a free text: at form feeds if there are any, else by size at blank lines. ascii_only: see
    functions.text.mode; form feeds are white space like other."""
    ship()
    bounded_batches(rows=PACKED_ROWS)
    most, spaces = cfg.page_chars, "\t\n\f\r " if ascii_only else None

    @F.pandas_udf("array<string>")
    def pack(col: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([pack_paragraphs(p, most, w, spaces) for p, w in zip(col, whole, strict=True)], dtype=object)

    whole = F.coalesce(text, F.lit(""))
    packed = pack.asNondeterministic()(F.split(whole, T.mode(r"\n\s*\n", ascii_only)), whole)
    return packed if ascii_only else F.when(F.contains(whole, F.lit("\f")), F.split(whole, "\f")).otherwise(packed)
