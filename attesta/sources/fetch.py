"""Web pages fetched by tasks: a host's pages by one task, so that its rate holds; retries; failures as rows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..shipping import ship

#: Replies after which another try may help; other errors of a server are final.
PASSING = {408, 425, 429, 500, 502, 503, 504}


def get(url: str, timeout: float) -> str:
    """A page's text in the encoding that its header names, else UTF-8."""
    with urlopen(Request(url, headers={"User-Agent": "attesta/0.1"}), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def attempt(url: str, cfg: Settings, wait=time.sleep) -> tuple[str | None, str | None]:
    """(text, None) or (None, what went wrong last); waits twice as long before each further try."""
    error = None
    for n in range(cfg.fetch_tries):
        if n:
            wait(cfg.fetch_pause * 2 ** (n - 1))
        try:
            return get(url, cfg.fetch_timeout), None
        except HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code not in PASSING:
                break
        except (OSError, ValueError, LookupError) as e:  # unreachable, timed out, malformed, unknown encoding
            error = f"{type(e).__name__}: {e}"
    return None, error


def fetched(urls: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """source_ord, url, html, error of a table (source_ord, url). A null URL is an error row.

    The pages of a host are in one task, which waits ``1 / fetch_per_second`` seconds after each reply, however many there are:
    what a host may be asked bounds that task, not Spark. A task that is lost fetches its pages again.
    """
    ship(urls.sparkSession)

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str | None, float] = (None, 0.0)
        for part in parts:
            for at, url, host in zip(part["source_ord"], part["url"], part["host"], strict=True):
                if host == last[0]:
                    time.sleep(max(0.0, last[1] + 1 / cfg.fetch_per_second - time.monotonic()))
                html, error = attempt(url, cfg) if url is not None else (None, "no URL")
                last = (host, time.monotonic())
                yield pd.DataFrame({"source_ord": [at], "url": [url], "html": [html], "error": [error]})

    host = F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit(""))
    dealt = urls.select(F.col("source_ord").cast("long").alias("source_ord"), "url", host.alias("host")).repartition("host").sortWithinPartitions("host", "source_ord")
    return dealt.mapInPandas(pages, "source_ord long, url string, html string, error string")
