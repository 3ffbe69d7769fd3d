"""Fetching pages and answers by a function that the caller gives: statuses, retries, spacing by domain.

There is no network code here: `get` is any picklable function url -> (http status, body), and tests and
offline runs use a table of pages.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelab.functions import html, urls

SCHEMA = "url string, fetch_status string, http_status_code long, body string, attempts long"


def backoff(attempt: int, base: float = 2.0, cap: float = 30.0, floor: float = 0.0) -> float:
    """Seconds to wait after a failed attempt, without jitter."""
    return max(min(base**attempt, cap), floor)


def call_with_retry(get: Callable, url: str, attempts: int = 4, jitter: float = 0.5, sleep: Callable = time.sleep, base: float = 2.0) -> tuple[str, int | None, str | None, int]:
    """(status, http code, body, attempts). Statuses: ok, http_N, empty_response, timeout, connection_error, or the error's name."""
    status, code, body = "never_tried", None, None
    for attempt in range(1, attempts + 1):
        try:
            code, body = get(url)
            if code is None or 200 <= code < 300:
                return ("ok" if body and body.strip() else "empty_response"), code, body, attempt
            status = f"http_{code}"
            if code not in (408, 425, 429) and code < 500:
                return status, code, body, attempt
        except TimeoutError:
            status = "timeout"
        except ConnectionError:
            status = "connection_error"
        except Exception as e:
            return type(e).__name__, None, None, attempt
        if attempt < attempts:
            sleep(backoff(attempt, base) + random.uniform(0, jitter))
    return status, code, body, attempts


def fetch(wanted: DataFrame, get: Callable, spacing: float = 0.1, sleep: Callable = time.sleep, threads: int = 10) -> DataFrame:
    """Sources of the distinct URLs in `wanted` (url). URLs of one host are asked one after the other, with a pause
    between them; hosts are spread over the partitions, and within one over threads, since calls mostly wait."""
    each = wanted.select("url").where("url is not null").distinct().withColumn("host", urls.domain_of(F.col("url")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}

        def ask(of_host: tuple) -> list[tuple]:
            host, wanted = of_host
            rows = []
            for url in wanted:
                wait = last.get(host, 0) + spacing - time.monotonic()
                if wait > 0:
                    sleep(wait)
                rows.append((url, *call_with_retry(get, url, sleep=sleep)))
                last[host] = time.monotonic()
            return rows

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                hosts = frame["url"].groupby(frame["host"].fillna(""), sort=False).apply(list)
                rows = [r for part in pool.map(ask, hosts.items()) for r in part]
                out = pd.DataFrame(rows, columns=["url", "fetch_status", "http_status_code", "body", "attempts"])
                out["http_status_code"] = out["http_status_code"].astype("Int64")
                yield out

    got = each.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, SCHEMA)
    ok = F.col("fetch_status") == "ok"
    return got.select(urls.canonical(F.col("url")).alias("url_canonical"), urls.domain_of(F.col("url")).alias("domain"), "fetch_status", "http_status_code", F.when(ok, html.to_text(F.col("body"))).otherwise("").alias("cleaned_text"), F.when(ok, html.title(F.col("body"))).alias("title_from_html"), F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("content_length"), "attempts")


def from_pages(pages: DataFrame) -> DataFrame:
    """The same table from pages that were stored before (url, html)."""
    ok = F.coalesce(F.trim("html"), F.lit("")) != ""
    return pages.select(urls.canonical(F.col("url")).alias("url_canonical"), urls.domain_of(F.col("url")).alias("domain"), F.when(ok, "ok").otherwise("empty_response").alias("fetch_status"), html.to_text(F.col("html")).alias("cleaned_text"), html.title(F.col("html")).alias("title_from_html"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("content_length"))
