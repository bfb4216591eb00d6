"""Fetching records by id through an injected client, with retries and a limit on the rate."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Answers worth another try.
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})


class FetchError(Exception):
    """A failed call; ``status`` is None where there was no answer."""

    def __init__(self, status: int | None, message: str = "") -> None:
        super().__init__(message or f"status {status}")
        self.status = status


def retryable(status: int | None) -> bool:
    return status is None or status in RETRYABLE


def spacing(per_minute: int, headroom: float = 0.9) -> float:
    """Seconds between calls."""
    return 60 / max(1, int(per_minute * headroom))


def fetch_one(client: Callable[[str], object], key: str, attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> dict:
    for n in range(attempts):
        try:
            value = client(key)
        except FetchError as e:
            if not retryable(e.status) or n == attempts - 1:
                raise
            wait(min(60.0, 2.0**n))
            continue
        if not isinstance(value, dict):
            raise FetchError(200, "the answer is no object")
        return value
    raise FetchError(None, "no attempts")


def fetch(ids: DataFrame, key: str, make_client: Callable[[], Callable[[str], object]], per_minute: int, partitions: int) -> DataFrame:
    """(key, fetched_at, response, error) of each id; the rate is shared by the partitions that run at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, pause, last = make_client(), spacing(per_minute) * partitions, 0.0
        for b in batches:
            out = []
            for k in b[key]:
                time.sleep(max(0.0, last + pause - time.monotonic()))
                last = time.monotonic()
                now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
                try:
                    out.append((k, now, json.dumps(fetch_one(client, k), ensure_ascii=False), None))
                except FetchError as e:
                    out.append((k, now, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "fetched_at", "response", "error"])

    return ids.select(key).repartition(partitions).mapInPandas(run, f"{key} string, fetched_at string, response string, error string")
