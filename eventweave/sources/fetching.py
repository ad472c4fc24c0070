"""Requests to services and hosts as a distributed read: each distinct request once, a rate for each host, retries, and a row for every answer or failure."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCHED = "reference string, body string, host string, content binary, mime string, status int, tries int, error string"


class Answer(NamedTuple):
    status: int
    content: bytes
    mime: str | None


Request = Callable[[str, str | None], Answer]


def http(url: str, body: str | None, timeout: float = 30.0) -> Answer:
    """GET, or POST of a JSON body; an answer with an error status is an answer."""
    sent = urllib.request.Request(url, None if body is None else body.encode(), {"Content-Type": "application/json"} if body is not None else {})
    try:
        with urllib.request.urlopen(sent, timeout=timeout) as got:
            return Answer(got.status, got.read(), got.headers.get_content_type())
    except urllib.error.HTTPError as e:
        return Answer(e.code, e.read(), None)


def host_of(url: Column) -> Column:
    """The host and port of a URL in lower case; empty for other references."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def again(status: int) -> bool:
    """Whether a status may be another at the next try: too many requests, or a fault of the server."""
    return status in (408, 425, 429) or status >= 500


def fetch(rows: DataFrame, reference: str, body: str | None = None, request: Request = http, tries: int = 3, wait: float = 0.5, per_second: float = 10.0, lanes: int = 4) -> DataFrame:
    """(reference, body, host, content, mime, status, tries, error) of each distinct request of rows: an answer, or the error that the last try ended with.

    Null and blank references ask nothing. A host's requests are dealt into ``lanes``, each in one task with its share of ``per_second``, so that a host never gets more than that, whatever
    the number of tasks, and a host with most of the requests keeps as many tasks busy. Failures and statuses that may pass are tried again after a wait that doubles;
    other statuses from 400 on are errors at once. A task that is lost asks anew for its lanes, so requests should bear repeating. The result is lazy: store it before it is read twice."""
    url = F.trim(F.col(reference).cast("string"))
    asked = rows.select(url.alias("reference"), (F.lit(None) if body is None else F.col(body)).cast("string").alias("body")).where("reference != ''").distinct()
    named = asked.withColumns({"host": host_of(F.col("reference")), "lane": F.pmod(F.xxhash64("reference", "body"), F.lit(lanes)).cast("int")})
    gap = lanes / per_second

    def one(url: str, sent: str | None) -> tuple:
        error, answer = None, None
        for turn in range(1, tries + 1):
            try:
                answer, error = request(url, sent), None
                if not again(answer.status):
                    break
                error = f"status {answer.status}"
            except Exception as failed:  # whatever a service does, its row says so
                answer, error = None, f"{type(failed).__name__}: {failed}"
            if turn < tries:
                time.sleep(wait * 2 ** (turn - 1))
        if answer is None:
            return None, None, None, turn, error
        if answer.status >= 400:
            return None, None, answer.status, turn, error or f"status {answer.status}"
        return answer.content, answer.mime, answer.status, turn, None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due: dict[tuple[str, int], float] = {}
        for batch in batches:
            for at in range(0, len(batch), 16):
                out = []
                for r in batch.iloc[at : at + 16].itertuples(index=False):
                    sent, lane = None if pd.isna(r.body) else r.body, (r.host, r.lane)
                    time.sleep(max(0.0, due.get(lane, 0.0) - time.monotonic()))
                    due[lane] = time.monotonic() + gap
                    out.append((r.reference, sent, r.host, *one(r.reference, sent)))
                made = pd.DataFrame(out, columns=[x.split()[0] for x in FETCHED.split(", ")])
                yield made.astype({"status": "Int32", "tries": "Int32"})

    return named.repartition("host", "lane").mapInPandas(work, FETCHED)
