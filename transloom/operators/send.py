"""Send chat-completion requests and land their replies as a table.

The payload table (``operators.reply.llm_payload``) goes through ``send`` inside the executors,
several requests of a task at a time; what comes back is landed raw and decoded by the
Spark plan in ``operators.reply``. A request that fails on the way (no connection, no answer
in time) lands without a status. There is no network here: ``send`` is injected, and tests
use a fake.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom import constants as K
from transloom.session import materialize, ship_package, stored

REPLIES = "request_id string, attempt bigint, http_status int, content_type string, body string"
Send = Callable[..., tuple[int, str, str]]  # (endpoint, payload, seconds[, headers]) -> (status, type, body)
#: Answers that another attempt may better; no answer is one of them.
RETRY = (429, 500, 502, 503, 504)


def headers(key: str | None) -> dict[str, str]:
    """What a request carries; the key only if there is one."""
    return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key.strip()}"} if key and key.strip() else {})


def _lander(send: Send, attempt: int, at_once: int, timeout_s: float, key_env: str | None):
    def land(endpoint: str, payload: str) -> tuple:
        try:
            if key_env is None:
                return send(endpoint, payload, timeout_s)
            return send(endpoint, payload, timeout_s, headers(os.environ.get(key_env)))
        except Exception as exc:  # the row tells; the others carry on
            return None, type(exc).__name__, str(exc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                landed = list(pool.map(land, pdf["endpoint"], pdf["payload"]))
                yield pd.DataFrame({"request_id": pdf["request_id"], "attempt": attempt,
                                    "http_status": pd.array([r[0] for r in landed], dtype="Int32"),
                                    "content_type": [r[1] for r in landed], "body": [r[2] for r in landed]})
    return run


def send_requests(payloads: DataFrame, send: Send, attempt: int = 0, at_once: int = 8,
                  timeout_s: float = K.LLM_TIMEOUT_S, key_env: str | None = None) -> DataFrame:
    """One landed reply per payload row, written once to the checkpoint folder: a retried stage
    re-reads it and does not send again. ``key_env`` names the executors' environment variable that holds the key; ``send``
    then gets the headers as well. The key is in no table and no plan."""
    ship_package(payloads.sparkSession)
    return materialize(payloads.mapInPandas(_lander(send, attempt, at_once, timeout_s, key_env), REPLIES))


def send_in_waves(payloads: DataFrame, send: Send, attempts: int = 3, retry: tuple = RETRY, **options) -> DataFrame:
    """All landed replies of up to ``attempts`` waves. A wave sends the requests without a reply that settles them: those
    whose id no earlier wave landed with a status outside ``retry``. ``operators.reply`` reads each request's last attempt."""
    pending, landed = stored(payloads, "payloads"), None
    for attempt in range(attempts):
        wave = send_requests(pending, send, attempt, **options)
        landed = wave if landed is None else landed.unionByName(wave)
        settled = wave.where(F.col("http_status").isNotNull() & ~F.col("http_status").isin(*retry)).select("request_id").distinct()
        pending = pending.join(settled, "request_id", "left_anti")
        if attempt + 1 < attempts and pending.isEmpty():
            break
    return landed
