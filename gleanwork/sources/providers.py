"""External functions: what a classifier, an auditor or a fetcher has to offer, and retries.

Providers run on executors inside mapInPandas; a task that runs again calls them
again, so their answers are written before anything else reads them.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


class NoVisionError(RuntimeError):
    """The model takes no images: the next model of the chain is asked."""


class SchemaError(RuntimeError):
    """The model takes no response schema: it is asked without one."""


class Classifier(Protocol):
    def __call__(self, content: bytes, model: str, with_schema: bool) -> str: ...


class Auditor(Protocol):
    def __call__(self, content: bytes, mime: str | None) -> dict: ...


#: Audits that run at a time, at most.
AUDITS = 4


def backoff(attempt: int, limited: bool = False, rng: random.Random | None = None) -> float:
    """Seconds before the next attempt: 2**attempt and up to one more; rate limits add one to two."""
    r = rng or random
    return 2**attempt + r.uniform(0, 1) + (r.uniform(1, 2) if limited else 0)


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 3
    final: tuple[int, ...] = (403, 404)
    waits: tuple[int, ...] = (429, 502, 503, 504)

    def wait(self, status: int, attempt: int, retry_after: float | None = None) -> float | None:
        """Seconds to wait, or None to give up."""
        if status in self.final or attempt + 1 >= self.attempts:
            return None
        return retry_after if status in self.waits and retry_after is not None else backoff(attempt, status == 429)


def ask(classifier: Classifier, content: bytes, models: tuple[str, ...], retries: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, str | None]:
    """(response, model, error). A try without schema counts as an attempt but doesn't wait."""
    models, with_schema, error = list(models), True, None
    for attempt in range(retries + 1):
        try:
            return classifier(content, models[0], with_schema), models[0], None
        except NoVisionError as e:
            error = str(e)
            if len(models) > 1:
                models.pop(0)
        except SchemaError as e:
            with_schema, error = False, str(e)
        except Exception as e:  # a provider's failure is a row, not a failed task
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(backoff(attempt))
    return None, models[0], error


def classify(payloads: DataFrame, classifier: Classifier, models: tuple[str, ...], retries: int = 2, concurrency: int = 3) -> DataFrame:
    """(sha256, response, model_name, error), one call for each distinct payload, written once."""
    once = payloads.groupBy("sha256").agg(F.first("content").alias("content"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = list(models)  # a model that takes no images isn't asked again by this task

        def one(content) -> tuple[str | None, str | None, str | None]:
            answer = ask(classifier, bytes(content), tuple(chain), retries)
            while answer[1] in chain[1:]:
                chain.pop(0)
            return answer

        with ThreadPoolExecutor(concurrency) as pool:
            for part in parts:
                answers = list(pool.map(one, part["content"]))
                yield pd.DataFrame([(s, *a) for s, a in zip(part["sha256"], answers, strict=True)], columns=["sha256", "response", "model_name", "error"])

    return cut(once.mapInPandas(run, "sha256 string, response string, model_name string, error string"))


def audit_one(auditor: Auditor, content: bytes, mime: str | None, retries: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The auditor's verdict {quality, is_gray, reason}; of a failure the quality `error` and the reason. Waits 2**attempt and a tenth of the attempt."""
    for attempt in range(retries + 1):
        try:
            return auditor(content, mime)
        except Exception as e:
            if attempt == retries:
                return {"quality": "error", "is_gray": None, "reason": str(e)}
            sleep(2**attempt + 0.1 * attempt)
    raise AssertionError("retries is negative")


def audit(files: DataFrame, auditor: Auditor, retries: int = 2, concurrency: int = 3) -> DataFrame:
    """(filepath, llm) of (filepath, content), written once, for audit.with_auditor()."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, min(concurrency, AUDITS))) as pool:
            for part in parts:
                said = list(pool.map(lambda c: audit_one(auditor, bytes(c), None, retries), part["content"]))
                gray = [x.get("is_gray") if isinstance(x.get("is_gray"), bool) else None for x in said]
                yield pd.DataFrame({"filepath": part["filepath"], "quality": [x.get("quality") for x in said], "is_gray": pd.Series(gray, dtype=object), "reason": [x.get("reason") for x in said]})

    told = files.select("filepath", "content").mapInPandas(run, "filepath string, quality string, is_gray boolean, reason string")
    return cut(told.select("filepath", F.struct("quality", "is_gray", "reason").alias("llm")))


def working_model(probe: Callable[[str], None], primary: str, fallback: str) -> str:
    """The fallback if the primary takes no images; any other failure leaves the primary."""
    try:
        probe(primary)
    except NoVisionError:
        return fallback
    except Exception:
        return primary
    return primary


def block_hosts(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """urls without those of listed hosts (host)."""
    from ..functions.url import url_host

    return urls.withColumn("host", F.lower(url_host(F.col("url")))).join(hosts.select(F.lower("host").alias("host")), "host", "left_anti").drop("host")
