"""Model calls as rows: a client that anyone can plug in, with errors as results and a deterministic stub."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.functions.text import json_candidates


class ModelClient(Protocol):
    """A model: a prompt in, an answer out. It must be picklable and is made anew in each task by a factory."""

    def complete(self, prompt: str) -> str: ...


class StubClient:
    """Answers that depend on the prompt alone, for tests and for runs without a network."""

    def complete(self, prompt: str) -> str:
        h = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        return json.dumps({"label": ["yes", "no"][h % 2], "score": round(h / 0xFFFFFFFF, 6)})


def complete(df: DataFrame, key: str, prompt: str, factory: Callable[[], ModelClient] = StubClient, tries: int = 3) -> DataFrame:
    """(key, answer, error): an answer for each prompt, or the last error after some tries; a null prompt has neither.

    Write the result before it is used twice: a plan that is computed again asks again.
    """
    kind = df.schema[key].dataType.simpleString()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for f in frames:
            out = []
            for k, p in zip(f[key], f[prompt], strict=True):
                answer, error = None, None
                for _ in range(tries if p is not None else 0):
                    try:
                        answer, error = client.complete(p), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:300]
                out.append((k, answer, error))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return df.select(key, prompt).mapInPandas(ask, f"`{key}` {kind}, answer string, error string")


def complete_json(df: DataFrame, key: str, prompt: str, schema: str, factory: Callable[[], ModelClient] = StubClient) -> DataFrame:
    """(key, value, error): the answer's JSON by schema; an answer without JSON is an error."""
    a = complete(df, key, prompt, factory).withColumn("json", json_candidates(F.col("answer")))
    error = F.coalesce("error", F.when(F.col("answer").isNotNull() & F.col("json").isNull(), "no JSON in the answer"))
    return a.select(key, F.from_json("json", schema).alias("value"), error.alias("error"))


def screen(df: DataFrame, key: str, prompt: str, factory: Callable[[], ModelClient] = StubClient) -> DataFrame:
    """df without the rows that the model says no to; a failed call keeps its row."""
    said = complete_json(df, key, prompt, "label string", factory).filter(F.lower("value.label") == "no").select(key)
    return df.join(said, key, "left_anti")


def cached(df: DataFrame, cache: DataFrame, key: str, prompt: str, factory: Callable[[], ModelClient] = StubClient) -> DataFrame:
    """(key, answer): from the cache by the prompt's hash, else from the model. cache: prompt_md5, answer."""
    want = df.select(key, prompt, F.md5(prompt).alias("prompt_md5"))
    known = want.join(cache.groupBy("prompt_md5").agg(F.max("answer").alias("answer")), "prompt_md5", "left")
    asked = complete(known.filter("answer is null"), key, prompt, factory)
    return known.filter("answer is not null").select(key, "answer").unionByName(asked.select(key, "answer"))


def validated(ask: Callable[[str], str], check: Callable[[str], str | None], prompt: str, steps: int = 4) -> tuple[str, str | None]:
    """An answer asked for again with its faults until check finds none or steps are over; with the last faults."""
    answer, faults = "", None
    for _ in range(steps):
        answer = ask(prompt if faults is None else f"{prompt}\n\nThe last answer had faults: {faults}")
        faults = check(answer)
        if faults is None:
            break
    return answer, faults
