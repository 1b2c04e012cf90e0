"""Model boundaries: a noise scorer and a correction client, each given as a factory that runs on executors.

The defaults are fixed functions, so plans can be tested without any model.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

from .parse import _object, salvage

Scorer = Callable[[list[list[str]]], list[list[float]]]
Client = Callable[[str], str]


def fixed_scorer() -> Scorer:
    return lambda sentences: [[((len(t) * 7 + i * 13) % 10) / 10.0 for i, t in enumerate(s)] for s in sentences]


def noise_scores(sentences: DataFrame, scorer: Callable[[], Scorer] = fixed_scorer, batch: int = 16, most: int = 512) -> DataFrame:
    """``row_id, tok_idx, p``: a probability a token; tokens beyond ``most`` score 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for frame in frames:
            rows = []
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = [list(r) for r in part.raw]
                for key, text, p in zip(part.row_id, texts, score([t[:most] for t in texts]), strict=True):
                    rows += [(key, i, float(p[i]) if i < len(p) else 0.0) for i in range(len(text))]
            yield pd.DataFrame(rows, columns=["row_id", "tok_idx", "p"])

    return sentences.where("row_id is not null and raw is not null").select("row_id", "raw").mapInPandas(run, "row_id bigint, tok_idx int, p double")


def correct(prompts: DataFrame, client: Callable[[], Client], workers: int = 2, retries: int = 3, wait: float = 0.2) -> DataFrame:
    """Answers of ``row_id, tok_idx, token, prompt``: ``raw_response``, ``normalized`` (null unless a string) and ``error``.

    The wait before another try doubles each time. A call that keeps failing gives a row with its error, and such rows count as done when a run is resumed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()

        def one(prompt: str):
            error = None
            for k in range(max(1, retries)):
                if k:
                    time.sleep(wait * 2 ** (k - 1))
                try:
                    answer = ask(prompt)
                except Exception as e:  # noqa: BLE001  a client's failures are recorded with the row
                    error = f"{type(e).__name__}: {e}"
                    continue
                found = salvage(answer)
                value = (_object(found) or {}).get("normalized") if found else None
                return answer, value if isinstance(value, str) else None, None
            return None, None, error

        with ThreadPoolExecutor(workers) as threads:
            for frame in frames:
                answers = list(threads.map(one, frame.prompt))
                out = frame[["row_id", "tok_idx", "token"]].copy()
                out[["raw_response", "normalized", "error"]] = pd.DataFrame(answers, index=out.index, columns=["raw_response", "normalized", "error"])
                yield out

    schema = "row_id bigint, tok_idx int, token string, raw_response string, normalized string, error string"
    return prompts.select("row_id", "tok_idx", "token", "prompt").mapInPandas(run, schema)
