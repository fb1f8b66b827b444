"""Runs a model over a column of a table.

Only the input column travels to Python; all other columns stay in the JVM and keep their row. The
model is built once per task and called in small batches.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.responses import is_json
from tessera.inference.models import ModelFactory

ERROR_MARK = "ERROR"
#: Answers that a worker hands on at once, about.
PIECE_ROWS = 256


def _attempt(call, texts: list, retries: int, backoff: float) -> tuple[list | None, str | None, int]:
    """(answers, error, attempts) for one call with retries and growing pauses."""
    for attempt in range(1, retries + 2):
        try:
            answers = call(texts)
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers for {len(texts)} inputs")
            return answers, None, attempt
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {e}"
            if attempt <= retries and backoff:
                time.sleep(backoff * 2 ** (attempt - 1))
    return None, message, retries + 1


def _run_batch(call, texts: list, retries: int, backoff: float) -> list[tuple]:
    """(response, error, latency_s, attempts) per text. A failing batch is run again row by row."""
    start = time.perf_counter()
    answers, _, attempts = _attempt(call, texts, retries if len(texts) == 1 else 0, backoff)
    if answers is not None:
        each = (time.perf_counter() - start) / len(texts)
        return [(a, None, each, attempts) for a in answers]
    rows = []
    for text in texts:
        start = time.perf_counter()
        answer, error, tried = _attempt(call, [text], retries, backoff)
        rows.append((answer[0] if answer else None, error, time.perf_counter() - start, tried))
    return rows


def model_call(text: Column, model: ModelFactory, returns: str = "string", batch: int = 50, retries: int = 0,
               backoff: float = 0.0) -> Column:
    """Struct (response, error, latency_s, attempts); null input gives null output without a call."""

    @F.pandas_udf(f"response {returns}, error string, latency_s double, attempts int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = model()
        for series in batches:
            # answers go on in pieces, so a worker never holds those of a whole Arrow batch
            rows: list[tuple] = []
            chosen: list[int] = []
            texts: list = []
            done = 0
            for i, value in enumerate(series):
                if value is not None:
                    chosen.append(i)
                    texts.append(value)
                if len(chosen) < batch and i + 1 < len(series):
                    continue
                rows += [(None, None, 0.0, 0)] * (i + 1 - done)
                if chosen:
                    start = len(rows) - (i + 1 - done)
                    for j, row in zip(chosen, _run_batch(call, texts, retries, backoff)):
                        rows[start + j - done] = row
                done, chosen, texts = i + 1, [], []
                if len(rows) >= PIECE_ROWS or done == len(series):
                    yield pd.DataFrame(rows, columns=["response", "error", "latency_s", "attempts"])
                    rows = []
            if not len(series):
                yield pd.DataFrame(rows, columns=["response", "error", "latency_s", "attempts"])

    # Not deterministic for the planner: a model must be called once per row, whatever reads the result.
    return run.asNondeterministic()(text)


def ai_query(df: DataFrame, text: str, model: ModelFactory, out: str = "response", returns: str = "string",
             ddl: str | None = None, on_error: str = "raise", timed: bool = False, attempts: bool = False,
             slots: int | None = None, batch: int = 50, retries: int = 0, backoff: float = 0.0) -> DataFrame:
    """``df`` with the model's answer to column ``text``.

    on_error  raise: the job fails; column: null answer and an ``error`` column; mark: answer "ERROR"
    ddl       answers are JSON text and come back as a struct of this schema
    slots     number of tasks that may call the model at the same time
    """
    rows = df.repartition(slots) if slots else df
    called = rows.withColumn("_call", model_call(F.col(text), model, returns, batch, retries, backoff))
    answer: Column = F.col("_call.response")
    failed = F.col("_call.error").isNotNull()
    if on_error == "raise":
        answer = F.when(failed, F.raise_error(F.col("_call.error")).cast(returns)).otherwise(answer)
    elif on_error == "mark":
        answer = F.when(failed, F.lit(ERROR_MARK)).otherwise(answer)
    elif on_error != "column":
        raise ValueError(f"unknown on_error {on_error}")
    if ddl:
        answer = F.when(is_json(answer), F.from_json(answer, ddl))
    made = [answer.alias(out)]
    if on_error == "column":
        made.append(F.col("_call.error").alias("error"))
    if timed:
        made.append(F.col("_call.latency_s").alias("latency_s"))
    if attempts:
        made.append(F.col("_call.attempts").alias("attempts"))
    return called.select(*[F.col(f"`{c}`") for c in df.columns if c != out], *made)


def infer_chain(df: DataFrame, text: str, steps: list[tuple[str, ModelFactory, str | None]]) -> DataFrame:
    """Model after model; each step (out, model, template) reads the answer of the one before.

    A template wraps the previous answer, which it names ``{answer}``. All steps run in one stage.
    """
    source = text
    for out, model, template in steps:
        if template:
            head, _, tail = template.partition("{answer}")
            df = df.withColumn("_prompt", F.concat(F.lit(head), F.col(source), F.lit(tail)))
            df = ai_query(df, "_prompt", model, out).drop("_prompt")
        else:
            df = ai_query(df, source, model, out)
        source = out
    return df


def model_sweep(df: DataFrame, text: str, models: dict[str, ModelFactory], batch: int = 50) -> DataFrame:
    """Every row through every model: one scan, one output row per (row, model_id)."""
    calls = reduce(lambda d, m: d.withColumn(f"_m_{m}", model_call(F.col(text), models[m], batch=batch)), models, df)
    pairs = F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"_m_{m}.response").alias("response"),
                               F.col(f"_m_{m}.error").alias("error")) for m in models])
    return calls.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(pairs).alias("_r")).select(
        *[F.col(f"`{c}`") for c in df.columns], "_r.*")


def run_throughput(timed: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Rows, seconds spent in the model, errors and rates over a timed run."""
    wanted = [F.count(F.lit(1)).alias("rows"), F.sum("latency_s").alias("seconds")]
    if "error" in timed.columns:
        wanted.append(F.count("error").alias("errors"))
    if tokens is not None:
        wanted.append(F.sum(tokens).alias("tokens"))
    out = timed.agg(*wanted).withColumn("rows_per_s", F.try_divide(F.col("rows"), F.col("seconds")))
    return out.withColumn("tokens_per_s", F.try_divide(F.col("tokens"), F.col("seconds"))) if tokens is not None else out
