"""The boundary to external models: a function over batches of texts, with a default that needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A model takes a list of prompts and gives an answer, or null, for each.
Model = Callable[[list[str]], list[str | None]]


def answers(df: DataFrame, prompt: str, out: str, model: Model | None, fallback: Column, batch: int = 64) -> DataFrame:
    """Adds the model's answer to each prompt as ``out``; where there is none, ``fallback``.

    The model runs on the executors in batches; an error in it gives null for its batch, never a failed task.
    """
    if model is None:
        return df.withColumn(out, fallback)

    @F.pandas_udf(StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got: list[str | None] = []
            for i in range(0, len(s), batch):
                part = [x or "" for x in s.iloc[i : i + batch]]
                try:
                    got += model(part)
                except Exception:
                    got += [None] * len(part)
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, F.coalesce(ask(F.col(prompt)), fallback))


def any_error(_: Exception) -> bool:
    """After every error the next model is asked."""
    return True


def model_is_gone(error: Exception) -> bool:
    """Only after an error that says that the model isn't there (any longer) is the next one asked."""
    said = str(error).lower()
    return any(x in said for x in ("404", "not found", "no longer available"))


def usable_key(key: str | None) -> bool:
    """Whether a key can be one: ten characters or more and no placeholder."""
    key = (key or "").strip()
    return len(key) >= 10 and not key.startswith("YOUR_")


def _one_by_one(model: Model, prompts: list[str]) -> list[tuple[str | None, Exception | None]]:
    """Answers and errors of a batch; where the batch fails, of each prompt by itself, so that one cannot spoil the others."""
    try:
        got = model(prompts)
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return [(a, None) for a in got]
    except Exception as error:
        return [(None, error)] if len(prompts) == 1 else [x for p in prompts for x in _one_by_one(model, [p])]


def ask_in_turn(models: list[tuple[str, Model]], prompts: list[str | None], least: int, go_on: Callable[[Exception], bool]) -> list[tuple[str | None, str | None, str | None]]:
    """(answer, model, error) of each prompt: of the first model whose answer has at least ``least`` characters."""
    out: list[tuple[str | None, str | None, str | None]] = [(None, None, None)] * len(prompts)
    open_ = list(range(len(prompts)))
    for name, model in models:
        if not open_:
            break
        left = []
        for i, (answer, error) in zip(open_, _one_by_one(model, [prompts[i] or "" for i in open_]), strict=True):
            if error is None and answer is not None and len(answer.strip()) >= max(least, 1):
                out[i] = (answer, name, None)
                continue
            out[i] = (None, None, f"{name}: {error}" if error is not None else f"{name}: no answer")
            if error is None or go_on(error):
                left.append(i)
        open_ = left
    return out


def cascade(
    df: DataFrame,
    prompt: str,
    out: str,
    models: list[tuple[str, Model]],
    fallback: Column,
    fallback_name: str = "heuristic",
    least: int = 1,
    go_on: Callable[[Exception], bool] = any_error,
    batch: int = 64,
) -> DataFrame:
    """Adds the answer of the first model that gives one as ``out``, with ``<out>_model`` and ``<out>_error``.

    ``models`` are asked in turn, each only for the prompts still without an answer of ``least`` characters;
    after an error for which ``go_on`` is false no further model is asked for that prompt. What no model
    answers gets ``fallback``, ``fallback_name`` and the last error. Runs on the executors in batches; a
    model's error never fails a task, nor the other prompts of its batch.
    """

    @F.pandas_udf("answer string, model string, error string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [x for i in range(0, len(s), batch) for x in ask_in_turn(models, s.iloc[i : i + batch].tolist(), least, go_on)]
            yield pd.DataFrame(rows, columns=["answer", "model", "error"], dtype=object)

    asked = df.withColumn("__a", ask(F.col(prompt)) if models else F.lit(None).cast("struct<answer:string,model:string,error:string>"))
    return asked.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (out, f"{out}_model", f"{out}_error")],
        F.coalesce("__a.answer", fallback).alias(out), F.coalesce("__a.model", F.lit(fallback_name)).alias(f"{out}_model"), F.col("__a.error").alias(f"{out}_error"),
    )
