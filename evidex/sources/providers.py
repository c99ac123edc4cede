"""Calls of text models from executors: a provider protocol, replay, failures as rows, sweeps."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.arrow import batches
from evidex.functions.text import fill_template


@dataclass(frozen=True)
class Settings:
    """What a call is made with. The numbers are fixed values of the published runs."""

    model: str = ""
    temperature: float = 0.0
    top_p: float = 1.0
    seed: int = 42
    max_tokens: int = 1500


#: A provider takes (prompt, settings) and returns (text, tokens in, tokens out).
Provider = Callable[[str, Settings], tuple[str, int, int]]
FAILED = "[[CALL_FAILED]] "


def named_provider(name: str) -> Provider:
    """The provider that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def echo(prompt: str, settings: Settings) -> tuple[str, int, int]:
    """A provider without a model: the prompt comes back."""
    return prompt, len(prompt), len(prompt)


def collect_outputs(prompts: DataFrame, keys: Sequence[str], provider: Provider, settings: Settings = Settings(), temperature: str = "temperature", pause: float = 0.0) -> DataFrame:
    """keys, raw, tokens_in, tokens_out, seconds and error of each row's prompt.

    A column named by temperature overrides that of the settings. A failed call gives a row with the
    failure as its text and no tokens. pause throttles each task, the wait before a call included in
    no one's seconds; the number of partitions bounds the calls at a time.
    """
    own = F.col(temperature).cast("double") if temperature in prompts.columns else F.lit(None).cast("double")
    rows = prompts.select(*keys, "prompt", F.coalesce(own, F.lit(float(settings.temperature))).alias("_t"))
    n = len(keys)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            out = []
            for prompt, heat in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                if pause:
                    time.sleep(pause)
                began = time.time()
                try:
                    text, tin, tout = provider(prompt, replace(settings, temperature=heat))
                    error = None
                except Exception as e:
                    text, tin, tout, error = f"{FAILED}{e}", 0, 0, str(e)
                out.append((text, tin, tout, time.time() - began, error))
            raw, tin, tout, seconds, error = zip(*out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(raw, pa.string()), pa.array(tin, pa.int64()), pa.array(tout, pa.int64()), pa.array(seconds, pa.float64()), pa.array(error, pa.string())], [*keys, "raw", "tokens_in", "tokens_out", "seconds", "error"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{head}, raw string, tokens_in bigint, tokens_out bigint, seconds double, error string")


def call_times(outputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, calls, failed, seconds, tokens_in, tokens_out): means of the measured calls that didn't fail."""
    ok = F.col("error").isNull()
    means = [F.avg(F.when(ok, F.col(c))).alias(c) for c in ("seconds", "tokens_in", "tokens_out")]
    return outputs.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(~ok).alias("failed"), *means)


def prompts(samples: DataFrame, template: str, text: str = "input_text") -> DataFrame:
    """samples with prompt: the template filled with each text."""
    return samples.withColumn("prompt", fill_template(template, F.coalesce(F.col(text), F.lit(""))))


def sweep(samples: DataFrame, temperatures: Sequence[float], repeats: int) -> DataFrame:
    """samples with temperature, repeat and run (T<temperature>_r<repeat>): one row a sample and setting."""
    settings = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.lit(r).alias("repeat"), F.lit(f"T{t}_r{r}").alias("run")) for t in temperatures for r in range(1, repeats + 1)])
    return samples.select("*", F.explode(settings).alias("x")).select(*samples.columns, "x.*")


def replay(outputs: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored outputs of the samples instead of calls; a sample without one has a failed call."""
    joined = samples.select(*keys).join(outputs.select(*keys, "raw"), list(keys), "left")
    return joined.withColumn("raw", F.coalesce("raw", F.lit(FAILED + "no stored output")))
