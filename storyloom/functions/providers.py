"""Recognisers and models as plug-ins: a provider maps a batch of inputs to outputs, and a table of them is an Arrow UDF."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: kind -> name -> factory of a function from one input to one output.
REGISTRY: dict[str, dict[str, Callable[[], Callable]]] = {"ocr": {}, "vision": {}, "text": {}, "speech": {}}


def register(kind: str, name: str):
    def add(factory):
        REGISTRY[kind][name] = factory
        return factory

    return add


def create(kind: str, name: str) -> Callable:
    """A provider by name; raises ValueError with the known names."""
    if name not in REGISTRY[kind]:
        raise ValueError(f"no {kind} provider {name!r}; there are {sorted(REGISTRY[kind])}")
    return REGISTRY[kind][name]()


@register("ocr", "dummy")
def dummy_ocr() -> Callable:
    return lambda image: json.dumps([{"text": "DUMMY", "bbox": [0, 0, 10, 10], "confidence": 0.5, "type": "unknown"}])


@register("text", "mock")
def mock_text() -> Callable:
    return lambda prompt: json.dumps({"text": prompt.strip().splitlines()[0][:80] if prompt and prompt.strip() else ""})


@register("vision", "mock")
def mock_vision() -> Callable:
    return lambda image: json.dumps({"characters": [], "environment": "unknown", "actions": [], "objects": [], "confidence": 0.0})


def apply(rows: DataFrame, kind: str, names: list[str], column: str) -> DataFrame:
    """Adds answer, provider and error: the first provider of names that answers; a provider is made once a task, and an
    input that all of them fail keeps its last error instead of failing the job."""
    schema = rows.schema.simpleString()[len("struct<") : -1]
    made_of = {n: REGISTRY[kind][n] for n in names}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {n: f() for n, f in made_of.items()}
        for frame in frames:
            out = []
            for value in frame[column]:
                answer, used, error = None, None, None
                for n, provider in ready.items():
                    try:
                        answer, used, error = provider(value), n, None
                        break
                    except Exception as e:  # any provider may fail in its own way
                        error = f"{n}: {e}"
                out.append((answer, used, error))
            yield frame.assign(answer=[o[0] for o in out], provider=[o[1] for o in out], error=[o[2] for o in out])

    return rows.mapInPandas(run, f"{schema}, answer:string, provider:string, error:string")
