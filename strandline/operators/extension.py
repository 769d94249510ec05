"""Extension points: named transforms, readers and the boundary of external calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Names to functions; a name is given once."""

    kind: str
    found: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str):
        def add(f):
            if name in self.found:
                raise ValueError(f"{self.kind} {name} is registered already")
            self.found[name] = f
            return f

        return add

    def get(self, name: str) -> Callable:
        if name not in self.found:
            raise KeyError(f"no {self.kind} {name}; there are {sorted(self.found)}")
        return self.found[name]


@dataclass(frozen=True)
class Invertible:
    """A transform with its inverse."""

    apply: Transform
    undo: Transform


def pipeline(registry: Registry, names: list[str]) -> Transform:
    steps = [registry.get(n) for n in names]

    def run(df):
        for step in steps:
            df = df.transform(step)
        return df

    return run


def external_calls(df: DataFrame, ident: str, text: str, call: Callable[[str], str] | None = None, retries: int = 2) -> DataFrame:
    """(ident, answer, tries, error): ``call`` for each row of Arrow batches, tried again after an error.

    Without a call the mock answers with the text's length, so plans run without a provider.
    """
    ask = call or (lambda x: f"mock:{len(x)}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, value in zip(frame[ident], frame[text]):
                answer, error = None, None
                for tries in range(1, retries + 2):
                    try:
                        answer, error = ask(value or ""), None
                        break
                    except Exception as e:  # noqa: BLE001 - the provider's errors are data here
                        error = type(e).__name__
                rows.append((key, answer, tries, error))
            yield pd.DataFrame(rows, columns=[ident, "answer", "tries", "error"])

    return df.select(ident, text).mapInPandas(run, f"{ident} {dict(df.dtypes)[ident]}, answer string, tries int, error string")
