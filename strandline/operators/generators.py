"""Generators as table functions: an episode goes in, samples come out, and the schema is known when a query is analysed."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

#: Decoders of values by name: (type that they give for a type, function).
DECODERS: dict[str, tuple[Callable[[T.DataType], T.DataType], Callable]] = {
    "none": (lambda t: t, lambda v: v),
    "scaled": (lambda t: T.DoubleType(), lambda v: None if v is None else float(v) / 100),
    "words": (lambda t: T.ArrayType(T.StringType()), lambda v: None if v is None else v.split()),
}


class IterEpisode:
    """Samples of each episode: a step's own value, those before it and those after it.

    ``iter_episode(TABLE(t), key, order, value, past, future, decoder)``: the function partitions by the column ``key``
    and orders by ``order`` itself. A step gives (key, step, now, past, future): ``past`` repeats the first value and
    ``future`` the last one where the episode ends, ``step`` counts from 0. Types follow the columns of the table and the
    decoder. A task keeps past + future + 1 values of one episode at a time.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, past: AnalyzeArgument, future: AnalyzeArgument, decoder: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument of iter_episode is a table")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name, argument in (("key", key), ("order", order), ("value", value)):
            if argument.value not in kinds:
                raise ValueError(f"{name} of iter_episode is a column of the table: {sorted(kinds)}")
        for name, argument in (("past", past), ("future", future)):
            if not isinstance(argument.value, int) or argument.value < 0:
                raise ValueError(f"{name} of iter_episode is a number from 0")
        if decoder.value not in DECODERS:
            raise ValueError(f"decoders of iter_episode are {sorted(DECODERS)}")
        kind = DECODERS[decoder.value][0](kinds[value.value])
        schema = T.StructType().add(key.value, kinds[key.value]).add("step", T.LongType()).add("now", kind).add("past", T.ArrayType(kind)).add("future", T.ArrayType(kind))
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self):
        self.step, self.known, self.window = 0, deque(), None

    def eval(self, row: Row, key: str, order: str, value: str, past: int, future: int, decoder: str) -> Iterator[tuple]:
        if self.window is None:
            self.window, self.key, self.decode = (past, future), row[key], DECODERS[decoder][1]
        now = self.decode(row[value])
        if not self.known:
            self.known.extend([now] * past)
        self.known.append(now)
        if len(self.known) == past + 1 + future:
            yield self._sample()

    def _sample(self) -> tuple:
        past, _ = self.window
        values = list(self.known)
        out = self.key, self.step, values[past], values[:past], values[past + 1 :]
        self.step += 1
        self.known.popleft()
        return out

    def terminate(self) -> Iterator[tuple]:
        if self.window is None:
            return
        past, future = self.window
        last = self.known[-1] if self.known else None
        while len(self.known) > past:
            ends = past + 1 + future - len(self.known)
            self.known.extend([last] * ends)
            sample = self._sample()
            for _ in range(ends):
                self.known.pop()
            yield sample


def register(spark: SparkSession) -> None:
    """``iter_episode`` for SQL."""
    spark.udtf.register("iter_episode", udtf(IterEpisode))
