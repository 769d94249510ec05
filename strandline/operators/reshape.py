"""Nested columns as trees: flatten, rebuild, rename by pattern, apply at paths, merge."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(schema: T.StructType, before: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all fields that are not structs."""
    out = []
    for f in schema.fields:
        path = (*before, f.name)
        out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
    return out


def _at(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """One column per leaf, named by its path."""
    return df.select(*[_at(p).alias(sep.join(p)) for p in leaves(df.schema)])


def build(paths: dict[tuple[str, ...], Column]) -> list[Column]:
    """Nested columns with the given leaves, in order of first appearance; a leaf may not also be a node."""
    heads: dict[str, dict | Column] = {}
    for path, column in paths.items():
        head, rest = path[0], path[1:]
        here = heads.get(head)
        if rest:
            if isinstance(here, Column):
                raise ValueError(f"{head} is both a leaf and a node")
            heads.setdefault(head, {})[rest] = column
        elif here is not None:
            raise ValueError(f"{head} is named twice or is both a leaf and a node")
        else:
            heads[head] = column
    return [(F.struct(*build(x)) if isinstance(x, dict) else x).alias(name) for name, x in heads.items()]


def unflatten(df: DataFrame, sep: str = "/") -> DataFrame:
    return df.select(*build({tuple(c.split(sep)): F.col(f"`{c}`") for c in df.columns}))


def repack(df: DataFrame, structure: dict[str, str], sep: str = "/") -> DataFrame:
    """New nested columns: target path -> source path."""
    return df.select(*build({tuple(to.split(sep)): _at(tuple(src.split(sep))) for to, src in structure.items()}))


def rename_paths(df: DataFrame, patterns: dict[str, str | None], sep: str = "/") -> DataFrame:
    """Rename leaves whose whole path matches; the first pattern wins, None deletes, two leaves on one path raise."""
    out: dict[tuple[str, ...], Column] = {}
    for path in leaves(df.schema):
        name = sep.join(path)
        for pattern, to in patterns.items():
            if re.fullmatch(pattern, name):
                name = None if to is None else re.sub(pattern, to, name)
                break
        if name is None:
            continue
        key = tuple(name.split(sep))
        if key in out:
            raise ValueError(f"two leaves become {name}")
        out[key] = _at(path)
    return df.select(*build(out))


def apply_at(df: DataFrame, paths: list[str], f: Callable[[Column], Column], strict: bool = True, sep: str = "/") -> DataFrame:
    """``f`` at the named leaves; unknown ones raise if ``strict``."""
    known = {sep.join(p): p for p in leaves(df.schema)}
    if strict and (missing := [p for p in paths if p not in known]):
        raise KeyError(f"no such leaves: {missing}")
    return df.select(*build({p: f(_at(p)) if name in paths else _at(p) for name, p in known.items()}))


def map_leaves(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.select(*build({p: f(_at(p)) for p in leaves(df.schema)}))


def merge_trees(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Deep merge of two struct columns; the right one wins."""
    paths = {p: (left, *p) for p in leaves(df.schema[left].dataType)}
    for p in leaves(df.schema[right].dataType):
        for q in [q for q in paths if q != p and (q[: len(p)] == p or p[: len(q)] == q)]:
            del paths[q]
        paths[p] = (right, *p)
    return df.withColumn(name, F.struct(*build({p: _at(full) for p, full in paths.items()})))


def only_features(columns: list[str], patterns: list[str], always: tuple[str, ...] = ("image",)) -> list[str]:
    """Columns that any pattern finds, and those that contain an ``always`` part."""
    return [c for c in columns if any(a in c for a in always) or any(re.search(p, c) for p in patterns)]


def common_columns(frames: list[DataFrame]) -> list[str]:
    return [c for c in frames[0].columns if all(c in f.columns for f in frames)]


def compose(inputs: list[Callable], outputs: list[Callable], more_inputs: list[Callable] = (), more_outputs: list[Callable] = ()):
    """(forward, backward): added input transforms come last, added output transforms first."""
    ins, outs = [*inputs, *more_inputs], [*more_outputs, *outputs]

    def run(steps):
        def f(df):
            for step in steps:
                df = df.transform(step)
            return df

        return f

    return run(ins), run(outs)


def keeping(keys: list[str], f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """``f`` over the other columns of each row, identity columns untouched: ``f`` sees them as one struct and may not
    change it."""

    def run(df):
        packed = df.select(F.struct(*keys).alias("_identity"), *[c for c in df.columns if c not in keys])
        out = f(packed)
        if "_identity" not in out.columns:
            raise ValueError("the transform dropped the identity columns")
        return out.select("_identity.*", *[c for c in out.columns if c != "_identity"])

    return run
