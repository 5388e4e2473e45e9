"""Analyses as graphs of stages: each stage makes one table, written once, and is run again only where its inputs changed.

A table is a list of segments.  A stage with a key (its rows of one key depend on the inputs' rows of that key alone) adds, on
an update, one segment with the rows of the touched keys and a table of those keys, which hides older rows; all other rows
stay where they are.  Other stages are run whole if a column that they read changed, by a digest that does not depend on
order, else their segments are carried over.  After MOST_SEGMENTS updates a table is written whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SEGMENTS = 8
#: Keys of one update that may be broadcast, by count.
SMALL_KEYS = 200_000
#: Stages of one level that run at a time.
AT_ONCE = 4


@dataclass(frozen=True)
class Stage:
    """name of the stage and its table; needs: the tables that it reads, with the columns; run: from those tables to its own."""

    name: str
    needs: Mapping[str, tuple[str, ...]]
    run: Callable[[Mapping[str, DataFrame]], DataFrame]
    key: str | None = None


@dataclass
class Tables:
    """The tables under one root, by their segments: (rows, keys that hide older rows of them, the key's name, number of keys)."""

    spark: SparkSession
    root: str
    segments: dict[str, list[tuple[str, str | None, str | None, int]]] = field(default_factory=dict)
    digests: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Tables:
        row = spark.read.schema("segments string, digests string").parquet(f"{root}/manifest").first()
        return cls(spark, root, {k: [tuple(s) for s in v] for k, v in json.loads(row["segments"]).items()}, json.loads(row["digests"]))

    def save(self) -> None:
        rows = [(json.dumps(self.segments), json.dumps(self.digests))]
        self.spark.createDataFrame(rows, "segments string, digests string").coalesce(1).write.parquet(f"{self.root}/manifest")

    def read(self, name: str) -> DataFrame:
        out = None
        for rows, keys, key, n in self.segments[name]:
            own = self.spark.read.parquet(rows)
            if out is not None:
                hidden = self.spark.read.parquet(keys)
                own = out.join(F.broadcast(hidden) if n <= SMALL_KEYS else hidden, key, "left_anti").unionByName(own)
            out = own
        return out

    def all(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.segments}

    def whole(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}")
        self.segments[name] = [(f"{self.root}/{name}", None, None, 0)]

    def delta(self, name: str, df: DataFrame, key: str, keys: str, n: int, before: list) -> None:
        """The rows of some keys, on top of the segments before."""
        df.write.parquet(f"{self.root}/{name}")
        self.segments[name] = [*before, (f"{self.root}/{name}", keys, key, n)]
        if len(self.segments[name]) > MOST_SEGMENTS:
            self.read(name).write.parquet(f"{self.root}/{name}-whole")
            self.segments[name] = [(f"{self.root}/{name}-whole", None, None, 0)]

    def digest(self, name: str, columns: tuple[str, ...], others: Iterable[tuple[str, ...]] = ()) -> str:
        """Number of rows and sum of their hashes over some columns; other sets of columns are taken in the same pass."""
        label = lambda c: f"{name}:{','.join(c)}"
        if label(columns) not in self.digests:
            wanted = sorted({columns, *others})
            row = [F.xxhash64(F.to_json(F.struct(*c), {"ignoreNullFields": "false"})).cast("decimal(38,0)") for c in wanted]
            n, *sums = self.read(name).agg(F.count("*"), *map(F.sum, row)).first()
            self.digests |= {label(c): f"{n} {s}" for c, s in zip(wanted, sums, strict=True)}
        return self.digests[label(columns)]


class Graph:
    def __init__(self, sources: Mapping[str, str | None], stages: Iterable[Stage] = ()) -> None:
        """sources: the given tables, each with its key or None."""
        self.sources, self.stages = dict(sources), {}
        for stage in stages:
            self.register(stage)

    def register(self, stage: Stage) -> None:
        if stage.name in self.stages or stage.name in self.sources:
            raise ValueError(f"{stage.name} is there already")
        self.stages[stage.name] = stage

    def extended(self, *stages: Stage) -> Graph:
        return Graph(self.sources, [*self.stages.values(), *stages])

    def levels(self) -> list[list[Stage]]:
        """Stages in groups; what a stage needs stands in earlier ones."""
        done, left, out = set(self.sources), dict(self.stages), []
        while left:
            ready = [s for s in left.values() if done.issuperset(s.needs)]
            if not ready:
                raise ValueError(f"stages that wait for each other or for what is not there: {', '.join(sorted(left))}")
            out.append(ready)
            done |= {s.name for s in ready}
            for s in ready:
                del left[s.name]
        return out

    def affected(self, changed: Iterable[str]) -> list[str]:
        """Stages that a change of these tables can reach, in order of running."""
        changed, out = set(changed), []
        for stage in (s for level in self.levels() for s in level):
            if changed.union(out).intersection(stage.needs):
                out.append(stage.name)
        return out

    def _read_sets(self) -> dict[str, set[tuple[str, ...]]]:
        """table -> the sets of columns that stages without a key read."""
        out: dict[str, set[tuple[str, ...]]] = {}
        for stage in self.stages.values():
            for table, columns in stage.needs.items() if stage.key is None else ():
                out.setdefault(table, set()).add(columns)
        return out

    def _digests(self, tables: Tables) -> None:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda x: tables.digest(x[0], min(x[1]), x[1]), self._read_sets().items()))

    def build(self, sources: Mapping[str, DataFrame], spark: SparkSession, root: str) -> Tables:
        """Every table, written under a new root."""
        tables = Tables(spark, root)
        for name in self.sources:
            tables.whole(name, sources[name])
        for level in self.levels():
            with ThreadPoolExecutor(AT_ONCE) as pool:
                list(pool.map(lambda s: tables.whole(s.name, s.run({t: tables.read(t) for t in s.needs})), level))
        self._digests(tables)
        tables.save()
        return tables

    def update(self, before: Tables, rows: Mapping[str, DataFrame], touched: DataFrame, key: str, root: str) -> tuple[Tables, list[str]]:
        """The tables under a new root after a change, and the stages that ran.

        rows: for each source with the key the new rows of the touched keys (none for what is gone); touched: those keys.  Sources
        without a key are given whole if they are in `rows`, else they stay.
        """
        spark = before.spark
        tables, ran, sets = Tables(spark, root), [], self._read_sets()
        touched.select(key).distinct().write.parquet(f"{root}/touched")
        keys = f"{root}/touched"
        n = spark.read.parquet(keys).count()
        fresh: dict[str, DataFrame] = {}  # the touched keys' rows of keyed tables
        for name, own in self.sources.items():
            if own == key:
                tables.delta(name, rows[name], key, keys, n, before.segments[name])
                fresh[name] = spark.read.parquet(f"{root}/{name}")
            elif name in rows:
                tables.whole(name, rows[name])
            else:
                tables.segments[name] = before.segments[name]

        def advance(stage: Stage) -> str | None:
            if stage.name not in before.segments:
                tables.whole(stage.name, stage.run({t: tables.read(t) for t in stage.needs}))
            elif stage.key == key and all(t in fresh for t in stage.needs):
                tables.delta(stage.name, stage.run({t: fresh[t] for t in stage.needs}), key, keys, n, before.segments[stage.name])
                fresh[stage.name] = spark.read.parquet(f"{root}/{stage.name}")
            elif all(tables.segments[t] == before.segments[t] or tables.digest(t, c, sets[t]) == before.digest(t, c, sets[t]) for t, c in stage.needs.items()):
                tables.segments[stage.name] = before.segments[stage.name]
                return None
            else:
                tables.whole(stage.name, stage.run({t: tables.read(t) for t in stage.needs}))
            return stage.name

        for level in self.levels():
            with ThreadPoolExecutor(AT_ONCE) as pool:
                ran += filter(None, pool.map(advance, level))
        tables.digests = {k: v for k, v in before.digests.items() if tables.segments.get(k.split(":", 1)[0]) == before.segments.get(k.split(":", 1)[0])} | tables.digests
        self._digests(tables)
        tables.save()
        return tables, ran
