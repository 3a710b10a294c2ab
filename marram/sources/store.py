"""Results that outlive a run: each is a table under a key, made once, and found again by any later run.

A key is worked out from what the result depends on, so nothing has to be told to go stale: cliques and scores belong to a digest of
the edges, a study's setting to a digest of its parameters. A table counts as made when its writer has put down its last file, the
mark of success; a run that is killed half-way leaves at most one table without the mark, and the next run makes just what has none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import cliques as cl
from marram.operators import methods
from marram.operators.collection import Collection, collect_networks
from marram.sources.networks import read_network, read_nodes
from marram.sources.shared import delete


def edge_digest(edges: DataFrame) -> str:
    """A digest of a set of edges (u, v), the same in any order, partitioning and direction: their number and sums of two hashes of each."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.least("u", "v"), F.greatest("u", "v")).cast("decimal(38,0)"))
    row = edges.agg(F.count("*"), total(1), total(2)).first()
    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()[:32]


class Store:
    """A folder, in any store that Spark writes to, of tables by kind and key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, kind: str, key: str) -> str:
        return f"{self.folder}/{kind}/{key}"

    def has(self, kind: str, key: str) -> bool:
        """Whether the table was written to its end."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(kind, key) + "/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def read(self, kind: str, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, key))

    def drop(self, kind: str, key: str) -> None:
        """Deletes the table, if it is there."""
        delete(self.spark, self.path(kind, key))

    def table(self, kind: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table, made and written first if it isn't there. What an unfinished writer left is written over."""
        if not self.has(kind, key):
            make().write.mode("overwrite").parquet(self.path(kind, key))
        return self.read(kind, key)


class StoredNetwork(methods.Network):
    """A network whose cliques and partition are taken from the store, or made and left there."""

    def __init__(self, store: Store, edges: DataFrame, partition: DataFrame | None = None):
        super().__init__(edges, partition)
        self.store, self.key = store, edge_digest(self.edges)

    @property
    def cliques(self) -> DataFrame:
        if self._cliques is None:
            self._cliques = self.store.table("cliques", self.key, lambda: cl.maximal_cliques(self.edges))
        return self._cliques

    @property
    def partition(self) -> DataFrame:
        if self._partition is None:
            make = super()
            self._partition = self.store.table("partitions", self.key, lambda: make.partition)
        return self._partition


def stored_scores(store: Store, edges: DataFrame, wanted: Iterable[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """(method, node, score) of the methods, and what became of each: kept, made, or its error. Only scores that are not in the store are worked out, each is written as soon as it is."""
    network, out, told = StoredNetwork(store, edges), None, {}
    for m in wanted:
        key = f"{network.key}-{m}"
        told[m] = "kept" if store.has("scores", key) else "made"
        try:
            rows = store.table("scores", key, lambda m=m: methods.score(m, network).select(F.lit(m).alias("method"), "node", F.col("score").cast("double").alias("score")))
        except Exception as error:  # noqa: BLE001  isolated on purpose, and reported
            told[m] = f"{type(error).__name__}: {error}"
            continue
        out = rows if out is None else out.union(rows)
    return out, told


def setting_key(setting: Mapping) -> str:
    """A digest of a setting's parameters, in any order."""
    return hashlib.sha256(json.dumps(dict(setting), sort_keys=True, default=str).encode()).hexdigest()[:32]


def pending(store: Store, study: str, settings: Iterable[Mapping]) -> list[Mapping]:
    """The settings of a study that have no result yet."""
    return [s for s in settings if not store.has(study, setting_key(s))]


def run_settings(store: Store, study: str, settings: Iterable[Mapping], make: Callable[[Mapping], DataFrame]) -> DataFrame:
    """The results of all settings of a study in one table, each with its parameters as text in `setting`.

    A setting is a commit of its own: a run that ends half-way is taken up by the next with the settings that are left. Values of a setting that name a graph should
    hold its digest (edge_digest), so that results follow the graph's edges and not its name. There must be a setting.
    """
    rows = []
    for s in settings:
        table = store.table(study, setting_key(s), lambda s=s: make(s))
        rows.append(table.withColumn("setting", F.lit(json.dumps(dict(s), sort_keys=True, default=str))))
    return reduce(DataFrame.unionByName, rows)


def first_readable(spark: SparkSession, paths: Iterable[str], read: Callable[[str], DataFrame]) -> tuple[str, DataFrame]:
    """The first of some places that can be read, and its table. Raises ValueError with what was wrong at each if there is none."""
    wrong = []
    for path in paths:
        try:
            df = read(path)
            df.head(1)
            return path, df
        except Exception as error:  # noqa: BLE001  the next place is tried, and all are reported
            wrong.append(f"{path}: {type(error).__name__}")
    raise ValueError("nothing to read: " + "; ".join(wrong))


def load_networks(spark: SparkSession, files: Mapping[str, str]) -> Collection:
    """All networks of some files (name: path) as one collection; nodes that a file's header counts but that have no ties are part of their network."""
    pairs, nodes = [], []
    for name, path in files.items():
        label = F.lit(name).alias("graph")
        pairs.append(read_network(spark, path).select(label, "u", "v"))
        if (own := read_nodes(spark, path)) is not None:
            nodes.append(own.select(label, "node"))
    if not pairs:
        raise ValueError("there is no file")
    return collect_networks(reduce(DataFrame.union, pairs), reduce(DataFrame.union, nodes) if nodes else None)
