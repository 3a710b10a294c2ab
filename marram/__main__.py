"""python -m marram: networks of a folder, their rankings with what is stored taken up, and their tables, from a shell or spark-submit.

    python -m marram networks FOLDER
    python -m marram score FOLDER STORE [--networks a,b] [--methods degree,core] [--force] [--verify]
    python -m marram ranks STORE OUT [--format csv]
    python -m marram query NAME TABLES OUT [--format csv]

Folders may be in any store that Spark reads; the session is the one that the launcher configures (spark-submit --conf ...).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import collection, methods
from marram.operators.graph import degrees, largest_component, relabel
from marram.sources import networks as files
from marram.sources.shared import materialise
from marram.sources.store import Store, edge_digest, stored_scores

CATALOGUE = "networks"


def names(text: str | None, known: Iterable[str], what: str) -> list[str]:
    """The names of a comma-separated list, each once and in its order; all known ones for None or `all`. Raises ValueError for an unknown or missing one."""
    known = list(known)
    if text is None or text.strip().lower() == "all":
        return known
    out = list(dict.fromkeys(part.strip() for part in text.split(",") if part.strip()))
    if wrong := [x for x in out if x not in known]:
        raise ValueError(f"unknown {what}: {', '.join(wrong)}; known: {', '.join(known)}")
    if not out:
        raise ValueError(f"no {what} named")
    return out


def prepared(spark: SparkSession, path: str) -> DataFrame:
    """The largest component of a network file, its nodes numbered from 0 in their order."""
    edges = materialise(largest_component(files.read_network(spark, path)), "component")
    labels = materialise(relabel(edges), "labels")
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("u", "v"))
    return edges.join(a, "u").join(b, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))


def score(spark: SparkSession, folder: str, where: str, wanted: str | None = None, chosen: str | None = None, *, force: bool = False, verify: bool = False) -> list[tuple[str, str, str]]:
    """(network, method, what became of it): kept, made, or an error. Only what the store lacks is worked out, or all scores if `force` is set (cliques are filed by edges and stay).

    With `verify` every stored ranking is counted: one that hasn't a finite score for each node is told as `n of m scores`.
    """
    store, paths, told = Store(spark, where), files.list_networks(spark, folder), []
    for name in names(wanted, sorted(paths), "networks"):
        edges = materialise(prepared(spark, paths[name]), "graph")
        key, own = edge_digest(edges), names(chosen, methods.METHODS, "methods")
        if force:
            for m in own:
                store.drop("scores", f"{key}-{m}")
        scores, became = stored_scores(store, edges, own)
        entry = spark.range(1).select(F.lit(name).alias("graph"), F.lit(key).alias("digest"))
        entry.write.mode("overwrite").parquet(store.path(CATALOGUE, name))
        if verify and scores is not None:
            n = degrees(edges).count()
            expected = scores.select(F.lit(name).alias("graph_id"), "method", F.lit(n).alias("n")).distinct()
            for r in files.missing_scores(scores.withColumn("graph_id", F.lit(name)), expected).collect():  # a row a method
                became[r["method"]] = f"{r['have']} of {n} scores"
        told += [(name, m, became[m]) for m in own]
    return told


def ranks(spark: SparkSession, where: str) -> DataFrame:
    """(graph, method, node, score, rank) of all that a store holds for the networks last scored into it."""
    store = Store(spark, where)
    catalogue = {r["graph"]: r["digest"] for r in spark.read.parquet(f"{store.folder}/{CATALOGUE}/*").collect()}  # a row a network
    rows = [store.read("scores", f"{key}-{m}").select(F.lit(g).alias("graph"), "method", "node", "score") for g, key in sorted(catalogue.items()) for m in methods.METHODS if store.has("scores", f"{key}-{m}")]
    if not rows:
        raise ValueError(f"{where} holds no scores")
    return collection.rank_all(reduce(DataFrame.union, rows))


def run_query(spark: SparkSession, name: str, tables: str) -> DataFrame:
    """A registered query of the engine over a folder of tables."""
    from marram.plans import many

    (name,) = names(name, many.QUERIES, "queries")
    return many.QUERIES[name](spark, tables)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marram", description="Rankings of networks on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("networks", help="the network files below a folder").add_argument("folder")
    scoring = sub.add_parser("score", help="scores of networks, as far as the store lacks them")
    scoring.add_argument("folder"), scoring.add_argument("store")
    scoring.add_argument("--networks"), scoring.add_argument("--methods")
    scoring.add_argument("--force", action="store_true"), scoring.add_argument("--verify", action="store_true")
    ranking = sub.add_parser("ranks", help="writes the rankings of a store")
    ranking.add_argument("store"), ranking.add_argument("out"), ranking.add_argument("--format", default="csv")
    query = sub.add_parser("query", help="writes the result of a registered query")
    query.add_argument("name"), query.add_argument("tables"), query.add_argument("out"), query.add_argument("--format", default="csv")
    return top


def main(arguments: Sequence[str] | None = None) -> int:
    """0, or 1 if a score failed or is not whole, or 2 for what can't be done as asked."""
    given = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("marram").getOrCreate()
    try:
        if given.command == "networks":
            for name, path in sorted(files.list_networks(spark, given.folder).items()):
                print(f"{name}\t{path}")
        elif given.command == "score":
            told = score(spark, given.folder, given.store, given.networks, given.methods, force=given.force, verify=given.verify)
            print("\n".join("\t".join(row) for row in told))
            return int(any(what not in ("kept", "made") for *_, what in told))
        elif given.command == "ranks":
            files.write_table(ranks(spark, given.store), given.out, given.format)
        else:
            files.write_table(run_query(spark, given.name, given.tables), given.out, given.format)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
