"""Epidemic spreading as percolation.

With recovery after one step, each ordered pair of neighbours is tried once, so the nodes ever
infected are those reachable from the seeds over open arcs, and the step of infection is the number of
arcs. Whether an arc is open is a hash of the run and the arc, never of the seeds: all seed sets of a
run meet the same arcs (common random numbers), and a run needs no random state.

Runs are bits. A plan's runs (with their settings) are dealt into words of at most 63, and where a word has room
left it holds the same runs for several seed sets side by side. An arc has a long integer for each word that says in
which runs it is open, and the state a row for a node, a group of sets and a word. A step is one join and one aggregation with bit_or;
it writes only what was reached anew, and where that is little, only the rows met again are looked up among those reached before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marram.operators.graph import adjacency
from marram.operators.order import place_within
from marram.sources.shared import Rounds, materialise


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the key's parts as text."""
    parts = [k if isinstance(k, Column) else F.col(k) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def runs(spark, blocks: int, repeats: int) -> DataFrame:
    """run = block * 1000 + repeat, for so many blocks of repeats; raises ValueError for more than 1000 repeats."""
    if not 0 < repeats <= 1000:
        raise ValueError("a block has from 1 to 1000 repeats")
    b, r = spark.range(blocks).withColumnRenamed("id", "block"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    return b.select("block", r).select((F.col("block") * 1000 + F.col("repeat")).alias("run"), "block", F.col("repeat").cast("long").alias("repeat"))


def infections(edges: DataFrame, seeds: DataFrame, settings: DataFrame, last: int | None = None) -> DataFrame:
    """(set_id, run, beta, node, step) of every node infected.

    seeds: (set_id, node); settings: (run, beta), each applied to every seed set; arcs open where
    uniform(run, u, v) < beta, so they nest over beta. Recovery is certain after one step.

    If settings have a column graph, edges and seeds must have it too: each network of a disjoint union is then run with its own settings. If they have a
    column method, seeds must have it: each method's sets then meet its own runs only. Steps after `last` are not run, where nobody asks for them.
    """
    return _spread(edges, seeds, settings, ["beta"], lambda coin, stay, beta: coin < beta, last=last)


def _scopes(df: DataFrame) -> list[str]:
    return [c for c in ("graph", "method") if c in df.columns]


#: Bits of a word: a long integer's, less its sign.
WORD = 63

#: A step looks up what it met, and does not go through all that was reached, while it starts from so many times fewer rows.
THIN = 8


#: Reached rows are brought together after so many steps at the latest, so that a step reads few folders.
FOLDERS = 16

Opens = Callable[..., np.ndarray]


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _or(x: Column, y: Column) -> Column:
    return x.bitwiseOR(y)


def _words(settings: DataFrame, own: list[str], keys: list[str]) -> DataFrame:
    """(own..., word, slots, cases, draws) of a plan: its runs (run, keys...) in words, each for `slots` sets at once.

    Case i of a set in slot j is bit i * slots + j. draws holds the cases by run, each with the mask of its bits for all slots, as cases of a run share its coins.
    """
    plan = settings.select(*own, "run", *keys).distinct()
    scope = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    # Cases of one run come together, so that its coins are tossed once a word.
    plan = plan.withColumn("at", F.row_number().over(scope.orderBy("run", *keys)) - 1).withColumn("of", F.count("*").over(scope))
    width = F.ceil(F.col("of") / F.ceil(F.col("of") / WORD))
    plan = plan.withColumn("width", width).withColumn("slots", F.least(F.floor(F.lit(WORD) / F.col("width")), F.lit(WORD - 1)).cast("int"))
    plan = plan.withColumn("w", F.floor(F.col("at") / F.col("width"))).withColumn("i", (F.col("at") % F.col("width")).cast("int"))
    mask = F.call_function("shiftleft", _bit(F.col("slots")) - 1, F.col("i") * F.col("slots"))
    case = F.struct(*[F.col(k) for k in keys], mask.alias("mask"))
    by_run = plan.groupBy(*own, "w", "slots", "run").agg(F.collect_list(case).alias("cases"))
    draws = by_run.groupBy(*own, "w", "slots").agg(F.collect_list(F.struct("run", "cases")).alias("draws"))
    cases = plan.groupBy(*own, "w", "slots").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "run", *keys))), lambda c: F.struct(c["run"].alias("run"), *[c[k].alias(k) for k in keys])).alias("cases"))
    both = cases.join(draws, [*own, "w", "slots"])
    number = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*own, "w")) - 1).alias("word")
    return materialise(both.select(*own, "slots", "cases", "draws", number), "plan")


def _coins(texts: list[bytes]) -> np.ndarray:
    """uniform() of keys whose parts are already joined."""
    digests = b"".join([hashlib.md5(t, usedforsecurity=False).digest() for t in texts])
    return np.frombuffer(digests, dtype=">u4")[::4] / float(1 << 32)


def _tossed(plan: dict[tuple, list[tuple]], scopes: list[str], opens: Opens, staying: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arcs (u, v, scopes...) of a batch to (u, v, word, open), without those that are closed in all of a word's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in scopes]
            u, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            own = np.array([hash(x) for x in zip(*columns, strict=True)]) if scopes else np.zeros(len(u), dtype=np.int64)
            for scope, words in plan.items():
                at = np.flatnonzero(own == hash(scope)) if scopes else np.arange(len(u))
                if scopes:
                    at = at[[all(c[i] == x for c, x in zip(columns, scope, strict=True)) for i in at]] if len(at) else at
                if not len(at):
                    continue
                a, b = u[at], v[at]
                ends = [b"|%d|%d" % e for e in zip(a.tolist(), b.tolist(), strict=True)]
                starts, of = np.unique(a, return_inverse=True) if staying else (None, None)
                for word, draws in words:
                    open_ = np.zeros(len(at), dtype=np.int64)
                    for number, cases in draws:
                        name = b"%d" % number
                        coin = _coins([name + e for e in ends])
                        stay = _coins([name + b"|%d|stay" % x for x in starts.tolist()])[of] if staying else None
                        for mask, *keys in cases:
                            open_ |= np.where(opens(coin, stay, *keys), np.int64(mask), np.int64(0))
                    some = np.flatnonzero(open_)
                    yield pa.RecordBatch.from_arrays([pa.array(a[some], pa.int64()), pa.array(b[some], pa.int64()), pa.array(np.full(len(some), word), pa.int32()), pa.array(open_[some], pa.int64())], names=["u", "v", "word", "open"])

    return run


def _open_arcs(edges: DataFrame, words: DataFrame, own: list[str], keys: list[str], opens: Opens, staying: bool) -> DataFrame:
    """(u, v, word, open) of the arcs that are open in some run of a word."""
    shared = [c for c in own if c in edges.columns]
    told: dict[tuple, list[tuple]] = {}
    for row in words.collect():  # a plan
        draws = [(d["run"], [(c["mask"], *[c[k] for k in keys]) for c in d["cases"]]) for d in row["draws"]]
        told.setdefault(tuple(row[c] for c in shared), []).append((row["word"], draws))
    adj = adjacency(edges, *shared).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *shared)
    return materialise(adj.mapInArrow(_tossed(told, shared, opens, staying), "u long, v long, word int, open long"), "arcs")


def _spread(edges: DataFrame, seeds: DataFrame, settings: DataFrame, keys: list[str], opens: Opens, staying: bool = False, last: int | None = None) -> DataFrame:
    """All nodes reached over open arcs with the step of arrival, in the runs of the settings: a row for each set, run and node."""
    own, rings, plan, names = _rings(edges, seeds, settings, keys, opens, staying, last)
    every = rings.join(plan.drop("draws"), "word").join(names, [*own, "sets"])
    each = F.flatten(F.transform("cases", lambda c, i: F.filter(F.transform(F.map_keys("names"), lambda j: F.when(F.col("now").bitwiseAND(_bit(i * F.col("slots") + j)) != 0, F.struct(F.element_at("names", j).alias("set_id"), c.alias("case")))), lambda x: x.isNotNull())))
    return every.select(*own, "node", "step", F.explode(each).alias("x")).select("x.set_id", "x.case.run", *own, *[F.col(f"x.case.{k}").alias(k) for k in keys], "node", "step")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sets, word, bit, n): how many rows (sets, word, now) of a batch have each bit."""
    for batch in batches:
        sets, word, now = (c.to_numpy() for c in batch.columns)
        if not len(now):
            continue
        keys, of = np.unique(np.rec.fromarrays([sets, word], names="sets,word"), return_inverse=True)
        counts = np.array([np.bincount(of, weights=now >> k & 1, minlength=len(keys)) for k in range(WORD)]).astype(np.int64)
        bit, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys["sets"][at], pa.int64()), pa.array(keys["word"][at], pa.int32()), pa.array(bit, pa.int32()), pa.array(counts[bit, at], pa.int64())], names=["sets", "word", "bit", "n"])


def _sizes(edges: DataFrame, seeds: DataFrame, settings: DataFrame, keys: list[str], opens: Opens, staying: bool = False, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As final_sizes of _spread: (set_id, run, keys..., n_infected), by graph and method if the settings have them. Bits are counted as they are; no row is made for a set, run and node."""
    own, rings, plan, names = _rings(edges, seeds, settings, keys, opens, staying, None, made)
    bits = rings.select(F.col("sets").cast("long").alias("sets"), "word", "now").mapInArrow(_counted, "sets long, word int, bit int, n long").groupBy("sets", "word", "bit").agg(F.sum("n").alias("n_infected"))
    every = bits.join(plan.drop("draws"), "word").join(names, [*own, "sets"])
    case, set_id = F.element_at("cases", F.floor(F.col("bit") / F.col("slots")).cast("int") + 1), F.element_at("names", F.col("bit") % F.col("slots"))
    return every.select(set_id.alias("set_id"), case.alias("case"), *own, "n_infected").select("set_id", "case.run", *own, *[F.col(f"case.{k}").alias(k) for k in keys], "n_infected")


def _rings(edges: DataFrame, seeds: DataFrame, settings: DataFrame, keys: list[str], opens: Opens, staying: bool, last: int | None, made: tuple[DataFrame, DataFrame] | None = None) -> tuple[list[str], DataFrame, DataFrame, DataFrame]:
    """What a spread reaches anew in each step (sets, word, node, now, step), in the runs of the settings (a plan, not data; each run once for equal keys); with its columns of scope, its words, and the names of the sets that share a row.

    opens says whether an arc's coin, and with `staying` that of its start's stay, opens it under the keys of a case. made: the words and open arcs of these settings, if they are there already.
    """
    own = _scopes(settings)
    words = _words(settings, own, keys) if made is None else made[0]
    arcs = _open_arcs(edges, words, own, keys, opens, staying) if made is None else made[1]
    plan = F.broadcast(words)
    none = F.lit(0).cast("long")
    sown = materialise(seeds.select("set_id", "node", *own).distinct(), "seeds")
    # Sets get places in their scope in the order of their first nodes, so that sets of the same region share rows.
    first = sown.groupBy(*own, "set_id").agg(F.min("node").alias("first")).withColumn("all", F.lit(0))
    places = place_within(first, own or ["all"], ["first", "set_id"], "place")
    slots = plan.select(*own, "slots").distinct()
    places = places.join(F.broadcast(slots), own) if own else places.crossJoin(F.broadcast(slots))  # a row a scope
    places = materialise(places.select(*own, "set_id", F.floor(F.col("place") / F.col("slots")).alias("sets"), (F.col("place") % F.col("slots")).cast("int").alias("slot")), "places")
    at = ["sets", "word", "node"]
    all_cases = F.aggregate(F.sequence(F.lit(0), F.size("cases") - 1), none, lambda got, i: _or(got, _bit(i * F.col("slots") + F.col("slot"))))
    named = places.select(*[F.col(c).alias(f"p_{c}") for c in own], F.col("set_id").alias("p_set_id"), "sets", "slot")
    start = sown.join(named, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*own, "set_id")]).select(*own, "node", "sets", "slot")
    start = (start.join(plan, own) if own else start.join(plan)).select(*at, all_cases.alias("now")).groupBy(*at).agg(F.bit_or("now").alias("now"))
    rings, bases, asked = Rounds(keep=None), Rounds(1), Rounds(2)

    def written(df: DataFrame, rounds: Rounds, name: str) -> tuple[DataFrame, int]:
        seen = Observation()
        return rounds.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]

    ring, n_ring = written(start.withColumn("step", F.lit(0)), rings, "ring")
    read, n_new = edges.sparkSession.read.schema(ring.schema), n_ring
    n_base, news, step = 0, list(rings.paths), 0
    while n_ring and (last is None or step < last):
        step += 1
        if len(news) > 1 and n_new > n_base or len(news) >= FOLDERS:
            # What was reached so far becomes one row each: as often as it has doubled, or has many folders.
            whole = read.parquet(*bases.paths, *news).groupBy(*at).agg(F.bit_or("now").alias("now")).withColumn("step", F.lit(0))
            n_base, n_new, news = written(whole, bases, "reached")[1], 0, []
        seen = read.parquet(*bases.paths, *news).select(*at, none.alias("now"), F.col("now").alias("old"))
        met = ring.withColumnRenamed("node", "u").join(arcs, ["word", "u"]).select("sets", "word", F.col("v").alias("node"), F.col("now").bitwiseAND(F.col("open")).alias("now")).where("now <> 0")
        if n_ring * THIN < n_base + n_new:
            met = asked.write(met.groupBy(*at).agg(F.bit_or("now").alias("now")), "met")
            seen = seen.join(met.select(*at), at, "left_semi")
        both = met.select(*at, "now", none.alias("old")).union(seen).groupBy(*at).agg(F.bit_or("now").alias("now"), F.bit_or("old").alias("old"))
        ring, n_ring = written(both.select(*at, F.col("now").bitwiseAND(F.bitwise_not("old")).alias("now"), F.lit(step).alias("step")).where("now <> 0"), rings, "ring")
        n_new, news = n_new + n_ring, [*news, rings.paths[-1]]
    bases.clear(edges.sparkSession)
    asked.clear(edges.sparkSession)
    names = places.groupBy(*own, "sets").agg(F.map_from_entries(F.collect_list(F.struct("slot", "set_id"))).alias("names"))
    return own, read.parquet(*rings.paths), plan, names


def _in_time(coin: np.ndarray, stay: np.ndarray, beta: float, gamma: float) -> np.ndarray:
    stays = 1.0 if gamma >= 1 else 1 + np.floor(np.log(1 - stay) / np.log(1 - gamma))
    attempts = 1.0 if beta >= 1 else 1 + np.floor(np.log(1 - coin) / np.log(1 - beta))
    return attempts <= stays


def infections_with_recovery(edges: DataFrame, seeds: DataFrame, settings: DataFrame) -> DataFrame:
    """As above for a recovery probability: settings (run, beta, gamma); nodes ever infected, without steps.

    A node stays infectious for a geometric number of steps; an arc opens at a geometric attempt, and
    counts if that comes no later than the recovery of its start.
    """
    return _spread(edges, seeds, settings, ["beta", "gamma"], _in_time, staying=True).drop("step")


def infected_counts(edges: DataFrame, seeds: DataFrame, settings: DataFrame) -> DataFrame:
    """The final_sizes of infections, or of infections_with_recovery if the settings have a column gamma, counted without a row for each node that is infected."""
    if "gamma" in settings.columns:
        return _sizes(edges, seeds, settings, ["beta", "gamma"], _in_time, staying=True)
    return _sizes(edges, seeds, settings, ["beta"], lambda coin, stay, beta: coin < beta)


def transmission(t: Column, gamma: Column) -> Column:
    """The infection rate that keeps the transmissibility t at a recovery rate; null where there is none."""
    beta = t * gamma / (1 - t * (1 - gamma))
    return F.when((t < 1) & (beta > 0) & (beta <= 1), beta)


def final_sizes(infected: DataFrame) -> DataFrame:
    keys = [c for c in infected.columns if c not in ("node", "step")]
    return infected.groupBy(*keys).agg(F.count("*").alias("n_infected"))


def curves(infected: DataFrame, horizon: int) -> DataFrame:
    """(set_id, run, beta, t, n_infected): nodes infected by step t, for t from 0 to horizon - 1; also by graph if infected has it."""
    keys = [c for c in infected.columns if c not in ("node", "step")]
    at = infected.where(F.col("step") < horizon).groupBy(*keys, "step").agg(F.count("*").alias("n"))
    later = at.select(*keys, F.explode(F.sequence(F.col("step"), F.lit(horizon - 1))).alias("t"), "n")
    return later.groupBy(*keys, "t").agg(F.sum("n").alias("n_infected"))


def block_means(sizes: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """(set_id, beta, block, percent): mean share of infected nodes over the repeats of a block; also by graph and method if sizes have them. n_nodes: one row (n), or (graph, n) if sizes have a graph."""
    own = _scopes(sizes)
    by = sizes.withColumn("block", F.floor(F.col("run") / 1000)).groupBy(*own, "set_id", "beta", "block").agg(F.avg("n_infected").alias("mean"))
    by = by.join(n_nodes, "graph") if "graph" in own else by.crossJoin(F.broadcast(n_nodes))
    return by.select(*own, "set_id", "beta", "block", (100.0 * F.col("mean") / F.col("n")).alias("percent"))


#: Open arcs that leave the end of an open arc, on average, up to which what nodes reach is closed by doubling, and reached pairs for a node and a run up to which it goes on.
BRANCHES, PAIRS = 1.25, 256


def _closure(arcs: DataFrame, most: int) -> tuple[Rounds, DataFrame | None]:
    """(case, u, v, d): the nodes that each node reaches over arcs (case, u, v), and in how many; no table if they are more than `most`.

    Each round joins the pairs at the greatest distance yet with all pairs and so doubles it: rounds grow with the logarithm of the longest way.
    """
    pairs, k = Rounds(2), 1

    def written(df: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        out = pairs.write(df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == 2 * k).alias("last")), "pairs")
        return out, seen.get["n"], seen.get["last"]

    got, n, _ = written(arcs.select("case", "u", "v", F.lit(1).alias("d")))
    last = n
    while last and n <= most:
        ring = got.where(F.col("d") == k).select("case", "u", F.col("v").alias("m"))
        on = got.select("case", F.col("u").alias("m"), "v", (F.col("d") + k).alias("d"))
        further = ring.join(on, ["case", "m"]).where("u <> v").select("case", "u", "v", "d")
        got, n, last = written(got.union(further).groupBy("case", "u", "v").agg(F.min("d").alias("d")))
        k *= 2
    return pairs, None if n > most else got


def single_node_sizes(edges: DataFrame, nodes: DataFrame, settings: DataFrame) -> DataFrame:
    """(node, score): mean number of nodes infected from each node alone, over the runs of the settings; by graph and method too if the settings have them.

    Where open arcs lead on to about one other each, as near the threshold, nodes reach few others but over long ways; the pairs are then made by doubling. Otherwise all nodes spread
    step by step.
    """
    own = _scopes(settings)
    words = _words(settings, own, ["beta"])
    opens = lambda coin, stay, beta: coin < beta
    arcs = _open_arcs(edges, words, own, ["beta"], opens, False)
    case = F.explode(F.sequence(F.lit(0), F.size("cases") - 1)).alias("i")
    each = arcs.join(F.broadcast(words.select("word", "slots", "cases")), "word").select("word", "slots", "open", "u", "v", case)
    each = each.where(F.col("open").bitwiseAND(_bit(F.col("i") * F.col("slots"))) != 0)
    open_ = materialise(each.select((F.col("word") * 64 + F.col("i")).alias("case"), "u", "v"), "open")
    out = open_.groupBy("case", "u").agg(F.count("*").alias("out"))
    into = open_.groupBy("case", F.col("v").alias("u")).agg(F.count("*").alias("into"))
    arcs_on = out.join(into, ["case", "u"], "left").agg(F.sum("out").alias("all"), F.sum(F.col("out") * F.col("into")).alias("on")).first()
    asked = nodes.select("node", *own).distinct()
    pairs, got = Rounds(), None
    if (arcs_on["on"] or 0) <= BRANCHES * (arcs_on["all"] or 0):
        runs_ = words.agg(F.sum(F.size("cases"))).first()[0] or 0
        pairs, got = _closure(open_, PAIRS * runs_ * max(1, edges.agg(F.count_distinct("u")).first()[0]))
    if got is None:
        pairs.clear(edges.sparkSession)
        alone = asked.select(F.col("node").cast("string").alias("set_id"), "node", *own)
        sizes = _sizes(edges, alone, settings, ["beta"], opens, made=(words, arcs))
        return sizes.groupBy(*own, F.col("set_id").cast("long").alias("node")).agg(F.avg("n_infected").alias("score"))
    scope = words.select(*own, "word", F.size("cases").alias("runs"))
    reached = got.groupBy(F.col("u").alias("node"), F.floor(F.col("case") / 64).cast("int").alias("word")).agg(F.count("*").alias("n"))
    plan = F.broadcast(scope)
    rows = asked.join(plan, own) if own else asked.crossJoin(plan)
    every = rows.join(reached, ["node", "word"], "left").groupBy(*own, "node").agg(F.sum("runs").alias("runs"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return every.select(*own, "node", ((F.col("runs") + F.col("n")).cast("double") / F.col("runs")).alias("score"))
