"""Louvain community detection as sweeps of joins and sums over an edge table.

One sweep moves every vertex to the neighbouring community of highest modularity gain, judged on the
assignment before the sweep. Gains are rounded to 12 digits; ties go to the smaller community; of two
single vertices that want each other's community only the larger id moves. Sweeps repeat until modularity
gains less than a threshold, and the state with the higher modularity is kept. Communities then become
vertices of the next phase's graph.

A sweep is one job over edges and state, whose table also has what modularity is summed from: state goes through the
shared folder, in a few tables that are written in turn. Once few vertices move, a sweep reads only the edges of those
that the moves can affect: vertices with an end in a community that has gained or lost members.
"""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinweave.functions import GAIN_DIGITS
from kinweave.operators import kernels
from kinweave.operators.coloring import color_balanced, color_distance_one, color_max_min
from kinweave.operators.graph import coarsen, compose, vertex_following
from kinweave.operators.metrics import modularity
from kinweave.plans.scratch import Rotation, materialize

LOCAL_EDGES = 2_000_000
#: A phase of at most so many edges may run in one task that gets them in small batches.
TASK_EDGES = 24_000_000
#: A sweep over the affected vertices alone follows one in which less than this share of the vertices moved.
FRONTIER = 0.05
#: A part of the graph that is left after at most so many rounds of moves without conflicts is not tried again at once.
SOON = 4


@dataclass(frozen=True)
class Options:
    """``coloring``: 0 none, 1 distance-1, 2 balanced, 3 max-min with ``num_colors``. ``sync``: 0 none, 1 moves without conflicts, 2 neighbourhoods in turns, 3 early termination, 4 moves without conflicts and with early termination.

    Of moves without conflicts, each touches the community that a vertex leaves and the one that it enters: the move of
    highest gain, then of least id, of all that touch either of the two is made, the others wait. So all gains of a
    sweep add up, as if its moves were made one after the other, and the rule for single vertices isn't needed.

    ``c_threshold`` ends coloured phases, ``threshold`` the others. ``percent`` below 100 lets only a
    hashed share of vertices move; the share is drawn again in the second sweep and then stays, or with
    ``redraw`` is drawn in every sweep. ``directed`` uses outgoing arcs alone and doubles the constant of the
    null model, in gains and in the quality that ends phases; the modularity returned is the plain one.

    ``local_edges`` bounds graphs of turns, phases of turns and parts of a graph that are done in one task, ``task_edges`` (0: not) phases
    of turns by distance-1 colours and of moves without conflicts. Larger phases are joins, with the same result.
    """

    coloring: int = 1
    sync: int = 0
    min_graph_size: int = 1000
    num_colors: int = 16
    c_threshold: float = 1e-6
    threshold: float = 1e-9
    percent: int = 100
    redraw: bool = False
    directed: bool = False
    follow: bool = True
    max_phases: int = 200
    max_rounds: int = 10_000
    local_edges: int = LOCAL_EDGES
    task_edges: int = 0

    @property
    def takes_turns(self) -> bool:
        return self.sync == 2 or (self.coloring > 0 and self.sync == 0 and self.percent == 100 and not self.directed)


def singletons(vertices: DataFrame) -> DataFrame:
    return vertices.select("v", F.col("v").alias("community"))


def neighbor_comm_weights(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """v, community and the weight of v's edges into it, self-loops included."""
    to = assign.select(F.col("v").alias("t_v"), F.col("community"))
    return edges.join(to, F.col("dst") == F.col("t_v")).groupBy(F.col("src").alias("v"), "community").agg(F.sum("weight").alias("weight"))


def vertex_weights(edges: DataFrame) -> DataFrame:
    """d_v, degree and loop: the weights of each vertex's edges and of its self-loops."""
    loop = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))
    return edges.groupBy(F.col("src").alias("d_v")).agg(F.sum("weight").alias("degree"), loop.alias("loop"))


def best_move(edges: DataFrame, assign: DataFrame, movable: Column | None = None, total_factor: float = 1.0, weights: DataFrame | None = None, moving: DataFrame | None = None) -> DataFrame:
    """v and the community that it moves to in one sweep; those that ``movable`` (on v) excludes and those without gain keep theirs.

    ``weights`` are the edges' ``vertex_weights`` if they are at hand. ``moving`` has the edges of the vertices that may move, if not all.
    """
    weights = vertex_weights(edges) if weights is None else weights
    total = weights.agg((F.sum("degree") * total_factor).alias("m2"))
    info = assign.select(F.col("v").alias("i_v"), F.col("community").alias("own")).join(weights, F.col("i_v") == F.col("d_v"), "left")
    info = info.select("i_v", "own", F.coalesce("degree", F.lit(0.0)).alias("degree"), F.coalesce("loop", F.lit(0.0)).alias("loop"))
    sums = info.groupBy(F.col("own").alias("c")).agg(F.sum("degree").alias("a"), F.count("*").alias("size"))
    to, at = (sums.select(*(F.col(x).alias(f"{p}_{x}") for x in ("c", "a", "size"))) for p in ("to", "at"))
    near = neighbor_comm_weights(edges if moving is None else moving, assign)
    mine = near.select(F.col("v").alias("e_v"), F.col("community").alias("e_c"), F.col("weight").alias("e_own"))
    held = info.join(mine, (F.col("i_v") == F.col("e_v")) & (F.col("own") == F.col("e_c")), "left").join(at, F.col("own") == F.col("at_c"))
    rows = near.join(held, F.col("v") == F.col("i_v")).join(to, F.col("community") == F.col("to_c")).crossJoin(total)  # one row
    gain = 2 * (F.col("weight") - (F.coalesce("e_own", F.lit(0.0)) - F.col("loop"))) - 2 * F.col("degree") * (F.col("to_a") - (F.col("at_a") - F.col("degree"))) / F.col("m2")
    gain = F.when(F.col("community") == F.col("own"), 0.0).otherwise(F.round(gain, GAIN_DIGITS))
    pick = rows.groupBy(F.col("v").alias("p_v")).agg(F.min(F.struct((-gain).alias("loss"), F.col("community").alias("c"), F.col("to_size").alias("to_size"), F.col("at_size").alias("at_size"))).alias("pick"))
    moves = (F.col("pick.loss") < 0) & ~((F.col("pick.to_size") == 1) & (F.col("pick.at_size") == 1) & (F.col("pick.c") > F.col("community")))
    if movable is not None:
        moves = moves & movable
    return assign.join(pick, F.col("v") == F.col("p_v"), "left").select("v", F.when(F.coalesce(moves, F.lit(False)), F.col("pick.c")).otherwise(F.col("community")).alias("community"))


def _share(v, round: int, percent: int):
    """Whether a vertex moves in this round; the same arithmetic on columns and arrays."""
    mixed = (v % (1 << 31)) * 2654435761 + round * 40503 * 65537
    return (mixed % (1 << 32)) < percent * (1 << 32) // 100


def _quality(edges: DataFrame, assign: DataFrame, factor: float = 1.0) -> float:
    """Modularity, judged by ``factor`` times the edges' total weight."""
    return modularity(edges, assign, factor).first()[0] or 0.0


def _named(assign: DataFrame) -> DataFrame:
    """The assignment with communities named by their least members."""
    least = assign.groupBy(F.col("community").alias("l_c")).agg(F.min("v").alias("least"))
    return assign.join(least, F.col("community") == F.col("l_c")).select("v", F.col("least").alias("community"))


def _factor(options: Options) -> float:
    return 0.5 if options.directed else 1.0


class _Tables:
    """The tables of a run, each written in turn to two places, and the weight that moves are judged by."""

    def __init__(self, spark: SparkSession, m2: float, options: Options):
        self.m2, self.options = m2, options
        self.sweeps, self.states, self.moves, self.best, self.graphs, self.weights, self.turns, self.parts = (Rotation(spark, n) for n in ("sweeps", "states", "moves", "best", "graphs", "weights", "turns", "parts"))


#: One statement, as a loop's plans are built anew in each of its sweeps and this is analysed once.
_JUDGED = """WITH sums AS (SELECT own AS c, sum(degree) AS a, count(*) AS size FROM {state} GROUP BY own),
info AS (SELECT BY_SUMS s.*, a, size FROM {state} s JOIN sums ON own = c),
near AS (SELECT BY_INFO src, own AS c, sum(weight) AS e, first(a) AS a, first(size) AS size FROM {edges} JOIN info ON dst = v GROUP BY src, own),
held AS (SELECT BY_INFO v, CARRIED, first(info.a) AS a, first(info.size) AS size, sum(CASE WHEN near.c = own THEN e ELSE 0D END) AS e_own,
  min(CASE WHEN near.c <> own THEN struct(-round(2 * e - 2 * degree * near.a / M2, DIGITS) AS loss, near.c AS c, near.size AS size) END) AS pick
  FROM near JOIN info ON src = v GROUP BY v),
gains AS (SELECT *, coalesce(round(-pick.loss - 2 * (e_own - loop) + 2 * degree * (a - degree) / M2, DIGITS), 0D) AS gain FROM held)
SELECT v, NAMES, e_own, a, CASE WHEN gain > 0 AND NOT (SWAPS AND pick.size = 1 AND size = 1 AND pick.c > own) THEN pick.c ELSE own END AS target, gain FROM gains"""


def _judged(edges: DataFrame, state: DataFrame, m2: float, swap_rule: bool = True, merged: bool = False) -> DataFrame:
    """For each vertex with ``edges``: v, own, degree, loop and the other columns of ``state``, e_own (weight into its own community), a (that one's degrees), target and gain.

    ``state`` has v, own, degree and loop; ``edges`` are those of the vertices that are asked for. What a vertex gains by
    leaving its community is the same for all targets, which are compared without it. ``merged`` joins send no broadcasts,
    each of which goes by way of the driver.
    """
    carried = [c for c in state.columns if c != "v"]
    query = _JUDGED.replace("CARRIED", ", ".join(f"first({c}) AS {c}" for c in carried)).replace("NAMES", ", ".join(carried))
    query = query.replace("M2", f"{m2!r}D").replace("DIGITS", str(GAIN_DIGITS)).replace("SWAPS", str(swap_rule))
    query = query.replace("BY_SUMS", "/*+ MERGE(sums) */" if merged else "").replace("BY_INFO", "/*+ MERGE(info) */" if merged else "")
    return edges.sparkSession.sql(query, state=state, edges=edges)


def _swept(rotation: Rotation, swept: DataFrame, m2: float) -> tuple[DataFrame, float, int, int]:
    """A sweep written and read back, the modularity of the assignment before it, how many vertices have another target, and how many there are.

    The sums are observed by the tasks that write.
    """
    table, got = rotation.observed(swept, e=F.sum("e_own"), squares=F.sum(F.col("degree") * F.col("a")), moved=F.count_if(F.col("target") != F.col("own")), n=F.count(F.lit(1)))
    return table, (got["e"] or 0.0) / m2 - (got["squares"] or 0.0) / m2 / m2, got["moved"], got["n"]


def _affected(edges: DataFrame, swept: DataFrame) -> DataFrame:
    """e_v: the vertices that the moves of a sweep can give another target."""
    changed = swept.where("own <> target").select(F.explode(F.array("own", "target")).alias("c")).distinct()
    inside = swept.join(changed, F.col("target") == F.col("c"), "left_semi").select(F.col("v").alias("e_v"))
    return edges.join(inside, F.col("dst") == F.col("e_v"), "left_semi").select(F.col("src").alias("e_v")).union(inside).distinct()


def _sweeps(edges: DataFrame, state: DataFrame, tables: _Tables, threshold: float) -> tuple[DataFrame, float]:
    """All vertices move at once, until modularity gains less than the threshold; the assignment before that and its modularity."""
    options, m2 = tables.options, tables.m2
    previous, before, frontier = -1.0, None, None
    if options.sync == 3:
        state = state.withColumn("still", F.lit(0))
    for round in range(options.max_rounds):
        if frontier is None:
            # Sampled runs judge all vertices in each of many sweeps: their broadcasts would add up at the driver.
            swept = _judged(edges, state, m2, merged=options.percent < 100)
        else:
            near = edges.join(frontier, F.col("src") == F.col("e_v"), "left_semi")
            rest = before.join(frontier, F.col("v") == F.col("e_v"), "left_anti")
            swept = _judged(near, state, m2).unionByName(rest.withColumn("own", F.col("target")))
        stays = F.lit(False)
        if options.percent < 100:
            stays = ~_share(F.col("v"), round if options.redraw else min(round, 1), options.percent)
        if options.sync == 3 and round > 2:
            stays = F.col("still") >= 2
        swept = swept.withColumn("target", F.when(stays, F.col("own")).otherwise(F.col("target")))
        if options.sync == 3:
            swept = swept.withColumn("still", F.when(F.col("target") == F.col("own"), F.col("still") + 1).otherwise(0))
        swept, now, moved, n = _swept(tables.sweeps, swept, m2)
        if round and now - previous < threshold:
            return before.select("v", F.col("own").alias("community")), previous
        previous, before = now, swept
        state = swept.select("v", F.col("target").alias("own"), *(c for c in state.columns if c not in ("v", "own")))
        # Vertices that were kept from moving have to be asked again.
        frontier = None
        if options.percent == 100 and options.sync != 3 and moved < FRONTIER * n:
            frontier = tables.moves.write(_affected(edges, swept))
    return before.select("v", F.col("own").alias("community")), previous


def _turns(edges: DataFrame, state: DataFrame, tables: _Tables, threshold: float, colors: DataFrame) -> tuple[DataFrame, float]:
    """In each round the vertices of one colour after the other move, seeing the moves before; the better one of the last two assignments and its modularity."""
    options, m2 = tables.options, tables.m2
    colors = colors.select(F.col("v").alias("c_v"), "color")
    state = tables.states.write(state.join(colors, F.col("v") == F.col("c_v")).drop("c_v"))
    turns = [r["color"] for r in state.select("color").distinct().orderBy("color").collect()]
    # Each turn reads the edges of its own colour alone.
    by_color = edges.join(colors, F.col("src") == F.col("c_v")).select("color", "src", "dst", "weight")
    by_color = materialize(by_color.repartition("color", "src"), "by_color", ["color"])
    as_assign = lambda table: table.select("v", F.col("own").alias("community"))
    previous, before = -1.0, None
    for round in range(options.max_rounds):
        now = _quality(edges, as_assign(state), _factor(options))
        if round and now - previous < threshold:
            return (as_assign(state), now) if now > previous else (as_assign(before), previous)
        previous, before = now, tables.turns.write(state)
        for color in turns:
            moved = _judged(by_color.where(F.col("color") == color).drop("color"), state, m2).withColumn("own", F.col("target"))
            state = tables.states.write(moved.where(F.col("color") == color).select(*state.columns).union(state.where(F.col("color") != color)))
    return as_assign(before), previous


def _at_once(edges: DataFrame, state: DataFrame, tables: _Tables, threshold: float) -> tuple[DataFrame, float]:
    """As ``_turns`` or ``_conflict_free``, all rounds of a phase in one task; the phase's edges were counted before."""
    options, m2 = tables.options, tables.m2
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("weight", pa.float64()), ("own", pa.int64())])

    def solve(batches):
        held = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        names, at, src = np.unique(held.column("src").to_numpy(), return_index=True, return_inverse=True)
        own = np.searchsorted(names, held.column("own").to_numpy()[at])
        graph = kernels.Graph(src, np.searchsorted(names, held.column("dst").to_numpy()), held.column("weight").to_numpy(), len(names))
        graph.total = m2
        del held, src
        if options.sync in (1, 4):
            found, quality = kernels.conflict_free_whole(graph, own, threshold, options.max_rounds, options.sync == 4)
        else:
            found, quality = _local_phase(graph, own, options, threshold, True, names)
        yield pa.RecordBatch.from_pydict({"v": names, "community": names[found], "quality": np.full(len(names), quality)})

    rows = edges.join(state.select(F.col("v").alias("s_v"), "own"), F.col("src") == F.col("s_v")).select("src", "dst", "weight", "own")
    solved = materialize(rows.repartition(1).mapInArrow(solve, "v long, community long, quality double"), "at_once")
    return solved.select("v", "community"), solved.first()["quality"]


def _few_asking(edges: DataFrame, swept: DataFrame, tables: _Tables, threshold: float, round: int) -> tuple[DataFrame, int] | None:
    """Rounds of moves without conflicts from a judged one on, in one task that reads the part of the graph that they can touch: r_v, r_own, r_still, and how many; None if that part has too many edges.

    The part are the communities that the moves touch, their neighbours, and if there is room the communities of these
    and their neighbours. It goes back to the joins before a round that would reach beyond, or end the phase.
    """
    options, m2 = tables.options, tables.m2
    hot = swept.where("own <> target").select(F.explode(F.array("own", "target")).alias("c")).distinct()
    part = None
    for _ in range(2):
        members = swept.join(hot, F.col("own") == F.col("c"), "left_semi").select(F.col("v").alias("e_v"))
        inside = tables.moves.write(edges.join(members, F.col("dst") == F.col("e_v"), "left_semi").select(F.col("src").alias("e_v")).union(members).distinct())
        near = edges.join(inside, F.col("src") == F.col("e_v"), "left_semi")
        if near.count() > options.local_edges:
            break
        part = hot, inside, near
        hot = swept.join(inside, F.col("v") == F.col("e_v"), "left_semi").select(F.col("own").alias("c")).distinct()
    if part is None:
        return None
    hot, inside, near = part
    ends = near.select(F.col("dst").alias("n_v")).union(inside.select("e_v")).distinct()
    nodes = swept.join(ends, F.col("v") == F.col("n_v"), "left_semi").join(inside, F.col("v") == F.col("e_v"), "left").join(hot, F.col("own") == F.col("c"), "left")
    nodes = nodes.select("v", "own", "target", "gain", "still", "degree", "loop", "a", F.col("e_v").isNotNull().alias("inside"), F.col("c").isNotNull().alias("hot"))
    early, rounds = options.sync == 4, options.max_rounds - round

    def solve(left, right):
        held = {c: right.column(c).to_numpy() for c in right.column_names}
        order = np.argsort(held["v"])
        held = {c: x[order] for c, x in held.items()}
        communities = np.unique(held["own"])
        names = held["v"]
        held |= {c: np.searchsorted(communities, held[c]) for c in ("own", "target")}
        src, dst = (np.searchsorted(names, left.column(c).to_numpy()) for c in ("src", "dst"))
        own, still, made = kernels.conflict_free(src, dst, left.column("weight").to_numpy(), held, m2, threshold, early, round, rounds)
        at = held["inside"]
        return pa.table({"r_v": names[at], "r_own": communities[own[at]], "r_still": still[at].astype(np.int32), "made": np.full(at.sum(), made)})

    one = F.lit(1).alias("one")
    solved = near.select(one, "src", "dst", "weight").groupBy("one").cogroup(nodes.withColumn("one", F.lit(1)).groupBy("one"))
    solved = tables.parts.write(solved.applyInArrow(solve, "r_v long, r_own long, r_still int, made long"))
    return solved.drop("made"), solved.first()["made"]


def _conflict_free(edges: DataFrame, state: DataFrame, tables: _Tables, threshold: float) -> tuple[DataFrame, float]:
    """Of all moves that gain, those are made at once that come first by gain and id at both of their communities; the last assignment and its modularity."""
    options, m2 = tables.options, tables.m2
    early = options.sync == 4
    state = state.withColumn("still", F.lit(0))
    names = state.columns
    previous, before, round, wait, delay = -1.0, None, 0, 0, 1
    while round < options.max_rounds:
        swept = _judged(edges, state, m2, swap_rule=False)
        if early and round > 2:
            swept = swept.withColumn("target", F.when(F.col("still") >= 2, F.col("own")).otherwise(F.col("target")))
        swept, now, wanted, n = _swept(tables.sweeps, swept, m2)
        if round and now - previous < threshold:
            kept = swept if now > previous else before
            return kept.select("v", F.col("own").alias("community")), max(now, previous)
        previous, before = now, swept
        if not wanted:
            return swept.select("v", F.col("own").alias("community")), now
        wait -= 1
        if wanted < FRONTIER * n and wait < 0 and not options.directed:
            found = _few_asking(edges, swept, tables, threshold, round)
            made = found[1] if found else 0
            # A part that was left soon is tried again later.
            delay = 1 if made > SOON else min(2 * delay, 16)
            wait = 0 if made > SOON else delay
            if made:
                moved = swept.join(found[0], F.col("v") == F.col("r_v"), "left").select("v", F.coalesce("r_own", "own").alias("own"), "degree", "loop", F.coalesce("r_still", F.col("still") + made).cast("int").alias("still"))
                # Each of these rounds has gained the threshold.
                state, previous, round = tables.states.write(moved.select(*names)), -1.0, round + made
                continue
        asked = swept.where("target <> own").select("v", "own", "target", "gain")
        first = asked.select(F.explode(F.array("own", "target")).alias("c"), F.struct((-F.col("gain")).alias("loss"), "v").alias("rank")).groupBy("c").agg(F.min("rank")["v"].alias("first"))
        at, to = (first.select(F.col("c").alias(f"{x}_c"), F.col("first").alias(f"{x}_first")) for x in ("at", "to"))
        made = asked.join(at, (F.col("own") == F.col("at_c")) & (F.col("v") == F.col("at_first"))).join(to, (F.col("target") == F.col("to_c")) & (F.col("v") == F.col("to_first")))
        made = made.select(F.col("v").alias("m_v"), F.col("target").alias("m_to"))
        still = F.when(F.col("target") == F.col("own"), F.col("still") + 1).otherwise(0)
        moved = swept.join(made, F.col("v") == F.col("m_v"), "left").select("v", F.coalesce("m_to", "own").alias("own"), "degree", "loop", still.alias("still"))
        state = tables.states.write(moved.select(*names))
        round += 1
    return before.select("v", F.col("own").alias("community")), previous


def _colored(vertices: DataFrame, edges: DataFrame, options: Options, coloring: int) -> DataFrame:
    if coloring == 3:
        return color_max_min(vertices, edges, options.num_colors)
    return color_balanced(vertices, edges) if coloring == 2 else color_distance_one(vertices, edges)


def _colors(graph: kernels.Graph, names: np.ndarray, options: Options) -> np.ndarray:
    """The colours that the operators in ``coloring`` give the graph."""
    if options.coloring == 3 and options.sync == 0:
        return kernels.color_max_min(graph, names, options.num_colors)
    colors = kernels.color_greedy(graph, kernels.row_hash(names, 1))
    return kernels.balance(graph, colors, names) if options.coloring == 2 and options.sync == 0 else colors


def _local_phase(graph: kernels.Graph, start: np.ndarray, options: Options, threshold: float, colored: bool, names: np.ndarray):
    rounds = options.max_rounds
    if colored or options.sync == 2:
        colors = _colors(graph, names, options)
        order = np.argsort(colors, kind="stable")
        turns = np.split(order, np.searchsorted(colors[order], np.arange(1, colors.max(initial=0) + 1)))
        return kernels.in_turns(graph, start, threshold, rounds, turns)[:2]
    eligible = (lambda k: _share(names, k if options.redraw else min(k, 1), options.percent)) if options.percent < 100 else None
    return kernels.jacobi(graph, start, threshold, rounds, eligible, early=options.sync == 3)[:2]


def run_local(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, options: Options, start: dict[int, int] | None = None, phase: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, communities named by their least member, modularity) of a graph in arrays."""
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    graph = whole = kernels.Graph(at[: len(src)], at[len(src) :], weight, len(names))
    if options.directed:
        graph = copy(graph)
        graph.total *= _factor(options)
    total = np.arange(len(names))
    if start is not None:
        label = np.array([start.get(int(v), int(v)) for v in names])
        _, first, node = np.unique(label, return_index=True, return_inverse=True)
        total = first[node]
    elif options.follow and not phase and not options.directed:
        counts = np.diff(graph.first)
        only = graph.dst[np.minimum(graph.first[:-1], max(len(graph.dst) - 1, 0))] if len(graph.dst) else total
        follows = (counts == 1) & ((counts[only] > 1) | (total > only))
        total = np.where(follows, only, total)
    own_names = names
    if start is None and (total != np.arange(len(names))).any():
        graph, node = graph.coarsen(total)
        own_names, total = names[np.unique(total)], node
        current = np.arange(graph.n)
    else:
        current = total.copy()
        total = np.arange(len(names))
    colored = options.coloring > 0 and options.sync == 0 and options.percent == 100 and not options.directed
    previous, best = graph.modularity(current), current[total]
    for k in range(phase, options.max_phases):
        use_color = colored and (k == 0 or graph.n > options.min_graph_size)
        own, quality = _local_phase(graph, current, options, options.c_threshold if use_color else options.threshold, use_color, own_names)
        gained = quality - previous > options.threshold
        if gained:
            best, previous = own[total], quality
        if not gained and use_color:
            colored = False
            current = own if quality > previous else current
            continue
        if not gained and not (start is not None and k == phase):
            break
        uncoarse = own if gained else current
        factor = graph.total / max(float(graph.degree.sum()), 1e-300)
        kept = np.unique(uncoarse)
        graph, node = graph.coarsen(uncoarse)
        graph.total *= factor
        own_names, total, current = own_names[kept], node[total], np.arange(graph.n)
    _, node = np.unique(best, return_inverse=True)
    least = np.full(node.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, names)
    label = least[node] if len(names) else names
    index = np.searchsorted(names, label)
    return names, label, whole.modularity(index)


def _local(edges: DataFrame, options: Options, initial: DataFrame | None, phase: int) -> DataFrame:
    """The run in one task; edges were counted before."""
    warm = initial is not None

    def solve(left, right):
        start = dict(zip(right.column("v").to_pylist(), right.column("community").to_pylist())) if warm else None
        ids, label, quality = run_local(*(np.asarray(left.column(c)) for c in ("src", "dst", "weight")), options, start, phase)
        return pa.table({"v": pa.array(ids, pa.int64()), "community": pa.array(label, pa.int64()), "modularity": pa.array(np.full(len(ids), quality))})

    one = F.lit(1).alias("one")
    given = initial.select(one, "v", "community") if warm else edges.sparkSession.createDataFrame([], "one int, v long, community long")
    rows = edges.select(one, F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"))
    return rows.groupBy("one").cogroup(given.groupBy("one")).applyInArrow(solve, "v long, community long, modularity double")


def louvain(vertices: DataFrame, edges: DataFrame, options: Options = Options(), initial: DataFrame | None = None) -> DataFrame:
    """v, community (its least member, -1 for isolated vertices) and the modularity of the whole assignment on ``edges``.

    ``initial`` is an assignment to start from.
    """
    graph = whole = materialize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")).hint("rebalance"), "edges")
    nodes = graph.select(F.col("src").alias("v")).union(graph.select(F.col("dst").alias("v"))).distinct()
    weight, n_edges = graph.agg(F.sum("weight"), F.count("*")).first()
    if options.takes_turns and n_edges <= options.local_edges:
        return _placed(vertices, _local(graph, options, initial, 0))
    weight = weight or 0.0
    if options.directed:
        # Vertices that only receive arcs take part with an empty loop.
        graph = materialize(graph.union(nodes.select("v", "v", F.lit(0.0))), "edges")
    found = nodes.select("v", F.col("v").alias("community"), F.lit(0.0).alias("modularity"))
    if weight > 0:
        named = materialize(_named(_phases(graph, nodes, _Tables(edges.sparkSession, weight * _factor(options), options), initial)), "named")
        found = named.withColumn("modularity", F.lit(_quality(whole, named)))
    return _placed(vertices, found)


def _placed(vertices: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("v", "f_v")
    return vertices.join(found, F.col("v") == F.col("f_v"), "left").select("v", F.coalesce("community", F.lit(-1).cast("long")).alias("community"), "modularity")


def _phases(graph: DataFrame, nodes: DataFrame, tables: _Tables, initial: DataFrame | None) -> DataFrame:
    """v and community: phases of sweeps, each over the communities of the one before, until one gains nothing."""
    options = tables.options
    takes_turns = options.takes_turns and options.sync == 0
    start = total = None
    if initial is not None:
        start = tables.best.write(_named(nodes.join(initial.select(F.col("v").alias("i_v"), "community"), F.col("v") == F.col("i_v"), "left").select("v", F.coalesce("community", "v").alias("community"))))
    elif options.follow and not options.directed:
        total = tables.best.write(vertex_following(nodes, graph))
        graph, nodes = tables.graphs.write(coarsen(graph, total).hint("rebalance")), total.select(F.col("community").alias("v")).distinct()
    start = singletons(nodes) if start is None else start
    best = start if total is None else total
    previous = _quality(graph, start, _factor(options))
    for phase in range(options.max_phases):
        degrees = vertex_weights(graph)
        state = tables.weights.write(start.join(degrees, F.col("v") == F.col("d_v")).select("v", F.col("community").alias("own"), "degree", "loop").hint("rebalance"))
        use_color = takes_turns and (phase == 0 or state.count() > options.min_graph_size)
        threshold = options.c_threshold if use_color else options.threshold
        in_turns, apart = use_color or options.sync == 2, options.sync in (1, 4) and not options.directed
        in_task = options.local_edges if in_turns else 0
        if apart or (in_turns and (options.coloring == 1 or options.sync == 2)):
            in_task = max(in_task, options.task_edges)
        if in_task and graph.count() <= in_task:
            own, quality = _at_once(graph, state, tables, threshold)
        elif in_turns:
            own, quality = _turns(graph, state, tables, threshold, _colored(state.select("v"), graph, options, options.coloring if use_color else 1))
        elif options.sync in (1, 4):
            own, quality = _conflict_free(graph, state, tables, threshold)
        else:
            own, quality = _sweeps(graph, state, tables, threshold)
        gained = quality - previous > options.threshold
        if gained:
            best, previous = tables.best.write(own if total is None else compose(total, own)), quality
        elif use_color:
            # Turns found nothing more: go on without them, from the better assignment.
            takes_turns = False
            start = materialize(own, "start") if quality > previous else start
            continue
        elif initial is None or phase:
            break
        kept = own if gained else start
        graph, total = tables.graphs.write(coarsen(graph, kept).hint("rebalance")), best
        start = singletons(graph.select(F.col("src").alias("v")).union(graph.select(F.col("dst").alias("v"))).distinct())
    return best
