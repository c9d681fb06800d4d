"""SQL of the iterative graph queries, for DuckDB: recursive CTEs whose rows are the state of a loop.

``edges`` (src, dst, weight) and ``vertices`` (v) are CTEs of the caller. Hashes are Spark's xxhash64 of a long and
int literals, computed on 128-bit integers.
"""

from __future__ import annotations

# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_WORD = 1 << 64


def _u(x: int) -> str:
    return f"{x % _WORD}::UHUGEINT"


def _times(x: str, prime: int) -> str:
    return f"(({x}) * {_u(prime)} % {_WORD}::UHUGEINT)"


def _plus(x: str, n: int) -> str:
    return f"(({x} + {_u(n)}) % {_WORD}::UHUGEINT)"


def _turned(by: int) -> str:
    return f"((h << {by}) % {_WORD}::UHUGEINT + (h >> {64 - by}))"


_LAST = [_times("xor(h, h >> 33)", P2), _times("xor(h, h >> 29)", P3), "xor(h, h >> 32)"]


def hashes(nodes: str, *numbers: int | str) -> str:
    """A query of ``nodes``' columns and h, the signed hash of v and the numbers (int literals or names of int columns)."""
    steps = [_times("v::UHUGEINT", P2), _times(_turned(31), P1), f"xor(h, {_u(42 + P5 + 8)})", _plus(_times(_turned(27), P1), P4), *_LAST]
    for n in numbers:
        steps += [f"xor({_plus('h', P5 + 4)}, {_times(f'{n}::UHUGEINT', P1)})", _plus(_times(_turned(23), P2), P3), *_LAST]
    steps.append(f"CASE WHEN h >= {_WORD // 2}::UHUGEINT THEN h::HUGEINT - {_WORD}::HUGEINT ELSE h::HUGEINT END")
    query = f"SELECT *, {steps[0]} AS h FROM {nodes}"
    for step in steps[1:]:
        query = f"SELECT * REPLACE ({step} AS h) FROM ({query})"
    return query


def greedy_colors(name: str, nodes: str = "vertices", pairs: str = "pairs", seed: int = 1) -> str:
    """CTEs ending in ``name`` (v, color): uncoloured nodes whose hash beats their uncoloured neighbours' take the least free colour."""
    return f"""{name}_rank AS ({hashes(nodes, seed)}), {name}_round AS (
SELECT 0 AS k, v, h, -1 AS color FROM {name}_rank UNION ALL
SELECT c.k + 1, c.v, c.h, CASE WHEN c.color >= 0 THEN c.color WHEN coalesce(beaten, false) THEN -1 ELSE coalesce(list_min(list_filter(range(0, len(used) + 1), lambda x: NOT list_contains(used, x))), 0) END
FROM {name}_round c LEFT JOIN (SELECT m.v, bool_or(o.color < 0 AND o.h > m.h) AS beaten, list(o.color) AS used FROM {pairs} JOIN {name}_round m ON m.v = src JOIN {name}_round o ON o.v = dst GROUP BY m.v) n ON n.v = c.v
WHERE EXISTS (SELECT 1 FROM {name}_round WHERE color < 0)),
{name} AS (SELECT v, color::INT AS color FROM {name}_round WHERE k = (SELECT max(k) FROM {name}_round))"""


def max_min_colors(name: str, nodes: str = "vertices", pairs: str = "pairs", n_colors: int = 16, n_hashes: int = 2, seed: int = 1) -> str:
    """CTEs ending in ``name`` (v, color): local maxima and minima of each hash take the next two colours, the rest the last."""
    rounds = n_hashes * max(1, n_colors // 4)
    return f"""{name}_rank AS ({hashes(f"(SELECT v, k FROM {nodes}, range({rounds}) t(k))", seed, "k")}), {name}_round AS (
SELECT 0 AS k, v, -1 AS color FROM {nodes} UNION ALL
SELECT c.k + 1, c.v, CASE WHEN c.color >= 0 THEN c.color WHEN n.own IS NULL OR n.own > n.most THEN 2 * c.k WHEN n.own < n.least THEN 2 * c.k + 1 ELSE -1 END
FROM {name}_round c LEFT JOIN (SELECT m.v, any_value(a.h) AS own, max(b.h) AS most, min(b.h) AS least
  FROM {pairs} JOIN {name}_round m ON m.v = src AND m.color < 0 JOIN {name}_round o ON o.v = dst AND o.color < 0 JOIN {name}_rank a ON a.v = src AND a.k = m.k JOIN {name}_rank b ON b.v = dst AND b.k = m.k GROUP BY m.v) n ON n.v = c.v
WHERE c.k < {rounds}),
{name} AS (SELECT v, CASE WHEN color < 0 THEN {2 * rounds} ELSE color END::INT AS color FROM {name}_round WHERE k = {rounds})"""


def balanced_colors(name: str, start: str, nodes: str = "vertices", pairs: str = "pairs", least_used: bool = False, seed: int = 1, rounds: int = 20) -> str:
    """CTEs ending in ``name`` (v, color): the colouring ``start`` with over-full colours emptied towards the mean."""
    many = f"(SELECT v, k FROM {nodes}, range({rounds}) t(k))"
    state = f"{name}_round"
    return f"""{name}_rank AS ({hashes(many, seed, "k")}), {name}_draw AS ({hashes(many, seed + 1, "k")}), {state} AS (
SELECT 0 AS k, v, color, false AS done FROM {start} UNION ALL
SELECT * FROM (WITH counts AS (SELECT color, count(*) AS n FROM {state} GROUP BY color), room AS (SELECT (sum(n) + count(*) - 1) // count(*) AS room FROM counts),
below AS (SELECT list(color ORDER BY {"n, " if least_used else ""}color) FILTER (n < room) AS below FROM counts, room),
over AS (SELECT s.v, s.k, r.h FROM {state} s JOIN counts USING (color) JOIN {name}_rank r ON r.v = s.v AND r.k = s.k, room WHERE n > room),
beaten AS (SELECT DISTINCT a.v FROM {pairs} JOIN over a ON a.v = src JOIN over b ON b.v = dst AND b.h > a.h),
used AS (SELECT src AS v, list(color) AS used FROM {pairs} JOIN {state} s ON s.v = dst GROUP BY src),
asking AS (SELECT over.v, k, list_filter(coalesce(below, []), lambda c: NOT list_contains(coalesce(used, []), c))[1] AS target FROM over LEFT JOIN used ON used.v = over.v, below WHERE over.v NOT IN (SELECT v FROM beaten)),
wanted AS (SELECT target, count(*) AS asked FROM asking WHERE target IS NOT NULL GROUP BY target),
moved AS (SELECT a.v, a.target FROM asking a JOIN wanted USING (target) JOIN counts ON counts.color = a.target JOIN {name}_draw d ON d.v = a.v AND d.k = a.k, room
  WHERE ((d.h % 1048576) + 1048576) % 1048576 < least(1.0::DOUBLE, (room - n)::DOUBLE / asked) * 1048576)
SELECT s.k + 1 AS k, s.v, coalesce(moved.target, s.color) AS color, NOT EXISTS (SELECT 1 FROM wanted) AS done FROM {state} s LEFT JOIN moved ON moved.v = s.v WHERE NOT s.done AND s.k < {rounds})),
{name} AS (SELECT v, color::INT AS color FROM {state} WHERE k = (SELECT max(k) FROM {state}))"""


#: Breadth-first levels from each component's vertex of least degree; ``pairs`` and ``vertices`` are given.
RCM = """reach AS (SELECT v, v AS r FROM vertices UNION SELECT reach.v, dst FROM reach JOIN pairs ON r = src),
held AS (SELECT v, component, count(src) AS degree FROM (SELECT v, min(r) AS component FROM reach GROUP BY v) LEFT JOIN pairs ON src = v GROUP BY v, component),
walk AS (SELECT 0 AS k, v, CASE WHEN row_number() OVER (PARTITION BY component ORDER BY degree, v) = 1 THEN 0 END AS level FROM held UNION ALL
SELECT w.k + 1, w.v, CASE WHEN w.level IS NOT NULL THEN w.level WHEN w.v IN (SELECT dst FROM pairs JOIN walk f ON f.v = src WHERE f.level IS NOT NULL) THEN w.k + 1 END FROM walk w WHERE EXISTS (SELECT 1 FROM walk WHERE level = k))
SELECT v, component, level, row_number() OVER (ORDER BY component DESC, level DESC, degree DESC, v DESC) - 1 AS place FROM walk JOIN held USING (v) WHERE k = (SELECT max(k) FROM walk)"""


def louvain(method: str = "none", warm: bool = False, directed: bool = False, early: bool = False, percent: int = 100, redraw: bool = False, c_threshold: float = 1e-6, threshold: float = 1e-9) -> str:
    """CTEs ending in ``found`` (v, community, modularity): all phases of Louvain, a row of ``state`` for each vertex and step.

    ``method`` says who moves in a step: "none" all nodes, "matched" those whose gain (then least node) is the first at both communities that their move touches, the others a colour. "greedy",
    "balanced" and "max_min" colour the first phase only, which is right for graphs of at most ``min_graph_size`` vertices;
    "greedy_all" colours every phase until one gains nothing; "turns" colours all phases but judges them as uncoloured ones.
    ``warm`` starts at the CTE ``assign``. Steps read the given edges: ``node`` is a vertex's node in the phase's coarse graph.
    A step with a null ``color`` colours nodes and leaves all else as it is.
    """
    use_color, precolored, matched = method in ("greedy", "balanced", "max_min", "greedy_all"), method in ("balanced", "max_min"), method == "matched"
    in_turns = "true" if method in ("turns", "matched") else "use_color"
    recolored = method in ("greedy", "greedy_all", "turns")
    if warm:
        start = "start AS (SELECT nodes.v, nodes.v AS node, min(nodes.v) OVER (PARTITION BY coalesce(community, nodes.v)) AS own FROM nodes LEFT JOIN assign ON nodes.v = assign.v)"
    elif directed:
        start = "start AS (SELECT v, v AS node, v AS own FROM nodes)"
    else:
        start = """fan AS (SELECT src AS v, count(*) AS n, min(dst) AS only_v FROM edges GROUP BY src),
start AS (SELECT v, f AS node, f AS own FROM (SELECT a.v, CASE WHEN a.n = 1 AND (b.n > 1 OR a.v > a.only_v) THEN a.only_v ELSE a.v END AS f FROM fan a JOIN fan b ON a.only_v = b.v))"""
    colors = f"rank AS ({hashes('nodes', 1)}), " if recolored else ""
    if precolored:
        colors = "first_nodes AS (SELECT DISTINCT node AS v FROM start), first_pairs AS (SELECT DISTINCT a.node AS src, b.node AS dst FROM edges JOIN start a ON src = a.v JOIN start b ON dst = b.v WHERE a.node <> b.node), "
        found = max_min_colors("turns", "first_nodes", "first_pairs") if method == "max_min" else greedy_colors("plain", "first_nodes", "first_pairs") + ", " + balanced_colors("turns", "plain", "first_nodes", "first_pairs")
        colors += found + ", "
    color = "NULL::INT" if recolored else "turn_of" if precolored else "0"
    origin = "start JOIN (SELECT v AS turn_v, (dense_rank() OVER (ORDER BY color) - 1)::INT AS turn_of FROM turns) ON turn_v = node" if precolored else "start"
    chosen = "NOT frozen"
    if method not in ("none", "matched"):
        chosen += f" AND (NOT {in_turns} OR info.color = info.turn)"
    if percent < 100:
        share = "round" if redraw else "least(round, 1)"
        chosen += f" AND ((info.node % 2147483648) * 2654435761::HUGEINT + {share} * {40503 * 65537}::HUGEINT) % 4294967296 < {percent * (1 << 32) // 100}"
    swap = "" if matched else " AND NOT (to_size = 1 AND at_size = 1 AND c > own)"
    first = """ WHERE node = (SELECT arg_min(w.node, (-w.gain, w.node)) FROM wanted w WHERE w.own IN (p.own, p.c) OR w.c IN (p.own, p.c))""" if matched else ""
    next_turn = f"(l.turn + 1) % CASE WHEN l.{in_turns} THEN (SELECT max(color) + 1 FROM live) ELSE 1 END".replace("l.true", "true")
    columns = "v, node, own, cur, before, best, color, still, frozen, phase, round, turn, prev, outer_q, use_color, done"
    paint = f"""UNION ALL SELECT {columns.replace("color,", "CASE WHEN color IS NOT NULL THEN color WHEN coalesce(beaten, false) THEN NULL ELSE coalesce(list_min(list_filter(range(0, len(used) + 1), lambda x: NOT list_contains(used, x))), 0) END::INT AS color,", 1)} FROM (SELECT * FROM state WHERE NOT done AND EXISTS (SELECT 1 FROM state WHERE {in_turns} AND color IS NULL)) l
LEFT JOIN (SELECT a.node AS n_node, bool_or(b.color IS NULL AND rb.h > ra.h) AS beaten, coalesce(list(b.color) FILTER (b.color IS NOT NULL), []) AS used
  FROM edges JOIN state a ON src = a.v JOIN state b ON dst = b.v JOIN rank ra ON ra.v = a.node JOIN rank rb ON rb.v = b.node WHERE a.node <> b.node GROUP BY a.node) n ON n_node = l.node""" if recolored else ""
    return f"""nodes AS (SELECT src AS v FROM edges UNION SELECT dst FROM edges), {start}, {colors}
whole AS (SELECT sum(weight) AS real, sum(weight) / {2 if directed else 1} AS m2 FROM edges),
state AS (SELECT v, node, own, own AS cur, own AS before, own AS best, {color} AS color, 0 AS still, false AS frozen, 0 AS phase, 0 AS round, 0 AS turn, -1::DOUBLE AS prev, NULL::DOUBLE AS outer_q, {str(use_color).lower()} AS use_color, false AS done FROM {origin} UNION ALL
SELECT * FROM (WITH live AS (SELECT * FROM state WHERE NOT done AND NOT EXISTS (SELECT 1 FROM state WHERE {in_turns} AND color IS NULL)),
ends AS (SELECT a.node, b.node AS node_to, a.own, b.own AS c, weight FROM edges JOIN live a ON src = a.v JOIN live b ON dst = b.v),
sums AS (SELECT own, sum(weight) AS a, coalesce(sum(weight) FILTER (own = c), 0) AS inside FROM ends GROUP BY own),
quality AS (SELECT sum(inside) / any_value(m2) - sum((a / m2) * (a / m2)) AS now FROM sums, whole),
verdict AS (SELECT now, turn = 0 AND round > 0 AND now - prev < CASE WHEN use_color THEN {c_threshold} ELSE {threshold} END AS ended, {in_turns} AND now > prev AS keep, CASE WHEN {in_turns} AND now > prev THEN now ELSE prev END AS q, coalesce(outer_q, now) AS outer_q FROM (SELECT * FROM live LIMIT 1), quality),
decision AS (SELECT *, ended AND q - outer_q > {threshold} AS gained FROM verdict),
degrees AS (SELECT node, sum(weight) AS degree, coalesce(sum(weight) FILTER (node = node_to), 0) AS loop FROM ends GROUP BY node),
info AS (SELECT l.*, dense_rank() OVER (ORDER BY l.node) - 1 AS place, coalesce(degree, 0) AS degree, coalesce(loop, 0) AS loop FROM (SELECT DISTINCT node, own, color, frozen, round, turn, use_color FROM live) l LEFT JOIN degrees ON degrees.node = l.node),
sizes AS (SELECT own AS c, count(*) AS size, sum(degree) AS a FROM info GROUP BY own),
near AS (SELECT node, c, sum(weight) AS e FROM ends GROUP BY node, c),
gains AS (SELECT info.node, info.own, place, turn, near.c, t.size AS to_size, s.size AS at_size, CASE WHEN near.c = info.own THEN 0 ELSE round(2 * (near.e - (coalesce(o.e, 0) - loop)) - 2 * degree * (t.a - (s.a - degree)) / m2, 12) END AS gain
  FROM info JOIN near ON near.node = info.node LEFT JOIN near o ON o.node = info.node AND o.c = info.own JOIN sizes t ON t.c = near.c JOIN sizes s ON s.c = info.own, whole WHERE {chosen}),
pick AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, c) = 1),
wanted AS (SELECT * FROM pick WHERE gain > 0{swap}),
moves AS (SELECT node, c FROM wanted p{first}),
next AS (SELECT l.*, coalesce(moves.c, l.own) AS moved, CASE WHEN l.turn = 0 THEN l.own ELSE l.before END AS held, CASE WHEN d.keep THEN l.own ELSE l.before END AS result, d.now, d.ended, d.gained, d.q, d.outer_q AS seen, {next_turn} AS next_turn FROM live l LEFT JOIN moves ON moves.node = l.node, decision d),
stay AS (SELECT *, CASE WHEN gained THEN result WHEN use_color AND q > seen THEN result ELSE cur END AS again, {str(warm).lower()} AND phase = 0 AS goes_on, CASE WHEN next_turn > 0 THEN still WHEN moved = held{" AND node NOT IN (SELECT node FROM wanted)" if matched else ""} THEN still + 1 ELSE 0 END AS stayed FROM next)
SELECT v, CASE WHEN ended AND (gained OR NOT use_color) THEN again ELSE node END AS node, CASE WHEN ended THEN again ELSE moved END AS own, CASE WHEN ended THEN again ELSE cur END AS cur,
  CASE WHEN ended THEN again ELSE held END AS before, CASE WHEN gained THEN result ELSE best END AS best, CASE WHEN ended AND {str(recolored or precolored).lower()} THEN NULL ELSE color END AS color,
  CASE WHEN ended THEN 0 ELSE stayed END AS still, NOT ended AND {str(early).lower()} AND (frozen OR (next_turn = 0 AND stayed >= 2 AND round > 1)) AS frozen,
  CASE WHEN ended THEN phase + 1 ELSE phase END AS phase, CASE WHEN ended THEN 0 WHEN next_turn = 0 THEN round + 1 ELSE round END AS round, CASE WHEN ended THEN 0 ELSE next_turn END AS turn,
  CASE WHEN ended THEN -1 WHEN turn = 0 THEN now ELSE prev END AS prev, CASE WHEN gained THEN q ELSE seen END AS outer_q, use_color AND (NOT ended OR ({str(method == "greedy_all").lower()} AND gained)) AS use_color, ended AND NOT gained AND NOT use_color AND NOT goes_on AS done FROM stay
{paint})),
final AS (SELECT v, min(v) OVER (PARTITION BY best) AS community FROM state WHERE done),
by_community AS (SELECT a.community, sum(weight) AS a, coalesce(sum(weight) FILTER (a.community = b.community), 0) AS inside FROM edges JOIN final a ON src = a.v JOIN final b ON dst = b.v GROUP BY a.community),
found AS (SELECT final.v, community, modularity FROM final, (SELECT sum(inside) / any_value(real) - sum((a / real) * (a / real)) AS modularity FROM by_community, whole))"""
