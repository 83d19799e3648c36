"""Changed symbols, the callers that reach them, and the nodes between.

A node is a symbol on some simple path from a symbol without callers to a changed one. Outside of cycles that is plain
reachability: what reaches a change and is reached from a root. Symbols on or between cycles (the core that peeling
leaves) need paths: only there, between where paths enter and leave the core, simple paths are spelled out.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators.compare import with_id
from strandline.operators.intervals import compacted, join_ranges
from strandline.scratch import cut, passing, written


@dataclass
class Impact:
    entry_points: DataFrame  # name
    nodes: DataFrame  # name


def changed_lines(added: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, line_no): every symbol that holds an added line."""
    return join_ranges(added.select("path", "line_no"), symbols.select("name", "path", "start_line", "end_line")).select("name", "line_no")


def changed_ranges(added: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, changed_lines): changed symbols with their compacted line ranges."""
    return compacted(changed_lines(added, symbols), "name")


def changed_symbols(changed: DataFrame, symbols: DataFrame, moves: DataFrame) -> DataFrame:
    """Ids of changed symbols, without what moved unchanged."""
    kept = changed.select("name").join(moves.where("body_equal").select("name"), "name", "left_anti")
    return with_id(symbols).join(kept, "name", "left_semi").select("id")


#: Steps that one pass of a loop takes: fewer tables between passes, for some steps taken twice.
HOPS = 4


def _closure(start: DataFrame, steps: DataFrame, name: str) -> DataFrame:
    """Names that `start` reaches over steps (a, b), with itself, frontier by frontier."""
    frontier = cut(start.select("name").distinct(), name)
    reached = frontier
    while not frontier.isEmpty():
        ahead, seen = frontier, None
        for _ in range(HOPS):
            ahead = ahead.join(steps, ahead["name"] == steps["a"]).select(F.col("b").alias("name")).distinct()
            seen = ahead if seen is None else seen.unionByName(ahead)
        frontier = cut(seen.distinct().join(reached, "name", "left_anti"), name)
        reached = reached.unionByName(frontier)
    return reached


def _core(steps: DataFrame) -> DataFrame:
    """Edges that are left when symbols without a caller or without a callee are taken out, again and again."""
    left, n = steps, steps.count()
    while n:
        kept = left
        for _ in range(2):
            kept = kept.join(kept.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
            kept = kept.join(kept.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        kept = cut(kept, "core")
        now = kept.count()
        if now == n:
            break
        left, n = kept, now
    return left


def _on_simple_paths(core: DataFrame, enters: DataFrame, leaves: DataFrame) -> DataFrame:
    """Names on simple paths of core edges from `enters` to `leaves`."""
    first = enters.select(F.col("name").alias("end"), F.array("name").alias("path"), F.lit(0).alias("hop"))
    made = [cut(first, "paths")]
    last = made[0]
    while not last.isEmpty():
        ahead, rows = last, None
        for hop in range(1, HOPS + 1):
            ahead = ahead.join(core, ahead["end"] == core["a"]).where(~F.array_contains("path", F.col("b")))
            ahead = ahead.select(F.col("b").alias("end"), F.concat("path", F.array("b")).alias("path"), F.lit(hop).alias("hop"))
            rows = ahead if rows is None else rows.unionByName(ahead)
        made.append(cut(rows, "paths"))
        last = made[-1].where(F.col("hop") == HOPS)
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    done = every.join(leaves, every["end"] == leaves["name"], "left_semi")
    return done.select(F.explode("path").alias("name")).distinct()


#: Call edges up to which the graph is walked in the driver's memory; beyond, by joins.
LOCAL_EDGES = 200_000


def impact(changed: DataFrame, edges: DataFrame, symbols: DataFrame) -> Impact:
    """Entry points and nodes for changed names. Callers that are no symbol are left out of both. A graph of at most
    LOCAL_EDGES edges is walked at once; a larger one frontier by frontier over tables."""
    spark = edges.sparkSession
    known = symbols.select("name")
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    steps = steps.join(known.select(F.col("name").alias("a")), "a", "left_semi").join(known.select(F.col("name").alias("b")), "b", "left_semi").distinct()
    start = changed.select("name").join(known, "name", "left_semi").distinct()
    with passing(spark) as keep:
        steps, start = cut(steps, "steps"), cut(start, "changed")
        few, asked = steps.limit(LOCAL_EDGES + 1).collect(), start.limit(LOCAL_EDGES + 1).collect()
        if max(len(few), len(asked)) <= LOCAL_EDGES:
            found = walked([(r["a"], r["b"]) for r in few], [r["name"] for r in asked])
            return Impact(*(spark.createDataFrame([(x,) for x in sorted(own)], "name string") for own in found))
        found = _impact_by_joins(start, steps)
        made = [written(df, "impact") for df in (found.entry_points, found.nodes)]
        keep += [path for _, path in made]
    return Impact(*(df for df, _ in made))


def walked(edges: list[tuple[str, str]], changed: list[str]) -> tuple[set[str], set[str]]:
    """Entry points and nodes of a graph in memory."""
    up, down = defaultdict(list), defaultdict(list)
    for a, b in edges:
        up[b].append(a)
        down[a].append(b)

    def reach(start, ahead, inside=None) -> set[str]:
        seen, stack = set(start), list(start)
        while stack:
            for x in ahead[stack.pop()]:
                if x not in seen and (inside is None or x in inside):
                    seen.add(x)
                    stack.append(x)
        return seen

    above = reach(changed, up)
    entry = {x for x in above if not up[x]}
    between = reach(entry, down, above)
    # What is left when symbols without a caller or without a callee are peeled off lies on or between cycles.
    core = set(between)
    for ahead, back in ((up, down), (down, up)):
        degree = {x: sum(y in core for y in ahead[x]) for x in core}
        gone = [x for x, n in degree.items() if not n]
        while gone:
            x = gone.pop()
            core.discard(x)
            for y in back[x]:
                if y in core:
                    degree[y] -= 1
                    if not degree[y]:
                        gone.append(y)
    if not core:
        return entry, between
    asked = set(changed)
    leaves = {x for x in core if x in asked or any(y in between and y not in core for y in down[x])}
    on_path: set[str] = set()
    for enter in (x for x in core if any(y in between and y not in core for y in up[x])):
        path, held, todo = [enter], {enter}, [iter(down[enter])]
        while todo:  # every simple path inside the core from here
            if path[-1] in leaves:
                on_path.update(path)
            step = next((y for y in todo[-1] if y in core and y not in held), None)
            if step is None:
                todo.pop()
                held.discard(path.pop())
            else:
                path.append(step)
                held.add(step)
                todo.append(iter(down[step]))
    return entry, (between - core) | on_path


def _impact_by_joins(names_changed: DataFrame, steps: DataFrame) -> Impact:
    above = cut(_closure(names_changed, steps.select(F.col("b").alias("a"), F.col("a").alias("b")), "above"), "above")
    entry = cut(above.join(steps.select(F.col("b").alias("name")), "name", "left_anti"), "entry")
    inside = steps.join(above.select(F.col("name").alias("a")), "a", "left_semi").join(above.select(F.col("name").alias("b")), "b", "left_semi")
    inside = cut(inside, "inside")
    between = cut(_closure(entry, inside, "between"), "between")
    inside = cut(inside.join(between.select(F.col("name").alias("a")), "a", "left_semi"), "inside")
    core = _core(inside)
    in_core = cut(core.select(F.col("a").alias("name")).unionByName(core.select(F.col("b").alias("name"))).distinct(), "in_core")
    if in_core.isEmpty():
        return Impact(entry, between)
    plain = between.join(in_core, "name", "left_anti")
    into = inside.join(in_core.select(F.col("name").alias("a")), "a", "left_anti").select(F.col("b").alias("name"))
    out = inside.join(in_core.select(F.col("name").alias("b")), "b", "left_anti").select(F.col("a").alias("name"))
    enters = in_core.join(into, "name", "left_semi")
    leaves = in_core.join(out.unionByName(names_changed), "name", "left_semi")
    return Impact(entry, plain.unionByName(_on_simple_paths(core, enters, cut(leaves, "leaves"))))


def chains(changed: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chain): every simple path from a symbol without callers to a changed one, callers first, joined by `->`. There can
    be exponentially many; the report itself needs none of them."""
    known = symbols.select("name")
    steps = edges.select("src", "dst").join(known.select(F.col("name").alias("src")), "src", "left_semi").distinct()
    start = changed.select("name").join(known, "name", "left_semi").distinct()
    last = cut(start.select(F.col("name").alias("head"), F.array("name").alias("path"), F.lit(0).alias("hop")), "chains")
    made = [last]
    while not last.isEmpty():
        ahead, rows = last, None
        for hop in range(1, HOPS + 1):
            ahead = ahead.join(steps, ahead["head"] == steps["dst"]).where(~F.array_contains("path", F.col("src")))
            ahead = ahead.select(F.col("src").alias("head"), F.concat(F.array("src"), "path").alias("path"), F.lit(hop).alias("hop"))
            rows = ahead if rows is None else rows.unionByName(ahead)
        made.append(cut(rows, "chains"))
        last = made[-1].where(F.col("hop") == HOPS)
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    roots = every.join(steps.select(F.col("dst").alias("head")), "head", "left_anti")
    return roots.select(F.array_join("path", "->").alias("chain")).distinct()


def node_calls(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, to_id, site_path, site_line): calls between nodes."""
    ids = with_id(symbols, "to_id").select(F.col("name").alias("dst"), "to_id")
    own = edges.join(nodes.select(F.col("name").alias("src")), "src", "left_semi")
    own = own.join(nodes.select(F.col("name").alias("dst")), "dst", "left_semi").join(ids, "dst")
    return own.select(F.col("src").alias("name"), "to_id", "site_path", "site_line")


def node_records(nodes: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes with their place, kind and changed lines."""
    rows = with_id(symbols).join(nodes, "name", "left_semi").join(changed, "name", "left")
    name = F.col("name")
    return rows.select(
        "id", "path", name, names.short_name(name).alias("short"), names.node_kind(name).alias("kind"), "start_line", "end_line",
        F.col("changed_lines").isNotNull().alias("changed"), "changed_lines", names.package(name).alias("package"),
    )
