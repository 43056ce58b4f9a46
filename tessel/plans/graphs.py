"""Queries of paths, cycles and beams over a graph of parts: a part leads to up to two others, by its size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths as P
from .catalog import query

#: rules by which parts lead on, as (kind, largest size for the first, size digit below which the second holds)
SPARSE, FULL = ((0, 20, 4), (1, 30, 2)), ((0, 40, 8), (1, 50, 5))
STEPS = {5: 1, 3: 7}


def leads_sql(rules) -> str:
    lead = "SELECT {kind} AS kind, p_partkey AS src, 1 + (p_partkey * {by} + {plus}) % n AS dst FROM part, (SELECT max(p_partkey) AS n FROM part) WHERE {when}"
    return " UNION ".join(lead.format(kind=k, by=by, plus=STEPS[by], when=w) for k, a, b in rules for by, w in ((5, f"p_size <= {a}"), (3, f"p_size % 10 < {b}")))


def leads(part, rules):
    rows = part.join(F.broadcast(part.agg(F.max("p_partkey").alias("n"))))  # one row
    edge = lambda kind, by, when: rows.where(when).select(F.lit(kind).alias("kind"), F.col("p_partkey").alias("src"), (1 + (F.col("p_partkey") * by + STEPS[by]) % F.col("n")).alias("dst"))
    parts = [edge(k, by, w) for k, a, b in rules for by, w in ((5, f"p_size <= {a}"), (3, f"p_size % 10 < {b}"))]
    return reduce(DataFrame.unionByName, parts)


SHOW = "array_to_string(list_transform({0}, lambda v: v::varchar), '>')"


def shown(path):
    return F.array_join(F.transform(path, lambda v: v.cast("string")), ">")


MAXIMAL = f"""
WITH RECURSIVE e AS ({{edges}}), s AS (SELECT DISTINCT kind, src AS node FROM e), free AS (SELECT * FROM s ANTI JOIN (SELECT kind, dst AS node FROM e) USING (kind, node)),
p(kind, path) AS (
  SELECT kind, [node] FROM (SELECT * FROM free UNION ALL SELECT * FROM s WHERE kind NOT IN (SELECT kind FROM free))
  UNION ALL SELECT p.kind, list_append(p.path, e.dst) FROM p JOIN e ON e.kind = p.kind AND e.src = p.path[-1] WHERE NOT list_contains(p.path, e.dst)
)
SELECT kind, {SHOW.format("path")} AS path, len(path)::int AS nodes FROM p
WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind = p.kind AND e.src = p.path[-1] AND NOT list_contains(p.path, e.dst))"""


@query("flow_paths", "part", sql=MAXIMAL.format(edges=leads_sql(SPARSE)))
def _(p):
    return P.maximal_paths(leads(p, SPARSE)).select("kind", shown("path").alias("path"), F.size("path").alias("nodes"))


@query("attack_paths", "part", sql="SELECT path, nodes FROM (" + MAXIMAL.format(edges=f"SELECT kind, src, dst FROM ({leads_sql(SPARSE)}) WHERE dst % 4 <> 0") + ") ORDER BY path, nodes LIMIT 20")
def _(p):
    flagged = leads(p, SPARSE).where("dst % 4 <> 0")
    return P.maximal_paths(flagged).select(shown("path").alias("path"), F.size("path").alias("nodes")).orderBy("path", "nodes").limit(20)


@query("graph_cycles", "part", sql=f"""
WITH RECURSIVE e AS ({leads_sql(FULL)}), p(kind, way) AS (SELECT kind, [src, dst] FROM e WHERE dst > src
  UNION ALL SELECT p.kind, list_append(p.way, e.dst) FROM p JOIN e ON e.kind = p.kind AND e.src = p.way[-1] WHERE e.dst > p.way[1] AND NOT list_contains(p.way, e.dst) AND len(p.way) < 8)
SELECT p.kind, {SHOW.format("way")} AS cycle, len(way)::int AS nodes FROM p JOIN e ON e.kind = p.kind AND e.src = p.way[-1] AND e.dst = p.way[1] WHERE len(way) >= 3""")
def _(p):
    graph = leads(p, FULL)
    return P.cycles(graph, 8).select("kind", shown("cycle").alias("cycle"), F.size("cycle").alias("nodes"))


def beam_sql(steps: int, width: int) -> str:
    score = "round({0} + coalesce((dst % 97) / 97.0::double, 0), 6)"
    place = "row_number() OVER (PARTITION BY beam ORDER BY score DESC, path) AS place"
    parts = [f"b0 AS (SELECT * FROM (SELECT beam, path, score, {place} FROM (SELECT p_partkey // 20 % 5 AS beam, [p_partkey] AS path, round((p_partkey % 97) / 97.0::double, 6) AS score FROM part WHERE p_partkey % 20 = 0)) WHERE place <= {width})"]
    for k in range(1, steps + 1):
        grown = f"SELECT beam, list_append(path, dst) AS path, {score.format('score')} AS score FROM b{k - 1} JOIN (SELECT DISTINCT src, dst FROM e) e ON e.src = path[-1] WHERE NOT list_contains(path, dst)"
        parts.append(f"b{k} AS (SELECT * FROM (SELECT beam, path, score, {place} FROM ({grown})) WHERE place <= {width})")
    every = " UNION ALL ".join(f"SELECT beam, {k}::int AS step, place::int AS place, {SHOW.format('path')} AS path, score FROM b{k}" for k in range(steps + 1))
    return f"WITH e AS ({leads_sql(FULL)}), {', '.join(parts)} {every}"


@query("beam_search", "part", sql=beam_sql(5, 10))
def _(p):
    gain = lambda c: (F.col(c) % 97) / 97.0
    seeds = p.where("p_partkey % 20 = 0").select((F.floor(F.col("p_partkey") / 20) % 5).alias("beam"), F.col("p_partkey").alias("node"))
    found = P.beam(seeds, leads(p, FULL), p.select(F.col("p_partkey").alias("node"), gain("p_partkey").alias("gain")), 10, 5)
    return found.select("beam", "step", "place", shown("path").alias("path"), "score")
