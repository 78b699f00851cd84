"""Queries of claim lineage over rounds of migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.operators import lineage as L
from tracequill.session import written

from . import fixtures as X

ROUNDS = 5


def _rounds(spark, sf):
    """Claims of a case over five rounds: some merge into their neighbour, some split, some retire, and some cases gain one.

    Returns (edges, claims): case_id, round, ref, old_ref and case_id, round, ref; refs are numbers.
    """
    claims = X.units(spark, sf).select("case_id", F.lit(0).alias("round"), F.col("pos").cast("long").alias("ref"))
    claims = written(spark, claims, "round")
    every, edges, gained = claims, None, claims.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    for r in range(1, ROUNDS + 1):
        a = F.col("old_ref")
        lived = claims.select("case_id", F.col("ref").alias("old_ref")).filter((a * 5 + r) % 13 != 0)
        to = F.when((a * 7 + r * 11) % 3 == 0, a - a % 2).otherwise(a)
        targets = F.when((a * 3 + r) % 17 == 0, F.array(to, a + 100000 * r)).otherwise(F.array(to))
        own = written(spark, lived.select("case_id", F.lit(r).alias("round"), F.explode(targets).alias("ref"), "old_ref"), "round")
        edges = own if edges is None else edges.unionByName(own)
        new = gained.filter(F.col("n") % (r + 2) == 0).select("case_id", F.lit(r).alias("round"), F.lit(900000 + r).cast("long").alias("ref"))
        claims = own.select("case_id", "round", "ref").unionByName(new).distinct()
        every = every.unionByName(claims)
    return edges, every


def j19_origins(spark, sf):
    edges, claims = _rounds(spark, sf)
    found = L.origins(edges, claims.filter(F.col("round") == ROUNDS))
    named = F.concat(F.col("origin_round").cast("string"), F.lit(":"), F.col("origin_ref").cast("string"))
    return found.groupBy("case_id", "ref").agg(F.array_join(F.array_sort(F.collect_set(named)), ",").alias("origins"))


def j14_migration_errors(spark, sf):
    """Entries of the first round, some with an unknown or a repeated claim, some of the wrong kind; half of the retired claims are registered."""
    edges, claims = _rounds(spark, sf)
    first = edges.filter("round = 1")
    name = lambda c: F.concat(F.lit("E"), c.cast("string"))
    n = F.col("ref")
    entries = first.groupBy("case_id", "ref").agg(F.array_sort(F.collect_list("old_ref")).alias("o")).select(
        "case_id", name(n).alias("entry_id"), F.when(F.size("o") > 1, "merged").when(n % 12 == 1, "split").otherwise("rewritten").alias("kind"),
        F.concat(F.transform("o", lambda x: name(x)), F.when(n % 10 == 3, F.array(F.lit("E999999"))).when(n % 14 == 5, F.array(name(n - 1))).otherwise(F.array().cast("array<string>"))).alias("old_refs"), F.array(name(n)).alias("new_refs"),
    )
    gone = claims.filter("round = 0").select("case_id", F.col("ref").alias("old_ref")).join(first.select("case_id", "old_ref"), ["case_id", "old_ref"], "left_anti").filter("old_ref % 2 = 0")
    retired = gone.select("case_id", F.concat(F.lit("R"), F.col("old_ref").cast("string")).alias("entry_id"), F.lit("retired").alias("kind"), F.array(name(F.col("old_ref"))).alias("old_refs"), F.array().cast("array<string>").alias("new_refs"))
    side = lambda r, sources: claims.filter(F.col("round") == r).select("case_id", name(n).alias("ref"), sources.alias("source_ids"))
    old = side(0, F.array(n, n + 1))
    new = side(1, F.when(n % 8 == 0, F.array(n + 7)).otherwise(F.array(n, n + 1)))
    return L.migration_errors(entries.unionByName(retired), old, new)


QUERIES = {"j19_origins": j19_origins, "j14_migration_errors": j14_migration_errors}


def _sql() -> str:
    parts = [f"{X.UNITS}, cnt AS (SELECT case_id, count(*) AS n FROM units GROUP BY case_id), c0 AS (SELECT case_id, pos::BIGINT AS ref FROM units)"]
    for r in range(1, ROUNDS + 1):
        to = f"CASE WHEN (ref * 7 + {r * 11}) % 3 = 0 THEN ref - ref % 2 ELSE ref END"
        parts.append(f"e{r} AS (SELECT case_id, unnest(CASE WHEN (ref * 3 + {r}) % 17 = 0 THEN [{to}, ref + {100000 * r}] ELSE [{to}] END) AS ref, ref AS old_ref FROM c{r - 1} WHERE (ref * 5 + {r}) % 13 <> 0)")
        parts.append(f"c{r} AS (SELECT case_id, ref FROM e{r} UNION SELECT case_id, {900000 + r} FROM cnt WHERE n % {r + 2} = 0)")
    return ",\n".join(parts)


_EDGES = " UNION ALL ".join(f"SELECT case_id, {r} AS round, ref, old_ref FROM e{r}" for r in range(1, ROUNDS + 1))
ORACLE = {
    "j19_origins": f"""WITH RECURSIVE {_sql()}, ed AS ({_EDGES}),
up(case_id, ref, round, at_) AS (SELECT case_id, ref, {ROUNDS}, ref FROM c{ROUNDS} UNION SELECT up.case_id, up.ref, up.round - 1, ed.old_ref FROM up JOIN ed ON ed.case_id = up.case_id AND ed.round = up.round AND ed.ref = up.at_),
tip AS (SELECT DISTINCT case_id, ref, round || ':' || at_ AS o FROM up WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.case_id = up.case_id AND ed.round = up.round AND ed.ref = up.at_))
SELECT case_id, ref, string_agg(o, ',' ORDER BY o) AS origins FROM tip GROUP BY ALL""",
    "j14_migration_errors": f"""WITH {_sql()}, g AS (SELECT case_id, ref, list_sort(list(old_ref)) AS o FROM e1 GROUP BY ALL),
en AS (SELECT case_id, 'E' || ref AS entry, CASE WHEN len(o) > 1 THEN 'merged' WHEN ref % 12 = 1 THEN 'split' ELSE 'rewritten' END AS kind, list_concat(list_transform(o, lambda x: 'E' || x), CASE WHEN ref % 10 = 3 THEN ['E999999'] WHEN ref % 14 = 5 THEN ['E' || (ref - 1)] ELSE [] END) AS olds, ['E' || ref] AS news, ref FROM g
  UNION ALL SELECT case_id, 'R' || ref, 'retired', ['E' || ref], [], ref FROM c0 ANTI JOIN (SELECT case_id, old_ref AS ref FROM e1) USING (case_id, ref) WHERE ref % 2 = 0),
xo AS (SELECT case_id, x, count(*) AS n FROM (SELECT case_id, unnest(olds) AS x FROM en) GROUP BY ALL), xn AS (SELECT case_id, x, count(*) AS n FROM (SELECT case_id, unnest(news) AS x FROM en) GROUP BY ALL),
ko AS (SELECT case_id, 'E' || ref AS x FROM c0), kn AS (SELECT case_id, 'E' || ref AS x FROM c1)
SELECT case_id, 'unknown_old' AS error, x AS subject FROM xo ANTI JOIN ko USING (case_id, x) UNION ALL SELECT case_id, 'repeated_old', x FROM xo WHERE n > 1 UNION ALL SELECT case_id, 'missing_old', x FROM ko ANTI JOIN xo USING (case_id, x)
UNION ALL SELECT case_id, 'unknown_new', x FROM xn ANTI JOIN kn USING (case_id, x) UNION ALL SELECT case_id, 'repeated_new', x FROM xn WHERE n > 1 UNION ALL SELECT case_id, 'missing_new', x FROM kn ANTI JOIN xn USING (case_id, x)
UNION ALL SELECT case_id, 'cardinality', entry FROM en WHERE NOT CASE kind WHEN 'rewritten' THEN len(olds) = 1 AND len(news) = 1 WHEN 'split' THEN len(olds) = 1 AND len(news) >= 2 WHEN 'merged' THEN len(olds) >= 2 AND len(news) = 1 ELSE len(olds) >= 1 AND len(news) = 0 END
UNION ALL SELECT m.case_id, 'no_overlap', m.entry || ':' || m.x FROM (SELECT case_id, entry, ref, unnest(olds) AS x FROM en WHERE kind = 'merged' AND len(olds) >= 2) m JOIN ko USING (case_id, x)
  WHERE NOT list_has_any([substr(m.x, 2)::BIGINT, substr(m.x, 2)::BIGINT + 1], CASE WHEN m.ref % 8 = 0 THEN [m.ref + 7] ELSE [m.ref, m.ref + 1] END)""",
}
