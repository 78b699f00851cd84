"""Preference pairs: one prompt, two masked completions. DataFrame functions only.

The longest common turn prefix (equal role and text) of a pair's chosen and
rejected conversations is rendered once as prompt; what follows is rendered as two
completions with masks, the code-point ranges of a completion that are trained on:
assistant text with its end mark. Markers that occur in a text are escaped.

Turns come in order of turn number (null last), then role, then text, so ties and
repeated rows have a defined place; null role is ``user``, null text is empty.
Every pair gives a row: ``status`` is ``ok``, ``identical`` (no difference),
``unpaired`` (a side has no turns) or ``untrained`` (a completion has no assistant
turn). Rows without a pair or side end in the pair of null as ``unpaired``. An
empty table gives an empty result; extra columns are ignored. A conversation is
one text, so its turns meet in one row by nature; pairs are dealt by pair id. Offsets
of n turns are running sums in blocks, about n ** (4/3) steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.functions import folds

END = "<|end|>"
TRAINED_ROLE = "assistant"


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _side(turns: str) -> str:
    """SQL for struct(text, mask, trained) of an array of turns (struct with role and text)."""
    head = "concat('<|', t.role, '|>\\n')"
    tail = f"concat(t.text, '{END}')"
    starts = folds.sums_before(f"transform({turns}, t -> cast(length({head}) + length({tail}) + 1 AS bigint))")
    ranges = f"zip_with({turns}, {starts}, (t, at) -> IF(t.role = '{TRAINED_ROLE}', concat(at + length({head}), ':', at + length({head}) + length({tail})), NULL))"
    return (
        f"named_struct('text', array_join(transform({turns}, t -> concat({head}, {tail}, '\\n')), ''), "
        f"'mask', array_join({ranges}, ','))"
    )


def _turn() -> Column:
    return F.struct(
        F.col("turn").isNull().alias("no_turn"),
        F.col("turn"),
        _escaped(F.coalesce("role", F.lit("user"))).alias("role"),
        _escaped(F.coalesce("text", F.lit(""))).alias("text"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, side (``chosen`` or ``rejected``), turn, role, text."""
    sides = (F.array_sort(F.collect_list(F.when(F.col("side") == side, _turn()))).alias(side[0]) for side in ("chosen", "rejected"))
    return formatted(turns.groupBy("pair_id").agg(*sides))


def formatted(paired: DataFrame) -> DataFrame:
    """``paired``: pair_id and the ordered turns ``c`` and ``r``; no shuffle."""
    shared = F.expr(
        "array_position(zip_with(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r))), "
        "(x, y) -> x.role = y.role AND x.text = y.text), false)"
    )
    n = F.when(shared == 0, F.least(F.size("c"), F.size("r"))).otherwise(shared - 1).cast("int")
    cut = paired.withColumn("n_prompt_turns", n).select(
        "pair_id",
        "n_prompt_turns",
        F.slice("c", F.lit(1), F.col("n_prompt_turns")).alias("p"),
        *(F.slice(x, F.col("n_prompt_turns") + 1, F.size(x)).alias(x) for x in "cr"),
        (F.least(F.size("c"), F.size("r")) == 0).alias("lone"),
    )
    done = cut.select(
        "pair_id", "n_prompt_turns", "lone", F.expr(_side("p")).alias("p"), F.expr(_side("c")).alias("c"), F.expr(_side("r")).alias("r"),
    )
    same = (F.col("c.text") == "") & (F.col("r.text") == "")
    bare = (F.col("c.mask") == "") | (F.col("r.mask") == "")
    return done.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        F.col("p.text").alias("prompt"),
        F.col("c.text").alias("chosen_completion"),
        F.col("c.mask").alias("chosen_mask"),
        F.col("r.text").alias("rejected_completion"),
        F.col("r.mask").alias("rejected_mask"),
        F.when(F.col("lone"), "unpaired").when(same, "identical").when(bare, "untrained").otherwise("ok").alias("status"),
    )


def branched(conversations: DataFrame) -> DataFrame:
    """A pair per conversation that branches at its last assistant turn; one shuffle.

    Chosen are the turns up to it, rejected the same turns with the last assistant turn of the
    neighbour (conversations 2k and 2k + 1 are neighbours) in its place. Where either has no assistant
    turn, chosen is the whole conversation and nothing is rejected. Turns without a conv_id are one
    conversation, which has no neighbour.
    """
    odd = F.coalesce(F.pmod("conv_id", F.lit(2)), F.lit(0))
    sides = (F.array_sort(F.collect_list(F.when(odd == i, _turn()))).alias(x) for i, x in enumerate("ab"))
    both = conversations.withColumn("turn", F.col("turn").cast("long")).groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("k")).agg(*sides)
    one = lambda i, own, other: F.struct((2 * F.col("k") + i).alias("pair_id"), F.col(own).alias("own"), F.col(other).alias("other"))
    each = both.select(F.explode(F.array(one(0, "a", "b"), one(1, "b", "a"))).alias("x")).select("x.*")
    each = each.filter("size(own) > 0")
    reply = f"x -> x.role = '{TRAINED_ROLE}'"
    last = f"size(own) - array_position(transform(reverse(own), {reply}), true) + 1"
    ends = each.selectExpr("pair_id", "own", f"filter(other, {reply}) AS replies", f"IF(exists(own, {reply}), cast({last} AS int), 0) AS last")
    ok = "last > 0 AND size(replies) > 0"
    return ends.selectExpr(
        "pair_id", f"IF({ok}, slice(own, 1, last), own) AS c", f"IF({ok}, concat(slice(own, 1, last - 1), slice(replies, -1, 1)), slice(own, 1, 0)) AS r"
    )


def op3_preference(spark, sf_dir: str) -> DataFrame:
    return formatted(branched(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP3_SQL = rf"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'user'), '<|', '<\|') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i FROM t),
e AS (SELECT conv_id, max(i) AS last, arg_max(text, i) AS reply FROM w WHERE role = '{TRAINED_ROLE}' GROUP BY conv_id),
v AS (SELECT a.conv_id, a.last, b.reply FROM e a JOIN e b ON b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
o AS (SELECT conv_id AS pair_id, 'c' AS side, i, role, text FROM w LEFT JOIN v USING (conv_id) WHERE last IS NULL OR i <= last
      UNION ALL SELECT conv_id, 'r', i, role, text FROM w JOIN v USING (conv_id) WHERE i < last
      UNION ALL SELECT conv_id, 'r', last, '{TRAINED_ROLE}', reply FROM v),
s AS (SELECT pair_id, count(*) FILTER (side = 'c') AS nc, count(*) FILTER (side = 'r') AS nr FROM o GROUP BY pair_id),
d AS (SELECT c.pair_id, min(c.i) AS first FROM o c JOIN o r ON c.pair_id = r.pair_id AND c.i = r.i AND c.side = 'c' AND r.side = 'r'
      WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id),
n AS (SELECT s.*, coalesce(d.first - 1, least(nc, nr)) AS n FROM s LEFT JOIN d USING (pair_id)),
x AS (SELECT o.pair_id, side, i, n.n, role, '<|' || role || '|>' || chr(10) AS head, text || '{END}' AS tail FROM o JOIN n ON o.pair_id IS NOT DISTINCT FROM n.pair_id),
a AS (SELECT *, coalesce(sum(length(head) + length(tail) + 1) OVER (PARTITION BY pair_id, side, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_ FROM x),
g AS (SELECT pair_id, side, string_agg(head || tail || chr(10), '' ORDER BY i) FILTER (i <= n) AS p,
             string_agg(head || tail || chr(10), '' ORDER BY i) FILTER (i > n) AS k,
             string_agg((at_ + length(head))::VARCHAR || ':' || (at_ + length(head) + length(tail))::VARCHAR, ',' ORDER BY i)
               FILTER (i > n AND role = '{TRAINED_ROLE}') AS m FROM a GROUP BY pair_id, side),
f AS (SELECT n.pair_id, n.n AS n_prompt_turns, coalesce(c.p, '') AS prompt, coalesce(c.k, '') AS chosen_completion, coalesce(c.m, '') AS chosen_mask,
             coalesce(r.k, '') AS rejected_completion, coalesce(r.m, '') AS rejected_mask, least(nc, nr) = 0 AS lone
      FROM n LEFT JOIN g c ON c.pair_id IS NOT DISTINCT FROM n.pair_id AND c.side = 'c' LEFT JOIN g r ON r.pair_id IS NOT DISTINCT FROM n.pair_id AND r.side = 'r')
SELECT * EXCLUDE (lone), CASE WHEN lone THEN 'unpaired' WHEN chosen_completion = '' AND rejected_completion = '' THEN 'identical'
       WHEN chosen_mask = '' OR rejected_mask = '' THEN 'untrained' ELSE 'ok' END AS status FROM f
"""
