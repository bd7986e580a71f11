"""Token-budgeted packing: a floor per layer, then one pool, both greedy and both skipping what doesn't fit.

The candidates are bounded by the layers' fetch caps, so they fold in one row with SQL's
aggregate(); nothing is collected to the driver, and each source is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER_COUNT = 4


def reserve_of(max_tokens: int, per_layer_min: int) -> int:
    return min(per_layer_min, max_tokens // LAYER_COUNT)


def pack(candidates: DataFrame, max_tokens: int, per_layer_min: int) -> DataFrame:
    """Kept rows of candidates(layer, id, score, tokens, ...) with all their columns and `phase` 1 (floor) or 2 (pool).

    Order: score down, id down, layer up. Ids are numbers or strings (ULIDs sort by time, so the newest comes first).
    """
    reserve = reserve_of(max_tokens, per_layer_min)
    ordered = F.expr("""array_sort(_b_rows, (a, b) -> case when a.score <> b.score then if(a.score > b.score, -1, 1)
        when a.id <> b.id then if(a.id > b.id, -1, 1) when a.layer <> b.layer then if(a.layer < b.layer, -1, 1) else 0 end)""")
    costs = F.expr("transform(_b_rows, (x, i) -> named_struct('i', i, 'layer', x.layer, 'tokens', cast(x.tokens as bigint)))")
    floor = F.expr(f"""aggregate(_b_costs,
        named_struct('used', cast(map() as map<string, bigint>), 'kept', cast(array() as array<int>)),
        (acc, x) -> if(coalesce(acc.used[x.layer], 0L) + x.tokens <= {reserve},
            named_struct('used', map_concat(map_filter(acc.used, (k, v) -> k <> x.layer), map(x.layer, coalesce(acc.used[x.layer], 0L) + x.tokens)),
                         'kept', concat(acc.kept, array(x.i))),
            acc),
        acc -> named_struct('kept', acc.kept, 'total', aggregate(map_values(acc.used), 0L, (s, v) -> s + v)))""")
    pool = F.expr(f"""if(_b_floor.total >= {max_tokens}, cast(array() as array<int>),
        aggregate(filter(_b_costs, x -> not array_contains(_b_floor.kept, x.i)),
            named_struct('used', _b_floor.total, 'kept', cast(array() as array<int>)),
            (acc, x) -> if(acc.used + x.tokens <= {max_tokens}, named_struct('used', acc.used + x.tokens, 'kept', concat(acc.kept, array(x.i))), acc),
            acc -> acc.kept))""")
    row = candidates.agg(F.collect_list(F.struct(*candidates.columns)).alias("_b_rows")).select(ordered.alias("_b_rows"))
    for name, value in (("_b_costs", costs), ("_b_floor", floor), ("_b_pool", pool)):
        row = row.withColumn(name, value)
    phases = F.expr("""concat(transform(_b_floor.kept, i -> named_struct('row', _b_rows[i], 'phase', 1)),
        transform(_b_pool, i -> named_struct('row', _b_rows[i], 'phase', 2)))""")
    # outer, since an inner one would have the fold made twice, for its inferred filter
    return row.select(F.explode_outer(phases).alias("_b_kept")).where("_b_kept is not null").select("_b_kept.row.*", "_b_kept.phase")
