"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) has a target weight at every node. The
token budget flows down: at each node the children's shares are filled in proportion
to their weights up to what the subtree can supply (its tokens times `max_epochs`),
so a shortage goes to siblings first and only what a whole subtree cannot supply goes
to the subtree's own siblings. Each leaf then takes the token-prefix of its seeded
epochs: epoch e orders the leaf's documents by a hash of seed, epoch and id.

Everything is DataFrame code. The only sums over a leaf are over 16**digits hash ranges;
the one range that holds the end of the prefix is cut into as many again, and just the
one among those is ordered row by row, so a leaf with a third of all rows is never
gathered in a task.

Defined results: a null or blank text has no tokens and is never selected; null levels
form a leaf of their own; repeated rows (same id, same or other text) are separate
documents, ties in the order are broken by id and then by token count, and rows equal
in all of these share the place, so a cut falls on all of them alike; an empty table
gives an empty result; a budget above what all leaves can supply selects everything
`max_epochs` times. Columns of the documents may have any names; beside them, `mix` gives
columns that start with `_m_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed target weights of the default tree; nodes not named have weight 1.
WEIGHTS = {"lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def default_domain(source: Column) -> Column:
    """The domain of a source where the table has none: one of four, by the source's last character."""
    return F.concat(F.lit("domain"), F.ascii(F.right(F.coalesce(source, F.lit("")), F.lit(1))) % 4)


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _weight(level: str, weights: dict) -> Column:
    chosen = F.lit(1.0)
    for name, value in weights.get(level, {}).items():
        chosen = F.when(F.col(f"_m_{level}") == name, F.lit(float(value))).otherwise(chosen)
    return chosen


def allocate(leaves: DataFrame, levels: list[str], budget: Column, weights: dict) -> DataFrame:
    """Budget of each leaf row (`_m_<level>` columns, `_m_supply`, `_m_total`), level by level from the root.

    Children sorted by supply / weight fill up in that order; the level they fill to is the
    largest rate (budget left / weight left) met on the way.
    """
    at = leaves.withColumn("_m_budget", budget)
    parents: list[str] = []
    for level in levels:
        node = [*parents, f"_m_{level}"]
        children = at.groupBy(*node).agg(F.sum("_m_supply").alias("_m_cap"), F.first("_m_budget").alias("_m_give")).withColumn("_m_w", _weight(level, weights))
        order = W.partitionBy(*parents).orderBy(F.col("_m_cap") / F.col("_m_w"), f"_m_{level}") if parents else W.partitionBy(F.lit(0)).orderBy(F.col("_m_cap") / F.col("_m_w"), f"_m_{level}")
        before = order.rowsBetween(W.unboundedPreceding, -1)
        rest = order.rowsBetween(0, W.unboundedFollowing)
        share = (F.col("_m_give") - F.coalesce(F.sum("_m_cap").over(before), F.lit(0))) * F.col("_m_w") / F.sum("_m_w").over(rest)
        # the rate rises over the children that are capped and falls after them, so the level is its largest value
        rate = F.max(share / F.col("_m_w")).over(W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0)))
        children = children.withColumn("_m_next", F.least(F.col("_m_cap").cast("double"), rate * F.col("_m_w")))
        children = children.select(*(F.col(c).alias(f"{c}_k") for c in node), "_m_next")
        same = [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in node]
        at = at.join(children, same, "left").withColumn("_m_budget", F.col("_m_next")).drop("_m_next", *(f"{c}_k" for c in node))
        parents = node
    return at


def mixed_rows(
    docs: DataFrame,
    levels: dict[str, Column] | None = None,
    share: float = 0.5,
    max_epochs: int = 3,
    weights: dict | None = None,
    seed: int = 17,
    digits: int = 3,
    steps: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Selected documents, each as one struct `_m_row`, with their levels, `_m_epoch`, `_m_tokens` and `_m_take`.

    A leaf's prefix ends in a range of the hashes that order it. Each step sums the leaf by the next
    `digits` hexadecimal digits and keeps the one range with the end, so that what is ordered row by
    row is 1 / 16 ** (digits * steps) of the leaf and no window has more than 16 ** digits sums of it.
    """
    levels = levels or {"domain": default_domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    weights = WEIGHTS if weights is None else weights
    names = [f"_m_{c}" for c in levels]
    scratch = Scratch(docs.sparkSession, "mix")
    # as one struct the columns of the documents, whatever their names, clash with nothing
    rows = docs.where(F.col(text_col).rlike(WORD)).select(F.struct(*docs.columns).alias("_m_row"), F.col(id_col).alias("_m_id"), *(v.alias(f"_m_{c}") for c, v in levels.items()))
    tokens = token_count(F.col("_m_row")[text_col]).alias("_m_tokens")
    narrow = scratch.table("tokens", rows.select(*names, "_m_id", tokens))

    place = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.col("_m_id")))
    leaves = narrow.groupBy(*names).agg(F.sum("_m_tokens").alias("_m_all"))
    total = leaves.agg(F.sum("_m_all").alias("_m_total"))
    leaves = leaves.crossJoin(total).withColumn("_m_supply", F.col("_m_all") * max_epochs)  # one row
    budgets = allocate(leaves, list(levels), F.col("_m_total") * share, weights).select(
        *names, "_m_all", F.floor(F.round("_m_budget", 3)).cast("long").alias("_m_budget")
    )

    same = lambda suffix: [F.col(c).eqNullSafe(F.col(f"{c}{suffix}")) for c in names]
    keyed = lambda df, suffix: df.withColumnsRenamed({c: f"{c}{suffix}" for c in names})

    def placed(df: DataFrame, plan: DataFrame) -> DataFrame:
        """Rows with their leaf's plan; the plan is a small table that Spark broadcasts below its threshold and else joins by key, splitting hot ones."""
        df = df.join(keyed(plan, "_p"), same("_p")).drop(*(f"{c}_p" for c in names)).withColumn("_m_order", place(F.col("_m_full")))
        return df.withColumn("_m_bucket", F.substring("_m_order", 1, F.length("_m_edge")))

    # the epoch that holds the end of the prefix, the tokens it still gives, and the range with the end
    whole_leaf = {"_m_full": F.floor(F.col("_m_budget") / F.col("_m_all")), "_m_left": F.col("_m_budget") % F.col("_m_all"), "_m_edge": F.lit(""), "_m_edge_ahead": F.lit(0).cast("long")}
    plan = scratch.table("plan_0", budgets.withColumns(whole_leaf).drop("_m_all", "_m_budget"))
    for step in range(1, steps + 1):
        within = placed(narrow, plan).where("_m_bucket = _m_edge")
        sums = within.groupBy(*names, F.substring("_m_order", 1, F.lit(digits * step)).alias("_m_next")).agg(F.sum("_m_tokens").alias("_m_sum"))
        sums = sums.join(keyed(plan.drop("_m_full"), "_p"), same("_p")).drop(*(f"{c}_p" for c in names))
        ahead = F.sum("_m_sum").over(W.partitionBy(*names).orderBy("_m_next").rowsBetween(W.unboundedPreceding, -1))
        sums = sums.withColumn("_m_ahead", F.col("_m_edge_ahead") + F.coalesce(ahead, F.lit(0)))
        ends = sums.where("_m_left > _m_ahead and _m_left <= _m_ahead + _m_sum").select(*names, F.col("_m_next").alias("_m_edge"), F.col("_m_ahead").alias("_m_edge_ahead"))
        plan = keyed(plan.drop("_m_edge", "_m_edge_ahead"), "_q").join(keyed(ends, "_e"), [F.col(f"{c}_q").eqNullSafe(F.col(f"{c}_e")) for c in names], "left")
        plan = scratch.table(f"plan_{step}", plan.drop(*(f"{c}_e" for c in names)).withColumnsRenamed({f"{c}_q": c for c in names}))

    # rows taken whole: once in each full epoch, once more if their range lies before the edge
    epochs = F.sequence(F.lit(0).cast("long"), F.col("_m_full") - F.when(F.col("_m_bucket") < F.col("_m_edge"), 0).otherwise(1))
    whole = placed(rows, plan).where("_m_full > 0 or _m_bucket < _m_edge").withColumn("_m_tokens", tokens)
    whole = whole.withColumn("_m_epoch", F.explode(epochs)).withColumn("_m_take", F.col("_m_tokens"))
    # rows of the edge range, ordered one by one without their texts
    edge = placed(narrow, plan).where("_m_bucket = _m_edge")
    key = [*names, "_m_order", "_m_id", "_m_tokens"]
    upto = W.partitionBy(*names).orderBy("_m_order", "_m_id", "_m_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    spots = edge.groupBy(*key, "_m_edge_ahead", "_m_left").agg(F.count("*").alias("_m_n"))
    all_of = F.col("_m_tokens") * F.col("_m_n")
    spots = spots.withColumn("_m_before", F.col("_m_edge_ahead") + F.sum(all_of).over(upto) - all_of)
    spots = spots.where("_m_before < _m_left").select(*(F.col(c).alias(f"{c}_s") for c in key), "_m_before")
    inside = placed(rows, plan).where("_m_bucket = _m_edge").withColumn("_m_tokens", tokens)
    inside = inside.join(spots, [F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in key])
    inside = inside.withColumn("_m_epoch", F.col("_m_full")).withColumn("_m_take", F.least(F.col("_m_tokens"), F.col("_m_left") - F.col("_m_before")))
    out = ["_m_row", *names, "_m_epoch", "_m_tokens", "_m_take"]
    return whole.select(*out).unionByName(inside.select(*out))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Selected documents with their levels (`_m_<level>`), `_m_epoch`, `_m_tokens` and `_m_take`; options as `mixed_rows` has them.

    `share` is the token budget as a part of all tokens. The last document of a leaf's
    prefix may be taken in part: `_m_take` is below `_m_tokens` there.
    """
    found = mixed_rows(docs, **options)
    return found.select("_m_row.*", *(c for c in found.columns if c != "_m_row"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pairs = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word"))
    return F.array_join(F.transform(F.slice(pairs, F.lit(1), n.cast("int")), lambda p: F.concat(p["gap"], p["word"])), "")


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The selection as documents: once per epoch, the last of a leaf's prefix cut to the words taken."""
    found = mixed_rows(docs, text_col=text_col, **options)
    cut = F.col("_m_take") < F.col("_m_tokens")
    own = {c: F.col("_m_row")[c] for c in docs.columns}
    text = own[text_col]
    own[text_col] = F.when(cut, first_words(text, F.col("_m_take"))).otherwise(text)
    if "n_chars" in own:
        own["n_chars"] = F.when(cut, F.length(first_words(text, F.col("_m_take"))).cast("long")).otherwise(own["n_chars"])
    return found.select(*(v.alias(c) for c, v in own.items()))
