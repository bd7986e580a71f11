import random

import pytest

from lamina.operators import budget

SCHEMA = "layer string, id long, score double, tokens long"


def greedy(rows, max_tokens, floor):
    """Plain two-phase packing."""
    order = sorted(rows, key=lambda r: (-r[2], -r[1], r[0]))
    reserve, used, kept = budget.reserve_of(max_tokens, floor), {}, set()
    for layer, i, _, cost in order:
        if used.get(layer, 0) + cost <= reserve:
            used[layer] = used.get(layer, 0) + cost
            kept.add((layer, i))
    total = sum(used.values())
    if total < max_tokens:
        for layer, i, _, cost in order:
            if (layer, i) not in kept and total + cost <= max_tokens:
                total += cost
                kept.add((layer, i))
    return kept


def packed(spark, rows, max_tokens, floor):
    return {(r["layer"], r["id"]) for r in budget.pack(spark.createDataFrame(rows, SCHEMA), max_tokens, floor).collect()}


def test_skips_and_goes_on(spark):
    rows = [("semantic", 3, 0.9, 100), ("semantic", 2, 0.8, 180), ("semantic", 1, 0.7, 50)]
    assert packed(spark, rows, 160, 0) == {("semantic", 3), ("semantic", 1)}


def test_zero_budget_keeps_only_free_rows(spark):
    rows = [("semantic", 1, 0.9, 5), ("episodic", 2, 0.5, 0)]
    assert packed(spark, rows, 0, 250) == {("episodic", 2)}


def test_empty(spark):
    assert packed(spark, spark.createDataFrame([], SCHEMA).collect() or [("semantic", 1, 0.1, 99)], 10, 2) == set()


@pytest.mark.parametrize("seed", range(6))
def test_random_sets(spark, seed):
    rng = random.Random(seed)
    layers = ("procedural", "episodic", "semantic", "working")
    rows = [(rng.choice(layers), i, rng.choice((0.1, 0.5, 0.5, 1.0)), rng.choice((0, 1, 20, 90, 300))) for i in range(60)]
    top, floor = rng.choice((0, 100, 800, 4000)), rng.choice((0, 50, 250))
    assert packed(spark, rows, top, floor) == greedy(rows, top, floor)
