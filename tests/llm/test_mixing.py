import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def share_out(give, children):
    """Fill in proportion to weights, capped; children: name -> (cap, weight)."""
    out, left = {}, dict(children)
    while left:
        rate = give / sum(w for _, w in left.values())
        capped = {k: c for k, (c, w) in left.items() if c <= rate * w}
        if not capped:
            return out | {k: rate * w for k, (_, w) in left.items()}
        for k, c in capped.items():
            out[k] = c
            give -= c
            del left[k]
    return out


def brute(rows, share, epochs, seed=17):
    leaves = defaultdict(list)
    for i, t, lang, source in rows:
        n = len(WORD.findall(t or ""))
        if n:
            leaves["domain%d" % (ord(source[-1]) % 4), lang, source].append((i, n))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = lambda level, name: {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}.get(name, 1.0) if level == 1 else 1.0
    gives = {(): share * sum(tokens.values())}
    for level in range(3):
        following = {}
        for parent, give in gives.items():
            children = defaultdict(float)
            for k, n in tokens.items():
                if k[:level] == parent:
                    children[k[level]] += n * epochs
            for name, got in share_out(give, {c: (cap, weight(level, c)) for c, cap in children.items()}).items():
                following[(*parent, name)] = got
        gives = following
    out = []
    for leaf, docs in leaves.items():
        budget = int(round(gives[leaf], 3))
        for epoch in range(epochs + 1):
            at = epoch * tokens[leaf]
            for i, n in sorted(docs, key=lambda d: (hashlib.md5(f"{seed}:{epoch}:{d[0]}".encode()).hexdigest(), d)):
                if at < budget:
                    out.append((i, epoch, n, min(n, budget - at)))
                at += n
    return sorted(out)


@pytest.mark.parametrize("share, epochs, digits", [(0.5, 3, 3), (0.9, 1, 1), (2.5, 3, 2), (5.0, 2, 3), (0.03, 1, 1)])
def test_selection_equals_a_plain_walk(spark, share, epochs, digits):
    rows = [(i, " ".join("w" for _ in range(i * 7 % 23)), ("en", "de", "fr")[i % 5 % 3], "src%d" % (0 if i % 3 else i % 7)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, share=share, max_epochs=epochs, digits=digits).collect()
    assert sorted((r["doc_id"], r["_m_epoch"], r["_m_tokens"], r["_m_take"]) for r in got) == brute(rows, share, epochs)


def test_edges(spark, edges, nothing):
    got = mixing.mixed_documents(edges, share=1.0, max_epochs=1)
    assert got.columns == edges.columns
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 6, 7, 8, 9, 10, 11, 12, None}
    assert mixing.mix(nothing).count() == 0
    untagged = frame(spark, [(1, "a b c"), (2, "d e")]).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(untagged, share=1.0, max_epochs=1).count() == 2


def test_columns_named_like_helpers(spark):
    docs = frame(spark, [(i, "a b c") for i in range(9)]).withColumnsRenamed({"key": "_m_tokens", "name": "_m_row"})
    got = mixing.mixed_documents(docs, share=0.5, max_epochs=1)
    assert got.columns == docs.columns and sum(len(r["text"].split()) for r in got.collect()) in (12, 13)


def test_cut_keeps_white_space(spark):
    df = spark.createDataFrame([(" a  b\nc d",)], "t string")
    assert df.select(mixing.first_words(F.col("t"), F.lit(3)).alias("x")).first()["x"] == " a  b\nc"


def test_plan_has_no_python(spark, edges):
    plan = mixing.mix(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
