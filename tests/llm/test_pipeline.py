import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lamina.llm import linear, pii, quality, queries
from lamina.session import Scratch
from tests.llm import test_jaccard, test_mixing, test_packing, test_pii, test_quality
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def stages(spark, small_dir):
    """Rows before the first stage and after each, and the tables themselves."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    scratch, tables = Scratch(spark, "stages"), [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.table(str(number), stage(spark, docs, small_dir))
        tables.append(docs)
    return tables


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_stage_against_plain_scores(spark, stages, small_dir):
    model = quality.train(stages[0], spark.read.parquet(f"{small_dir}/labels.parquet"))
    scores = {(i, t): float(linear.sigmoid(np.array(test_quality.plain_logit(t or "", model)))) for i, t in set(pairs(stages[0]))}
    kept = set(pairs(stages[1]))
    assert all((x in kept) == (s >= quality.THRESHOLD) for x, s in scores.items() if abs(s - quality.THRESHOLD) > 1e-3)
    assert 0 < len(kept) < len(scores)


def test_near_copy_stage_against_brute_force(stages):
    before, after = pairs(stages[1]), pairs(stages[2])
    want = {root for _, n, root in test_jaccard.brute(before, 5, 80, 100) if n} | {i for i, n, _ in test_jaccard.brute(before, 5, 80, 100) if not n}
    assert sorted(i for i, _ in after) == sorted(want) and set(after) <= set(before)


def test_redaction_stage_against_patterns(spark, stages):
    texts = dict(pairs(stages[2]))
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.find(stages[2]).collect()}
    for i, text in pairs(stages[3]):
        whole = texts[i] or ""
        found = sorted({(int(a), -int(b), k) for k, a, b in spans[i]})
        assert {(k, a, b) for k, a, b in test_pii.base(whole)} == {(k, a, -b) for a, b, k in found if k in pii.STRICT}
        at, out = 0, []
        for start, end, kind in found:
            if start >= at:
                out += [whole[at:start], f"<{kind.upper()}>"]
            at = max(at, -end)
        assert (text or "") == "".join(out) + whole[at:]


def test_mixing_stage_against_a_plain_walk(stages):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in stages[3].collect()]
    taken = Counter((i, take) for i, _, _, take in test_mixing.brute(rows, 0.8, 2))
    assert taken == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in pairs(stages[4]))


def test_packing_stage_against_the_tokenizer(stages):
    rows = stages[5].collect()
    once = {}
    for i, t in pairs(stages[4]):
        once.setdefault(i, set()).add(t)
    single = [(i, t) for i, ts in once.items() if len(ts) == 1 for t in ts]
    n = test_packing.check_packed(rows, single, Tokenizer.from_file(corpus_pipeline.VOCABULARY), 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_run_packs_what_the_stages_keep(spark, small_dir):
    rows = corpus_pipeline.run(spark, small_dir).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_take_an_empty_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_dir)
    assert docs.count() == 0


def test_registered_queries_match_sql(spark, small_dir):
    duck = connection(small_dir)
    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, small_dir), duck, sql)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
