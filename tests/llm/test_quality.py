import random
import zlib

import numpy as np
import pytest

from lamina.llm import features, linear, quality, rules
from tests.llm.conftest import frame


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        text = " ".join(body) + "." if good else " | ".join(w.upper() + "###" for w in body)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, corpus):
    rows, labels = corpus
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: q for i, q, _ in labels}
    for found in (
        [(r["doc_id"], r["score"], r["predicted"], r["held_out"]) for r in quality.classify(frame(spark, rows), table).collect()],
        [(r["doc_id"], r["probability"], int(r["kept"]), zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rules.apply_rules(frame(spark, rows), table).collect()],
    ):
        assert len(found) == len(rows)
        assert all(0 <= s <= 1 and h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, s, _, h in found)
        held = [(p, truth[i]) for i, _, p, h in found if h]
        assert np.mean([p == t for p, t in held]) > 0.95


def test_scores_ignore_everything_but_the_text(spark, corpus):
    rows, labels = corpus
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.train(docs, table)
    one = frame(spark, [(1, "hello there"), (999, "hello there")]).withColumn("lang", docs["doc_id"] if False else quality.F.lit("xx"))
    assert len({r["_q_score"] for r in quality.scores(one, model, "doc_id").collect()}) == 1


def test_gradient_is_reversed_where_the_negative_risk_is_negative():
    y = np.array([1.0, 1.0, 0.0])
    g = quality.pu_gradient(y, 0.9)(np.array([4.0, 4.0, -4.0]))
    assert (g[:2] > 0).all() and g[2] < 0
    z = np.array([0.3, -0.2, 0.4])
    risk = lambda z: 0.4 * np.logaddexp(0, -z[:2]).mean() + max(0, np.logaddexp(0, z[2:]).mean() - 0.4 * np.logaddexp(0, z[:2]).mean())
    numeric = [(risk(z + 1e-6 * np.eye(3)[i]) - risk(z - 1e-6 * np.eye(3)[i])) / 2e-6 for i in range(3)]
    assert quality.pu_gradient(y, 0.4)(z) == pytest.approx(numeric, abs=1e-6)


def test_platt_stays_finite_on_separated_scores():
    a, b = linear.platt(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    p = linear.sigmoid(a * np.array([-2.0, 2.0]) + b)
    assert np.isfinite([a, b]).all() and p[0] < 0.3 < 0.7 < p[1]


def plain_counts(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def test_base_rules_equal_plain_counts(spark, edges, edge_rows, labels):
    more = [(20, "a b c a b c a\na b c\n\n \na b c"), (21, "x\nx\n x\nx "), (22, "# * $ % & | < > #"), (23, "a a a a"), (24, "é è\x0bb\x1cc")]
    got = rules.apply_rules(edges.unionByName(frame(spark, more)), labels).collect()
    want = sorted((i, *plain_counts(t)) for i, t in [*edge_rows, *more] if i is not None)
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got if r["doc_id"] is not None) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)


def test_edges(spark, edges, nothing, labels):
    assert quality.classify(edges, labels).count() == edges.count()
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(edges, labels.limit(0)).where("score = 0.5").count() == edges.count()
    assert quality.keep_good(edges, labels).columns == edges.columns
    assert rules.apply_rules(nothing, labels).count() == 0
    assert rules.apply_rules(edges, labels.limit(0)).count() == edges.count()


def test_columns_named_like_helpers(spark, corpus):
    rows, labels = corpus
    docs = frame(spark, rows[:60]).withColumnsRenamed({"key": "_q_score", "name": "row"})
    kept = quality.keep_good(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and 0 < kept.count() < 60


def test_vector_parts_add_up():
    x = features.vector("one two three two")
    assert x[: features.SIZE].sum() == pytest.approx(4.0, abs=1e-4)
    assert not features.vector("").any()


def plain_logit(text, model):
    """The model applied one gram at a time."""
    import re

    import xxhash

    full = (1 << 64) - 1

    def mixed(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & full
        return h ^ (h >> 31)

    width = features.SIZE // 4
    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    groups = [[mixed(a) * width >> 64 for a in h], [mixed((mixed(a) + b * 0x9E3779B97F4A7C15) & full) * width >> 64 for a, b in zip(h, h[1:], strict=False)]]
    for k in (3, 4):
        own = []
        for i in range(len(text) - k + 1):
            code = 0
            for c in text[i : i + k]:
                code = (code * 1000003 + ord(c)) % (1 << 32)
            own.append((code * 2654435761 % (1 << 32)) * width >> 32)
        groups.append(own)
    total = float(features.statistics(text, features.analyse(text)) @ model["stats"][:-1] + model["stats"][-1])
    return total + sum(sum(float(model["grams"][n * width + b]) for b in own) / len(own) for n, own in enumerate(groups) if own)


def test_scores_against_plain_arithmetic(spark, corpus, edge_rows):
    rows, labels = corpus
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model, rule = quality.train(docs, table), rules.train(docs, table)
    texts = [(i, t) for i, t in [*rows[:40], *edge_rows] if i is not None]
    some = frame(spark, texts)
    plain = lambda t, m: plain_logit(t or "", m)
    want = sorted((i, float(linear.sigmoid(np.array(plain(t, model))))) for i, t in texts)
    got = sorted((r["doc_id"], r["_q_score"]) for r in quality.scores(some, model, "doc_id").collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)
    want = sorted((i, float(linear.sigmoid(np.array(rule["slope"] * plain(t, rule) + rule["shift"])))) for i, t in texts)
    got = sorted((r["doc_id"], r["probability"]) for r in rules.apply_rules(docs.unionByName(some.withColumn("doc_id", some.doc_id + 10_000)), table).where("doc_id >= 10000").collect())
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)


@pytest.mark.parametrize("prior", [0.1, 0.4, 0.8])
def test_best_bin_estimation(prior):
    rng = np.random.default_rng(7)
    unl = np.r_[rng.normal(2, 1, int(2000 * prior)), rng.normal(-2, 1, 2000 - int(2000 * prior))]
    assert quality.best_bin(rng.normal(2, 1, 2000), unl) == pytest.approx(prior, abs=0.06)


def test_prior_reads_no_negative_labels(spark, corpus):
    rows, labels = corpus
    docs = frame(spark, rows)
    kinds = "doc_id long, quality int, toxic int"
    whole = quality.train(docs, spark.createDataFrame(labels, kinds))
    part = quality.train(docs, spark.createDataFrame([x for x in labels if x[1]], kinds))
    assert (whole["grams"] == part["grams"]).all() and (whole["stats"] == part["stats"]).all()


def test_sample_is_bounded_in_rows(spark):
    docs = frame(spark, [(1, f"text {i % 3}") for i in range(500)] + [(2, "b")])
    keys = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, label double")
    rows = linear.sample(docs, keys, 10).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2]


def test_values_of_edge_rows(spark, edges, edge_rows, labels):
    """Null and blank texts score as a text without features; rows with the same text score the same."""
    found = [(r["_q_score"], r["text"]) for r in quality.scores(edges, quality.train(edges, labels), "text").collect()]
    blank = {round(s, 12) for s, t in found if not (t or "").split()}
    assert len(found) == len(edge_rows) and len({t: s for s, t in found}) == len({(t, round(s, 12)) for s, t in found}) and len(blank) <= 2
    kept = rules.apply_rules(edges, labels).collect()
    assert all(r["base_failed"] and not r["kept"] for r in kept if r["n_words"] == 0) and len(kept) == len(edge_rows)


def test_the_driver_gets_the_model_alone(spark, edges):
    """Vectors of the sample meet in a task; none passes through the driver."""
    import os

    from lamina.llm import linear

    rows = edges.where("doc_id is not null").selectExpr("doc_id", "text", "cast(doc_id % 2 as double) as label")
    found = linear.learned(rows, lambda x, y, ids: {"at": os.getpid(), "n": len(x), "ordered": bool((ids[1:] >= ids[:-1]).all()), "labels": sorted(set(y.tolist()))})
    assert found.pop("at") != os.getpid()
    assert found == {"n": rows.count(), "ordered": True, "labels": [0.0, 1.0]}
