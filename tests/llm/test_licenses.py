import random
import re
import string

from lamina.llm import licenses
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(rows, texts):
    assert sorted(str((i, *base(t))) for i, t in texts) == sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in rows)
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_base_places(spark):
    rng = random.Random(1)
    pieces = ["MIT", "license", "License,", "mit-license", "apache", "general", "public", "GENERAL PUBLIC LICENSE", " ", "é", "x1", "İ", "K", "lİcense", "\n"]
    texts = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(400)]
    check(licenses.scan(frame(spark, texts)).collect(), texts)


def test_edges(spark, edges, edge_rows, nothing):
    check(licenses.scan(edges).collect(), edge_rows)
    assert licenses.scan(nothing).count() == 0


def test_copies_of_a_row_do_not_add_up(spark):
    texts = [(1, "mit license " * 3), (1, "mit license " * 3), (1, "other text")]
    check(licenses.scan(frame(spark, texts)).collect(), texts)


def test_inserted_and_dropped_words_merge_diagonals(spark):
    mit = licenses.TEMPLATES[1][0].split()
    edited = " ".join([*mit[:10], "really", *mit[10:20], *mit[22:]])
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, [(1, edited), (2, " ".join(mit[:6])), (3, "permission is granted here")])).collect()}
    assert rows[1]["labels"] == "mit" and rows[1]["score"] < 1 and len(rows[1]["spans"]) == 1
    assert rows[2]["labels"] == rows[3]["labels"] == ""


def test_plan_has_no_python(spark, edges):
    plan = licenses.scan(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def voted(text, slack=4, coverage=0.6, stretch=1.5):
    """The method in plain Python: labels and score of a text."""
    words = WORD.findall((text or "").translate(LOWER))
    labels, score = set(base(text)[4].split(",")) - {""}, 0.0
    for phrase, _ in licenses.PHRASES:
        own = phrase.split()
        if any(words[i : i + len(own)] == own for i in range(len(words))):
            score = 1.0
    for template, label in licenses.TEMPLATES:
        own = template.split()
        votes = {}
        for i in range(len(words) - 2):
            for j in range(len(own) - 2):
                if words[i : i + 3] == own[j : j + 3]:
                    votes.setdefault(i - j, []).append((i, j))
        last, groups = None, []
        for diagonal in sorted(votes):
            if last is None or diagonal - last > slack:
                groups.append([])
            groups[-1] += votes[diagonal]
            last = diagonal
        for group in groups:
            cover = len({j for _, j in group}) / (len(own) - 2)
            length = max(i for i, _ in group) + 3 - min(i for i, _ in group)
            if cover >= coverage and length <= stretch * len(own):
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(labels)), round(score, 9)


def test_labels_and_score_against_plain_voting(spark):
    rng = random.Random(5)
    texts = []
    for i in range(250):
        words = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(licenses.TEMPLATES)[0].split()
            own = [w for w in own if rng.random() > rng.choice([0, 0.02, 0.1])]
            cut = rng.randint(0, len(own) // 2)
            words += ["x"] * rng.randint(0, 3) + own[cut : rng.randint(cut, len(own) + 5)]
            if rng.random() < 0.3:
                words.insert(rng.randint(0, len(words)), "Inserted")
        texts.append((i, " ".join(words)))
    texts += [(900, licenses.TEMPLATES[-2][0]), (901, licenses.TEMPLATES[-1][0].upper()), (902, "mit license " * 100)]
    found = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(frame(spark, texts)).collect()}
    assert found == {i: voted(t) for i, t in texts}
    assert len({v for v in found.values()}) > 30


def test_hashes_are_those_of_sql(spark):
    rows = licenses.template_rows()
    table = licenses.template_grams(spark, rows).where("k > 0").selectExpr("gram_hash", "xxhash64(get(split(t_gram, ' '), 0), get(split(t_gram, ' '), 1), get(split(t_gram, ' '), 2)) as h")
    assert table.where("gram_hash <> h").count() == 0 and table.count() == len(rows)


def test_long_phrases_and_kelvin_signs(spark):
    phrase = " ".join(f"word{i}" for i in range(150))
    rows = licenses.scan(frame(spark, [(1, phrase + " " + phrase), (2, phrase[:-1]), (3, "a book to keep safe"), (4, "a booK to Keep safe")]), ((phrase, "long"),), (("a book to keep safe", "book"),)).collect()
    found = {r["doc_id"]: r for r in rows}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"]) == (2, 0, 150)
    assert found[2]["n_base"] == 0 and found[3]["labels"] == "book" and found[4]["labels"] == ""
