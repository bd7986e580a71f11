import hashlib
import random
import re

import pytest
import regex

from lamina.llm import pii
from tests.llm.conftest import frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]


def check(rows, texts):
    assert len(rows) == len(texts)
    want = []
    for i, t in texts:
        spans = base(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append(str((i, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest())))
    assert sorted(want) == sorted(str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in rows)
    for r in rows:
        strict = [s for s in r["spans"].split(",") if s and s.split(":")[0] in PATTERNS]
        assert hashlib.sha256(",".join(strict).encode()).hexdigest() == r["base_sha256"]


def test_strict_spans_equal_the_patterns(spark):
    rng = random.Random(2)
    pieces = [
        "a@b.c", "a@b.c_d@e.f", "x.@y-.z.", "@", ".", "_%+", "é", " ", "-", "  ", "--", "1", "23", "255.1.2.3", "256.1.2.3", "1.2.3.4.5.6.7.8", "0000255.01.002.3", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "4111111111111111", "+1 (459) 555-9246", "+1", "+", "(", ")", "123456789012345678901234", "99999999999999.1.1.1", "word", "key = \"", "\n", "中",
    ]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))) for i in range(1500)]
    check(pii.find(frame(spark, texts)).collect(), texts)


def test_edges(spark, edges, edge_rows, nothing):
    hard = [(90, "1 " * 9000), (91, "1" * 40_000), (92, "a." * 20_000 + "@"), (93, "+" + "1 " * 5000), (94, "a" * 50_000 + "@b.c"), (95, "1.1." * 3000)]
    check(pii.find(edges.unionByName(frame(spark, hard))).collect(), [*edge_rows, *hard])
    assert pii.find(nothing).count() == 0
    assert pii.redact(edges).columns == edges.columns


def test_trees_find_secrets_and_leave_plain_words(spark):
    rng = random.Random(6)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = []
    for i in range(300):
        t = token()
        texts.append((i, {0: f'the token = "{t}" is', 1: "plain words and_a_long_name_with_1_digit_inside here", 2: f"mail me at who{i}@mail.example.com or +1 (459) 555-{1000 + i}"}[i % 3]))
    rows = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, texts)).collect()}
    assert all(("secret:13:53" in s) == (i % 3 == 0) for i, s in rows.items())
    redacted = {r["doc_id"]: r for r in pii.redact(frame(spark, texts)).collect()}
    assert redacted[0]["text"] == 'the token = "<SECRET>" is' and redacted[0]["n_chars"] == len(redacted[0]["text"])
    assert redacted[1]["text"] == texts[1][1]
    assert redacted[2]["text"] == "mail me at <EMAIL> or <PHONE>"


def test_overlapping_spans_are_redacted_once(spark):
    text = "x 1.2.3.4@host.org y"
    assert pii.redact(frame(spark, [(1, text)])).first()["text"] == "x <EMAIL> y"


def test_boosting_separates_and_calibrates():
    blank = dict.fromkeys(pii.AROUND, 0)
    cells = [blank | {"kind": 6, "assigned": a, "held_out": h, "label": y, "n": n} for a, y, n in ((1, 1, 90), (1, 0, 2), (0, 0, 80), (0, 1, 1)) for h in (False, True)]
    model = pii.fit(cells, pii.AROUND)
    assert model["trees"] and 6 in model["thresholds"]
    assert pii.fit([], pii.AROUND)["trees"] == []


def plain_spans(text, models):
    """Loose spans of the method in plain Python, with the models that were fitted."""
    import numpy as np

    hidden = list(text)
    for _, a, b in base(text):
        hidden[a:b] = "\x01" * (b - a)
    hidden, found = "".join(hidden), []
    bucket = lambda v, bounds: sum(v > x for x in bounds)
    luhn = lambda d: sum(x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    for k, name in enumerate(pii.LOOSE, len(pii.STRICT)):
        probe, pattern = pii.GENERATORS[name]
        for m in regex.finditer(pattern, hidden) if regex.search(probe, hidden) else ():
            last = max((x[2] for x in found if x[0] == k), default=0)
            v, before, after = m.group(), hidden[max(last, m.start() - 24) : m.start()], hidden[m.end() : m.end() + 8]
            digits = re.sub("[^0-9]", "", v)
            mark = bool(re.search(pii.KNOWN_KEY, v))
            if k == 4:
                mark = bool(re.search(pii.BRACKETS[0], v)) + bool(re.search(pii.BRACKETS[1], v))
            if k == 7:
                v4 = v.replace(" ", "")
                mark = int("".join(str(int(c, 36)) for c in v4[4:] + v4[:4])) % 97 == 1
            if k == 5:
                mark = bool(re.search(pii.TELEPHONE, v)) or 13 <= len(digits) <= 19 and luhn(digits)
            side = lambda t, far, near: 0 if t == "" else 1 if re.search(far, t) else 2 if re.search(near, t) else 3
            x = {
                "kind": k, "digits": bucket(len(digits), (0, 3, 6, 9, 12)), "separators": min(2, sum(bool(re.search(p, v)) for p in ("[ ]", "[_-]", "[.]", r"[()\[\]]"))), "size": bucket(len(v), (11, 15, 23, 35)),
                "letters": 0 if not re.search("[A-Za-z]", v) else 1 if re.fullmatch("[0-9a-f]+", v) else 2 if re.search("[a-z]", v) and re.search("[A-Z]", v) else 3,
                "variety": bucket(len(set(v[:64])), (6, 12)), "runs": bucket(len(re.sub("[0-9]+|[A-Za-z]+", "x", v[:64])), (3, 8)), "mark": int(mark),
                "tight": int(bool(re.search("[A-Za-z0-9]$", before) or re.search("^[A-Za-z0-9]", after))), "context": next((n for n, p in pii.CONTEXT if re.search(p, before)), 0),
                "assigned": int(bool(re.search("[=:][ ]?[\"']?$", before))), "opens": side(before, "[ ]$", "[\"'(=:,;]$"), "closes": side(after, "^[ ]", "^[\"').,;]"), "line": int("\n" in before),
            }
            row = {f: np.array([n]) for f, n in x.items()}
            good = False
            for model in models.values():
                raw = model["rate"] * sum(pii._values(t, row)[0] for t in model["trees"]) if model["trees"] else 0.0
                good |= 1 / (1 + np.exp(-(model["slope"] * raw + model["shift"]))) >= model["thresholds"].get(k, 2)
            found.append((k, m.start(), m.end(), good))
    out, at = [], 0
    for k, a, b, good in sorted(found, key=lambda c: (c[1], -c[2])):
        if good and a >= at:
            out.append((pii.LOOSE[k - len(pii.STRICT)], a, b))
            at = b
    return out


def test_loose_spans_against_plain_code(spark):
    rng = random.Random(12)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    pieces = [
        lambda: f'token = "{token(40)}"', lambda: token(40), lambda: token(27), lambda: "call (640) 555-0953", lambda: "(640) 555-0953", lambda: f"{rng.randrange(10**9)}", lambda: "12.10.2019 - 14",
        lambda: "1 000 000", lambda: "who (at) host (dot) org", lambda: "mail jo at host dot org", lambda: "at noon dot the end", lambda: "a@b.org", lambda: "10.2.3.4", lambda: "chapter-12-of-the-long-story",
        lambda: "+1 (459) 555-9246 12 34", lambda: "iban DE89 3704 0044 0532 0130 00", lambda: "GB29NWBK60161331926819", lambda: "AB12 3456 7890 1234", lambda: "JO [AT] mail [Dot] host DOT org", lambda: "pwd = openthegates", lambda: "\n", lambda: "é中", lambda: "AKIA" + token(20).upper(), lambda: "key: " + token(22),
    ]
    texts = [(i, " ".join(rng.choice(pieces)() for _ in range(rng.randint(1, 8)))) for i in range(400)]
    docs = frame(spark, texts)
    models = pii.fitted(pii.candidates(docs.select(docs.doc_id.alias("_p_id"), pii._text("text"))), spark)
    kinds = set()
    for r in pii.find(docs).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        loose = sorted((s for s in spans if s[0] in pii.LOOSE), key=lambda s: s[1])
        text = dict(texts)[r["doc_id"]]
        assert loose == plain_spans(text, models), (text, loose, plain_spans(text, models))
        kinds |= {s[0] for s in loose}
    assert kinds == set(pii.LOOSE)


def test_formats_are_learned_from_contexts(spark):
    """Tokens of the form that stands behind key words are found where no word announces them; other long names are left alone."""
    rng = random.Random(3)
    token = lambda: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(28))
    texts = [(i, f'password = "{token()}"' if i % 2 else "see the product_catalogue_2019_edition here") for i in range(300)]
    hidden = [(500 + i, f"we had {token()} on the wall") for i in range(20)]
    names = [(600 + i, f"file report_of_year_20{i:02d}_final here") for i in range(20)]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, texts + hidden + names)).collect()}
    assert sum(rows[i] == "secret:7:35" for i, _ in hidden) >= 18
    assert not any(rows[i] for i, _ in names) and not any(rows[i] for i, _ in texts if not i % 2)


def test_many_candidates_fold_in_chunks(spark):
    many = "call 555 123 4567, " * 3000 + "x " * 10
    row = pii.find(frame(spark, [(1, many)])).first()
    spans = row["spans"].split(",")
    assert len(spans) == 3000 and spans[700] == f"number:{19 * 700 + 5}:{19 * 700 + 17}"
    assert pii.redact(frame(spark, [(1, many)])).first()["text"] == "call <NUMBER>, " * 3000 + "x " * 10


def test_columns_named_like_helpers(spark):
    docs = frame(spark, [(1, "mail a@b.org"), (2, None)]).withColumnsRenamed({"key": "_p_text", "name": "_p_spans", "label": "_p_id"})
    got = pii.redact(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "mail <EMAIL>"), (2, None)]


def test_plan_has_no_python(spark, edges):
    plan = pii.find(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("kind", [*pii.STRICT, *pii.LOOSE])
def test_probe_never_rejects_a_match(kind):
    probe, pattern = pii.GENERATORS[kind]
    samples = {"email": "a@b.c", "ip": "1.2.3.4", "card": "4111 1111 1111 1111", "phone": "+1 23 456 7890", "address": "who (at) host [dot] org", "number": "555 123 4567", "secret": "a1" * 10, "iban": "GB29NWBK60161331926819"}
    assert re.search(probe, samples[kind])


def test_written_out_addresses_and_numbers_are_found_among_many_others(spark):
    """Two addresses and a few numbers in a corpus of tokens, plain numbers and strict spans."""
    rng = random.Random(8)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [(i, (f'token = "{token()}"', f"mail a{i}@b.org, +1 459 555 {1000 + i}", f"in the years {1000 + i}-{2000 + i} they met", "look at foo dot com now")[i % 4]) for i in range(400)]
    found = {500: "who (at) host (dot) org", 501: "who [at] host [dot] org", 502: "jo at host dot org", 503: "555 123 4567", 504: "555-987-6543"}
    texts += [(i, {502: "contact: ", 503: "please call ", 504: "fax "}.get(i, "write to me, ") + t) for i, t in found.items()]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, texts)).collect()}
    for i, t in found.items():
        at = dict(texts)[i].index(t)
        assert rows[i] == f"{'address' if i < 503 else 'number'}:{at}:{at + len(t)}"
    assert not any("address" in s or "number" in s for i, s in rows.items() if i < 500)
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    assert redacted[500] == redacted[501] == "write to me, <ADDRESS>" and redacted[503] == "please call <NUMBER>"
    assert redacted[3] == "look at foo dot com now"


@pytest.mark.parametrize("doc_id", range(6))
def test_the_only_candidate_of_a_corpus_is_redacted(spark, doc_id):
    """Whichever fold it falls into."""
    assert pii.redact(frame(spark, [(doc_id, "x, who (at) host (dot) org")])).first()["text"] == "x, <ADDRESS>"


#: Forms that EXAMPLES doesn't hold: personal data in a text, and the part that has to go.
PLANTED = {
    "address": [
        "jane (at) mail (dot) host (dot) org", "x" * 70 + " (at) host (dot) org", "JANE [AT] HOST [DOT] ORG", "kim{at}site{dot}net", "lee<at>web<dot>de", "o.neil (AT) uni (DOT) edu (dot) au", "max (at) firm.example.com",
        "ann_b [at] box[dot]co[dot]uk", "r2-d2 (at) droid (dot) io", "pat%x [At] two [Dot] fr", "a.b.c(at)d(dot)e-f(dot)es", "zed [at] deep [dot] deeper [dot] deepest [dot] com",
    ],
    "secret": [
        "password = correcthorsebatterystaple", "token=abcdefghijklmnopqrstuvwxyzab", "secret: short1234key", "pwd='Tr0ub4dor&3'", 'api_key: "k9-2mm/77+aa=="', "auth=Zm9vOmJhcg", "passwd: 0p3nS3sam3!",
        "SECRET = hunteronthehill", "api-key=live_77ab20", "token: eyJ0eXAi.eyJzdWIi.c2ln1", "passphrase: manyquietriversflow", "password:x7#kkw2",
    ],
    "iban": [
        "NL91 ABNA 0417 1643 00", "CH9300762011623852957", "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "IT60 X054 2811 1010 0000 0123 456", "PL61109010140000071219812874", "SE45 5000 0000 0583 9825 7466",
        "DK50 0040 0440 1162 43", "NO93 8601 1117 947", "FI21 1234 5600 0007 85", "PT50000201231234567890154",
    ],
    "number": [
        "call 640 555 0953", "tel: 212-555-0187", "phone (415) 555-2671", "fax 1-800-555-0199", "mobile 020 7946 0958", "contact 303.555.0142", "call 555-0134-22", "tel 030 90 18 20 0", "phone: 1 202 555 0171", "fax (089) 555-1200", "card 5500 0055 5555 5559",
    ],
}
CARRIERS = ("we wrote, {} and went on", "{}, it said", "then they saw {} there", "the note: {}", "and ({}) again", "nobody knew {} before")
#: Near misses that stay.
CLEAN = [
    "look at foo dot com now", "meet me at noon dot sharp", "the key: understanding people", "a secret: nobody knows", "the password is long", "in the years 1914-1918 and 1939-1945", "version 10.4.2 of 12.03.2020", "about 12 000 000 people",
    "model AB12 3456 7890 1234 sold", "the token economy = growth", "see pages 100-200 at home", "file report_of_year_2019_final here", "he said (at last) dot and done", "token ring", "key = C", "Password: required",
]


def test_recall_and_precision_by_kind(spark):
    """Planted forms outside the examples, amid plain text: whole spans, at least nine of ten of each kind, and nothing of what is clean."""
    texts, want = [], {}
    for kind, forms in PLANTED.items():
        for form in forms:
            word = re.match(r"(?i)((?:call|tel|phone|fax|mobile|contact|card):? |[a-z_-]+ ?[:=] ?[\"']?)", form) if kind in ("number", "secret") else None
            value = (form[word.end() :] if word else form).rstrip("\"'").lstrip("(")
            text = CARRIERS[len(texts) % len(CARRIERS)].format(form)
            texts.append((len(texts), text))
            want[len(texts) - 1] = (kind, text.index(value), text.index(value) + len(value))
    clean = [(1000 + i, CARRIERS[i % len(CARRIERS)].format(t)) for i, t in enumerate(CLEAN)]
    filler = [(2000 + i, "plain words that say nothing at all about anyone") for i in range(40)]
    rows = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in pii.find(frame(spark, texts + clean + filler)).collect()}
    right, total, wrong = {}, {}, [t for i, t in clean if rows[i]]
    for i, (kind, a, b) in want.items():
        total[kind] = total.get(kind, 0) + 1
        covers = any(int(x) <= a and int(y) >= b for _, x, y in rows[i])
        right[kind] = right.get(kind, 0) + covers
    missed = [dict(texts)[i] for i, (_, a, b) in want.items() if not any(int(x) <= a and int(y) >= b for _, x, y in rows[i])]
    assert all(right[k] >= 0.9 * total[k] for k in total), (right, total, missed)
    assert len(wrong) <= 0.1 * len(clean), wrong
    whole = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts[:12])).collect()}
    assert all(t == CARRIERS[i % len(CARRIERS)].format("<ADDRESS>") for i, t in whole.items()), whole
