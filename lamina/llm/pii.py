"""Personal data: candidate generation, gradient boosting on format and context, calibrated thresholds.

Generators with high recall propose overlapping spans: four strict kinds (email, ip,
card, phone) whose checks decide alone, and loose kinds (written-out addresses, long
numbers, tokens and values assigned to key words, bank accounts), which read the text with the strict spans blanked out. Each loose
candidate has two vectors of features, one of its format and one of its context, and two
weak labels: its context speaks for it (a contact, card or key word before it), or its
format does (bracketed separators, the shape of a telephone number or a checksum, the form
of a known key). The trees of the format learn the label of the context and those of the
context the label of the format, so that neither can read its own label: what stands
behind key words teaches the format of keys, also of those that no word announces. A
candidate that only its own view speaks for is left out of that view's training.

All candidates of all texts are counted by vector; the table of counts is bounded by the
number of vectors (not by the corpus), and boosted trees with logistic loss are fitted to
it on the driver, beside a few labelled examples of each kind, with counter-examples,
which decide where a corpus says nothing. Every tree parts the kinds first, so that a rare
kind is learned beside frequent ones. Scores are calibrated on the fold the trees have not
seen, and each kind and view gets the lowest threshold whose precision there is high
enough. A span is selected if one of its views reaches its threshold. The trees are then
SQL expressions: candidates, features and scores never leave the JVM. Texts with very many
candidates are folded in chunks, so that their cost stays near their length.

Defined results: a null text is empty and has no spans; a null id takes part like any
other; repeated rows give repeated output rows; strict spans always stay and no loose span
overlaps one; of overlapping loose spans the leftmost, then the longest stays; an empty
table gives an empty result; other input columns are kept as they are by `redact`,
whatever their names, and ignored by `find`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import Scratch

STRICT = ("email", "ip", "card", "phone")
LOOSE = ("address", "number", "secret", "iban")
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\}|<at>)", r"(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot )"
#: Parts of a domain up to the last one; with a bracketed `at` plain dots part them too.
_PARTS = r"[a-z0-9-]++(?: ?{dot} ?[a-z0-9-]++)* ?{dot} ?[a-z][a-z0-9-]++"
_KEY_WORD = r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|key|auth)"
#: The generators. A prefix test spares most texts the search; it never rejects a text with a match.
GENERATORS = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9](?:[ ().-]*+[0-9]){8,14}+(?![ ().-]*+[0-9])"),
    # a local part of any length and all parts of the domain, whatever the case
    "address": (
        r"(?i)(?:[(\[{< ]dot[)\]}> ]|[(\[{<]at[)\]}>])",
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: ?" + _AT + " ?" + _PARTS.replace("{dot}", f"(?:{_DOT}|[.])") + "| at " + _PARTS.replace("{dot}", _DOT) + ")",
    ),
    "number": (r"[0-9][0-9 ().-]{6}", r"[0-9](?<![0-9][0-9])[0-9 ().-]{6,}[0-9]"),
    # long tokens with a digit; what is assigned to a key word with "=", or with ":" if it is long or has a digit
    "secret": (
        r"[0-9]|(?i:" + _KEY_WORD + r"[\"']?[ ]{0,2}[:=])",
        r"[A-Za-z0-9_-](?<![A-Za-z0-9_-][A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{19,}+"
        r"|(?<=[:= \"'])(?<=[:=][ ]{0,2}[\"']?)(?<=(?i:" + _KEY_WORD + r")[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?)(?<![^\s\"':=])(?:(?<=[=][ ]{0,2}[\"']?)[^\s\"',;]{6,}+|(?=[^\s\"',;]*?[0-9])[^\s\"',;]{6,}+|[^\s\"',;]{16,}+)",
    ),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
}
#: Words before a span that speak for it.
CONTEXT = (
    (1, r"(?i)(?:tel|phone|call|fax|mobile|mail|contact)[^A-Za-z]{0,4}$"),
    (2, r"(?i)(?:key|token|secret|passw(?:or)?d|auth|bearer)[^A-Za-z]{0,4}$"),
    (3, r"(?i)(?:card|visa|iban|account|ssn)[^A-Za-z]{0,4}$"),
)
#: Separators of a written-out address that no running text has, the shape of a telephone number, the forms of known keys.
BRACKETS = (r"(?i)[(\[{<]at[)\]}>]", r"(?i)[(\[{<]dot[)\]}>]")
TELEPHONE = r"^(?:[0-9]{1,3}[ .-])?[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"
KNOWN_KEY = r"^(?:(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|xox[abp]-|eyJ|glpat-).{16,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Of features that part the candidates alike, the trees take the first.
FORMAT = ("mark", "digits", "letters", "separators", "size", "variety", "runs", "tight")
AROUND = ("context", "assigned", "opens", "closes", "line")
VIEWS = {"format": FORMAT, "context": AROUND}
_ADDRESS, _NUMBER, _SECRET, _IBAN = (len(STRICT) + LOOSE.index(name) for name in LOOSE)
#: Examples of each loose kind and whether they are personal data.
EXAMPLES = (
    (_ADDRESS, 1, "write to jane (at) host (dot) org today"), (_ADDRESS, 1, "mail bob.smith [at] site [dot] net"), (_ADDRESS, 1, "ask ann [at] mail [dot] org"), (_ADDRESS, 1, "contact ann at mail dot com"),
    (_ADDRESS, 1, "contact: jo2 at host dot org"), (_ADDRESS, 1, "x, who (at) mail (dot) com"), (_ADDRESS, 0, "look at foo dot com now"), (_ADDRESS, 0, "meet at noon dot the end"),
    (_ADDRESS, 0, "stare at one dot on it"), (_ADDRESS, 0, "good at polka dot dresses"), (_ADDRESS, 0, "we met at home dot anyway"),
    (_NUMBER, 1, "please call 555 123 4567"), (_NUMBER, 1, "fax 555-987-6543"), (_NUMBER, 1, "tel (030) 123-4567"), (_NUMBER, 1, "phone 1 640 555-0953"), (_NUMBER, 1, "account 1234 5678 90"),
    (_NUMBER, 0, "in the years 1939-1945 they met"), (_NUMBER, 0, "between 2019 - 2021"), (_NUMBER, 0, "on 12.10.2019 - 14"), (_NUMBER, 0, "about 1 000 000 people"), (_NUMBER, 0, "it is 3.14159265 or so"),
    (_NUMBER, 0, "rows 12 34 56 78 90"), (_NUMBER, 0, "ISBN 978-3-16-148410-0"), (_NUMBER, 0, "id 20240131"), (_NUMBER, 0, "pages 1000-2000 and on"),
    (_SECRET, 1, 'api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), (_SECRET, 1, "token: ghp_16C7e42F292c6912E7710c838347Ae178B4a"), (_SECRET, 1, 'secret="wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY1"'),
    (_SECRET, 1, "password = hT7kq92LmZx04VbnQp81"), (_SECRET, 1, "bearer eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"), (_SECRET, 0, "words and_a_long_name_with_1_digit_inside here"), (_SECRET, 0, "the covid-19-related-restrictions of"),
    (_SECRET, 0, "see chapter-12-of-the-long-story"), (_SECRET, 0, "a 00000000000000000000000 run"), (_SECRET, 0, "file product_catalogue_2019_edition"), (_SECRET, 0, "----------2019----------"),
    (_SECRET, 0, "donaudampfschifffahrt1234567890gesellschaft"), (_SECRET, 1, "pwd=openthedoornow"), (_SECRET, 1, "passphrase: allthegreenhorsesrun"),
    (_SECRET, 1, "(password: ninelongquietwords7) as said"), (_SECRET, 1, "log in with pwd='hT7kq9!x' now"), (_SECRET, 1, "secret = opensesame1, then go"), (_SECRET, 1, '"token": "Zx9-kkq2/+"}'), (_SECRET, 1, "(secret=theroadgoeseveron)"),
    (_IBAN, 1, "iban DE89 3704 0044 0532 0130 00"), (_IBAN, 1, "to FR1420041010050500013M02606 today"), (_IBAN, 1, "account GB29 NWBK 6016 1331 9268 19"), (_IBAN, 1, "x AT61 1904 3002 3457 3201"),
    (_IBAN, 0, "the model AB12 3456 7890 1234 came"), (_IBAN, 0, "code XX00 AAAA BBBB CCCC here"), (_IBAN, 0, "part GH45 1111 2222 3333 44 of"), (_IBAN, 0, "plate KL20 9988 7766 55"),
)
#: Rows that an example counts for.
EXAMPLE_ROWS = 5
SPAN = "struct<kind:int,start:int,end:int,value:string,before:string,after:string>"
LEAN = "struct<kind:int,start:int,end:int>"
#: Steps of a fold whose results are gathered before they join the others: adding to an array copies it.
CHUNK = 256


def _sql_text(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _fold(n: str, state: dict[str, str], element: str, step) -> str:
    """SQL of an array that a fold over 0 .. n - 1 builds; step(acc, i) gives the new state, with `out`, from acc.

    Chunks of CHUNK steps are folded on their own and joined at the end.
    """
    empty, fields = f"cast(array() as array<{element}>)", ", ".join(f"'{k}', {v}" for k, v in state.items())
    kept = ", ".join(f"'{k}', acc.{k}" for k in state)
    chunk = f"aggregate(sequence(j, least(j + {CHUNK}, {n}) - 1), named_struct({kept}, 'out', {empty}), (b, i) -> {step('b', 'i')})"
    joined = f"transform(array({chunk}), r -> named_struct({', '.join(f"'{k}', r.{k}" for k in state)}, 'out', concat(acc.out, array(r.out))))[0]"
    outer = f"named_struct({fields}, 'out', cast(array() as array<array<{element}>>))"
    return f"if({n} = 0, {empty}, aggregate(sequence(0, {n} - 1, {CHUNK}), {outer}, (acc, j) -> {joined}, acc -> flatten(acc.out)))"


def _matches(text: str, kind: int, probe: str, pattern: str) -> str:
    """SQL for all matches with their places in code points: lengths of the pieces between matches and of the matches add up."""
    search = _sql_text(pattern)

    def step(acc: str, i: str) -> str:
        start = f"{acc}.at + length(z.parts[{i}])"
        hit = f"""named_struct('kind', {kind}, 'start', {start}, 'end', {start} + length(z.hits[{i}]), 'value', z.hits[{i}],
            'before', right(z.parts[{i}], 24), 'after', left(z.parts[{i} + 1], 8))"""
        return f"named_struct('at', {start} + length(z.hits[{i}]), 'out', concat({acc}.out, array({hit})))"

    found = _fold("size(z.hits)", {"at": "0"}, SPAN, step)
    bound = f"transform(array(named_struct('parts', split({text}, {search}, -1), 'hits', regexp_extract_all({text}, {search}, 0))), z -> {found})[0]"
    return f"if({text} rlike {_sql_text(probe)}, {bound}, cast(array() as array<{SPAN}>))"


def _blanked() -> str:
    """SQL of `_p_text` with a character that no generator takes in the place of each one of a strict span."""

    def step(acc: str, i: str) -> str:
        c = f"o[{i}]"
        new = f"array(substring(_p_text, {acc}.at + 1, greatest({c}.start - {acc}.at, 0)), repeat('\\u0001', greatest({c}.end - greatest({acc}.at, {c}.start), 0)))"
        return f"named_struct('at', greatest({acc}.at, {c}.end), 'out', concat({acc}.out, {new}))"

    pieces = _fold("size(o)", {"at": "0"}, "string", step)
    ordered = "array_sort(_p_strict, (a, b) -> a.start - b.start)"
    return f"transform(array({ordered}), o -> concat(array_join({pieces}, ''), substring(_p_text, array_max(transform(o, c -> c.end)) + 1)))[0]"


_DIGITS = "regexp_replace(c.value, '[^0-9]', '')"
_LUHN = f"""transform(array({_DIGITS}), d -> aggregate(sequence(1, length(d)), 0, (s, i) -> s + transform(
    array(int(substring(d, length(d) - i + 1, 1)) * if(i % 2 = 0, 2, 1)), v -> if(v > 9, v - 9, v))[0]))[0] % 10 = 0"""
_VALID = f"""case c.kind when 0 then true when 1 then forall(split(c.value, '[.]'), p -> coalesce(try_cast(p as int), 256) <= 255)
    when 2 then {_LUHN} when 3 then true else false end"""
#: The first four characters at the end, letters as 10 to 35: 1 is left over of 97.
_MOD97 = """transform(array(replace(c.value, ' ', '')), v -> aggregate(split(concat(substring(v, 5), left(v, 4)), ''), 0,
    (s, x) -> if(x = '', s, if(x rlike '[0-9]', s * 10 + int(x), s * 100 + ascii(x) - 55) % 97)))[0] = 1"""
_QUOTE = "\"" + chr(39)


def _features() -> dict[str, str]:
    """SQL of both vectors of a candidate c, by view."""
    context = "case " + " ".join(f"when c.before rlike {_sql_text(p)} then {n}" for n, p in CONTEXT) + " else 0 end"
    bucket = lambda value, bounds: f"(case {' '.join(f'when {value} <= {b} then {n}' for n, b in enumerate(bounds))} else {len(bounds)} end)"
    mark = f"""case c.kind when {_ADDRESS} then int(c.value rlike {_sql_text(BRACKETS[0])}) + int(c.value rlike {_sql_text(BRACKETS[1])})
        when {_NUMBER} then int(c.value rlike {_sql_text(TELEPHONE)} or length({_DIGITS}) between 13 and 19 and {_LUHN})
        when {_IBAN} then int({_MOD97}) else int(c.value rlike {_sql_text(KNOWN_KEY)}) end"""
    side = lambda text, far, near: f"case when {text} = '' then 0 when {text} rlike {_sql_text(far)} then 1 when {text} rlike {_sql_text(near)} then 2 else 3 end"
    parts = {
        "digits": bucket(f"length({_DIGITS})", (0, 3, 6, 9, 12)),
        "letters": "case when not c.value rlike '[A-Za-z]' then 0 when c.value rlike '^[0-9a-f]+$' then 1 when c.value rlike '[a-z]' and c.value rlike '[A-Z]' then 2 else 3 end",
        "separators": "least(" + " + ".join(f"int(c.value rlike {_sql_text(p)})" for p in ("[ ]", "[_-]", "[.]", r"[()\[\]]")) + ", 2)",
        "size": bucket("length(c.value)", (11, 15, 23, 35)),
        "variety": bucket("size(array_distinct(split(left(c.value, 64), '')))", (6, 12)),
        "runs": bucket("length(regexp_replace(left(c.value, 64), '[0-9]+|[A-Za-z]+', 'x'))", (3, 8)),
        "mark": mark,
        "tight": "int(c.before rlike '[A-Za-z0-9]$' or c.after rlike '^[A-Za-z0-9]')",
        "context": context,
        "assigned": f"int(c.before rlike {_sql_text('[=:][ ]?[' + _QUOTE + ']?$')})",
        "opens": side("c.before", "[ ]$", f"[{_QUOTE}(=:,;]$"),
        "closes": side("c.after", "^[ ]", f"^[{_QUOTE}).,;]"),
        "line": r"int(c.before rlike r'\n')",
    }
    return {view: "named_struct(" + ", ".join(f"'{f}', {parts[f]}" for f in names) + ")" for view, names in VIEWS.items()}


#: Weak labels, each from the view that the trees of the other don't see.
_LABELS = {
    "format": f"int(case c.kind when {_ADDRESS} then v.context.context = 1 when {_NUMBER} then v.context.context in (1, 3) when {_IBAN} then v.context.context = 3 else v.context.context = 2 and v.context.assigned = 1 end)",
    "context": f"int(v.format.mark > 0)",
}


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `_p_text`, and beside it `_p_strict` (strict spans that pass their checks) and `_p_loose` (all other candidates with both vectors and labels)."""
    strict = ", ".join(_matches("_p_text", k, *GENERATORS[name]) for k, name in enumerate(STRICT))
    blank = _blanked()
    loose = ", ".join(_matches("_p_blank", k + len(STRICT), *GENERATORS[name]) for k, name in enumerate(LOOSE))
    views = _features()
    shaped = f"""transform(_p_raw, c -> transform(array(named_struct('format', {views['format']}, 'context', {views['context']})), v -> named_struct(
        'kind', c.kind, 'start', c.start, 'end', c.end, 'format', v.format, 'context', v.context, 'by_context', {_LABELS['format']}, 'by_format', {_LABELS['context']}))[0])"""
    df = docs.withColumn("_p_strict", F.expr(f"filter(concat({strict}), c -> {_VALID})"))
    df = df.withColumn("_p_blank", F.expr(f"if(size(_p_strict) = 0, _p_text, {blank})"))
    df = df.withColumn("_p_raw", F.expr(f"concat({loose})")).withColumn("_p_loose", F.expr(shaped))
    lean = "transform(_p_strict, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))"
    return df.withColumn("_p_strict", F.expr(lean)).drop("_p_blank", "_p_raw")


def count_vectors(found: DataFrame) -> dict[str, list[dict]]:
    """Candidates of the whole corpus by view, kind, fold, vector and label: at most one row for each possible vector; found has `_p_id` and `_p_loose`."""
    fold = F.crc32(F.coalesce(F.col("_p_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = found.where("size(_p_loose) > 0").select(fold.alias("held_out"), F.explode("_p_loose").alias("c"))
    both = []
    for view, label, own in (("format", "by_context", "by_format"), ("context", "by_format", "by_context")):
        vector = F.concat_ws(",", *(F.col(f"c.{view}.{f}") for f in VIEWS[view]))
        both.append(F.struct(F.lit(view).alias("view"), vector.alias("vector"), F.col(f"c.{label}").alias("label"), F.col(f"c.{own}").alias("own")))
    known = rows.select("held_out", "c.kind", F.explode(F.array(*both)).alias("v"))
    # what only its own view speaks for is neither a positive nor a negative there
    known = known.where("v.label = 1 or v.own = 0").groupBy("held_out", "kind", "v.view", "v.vector", "v.label").count()
    table: dict[str, list[dict]] = {view: [] for view in VIEWS}
    for r in known.collect():
        values = dict(zip(VIEWS[r["view"]], map(int, r["vector"].split(",")), strict=True))
        table[r["view"]].append(values | {"kind": r["kind"], "held_out": r["held_out"], "label": r["label"], "n": r["count"]})
    return table


def example_cells(spark) -> dict[str, list[dict]]:
    """The labelled examples as cells of both views and folds, made by the same SQL."""
    docs = spark.createDataFrame(EXAMPLES, "kind int, label int, _p_text string")
    rows = candidates(docs).select("kind", "label", F.explode("_p_loose").alias("c")).where("c.kind = kind").collect()  # a few dozen
    return {view: [r["c"][view].asDict() | {"kind": r["kind"], "held_out": h, "label": r["label"], "n": EXAMPLE_ROWS} for r in rows for h in (False, True)] for view in VIEWS}


# ---- boosting on the tables of counts (driver; bounded by the number of vectors)


def _grow(x: dict[str, np.ndarray], grads: np.ndarray, hess: np.ndarray, rows: np.ndarray, names: tuple, depth: int):
    """A tree (feature, cut, tree up to the cut, tree above it), or a leaf's value."""
    total_g, total_h = grads[rows].sum(), hess[rows].sum()
    best = (1e-9, None, 0)
    for f in names if depth else ():
        values = x[f][rows]
        g, h = (np.cumsum(np.bincount(values, part[rows]))[:-1] for part in (grads, hess))
        if len(g):
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            cut = int(np.argmax(np.round(gain, 9)))
            if gain[cut] > best[0] + 1e-12:
                best = (gain[cut], f, cut)
    if best[1] is None:
        return float(-total_g / (total_h + 1))
    _, f, cut = best
    low = x[f][rows] <= cut
    return (f, cut, *(_grow(x, grads, hess, rows[side], names, depth - 1) for side in (low, ~low)))


def _values(tree, x: dict[str, np.ndarray]) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x["kind"]), tree)
    return np.where(x[tree[0]] <= tree[1], _values(tree[2], x), _values(tree[3], x))


def _columns(cells: list[dict], names: tuple) -> dict[str, np.ndarray]:
    return {f: np.array([c[f] for c in cells], np.int64) for f in (*names, "kind", "label", "n", "held_out")}


def fit(cells: list[dict], names: tuple, rounds: int = 10, depth: int = 3, rate: float = 0.5, precision: float = 0.9) -> dict:
    """Boosted trees on the counts of the training fold; calibration and a threshold for each kind from the held-out fold."""
    model = {"trees": [], "rate": rate, "slope": 1.0, "shift": 0.0, "thresholds": {}}
    order = sorted(cells, key=lambda c: (c["kind"], *(c[f] for f in names), c["held_out"], c["label"]))
    folds = {(c["kind"], c["held_out"]) for c in cells if c["label"]}
    # a kind whose positives all lie in one fold is learned and judged on both
    both = lambda c: not {(c["kind"], False), (c["kind"], True)} <= folds
    train, held = (_columns([c for c in order if c["held_out"] == side or both(c)], names) for side in (False, True))
    if not train["label"].any():
        return model
    scores = np.zeros(len(train["n"]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scores))
        grads, hess = train["n"] * (p - train["label"]), train["n"] * p * (1 - p)
        tree = None  # its first splits part the kinds, so that a rare one is learned beside frequent ones
        for kind in reversed(np.unique(train["kind"]).tolist()):
            own = _grow(train, grads, hess, np.flatnonzero(train["kind"] == kind), names, depth)
            tree = own if tree is None else ("kind", kind, own, tree)
        model["trees"].append(tree)
        scores = scores + rate * _values(tree, train)
    judge = held if len(set(held["label"].tolist())) == 2 else train
    raw = rate * sum(_values(t, judge) for t in model["trees"])
    slope, shift, n = 1.0, 0.0, judge["n"].sum()
    for _ in range(200):  # Platt scaling, with a small pull to the identity
        q = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        away = judge["n"] * (q - judge["label"]) / n
        slope, shift = slope - 0.05 * float((away * raw).sum() + 0.01 * (slope - 1)), shift - 0.05 * float(away.sum())
    model |= {"slope": slope, "shift": shift}
    q = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
    for kind in np.unique(judge["kind"]).tolist():
        own = judge["kind"] == kind
        for limit in np.unique(q[own & (q >= 0.5)]).tolist():
            above = own & (q >= limit)
            if (judge["n"] * judge["label"])[above].sum() >= precision * judge["n"][above].sum():
                model["thresholds"][kind] = limit - 1e-9
                break
    return model


def fitted(found: DataFrame, spark) -> dict[str, dict]:
    counts, examples = count_vectors(found), example_cells(spark)
    return {view: fit([*counts[view], *examples[view]], names) for view, names in VIEWS.items()}


def _tree_sql(tree, view: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f = "c.kind" if tree[0] == "kind" else f"c.{view}.{tree[0]}"
    return f"if({f} <= {tree[1]}, {_tree_sql(tree[2], view)}, {_tree_sql(tree[3], view)})"


def _reaches(model: dict, view: str) -> str:
    """SQL: the calibrated score of candidate c in this view reaches its kind's threshold."""
    if not model["thresholds"]:
        return "false"
    total = " + ".join(f"{model['rate']!r}D * {_tree_sql(t, view)}" for t in model["trees"])
    limits = "case c.kind " + " ".join(f"when {k} then {v!r}D" for k, v in model["thresholds"].items()) + " else 2D end"
    return f"1 / (1 + exp(-least(greatest({model['slope']!r}D * ({total}) + {model['shift']!r}D, -30D), 30D))) >= {limits}"


_BY_PLACE = "(a, b) -> case when a.start <> b.start then a.start - b.start else b.end - a.end end"


def select_spans(found: DataFrame, models: dict[str, dict]) -> DataFrame:
    """Adds `_p_spans`: strict spans and the loose ones above a threshold, without overlaps among the loose."""
    good = " or ".join(_reaches(models[view], view) for view in VIEWS)
    picked = f"array_sort(filter(_p_loose, c -> {good}), {_BY_PLACE})"

    def step(acc: str, i: str) -> str:
        c = f"o[{i}]"
        new = f"named_struct('at', {c}.end, 'out', concat({acc}.out, array(named_struct('kind', {c}.kind, 'start', {c}.start, 'end', {c}.end))))"
        return f"if({c}.start < {acc}.at, {acc}, {new})"

    apart = f"transform(array({picked}), o -> {_fold('size(o)', {'at': '0'}, LEAN, step)})[0]"
    return found.withColumn("_p_spans", F.expr(f"array_sort(concat(_p_strict, if(size(_p_loose) = 0, cast(array() as array<{LEAN}>), {apart})))"))


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{n}'" for n in (*STRICT, *LOOSE))
    return F.expr(f"array_join(transform({spans}, c -> concat_ws(':', array({names})[c.kind], string(c.start), string(c.end))), ',')")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_p_text")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the strict spans and all spans of every row.

    The generators read each text once; what they find is written out, without texts, and read for the counts and for the scores.
    """
    found = candidates(docs.select(F.col(id_col).alias("_p_id"), _text(text_col))).drop("_p_text")
    found = Scratch(docs.sparkSession, "pii").table("candidates", found)
    rows = select_spans(found, fitted(found, docs.sparkSession))
    strict = f"filter(_p_spans, c -> c.kind < {len(STRICT)})"
    counts = [F.expr(f"bigint(size(filter(_p_strict, c -> c.kind = {k})))").alias(f"n_{name}") for k, name in enumerate(STRICT)]
    return rows.select(F.col("_p_id").alias("doc_id"), *counts, F.sha2(_joined(strict), 256).alias("base_sha256"), _joined("_p_spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    # as one struct the columns of the documents, whatever their names, clash with nothing
    found = candidates(docs.select(F.struct(*docs.columns).alias("_p_row"), F.col(id_col).alias("_p_id"), _text(text_col))).drop("_p_text")
    # the generators read each text once: what they find is written beside the row, for the counts and for the scores
    found = Scratch(docs.sparkSession, "redact").table("candidates", found).withColumn("_p_text", F.coalesce(F.col("_p_row")[text_col].cast("string"), F.lit("")))
    rows = select_spans(found, fitted(found, docs.sparkSession))
    names = ", ".join(f"'<{n.upper()}>'" for n in (*STRICT, *LOOSE))

    def step(acc: str, i: str) -> str:
        c = f"o[{i}]"
        new = f"named_struct('at', {c}.end, 'out', concat({acc}.out, array(substring(_p_text, {acc}.at + 1, {c}.start - {acc}.at), array({names})[{c}.kind])))"
        return f"if({c}.start < {acc}.at, named_struct('at', greatest({acc}.at, {c}.end), 'out', {acc}.out), {new})"

    pieces = _fold("size(o)", {"at": "0"}, "string", step)
    whole = f"transform(array(array_sort(_p_spans, {_BY_PLACE})), o -> concat(array_join({pieces}, ''), substring(_p_text, array_max(transform(o, c -> c.end)) + 1)))[0]"
    some = F.size("_p_spans") > 0
    rows = rows.select("_p_row", some.alias("_p_some"), F.when(some, F.expr(whole)).alias("_p_changed"))
    own = {c: F.col("_p_row")[c] for c in docs.columns}
    own[text_col] = F.when(F.col("_p_some"), F.col("_p_changed")).otherwise(own[text_col])
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_p_some"), F.length("_p_changed").cast("long")).otherwise(own["n_chars"])
    return rows.select(*(v.alias(c) for c, v in own.items()))
