"""All queries over the reference tables and their SQL twins (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import embedding, scoring, text, ulid, vectors
from lamina.operators import episodic, knn, oplog, tiers, working
from lamina.operators.positions import numbered
from lamina.plans import context, diagnostics
from lamina.plans.recall import recall
from lamina.schemas import MEMORY_KINDS, OPLOG
from lamina.session import Scratch
from lamina.sources import cold, pins, sessions, testdata
from lamina.sources.store import OpLogStore
from lamina.sources.testdata import Layers
from lamina.sources.vector_index import GraphIndex
from lamina.streaming import events as streams
from lamina.streaming import jobs, schedulers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = f"timestamp '{testdata.NOW}'"
VEC = 7
_CTE = {"epi": testdata.EPISODIC, "items": testdata.SEMANTIC, "turns": testdata.TURNS, "pins": testdata.PINS, "vecs": "select vec_id as id, embedding from embeddings"}


def _now():
    return F.expr(NOW)


def query(sql: str | None = None, recursive: bool = False, **ctes: str):
    """Register a query under its function's name; the SQL may use the layers (epi, items, turns, pins, vecs) and the given CTEs."""

    def register(f: Callable[[Layers], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Layers(spark, sf_dir))
        if sql is not None:
            whole = sql + " ".join(ctes.values())
            parts = [f"{k} as ({v})" for k, v in _CTE.items() if f" {k}" in whole] + [f"{k} as ({v})" for k, v in ctes.items()]
            ORACLES[f.__name__] = (f"with {'recursive ' if recursive else ''}{', '.join(parts)} " if parts else "") + sql
        return f

    return register


_DIST = f"round(1 - list_inner_product(v.embedding::double[], (select embedding::double[] from embeddings where vec_id = {VEC})), 6) + 0.0"
_T1 = "order by last_accessed desc, retrieval_weight desc, created_at desc, id"
_RECENCY = "exp(-greatest((floor(epoch({now})) - floor(epoch({ts}))) / 86400.0, 0.0) * ln(2.0) / 14.0)"


def _recency(ts: str) -> str:
    return _RECENCY.format(now=NOW, ts=ts)


# ---- recency and listings


@query(f"select id, kind, scope, payload, retrieval_weight, last_accessed, created_at from epi {_T1} limit 20")
def recent_top20(t: Layers) -> DataFrame:
    return episodic.recall_recent(t.episodic, 20)


@query(f"select id, kind, scope, payload, retrieval_weight, last_accessed, created_at from epi where scope = 'work' and kind = 'click' {_T1} limit 50")
def recent_scope_kind(t: Layers) -> DataFrame:
    return episodic.recall_recent(t.episodic, 50, "work", "click")


def _tiered(t: Layers, hot: int = 7, warm: int = 21, now: str = NOW) -> DataFrame:
    return tiers.consolidated(t.episodic.withColumn("tier", F.lit("hot")), F.expr(now), hot, warm)


def _tier_sql(hot: int = 7, warm: int = 21, now: str = NOW) -> str:
    return f"select *, case when last_accessed <= {now} - interval {warm} day then 'cold' when last_accessed <= {now} - interval {hot} day then 'warm' else 'hot' end as tier from epi"


@query("select id, created_at, row_number() over (order by created_at desc, id) as pos from t where tier = 'hot'", t=_tier_sql())
def list_hot(t: Layers) -> DataFrame:
    return _positions(episodic.list_hot(_tiered(t)).select("id", "created_at"), "created_at desc, id")


@query("select id, created_at, row_number() over (order by created_at, id) as pos from t where tier = 'warm'", t=_tier_sql())
def list_warm(t: Layers) -> DataFrame:
    return _positions(episodic.list_warm(_tiered(t)).select("id", "created_at"), "created_at, id")


def _positions(rows: DataFrame, order: str) -> DataFrame:
    keys = [F.expr(k.replace(" desc", "")).desc() if k.endswith(" desc") else F.expr(k).asc() for k in order.split(", ")]
    return numbered(rows, keys)


@query("select id, tier from t where id in (select max(id) from t group by tier)", t=_tier_sql())
def find_by_id(t: Layers) -> DataFrame:
    rows = _tiered(t)
    ids = [r["id"] for r in rows.groupBy("tier").agg(F.max("id").alias("id")).collect()]  # three rows
    found = [episodic.find(rows, i).select("id", "tier") for i in ids]
    return diagnostics.union_all(found)


# ---- vectors and recall


@query(f"select id, {_DIST} as distance from vecs v order by distance, id limit 10")
def knn_exact_top10(t: Layers) -> DataFrame:
    return knn.nearest(t.vectors, t.query_vector(VEC), 10).select("id", "distance")


@query(
    "select qid, id, distance, rank from (select *, row_number() over (partition by qid order by distance, id)::int as rank from d) where rank <= 10",
    d="select q.id as qid, v.id, round(1 - list_inner_product(v.embedding::double[], q.embedding::double[]), 6) + 0.0 as distance from vecs v, vecs q where q.id % 100 = 0",
)
def knn_batch_top10(t: Layers) -> DataFrame:
    return knn.nearest_batch(t.vectors, t.vectors.where("id % 100 = 0").selectExpr("id as qid", "embedding"), 10)


@query()
def ann_lsh_top10(t: Layers) -> DataFrame:
    return knn.nearest_lsh(t.vectors, t.query_vector(VEC), 10)


_HITS = f"select i.id, i.content, i.kind, i.scope, {_DIST} as score from items i join vecs v on i.id = v.id"


@query("select * from h where scope = 'es' order by score, id limit 10", h=_HITS)
def recall_scope_exact(t: Layers) -> DataFrame:
    return recall(t.semantic, t.vectors, t.query_vector(VEC), 10, scope="es").select("id", "content", "kind", "scope", "score")


@query(
    "select i.id, i.content, i.kind, i.scope, n.score from n join items i on i.id = n.id where i.scope = 'es' order by n.score, i.id limit 10",
    n=f"select id, {_DIST} as score from vecs v order by score, id limit 40",
)
def recall_scope_overfetch(t: Layers) -> DataFrame:
    return recall(t.semantic, t.vectors, t.query_vector(VEC), 10, scope="es", mode="overfetch").select("id", "content", "kind", "scope", "score")


@query("select * from h where kind = 'decision' order by score, id limit 10", h=_HITS)
def recall_kind_exact(t: Layers) -> DataFrame:
    return recall(t.semantic, t.vectors, t.query_vector(VEC), 10, kind="decision").select("id", "content", "kind", "scope", "score")


@query("select * from h where id % 5 <> 0 order by score, id limit 10", h=_HITS)
def recall_orphan_skip(t: Layers) -> DataFrame:
    known = t.semantic.where("id % 5 <> 0")  # every fifth vector has no item
    return recall(known, t.vectors, t.query_vector(VEC), 10).select("id", "content", "kind", "scope", "score")


# ---- op log

_LOG = """select id as lsn, 'insert' as op, id, 'v' || cast(id as string) as content, cast(null as string) as scope from {v}
  union all select 1000000 + id, case when id % 7 = 0 then 'delete' when id % 3 = 0 then 'replace' else 'patch' end, id,
    case when id % 7 = 0 or id % 2 = 0 then cast(null as string) else 'w' || cast(id as string) end, case when id % 5 = 0 then 'work' end from {v} where id % 2 = 1 or id % 7 = 0
  union all select 2000000 + id, 'insert', id, 'x' || cast(id as string), cast(null as string) from {v} where id % 21 = 0"""
_LOG_SQL = _LOG.format(v="vecs")


def _log(t: Layers) -> DataFrame:
    return t.spark.sql(_LOG.format(v="{v}"), v=t.vectors)


@query("select id, lsn, op, content, scope from (select *, row_number() over (partition by id order by lsn desc) as n from log) where n = 1", log=_LOG_SQL)
def oplog_latest_state(t: Layers) -> DataFrame:
    return oplog.latest(_log(t))


@query("select lsn, op, id, content, scope from log where lsn > 1000100 order by lsn", log=_LOG_SQL)
def oplog_replay_after_lsn(t: Layers) -> DataFrame:
    return oplog.replay(_log(t), 1_000_100)


@query(
    """select id, arg_max(content, lsn) filter (where content is not null) as content, arg_max(scope, lsn) filter (where scope is not null) as scope, max(lsn) as lsn
       from alive group by id having bool_or(op in ('insert', 'replace'))""",
    log=_LOG_SQL,
    cut="select id, max(lsn) as cut from log where op = 'delete' group by id",
    alive="select log.* from log left join cut on log.id = cut.id where op <> 'delete' and (cut is null or lsn > cut)",
)
def update_patch_merge(t: Layers) -> DataFrame:
    log = _log(t).withColumn("created_at", F.lit(None).cast("timestamp"))
    return oplog.merged(log).select("id", "content", "scope", "lsn")


_OVER = "select id from vecs where id % 10 <> 3 union all select id from vecs where id % 10 = 3 and id % 4 <> 1"


def _overlaid(t: Layers) -> DataFrame:
    snapshot = t.vectors.where("id % 10 <> 3 or id % 20 = 13")
    tail = t.vectors.where("id % 10 = 3").selectExpr("id as lsn", "case when id % 4 = 1 then 'delete' else 'insert' end as op", "id", "embedding")
    return oplog.overlay(snapshot, tail)


@query(f"select v.id, {_DIST} as distance from vecs v join o on v.id = o.id order by distance, v.id limit 10", o=_OVER)
def vector_overlay_search(t: Layers) -> DataFrame:
    return knn.nearest(_overlaid(t), t.query_vector(VEC), 10).select("id", "distance")


@query("select count(*) as live from o", o=_OVER)
def live_vector_count(t: Layers) -> DataFrame:
    return _overlaid(t).agg(F.count("*").alias("live"))


@query(
    """select ids.id, case when ids.id in (select id from items) then 'semantic' when ids.id in (select id from pins) then 'procedural'
            when ids.id in (select id from t where tier = 'hot') then 'hot' when ids.id in (select id from t where tier = 'warm') then 'warm' end as layer from ids""",
    t=_tier_sql(), ids="select distinct user_id * 3 as id from events",
)
def forget_resolution(t: Layers) -> DataFrame:
    rows = _tiered(t)
    ids = t.table("events").select((F.col("user_id") * 3).alias("id")).distinct()
    return oplog.resolve_forget(ids, [("semantic", t.semantic), ("procedural", t.pins), ("hot", rows.where("tier = 'hot'")), ("warm", rows.where("tier = 'warm'"))])


# ---- scores and text


@query(f"select id, round(retrieval_weight * 0.8 * {_recency('last_accessed')}, 6) + 0.0 as score from epi")
def scores_episodic(t: Layers) -> DataFrame:
    return t.episodic.select("id", vectors.rounded(scoring.episodic_score(F.col("retrieval_weight"), F.col("last_accessed"), _now())).alias("score"))


@query(f"select i.id, round(least(greatest(1 - ({_DIST}), 0), 1) * 0.7 * {_recency('i.created_at')}, 6) + 0.0 as score from items i join vecs v on i.id = v.id")
def scores_semantic(t: Layers) -> DataFrame:
    rows = t.semantic.join(t.vectors, "id").withColumn("d", vectors.rounded(vectors.cosine_distance(F.col("embedding"), vectors.literal(t.query_vector(VEC)))))
    return rows.select("id", vectors.rounded(scoring.semantic_score(F.col("d"), F.col("created_at"), _now())).alias("score"))


@query(f"select session_id, turn_idx, round(0.9 * {_recency('turn_at')}, 6) + 0.0 as score from turns")
def scores_working(t: Layers) -> DataFrame:
    return t.turns.select("session_id", "turn_idx", vectors.rounded(scoring.working_score(F.col("turn_at"), _now())).alias("score"))


@query("select lang, sum((length(text) + 3) // 4)::bigint as tokens, max((length(text) + 3) // 4)::bigint as most from documents group by lang")
def token_estimate_by_lang(t: Layers) -> DataFrame:
    tokens = text.token_estimate(F.col("text"))
    return t.table("documents").groupBy("lang").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"))


@query("select turn_idx, session_id, case when octet_length(encode(content)) > 500 then substr(content, 1, 500) || '…' else content end as message from turns")
def truncate_message(t: Layers) -> DataFrame:
    return t.turns.select("turn_idx", "session_id", text.truncated_message(F.col("content")).alias("message"))


@query("select id, content as trimmed, length(content)::int as n from items")
def trim_nonblank(t: Layers) -> DataFrame:
    padded = t.semantic.withColumn("padded", F.concat(F.lit("\t  "), "content", F.lit(" \n ")))
    return padded.where(text.non_blank(F.col("padded"))).select("id", text.trimmed(F.col("padded")).alias("trimmed"), F.length(text.trimmed(F.col("padded"))).alias("n"))


@query("""select id, case id % 5 when 0 then [] when 1 then [scope, source] when 2 then [source] when 3 then null else null end as tags from items""")
def tags_parse(t: Layers) -> DataFrame:
    quoted = lambda *c: F.to_json(F.array(*c))
    argument = (
        F.when(F.col("id") % 5 == 0, F.lit("null")).when(F.col("id") % 5 == 1, quoted("scope", "source"))
        .when(F.col("id") % 5 == 2, F.concat(F.lit('"'), F.replace(quoted("source"), F.lit('"'), F.lit('\\"')), F.lit('"')))
        .when(F.col("id") % 5 == 3, F.lit("[1, 2]")).otherwise(F.lit("{}"))
    )
    return t.semantic.select("id", text.parsed_tags(argument).alias("tags"))


@query(
    """select id, case id % 4 when 0 then '{"tool":"recall","query":"' || kind || '"}' when 1 then '{"tool":"switch_scope","new_scope":"' || scope || '"}'
        when 2 then '{"tool":"forget","id":"' || cast(id as varchar) || '"}' else '{"tool":"stats"}' end as payload from epi"""
)
def tool_payload_allowlist(t: Layers) -> DataFrame:
    rows = t.episodic.withColumn("tool", F.element_at(F.array(*map(F.lit, ("recall", "switch_scope", "forget", "stats"))), (F.col("id") % 4 + 1).cast("int")))
    arguments = F.to_json(F.struct(F.col("kind").alias("query"), F.col("scope"), F.col("id").cast("string").alias("id"), F.col("payload").alias("content")))
    return rows.select("id", diagnostics.recorded_call(F.col("tool"), arguments).alias("payload"))


@query("select kind, sum(cast(json_extract_string(payload, '$.k') as bigint))::bigint as total, count(*) filter (where json_valid(payload)) as valid from epi group by kind")
def payload_json(t: Layers) -> DataFrame:
    value = F.get_json_object("payload", "$.k").cast("long")
    return t.episodic.groupBy("kind").agg(F.sum(value).alias("total"), F.count(F.when(F.expr("try_parse_json(payload)").isNotNull(), 1)).alias("valid"))


_STUB = """select id, list_transform(range(0, 8), lambda i: case when i % 2 = 0 then sin(b * 0.07 + i * 0.61803) else cos(n * 0.13 + i * 0.61803) end) as raw from b"""


@query(
    "select id, round(sqrt(list_inner_product(raw, raw)), 6) as norm, list_transform(raw, lambda x: round(x / sqrt(list_inner_product(raw, raw)), 6) + 0.0) as embedding from r",
    b="select id, cast('0x' || substr(hex(encode(content)), 1, 2) as int)::double as b, octet_length(encode(content))::double as n from items",
    r=_STUB,
)
def reembed_stub(t: Layers) -> DataFrame:
    made = t.semantic.select("id", embedding.embedder("stub", 8)(F.col("content")).alias("e"), "content")
    first = F.conv(F.hex(F.substring(F.encode("content", "UTF-8"), 1, 1)), 16, 10).cast("double")
    raw = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i % 2 == 0, F.sin(first * 0.07 + i * 0.61803)).otherwise(F.cos(F.octet_length("content") * 0.13 + i * 0.61803)))
    return made.select("id", F.round(F.sqrt(vectors.dot(raw, raw)), 6).alias("norm"), F.transform("e", lambda x: vectors.rounded(x)).alias("embedding"))


# ---- context


def _context(t: Layers, **options) -> DataFrame:
    session = t.turns.where("session_id = 0")
    return context.build_context(t.pins, t.episodic, t.semantic, t.vectors, session, _now(), **options)


def _context_sql(query_vector: bool, max_tokens: int = 4000, floor: int | None = None, scope: str | None = None, text_ids: bool = False) -> tuple[str, dict]:
    kind = "varchar" if text_ids else "bigint"
    floor = max_tokens // 16 if floor is None else floor
    reserve = min(floor, max_tokens // 4)
    where = f"where scope = '{scope}'" if scope else ""
    sem = f"select i.id, i.content, i.created_at, {_DIST} as distance from items i join vecs v on i.id = v.id {'where i.scope = ' + repr(scope) if scope else ''} order by distance, i.id limit 32"
    ctes = {
        "pin64": f"select * from pins {where} order by line_no limit 64",
        "epi64": f"select * from epi {where} {_T1} limit 64",
        "tur32": "select * from turns where session_id = 0 order by turn_idx desc limit 32",
    }
    parts = [
        "select 'procedural' as layer, id, 1.0::double as score, (length(content) + 3) // 4 as tokens, created_at as seen from pin64",
        f"select 'episodic', id, round(retrieval_weight * 0.8 * {_recency('last_accessed')}, 6) + 0.0, (length(payload) + 3) // 4, last_accessed from epi64",
        f"select 'working', turn_idx, round(0.9 * {_recency('turn_at')}, 6) + 0.0, (length(content) + 3) // 4, turn_at from tur32",
    ]
    if text_ids:
        parts = [part.replace("id,", "lpad(cast(id as varchar), 12, '0') as id,", 1) for part in parts[:2]]
    if query_vector:
        ctes["sem32"] = sem
        parts.append(f"select 'semantic', id, round(least(greatest(1 - distance, 0), 1) * 0.7 * {_recency('created_at')}, 6) + 0.0, (length(content) + 3) // 4, created_at from sem32")
    ctes |= {
        "cand": " union all ".join(parts),
        "o1": "select *, row_number() over (partition by layer order by score desc, id desc) as rn from cand",
        "p1": f"""select layer, id, rn, tokens, tokens <= {reserve} as keep, case when tokens <= {reserve} then tokens else 0 end as used from o1 where rn = 1
            union all select o1.layer, o1.id, o1.rn, o1.tokens, p1.used + o1.tokens <= {reserve}, case when p1.used + o1.tokens <= {reserve} then p1.used + o1.tokens else p1.used end
            from p1 join o1 on o1.layer = p1.layer and o1.rn = p1.rn + 1""",
        "t1": "select coalesce(sum(tokens), 0) as used from p1 where keep",
        "o2": "select c.*, row_number() over (order by score desc, id desc, layer) as rn from cand c where not exists (select 1 from p1 where p1.layer = c.layer and p1.id = c.id and p1.keep)",
        "p2": f"""select cast(null as varchar) as layer, cast(null as {kind}) as id, 0::bigint as rn, false as keep, used from t1 where used < {max_tokens}
            union all select o2.layer, o2.id, o2.rn, p2.used + o2.tokens <= {max_tokens}, case when p2.used + o2.tokens <= {max_tokens} then p2.used + o2.tokens else p2.used end
            from p2 join o2 on o2.rn = p2.rn + 1""",
        "kept": "select layer, id from p1 where keep union all select layer, id from p2 where keep",
    }
    sql = """select layer, row_number() over (partition by layer order by case when layer = 'procedural' then epoch_us(seen) end, case when layer = 'working' then -epoch_us(seen) end,
            case when layer in ('semantic', 'episodic') then -score end, case when layer = 'procedural' then id end, id desc)::int as pos,
            id, score, tokens::bigint as tokens, (sum(tokens) over ())::bigint as total_tokens from cand semi join kept using (layer, id)"""
    return sql, ctes


def _register_context(name: str, sql_options: dict, **options) -> None:
    sql, ctes = _context_sql(**sql_options)

    def run(t: Layers) -> DataFrame:
        own = dict(options)
        if sql_options["query_vector"]:
            own["query"] = t.query_vector(VEC)
        return _context(t, **own)

    run.__name__ = name
    query(sql, recursive=True, **ctes)(run)


_register_context("context_no_query", {"query_vector": False})
_register_context("context_with_query", {"query_vector": True})
_register_context("context_scope", {"query_vector": True, "scope": "personal"}, scope="personal")
_register_context("context_tight_budget", {"query_vector": True, "max_tokens": 600}, max_tokens=600)
_register_context("context_zero_budget", {"query_vector": True, "max_tokens": 0}, max_tokens=0)


_ULID_SQL, _ULID_CTES = _context_sql(query_vector=False, max_tokens=300, text_ids=True)


@query(_ULID_SQL, recursive=True, **{k: v for k, v in _ULID_CTES.items() if k != "tur32"})
def context_ulid_pins(t: Layers) -> DataFrame:
    """String ids, as the tools have them: of pins with equal scores the newest stay."""
    named = lambda df: df.withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))
    found = context.build_context(named(t.pins), named(t.episodic), t.semantic, t.vectors, t.turns.where("false"), _now(), max_tokens=300, details=True)
    return found.select("layer", "pos", "id", "score", "tokens", "total_tokens")


# ---- tiers and the cold store


@query("select tier, count(*) as n from t group by tier", t=_tier_sql())
def consolidate_tier_counts(t: Layers) -> DataFrame:
    return _tiered(t).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"select count(*) filter (where last_accessed <= {NOW} - interval 7 day) as promoted_to_warm, count(*) filter (where last_accessed <= {NOW} - interval 21 day) as archived_to_cold from epi")
def consolidation_report(t: Layers) -> DataFrame:
    return tiers.report(_tiered(t))


_LATER = "timestamp '2024-07-15 00:00:00'"


@query("select tier, count(*) as n from t group by tier", t=_tier_sql(28, 180, _LATER))
def consolidate_defaults(t: Layers) -> DataFrame:
    return _tiered(t, tiers.HOT_DAYS, tiers.WARM_DAYS, _LATER).groupBy("tier").agg(F.count("*").alias("n"))


def _orders(t: Layers) -> DataFrame:
    return t.table("orders").selectExpr("o_orderkey as id", "o_totalprice as price", "cast(o_orderdate as timestamp) as created_at")


_ORDERS = "select o_orderkey as id, o_totalprice as price, cast(o_orderdate as timestamp) as created_at from orders"


@query("select year(created_at)::int as year, quarter(created_at)::int as quarter, printf('%04d-Q%d', year(created_at), quarter(created_at)) as name, count(*) as n from o group by all", o=_ORDERS)
def cold_quarter_counts(t: Layers) -> DataFrame:
    rows = tiers.with_quarter(_orders(t)).groupBy("year", "quarter").agg(F.count("*").alias("n"))
    return rows.withColumn("name", tiers.quarter_name(F.col("year"), F.col("quarter")))


@query("select id, price, created_at from o where year(created_at) = 1996 and quarter(created_at) = 3", o=_ORDERS)
def cold_read_quarter(t: Layers) -> DataFrame:
    store = cold.ColdStore(t.spark, Scratch(t.spark, "cold").path("bundles"))
    store.archive(_orders(t))
    return store.quarter(1996, 3).select("id", "price", "created_at")


@query("select count(distinct (year(created_at), quarter(created_at))) as quarters from o", o=_ORDERS)
def cold_list_quarters(t: Layers) -> DataFrame:
    return tiers.with_quarter(_orders(t)).select("year", "quarter").distinct().agg(F.count("*").alias("quarters"))


@query("select id, case when id % 3 = 0 then price + 1 else price end as price, created_at from o", o=_ORDERS)
def cold_upsert(t: Layers) -> DataFrame:
    store = cold.ColdStore(t.spark, Scratch(t.spark, "cold").path("bundles"))
    store.archive(_orders(t).where("id % 2 = 0 or id % 3 <> 0"))
    store.archive(_orders(t).where("id % 3 = 0").withColumn("price", F.col("price") + 1))
    return store.read().select("id", "price", "created_at")


# ---- diagnostics


@query(
    """select 'semantic' as name, count(*) as n from items union all select 'procedural', count(*) from pins union all select 'episodic_hot', count(*) from t where tier = 'hot'
       union all select 'episodic_warm', count(*) from t where tier = 'warm' union all select 'cold_quarters', count(distinct (year(created_at), quarter(created_at))) from t where tier = 'cold'
       union all select 'total_stored', (select count(*) from items) + (select count(*) from t where tier <> 'cold')""",
    t=_tier_sql(),
)
def stats_counts(t: Layers) -> DataFrame:
    return diagnostics.counts(t.semantic, t.pins, tiers.with_quarter(_tiered(t)), ["year", "quarter"])


@query("select distinct scope from (select scope from pins union all select scope from t where tier <> 'cold' union all select scope from items)", t=_tier_sql())
def list_scopes(t: Layers) -> DataFrame:
    return diagnostics.scopes(t.pins, _tiered(t).where("tier <> 'cold'"), t.semantic)


def _export_sql(limit: int, scope: str | None = None) -> str:
    where = f"where scope = '{scope}'" if scope else ""
    return f"""(select 'procedural' as layer, id, scope, content, created_at from pins {where} order by line_no limit {limit})
        union all (select 'episodic', id, scope, payload, created_at from epi {where} {_T1} limit {limit})
        union all (select 'semantic', id, scope, content, created_at from items {where} order by created_at desc, id limit {limit})"""


@query("select * from x", x=_export_sql(200))
def export_layers(t: Layers) -> DataFrame:
    return diagnostics.export(t.pins, t.episodic, t.semantic)


@query("select * from x", x=_export_sql(50, "personal"))
def export_scope_limit(t: Layers) -> DataFrame:
    return diagnostics.export(t.pins, t.episodic, t.semantic, 50, "personal")


_LINE = "'- [' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z] ' || kind || ' (' || scope || '): ' || payload"


@query(f"select row_number() over ({_T1}) as pos, {_LINE} as line from (select * from epi {_T1} limit 30)")
def summarize_prompt(t: Layers) -> DataFrame:
    prompt = diagnostics.summary_prompt(t.episodic, 30)
    lines = prompt.select(F.posexplode(F.filter(F.split("prompt", "\n"), lambda x: x.startswith("- ["))).alias("p", "line"))
    return lines.select((F.col("p") + 1).cast("long").alias("pos"), "line")


# ---- sessions


@query("select session_id, turn_idx, role, content from (select *, row_number() over (partition by session_id order by turn_idx desc) as n from turns) where n <= 4")
def last_n_turns(t: Layers) -> DataFrame:
    return working.last_turns(t.turns, 4).select("session_id", "turn_idx", "role", "content")


@query("select session_id, turn_idx, role, content from turns where role in ('user', 'assistant') and length(content) > 0")
def message_mirror(t: Layers) -> DataFrame:
    events = t.turns.select("session_id", "turn_idx", F.concat("role", F.lit("_message")).alias("kind"), F.to_json(F.struct("content")).alias("payload"))
    return episodic.mirrored_turns(events).select("session_id", "turn_idx", "role", "content")


@query(
    """select session_id, turn_idx, n as turns_saved, ceil(n / 5.0)::bigint as checkpoint, back = 1 as final from
       (select *, row_number() over (partition by session_id order by turn_idx) as n, row_number() over (partition by session_id order by turn_idx desc) as back from turns) where n % 5 = 0 or back = 1"""
)
def checkpoint_turn_trigger(t: Layers) -> DataFrame:
    return working.turn_checkpoints(t.turns)


@query(
    "select tick from (select unnest(generate_series(lo, hi, interval 5 minute)) as tick from b) k where not exists (select 1 from a where a.tick = k.tick)",
    b="select time_bucket(interval 5 minute, min(created_at)) as lo, time_bucket(interval 5 minute, max(created_at)) as hi from epi",
    a="select distinct time_bucket(interval 5 minute, created_at) as tick from epi",
)
def idle_ticks(t: Layers) -> DataFrame:
    return streams.idle_ticks(t.episodic, 5)


# ---- streams


@query("select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 4) as total from events where date_trunc('day', ts) < (select date_trunc('day', max(ts)) from events) group by all")
def stream_daily_counts(t: Layers) -> DataFrame:
    return streams.daily_counts(t.spark, t.sf_dir)


@query(
    """select user_id, min(ts)::timestamp as started, max(ts)::timestamp as last_event, count(*) as n from
         (select *, sum(gap) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from
           (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as gap from events))
       group by user_id, s having max(ts) + interval 6 hour <= (select max(ts) from events)"""
)
def stream_sessions(t: Layers) -> DataFrame:
    return streams.sessions(t.spark, t.sf_dir)


@query("select distinct user_id, event_type from events")
def stream_dedup(t: Layers) -> DataFrame:
    return streams.first_seen(t.spark, t.sf_dir)


@query("select conv_id as session_id, (count(*) // 5)::bigint as full_checkpoints, count(*) as turns from conversations group by conv_id")
def stream_checkpoints(t: Layers) -> DataFrame:
    return streams.checkpointed_sessions(t.spark, t.sf_dir)


# ---- ids, kinds, tags and pooling


@query("select id, kind in ('fact', 'decision', 'preference', 'conversation') and id % 3 = 0 as valid from items")
def valid_kinds(t: Layers) -> DataFrame:
    given = F.when(F.col("id") % 3 == 0, F.col("kind")).when(F.col("id") % 3 == 1, F.upper("kind")).otherwise(F.concat("kind", F.lit(" ")))
    return t.semantic.select("id", text.valid_kind(given).alias("valid"))


@query("select id, case id % 3 when 0 then [scope, source] when 1 then [] end as tags from items")
def tags_strict(t: Layers) -> DataFrame:
    """An array or nothing; a string that holds an array is refused."""
    quoted = F.to_json(F.array("scope", "source"))
    nested = F.concat(F.lit('"'), F.replace(quoted, F.lit('"'), F.lit('\\"')), F.lit('"'))
    argument = F.when(F.col("id") % 3 == 0, quoted).when(F.col("id") % 3 == 1, F.lit("null")).otherwise(nested)
    return t.semantic.select("id", text.parsed_tags(argument, nested=False).alias("tags"))


@query("select distinct cast(session_id as varchar) as session_id from turns")
def session_uri(t: Layers) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ("", "?x=1", "#top", "/turns"))), (F.col("session_id") % 4 + 1).cast("int"))
    uri = F.concat(F.lit("memory://session/"), F.col("session_id").cast("string"), tail)
    return t.turns.select(text.session_id_of(uri).alias("session_id")).distinct()


@query("select id, (epoch_us(created_at) // 1000)::bigint as ms, 26 as n from epi")
def ulid_times(t: Layers) -> DataFrame:
    made = ulid.timed(F.unix_millis("created_at"), F.col("id"))
    return t.episodic.select("id", made.alias("u")).select("id", ulid.created_ms(F.col("u")).alias("ms"), F.length("u").alias("n"))


@query("select id, row_number() over (order by epoch_ms(created_at), id)::bigint as pos from (select min(id) as id, created_at from (select id, date_trunc('second', created_at) as created_at from epi) group by created_at)")
def ulid_order(t: Layers) -> DataFrame:
    """Ids sort as their times do: one event of each second."""
    rows = t.episodic.groupBy(F.date_trunc("second", "created_at").alias("created_at")).agg(F.min("id").alias("id"))
    return _positions(rows.select("id", ulid.timed(F.unix_millis("created_at"), F.col("id")).alias("u")), "u").select("id", "pos")


_TOKENS = "select id, list_transform(range(0, 16), lambda i: list_transform(range(1, 5), lambda d: v.embedding[4 * i + d]::double)) as tokens from vecs v"
_UNIT = "list_transform(s, lambda x: round(x / greatest(sqrt(list_inner_product(s, s)), 1.1920929e-07), 6) + 0.0)"


def _tokens(t: Layers) -> DataFrame:
    """Vectors of 64 values as 16 token vectors of four."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", 4 * i + 1, F.lit(4)))
    return t.vectors.select("id", cut.alias("tokens"))


@query(
    f"select id, {_UNIT} as pooled from (select id, list_transform(range(1, 5), lambda d: list_sum(list_transform(kept, lambda x: x[d])) / len(kept)) as s from k)",
    k=f"select id, list_transform(list_filter(range(1, 17), lambda i: i <= 4 + id % 13), lambda i: tokens[i]) as kept from ({_TOKENS})",
)
def pooling_mean(t: Layers) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (i <= 4 + F.col("id") % 13).cast("int"))
    return _tokens(t).select("id", F.transform(embedding.mean_pooled(F.col("tokens"), mask), lambda x: vectors.rounded(x)).alias("pooled"))


@query(f"select id, {_UNIT} as pooled from (select id, tokens[1] as s from k)", k=_TOKENS)
def pooling_cls(t: Layers) -> DataFrame:
    return _tokens(t).select("id", F.transform(embedding.cls_pooled(F.col("tokens")), lambda x: vectors.rounded(x)).alias("pooled"))


# ---- vectors of several rows, and of other dimensions


@query(f"select id, min(distance) as distance from d group by id order by min(distance), id limit 10", d=f"select v.id // 3 as id, {_DIST} as distance from vecs v")
def knn_min_per_id(t: Layers) -> DataFrame:
    return knn.nearest_per_id(t.vectors.withColumn("id", F.floor(F.col("id") / 3)), t.query_vector(VEC), 10)


@query("select id as lsn, id from vecs where id > 20 and id % 4 <> 1")
def replay_skips_other_dimensions(t: Layers) -> DataFrame:
    """Every fourth vector was written under a model of another dimension, every sixth op has none."""
    vector = F.when(F.col("id") % 4 == 1, F.slice("embedding", 1, 8)).when(F.col("id") % 6 == 0, F.lit(None)).otherwise(F.col("embedding"))
    return oplog.replay(t.vectors.withColumn("embedding", vector).withColumn("lsn", F.col("id")), 20, 64).select("lsn", "id")


# ---- the file stores


def _local(path: str) -> str:
    """The path of a folder for stores that belong to one process; a shared file system that isn't mounted has none."""
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"{path} isn't a local folder")
    return path.removeprefix("file://")


def _pin_file(t: Layers) -> str:
    """The pins as a file that people edit: a comment and a blank before each line."""
    path = Scratch(t.spark, "pins").path("pinned.jsonl")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "content", "scope", stamp.alias("created_at")))
    t.pins.orderBy("line_no").select(F.explode(F.array(F.lit("# rule"), F.lit(""), line)).alias("value")).coalesce(1).write.text(path)
    return path


@query("select cast(id as varchar) as id, content, scope, created_at, 3 * row_number() over (order by line_no) as line_no from pins")
def pinned_file_read(t: Layers) -> DataFrame:
    return pins.read(t.spark, _pin_file(t)).select("id", "content", "scope", "created_at", "line_no")


@query("select count(*) as n from pins")
def pinned_line_count(t: Layers) -> DataFrame:
    return t.spark.range(1).select(F.lit(pins.count_lines(t.spark, _pin_file(t))).cast("long").alias("n"))


@query("select content, scope from pins where line_no % 3 <> 0")
def pin_and_unpin(t: Layers) -> DataFrame:
    path = _local(Scratch(t.spark, "pins").path("pinned.jsonl"))
    for r in t.pins.orderBy("line_no").toLocalIterator():  # a file that people edit
        made = pins.append(path, r["content"], r["scope"])
        if r["line_no"] % 3 == 0:
            pins.remove(path, made)
    return pins.read(t.spark, path).select("content", "scope")


@query("select cast(session_id as varchar) as session_id, (row_number() over (partition by session_id order by turn_idx) - 1)::int as turn_idx, role, content, turn_at from turns")
def session_files(t: Layers) -> DataFrame:
    folder = _local(Scratch(t.spark, "sessions").path("saved"))
    turn = F.struct("turn_idx", "role", "content", F.concat(F.date_format("turn_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("at"))
    saved = t.turns.groupBy(F.col("session_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    sessions.write_all(folder, saved)
    return sessions.turns(sessions.read(t.spark, folder)).select("session_id", "turn_idx", "role", "content", "turn_at")


def _committed(t: Layers) -> OpLogStore:
    """The op log through group commit, as a stream, into a store."""
    scratch = Scratch(t.spark, "store")
    log = _log(t).withColumn("id", F.col("id").cast("string"))
    missing = [F.lit(None).cast(f.dataType.simpleString()).alias(f.name) for f in OPLOG.fields if f.name not in log.columns]
    log.select("*", *missing).select([f.name for f in OPLOG.fields]).orderBy("lsn").coalesce(1).write.parquet(scratch.path("ops"))
    store = OpLogStore(t.spark, _local(scratch.path("store")), 64)
    jobs.group_commit(t.spark.readStream.schema(OPLOG).parquet(scratch.path("ops")), store, scratch.path("checkpoint")).awaitTermination()
    return store


@query("select cast(id as varchar) as id, content, scope from m", log=_LOG_SQL, cut="select id, max(lsn) as cut from log where op = 'delete' group by id",
       alive="select log.* from log left join cut on log.id = cut.id where op <> 'delete' and (cut is null or lsn > cut)",
       m="""select id, arg_max(content, lsn) filter (where content is not null) as content, arg_max(scope, lsn) filter (where scope is not null) as scope
            from alive group by id having bool_or(op in ('insert', 'replace'))""")  # fmt: skip
def group_commit_state(t: Layers) -> DataFrame:
    """The store's rows after a group commit and a compaction."""
    store = _committed(t)
    store.compact()
    store.close()
    return store.items().select("id", "content", "scope")


@query("select count(*) as lsn, count(*) as pending from log", log=_LOG_SQL)
def group_commit_lsn(t: Layers) -> DataFrame:
    store = _committed(t)
    store.close()
    return t.spark.range(1).select(F.lit(store.last_lsn()).cast("long").alias("lsn"), F.lit(store.pending()).cast("long").alias("pending"))


# ---- events and timers


@query("select id, case when id = (select max(id) from t where tier = 'hot') then timestamp '2024-02-01 00:00:00' else last_accessed end as last_accessed from t", t=_tier_sql())
def touch_event(t: Layers) -> DataFrame:
    rows = _tiered(t)
    last = rows.where("tier = 'hot'").agg(F.max("id")).first()[0]
    return episodic.touch(rows, last, _now()).select("id", "last_accessed")


@query("select session_id, count(distinct epoch(turn_at)::bigint // 30)::bigint as flushes from turns group by session_id")
def checkpoint_timer(t: Layers) -> DataFrame:
    """Saves of each session by the timer alone: one at the end of each 30 seconds in which a turn came."""
    return working.timer_checkpoints(t.turns, 30)


@query("select count(*) as ran, (select count(*) from k) as ticks from k where not exists (select 1 from a where a.tick = k.tick)",
       k="select unnest(generate_series(time_bucket(interval 60 minute, min(created_at)), time_bucket(interval 60 minute, max(created_at)), interval 60 minute)) as tick from epi",
       a="select distinct time_bucket(interval 60 minute, created_at) as tick from epi")
def idle_gate_runs(t: Layers) -> DataFrame:
    """How often consolidation would have run, at hourly ticks, with the events' writes as activity."""
    return streams.gate_runs(t.episodic, 60)


_CLOSES = "case when session_id % 2 = 0 then interval 10 second else interval 40 second end"


@query(
    """select session_id, turn_at as flushed_at, 'turns' as reason, 5::bigint as turns, turn_idx::bigint as through from n where n % 5 = 0
       union all select session_id, least(due, closed) as flushed_at, case when due <= closed then 'timer' else 'shutdown' end as reason, waiting as turns, through from w""",
    n="select *, row_number() over (partition by session_id order by turn_idx) as n, count(*) over (partition by session_id) as total from turns",
    w=f"""select session_id, min(turn_at) + interval 30 second as due, max(turn_at) + any_value({_CLOSES}) as closed, count(*) as waiting, max(turn_idx)::bigint as through
          from n where n > total - total % 5 group by session_id""",
)
def checkpoint_stream(t: Layers) -> DataFrame:
    """The checkpoint scheduler as a stream over turns and closes: by five turns, by its timer of 30 seconds, or at the close 10 or 40 seconds after the last turn."""
    scratch = Scratch(t.spark, "signals")
    closes = t.turns.groupBy("session_id").agg(F.max("turn_at").alias("last")).select("session_id", (F.col("last") + F.expr(_CLOSES.replace("second ", "seconds "))).alias("close_at"))
    scratch.table("rows", schedulers.signals(t.turns, closes))
    return schedulers.checkpoint_flushes(t.spark, scratch.path("rows"))


@query(
    "select store, tick, not exists (select 1 from a where a.store = k.store and a.hour = k.tick - interval 1 hour) as ran from k",
    a="select distinct scope as store, date_trunc('hour', created_at)::timestamp as hour from epi",
    k="select store, unnest(generate_series(min(hour) + interval 1 hour, (select max(hour) from a), interval 1 hour)) as tick from a group by store",
)
def idle_gate_stream(t: Layers) -> DataFrame:
    """The consolidation scheduler as a stream over the writes of each scope: hourly ticks, and whether nothing was written since the one before."""
    scratch = Scratch(t.spark, "writes")
    scratch.table("rows", t.episodic.select(F.col("scope").alias("store"), F.col("created_at").alias("at")))
    return schedulers.idle_gate_ticks(t.spark, scratch.path("rows"))


# ---- approximate search


@query("select 10::bigint as least, true as enough")
def ann_lists_recall(t: Layers) -> DataFrame:
    """Approximate search for every hundredth vector against exact search: rows of the worst query, and whether 0.9 of all were found."""
    queries = t.vectors.where("id % 100 = 0").selectExpr("id as qid", "embedding")
    near = knn.nearest_lists(t.vectors, queries, 10)
    exact = knn.nearest_batch(t.vectors, queries, 10)
    hits = exact.select("qid", "id").join(near.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    rows = hits.join(near.groupBy("qid").agg(F.count("*").alias("found")), "qid", "left")
    return rows.agg(F.min(F.coalesce("found", F.lit(0))).alias("least"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("enough"))


# ---- the stored index

_INDEXES: dict[tuple[str, str], GraphIndex] = {}


def _index(t: Layers) -> GraphIndex:
    """The stored index of all vectors with the scope and kind of their items, built once for an application and a folder of tables."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        rows = t.vectors.join(t.semantic.select("id", "scope", "kind"), "id", "left")
        index = GraphIndex(t.spark, Scratch(t.spark, "index").path("all"))
        index.build(rows, lsn=1000)
        _INDEXES[key] = index
    return _INDEXES[key]


def _hundredth(t: Layers) -> DataFrame:
    return t.vectors.where("id % 100 = 0").selectExpr("id as qid", "embedding")


@query(
    "select qid, id, distance, rank from (select *, row_number() over (partition by qid order by distance, id)::int as rank from d) where rank <= 10",
    d="select q.id as qid, v.id, round(1 - list_inner_product(v.embedding::double[], q.embedding::double[]), 6) + 0.0 as distance from vecs v, vecs q",
)
def knn_batch_all(t: Layers) -> DataFrame:
    """The neighbours of every vector: both sides are shuffled in blocks."""
    return knn.nearest_batch(t.vectors, t.vectors.selectExpr("id as qid", "embedding"), 10, block=250)


@query("select count(*)::bigint as queries, true as enough from vecs where id % 100 = 0")
def ann_graph_recall(t: Layers) -> DataFrame:
    """Search in the stored graph for every hundredth vector against exact search: the queries, and whether 0.9 of all neighbours were found."""
    near = _index(t).search(_hundredth(t), 10).select("qid", "id", F.lit(1).alias("hit"))
    exact = knn.nearest_batch(t.vectors, _hundredth(t), 10)
    hits = exact.select("qid", "id").join(near, ["qid", "id"], "left")
    return hits.agg(F.count_distinct("qid").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query()
def ann_graph_compared(t: Layers) -> DataFrame:
    """The vectors that each query of ann_graph_recall is compared with, and their part of the corpus."""
    n = t.vectors.count()
    return _index(t).met(_hundredth(t), 10).select("qid", "compared", (F.col("compared") / n).alias("share"))


_TAIL = """select 1000 + id as lsn, 'insert' as op, 1000000 + id as id, {reverse}(embedding) as embedding from {v} where id % 10 = 3
  union all select 2000000 + id, 'replace', id, {reverse}(embedding) from {v} where id % 10 = 5
  union all select 3000000 + id, 'delete', id, null from {v} where id % 10 = 7"""
_LIVE = """select id, case when id % 10 = 5 then list_reverse(embedding) else embedding end as embedding from vecs where id % 10 <> 7
  union all select 1000000 + id, list_reverse(embedding) from vecs where id % 10 = 3"""
_NEAR = "select q.id as qid, v.id, round(1 - list_inner_product(v.embedding::double[], q.embedding::double[]), 6) + 0.0 as distance from live v, vecs q where q.id % 100 = 0"
_RANKED = "select qid, id, distance, rank from (select *, row_number() over (partition by qid order by distance, id)::int as rank from d) where rank <= 10"


def _tail(t: Layers) -> DataFrame:
    """Inserts, replaced vectors and deletes after the index's version."""
    return t.spark.sql(_TAIL.format(v="{v}", reverse="reverse"), v=t.vectors)


@query(_RANKED, live=_LIVE, d=_NEAR)
def index_overlay_search(t: Layers) -> DataFrame:
    """The stored graph under a log: touched ids are hidden in the search, what lives of them is searched exactly, and what the graph finds is verified."""
    return _index(t).search(_hundredth(t), 10, _tail(t), beam=100, width=25, exact=True).select("qid", "id", "distance", "rank")


@query(_RANKED, live=_LIVE, d=_NEAR)
def index_rebuilt_search(t: Layers) -> DataFrame:
    """The same after the log has been taken into a version of its own."""
    rebuilt = GraphIndex(t.spark, Scratch(t.spark, "index").path("rebuilt"))
    rebuilt.build(_index(t).live(_tail(t)), lsn=4_000_000)
    return rebuilt.search(_hundredth(t), 10, _tail(t).where("lsn > 4000000"), beam=100, width=25, exact=True).select("qid", "id", "distance", "rank")


@query("select (select count(*) from live)::bigint as live, (select count(*) from vecs where id % 10 in (3, 5, 7))::bigint as pending", live=_LIVE)
def index_pending(t: Layers) -> DataFrame:
    """Live vectors under the log, and the ids that wait for the next version."""
    tail = _tail(t)
    waiting = _index(t).replayed(tail)[0].agg(F.count("*").alias("pending"))
    return _index(t).live(tail).agg(F.count("*").alias("live")).crossJoin(waiting)


@query(f"select id, {_DIST} as distance from vecs v where id in (select id from items where scope = 'es') order by distance, id limit 10")
def recall_bounds_exact(t: Layers) -> DataFrame:
    """The nearest vectors of a scope: lists are opened until their bounds prove the answer."""
    return _index(t).search_bounded(t.query_vector(VEC), 10, F.col("scope") == "es")[0]
