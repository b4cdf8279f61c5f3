"""Queries that apply the library's operators to the tables, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import numbers, text
from quillmill.operators import language, markdown, report, selection, states, traces
from quillmill.plans import fixtures as fx
from quillmill.plans.fixtures import frame, values
from quillmill.sources import files, outputs

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: A few rows with given results: operators' cases for the tests, not queries of tables.
CASES: dict = {}
CASE_SQL: dict[str, str] = {}


def _adder(queries: dict, sqls: dict[str, str]):
    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query, case = _adder(QUERIES, SQL), _adder(CASES, CASE_SQL)


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return rows.select(*cols) if cols else rows


# --- selection -------------------------------------------------------------------------
_STRATA = [("guias", "n_chars > 5000", 0.20), ("revisiones_sistematicas", "lang = 'fr'", 0.22), ("revisiones", "lang IN ('fr', 'de')", 0.20), ("ensayos", "source = 'src0'", 0.18), ("originales", "true", 0.20)]


def _greedy_sql(n: int = 35) -> str:
    ctes, seen = [], []
    for k, (name, among, w) in enumerate(_STRATA):
        q = numbers.quota(n, w)
        skip = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM s{j})" for j in range(k))
        ctes.append(f"c{k} AS (SELECT doc_id, n_chars FROM documents WHERE {among} ORDER BY n_chars DESC, doc_id LIMIT {3 * q}), s{k} AS (SELECT doc_id, n_chars, '{name}' AS stratum, {k} AS stratum_ord FROM c{k} WHERE true{skip} ORDER BY n_chars DESC, doc_id LIMIT {q})")
        seen.append(f"SELECT * FROM s{k}")
    return "WITH " + ", ".join(ctes) + ", chosen AS (" + " UNION ALL ".join(seen) + ") "


def _chosen(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    strata = [(name, F.expr(among), w) for name, among, w in _STRATA]
    return selection.greedy_select(docs, strata, 35, [F.desc("n_chars"), F.col("doc_id")], "doc_id").select("doc_id", "n_chars", "stratum", "stratum_ord")


@query(_greedy_sql() + "SELECT doc_id, n_chars, stratum, stratum_ord FROM chosen")
def q01_stratified_select(spark, d):
    return _chosen(spark, d)


@query(_greedy_sql() + "SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(stratum_ord)) AS place FROM chosen GROUP BY stratum")
def q02_stratum_counts(spark, d):
    return selection.counts_first_seen(_chosen(spark, d), "stratum", "stratum_ord")


_ACCESS_SQL = """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '10.' || doc_id END AS doi, CASE WHEN source = 'src3' THEN 'PMC' || doc_id ELSE '' END AS pmcid FROM documents),
g AS (SELECT '10.' || doc_id AS k, quality = 1 AS is_oa, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id END AS pdf, 'v' || doc_id AS page FROM labels),
x AS (SELECT r.*, coalesce(g.is_oa, false) AS o, g.pdf, g.page FROM r LEFT JOIN g ON r.doi = g.k AND r.doi <> '' AND r.pmcid = '')
"""


def _access(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "lang")
    rows = docs.select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("10."), "doc_id")).alias("doi"), F.when(F.col("source") == "src3", F.concat(F.lit("PMC"), "doc_id")).otherwise("").alias("pmcid"))
    reg = table(spark, d, "labels", "doc_id", "quality").select(F.concat(F.lit("10."), "doc_id").alias("doi"), (F.col("quality") == 1).alias("is_oa"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), "doc_id")).alias("url_for_pdf"), F.concat(F.lit("v"), "doc_id").alias("url_for_landing_page"), F.lit("").alias("url"), F.lit("cc").alias("license"))
    return selection.access(rows, reg)


@query(_ACCESS_SQL + """
SELECT doc_id, CASE WHEN pmcid <> '' THEN 'pmc' WHEN o THEN 'oa' ELSE 'paywall' END AS access,
  CASE WHEN pmcid <> '' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmcid || '/pdf/' WHEN o THEN coalesce(pdf, '') ELSE '' END AS url_pdf,
  CASE WHEN pmcid <> '' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmcid || '/' WHEN o THEN page WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS url_text,
  CASE WHEN pmcid = '' AND o THEN 'cc' ELSE '' END AS license FROM x""")
def q03_access_class(spark, d):
    return _access(spark, d).select("doc_id", "access", "url_pdf", "url_text", "license")


@query(_ACCESS_SQL + "SELECT CASE WHEN pmcid <> '' THEN 'pmc' WHEN o THEN 'oa' ELSE 'paywall' END AS access, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM x GROUP BY 1")
def q04_access_counts(spark, d):
    return selection.counts_first_seen(_access(spark, d), "access", "doc_id")


_YEARS_SQL = "WITH y AS (SELECT o_orderkey, o_orderpriority AS stratum, CASE WHEN o_orderkey % 7 = 0 THEN 'in press' WHEN o_orderkey % 11 = 0 THEN '' ELSE year(o_orderdate)::VARCHAR END AS anio FROM orders) "


def _years(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderdate")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("stratum"), F.when(F.col("o_orderkey") % 7 == 0, "in press").when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.year("o_orderdate").cast("string")).alias("anio"))


@query(_YEARS_SQL + "SELECT count(*) AS n, count(*) FILTER (WHERE regexp_full_match(anio, '[0-9]+')) AS n_numeric, min(anio) FILTER (WHERE regexp_full_match(anio, '[0-9]+')) AS first_year, max(anio) FILTER (WHERE regexp_full_match(anio, '[0-9]+')) AS last_year FROM y WHERE NOT regexp_full_match(anio, '[0-9]+') OR try_cast(anio AS INT) >= 1994")
def q04b_year_filter_range(spark, d):
    rows, numeric = selection.since(_years(spark, d), "anio", 1994), selection.year_number(F.col("anio")).isNotNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(numeric).alias("n_numeric"), F.min(F.when(numeric, F.col("anio"))).alias("first_year"), F.max(F.when(numeric, F.col("anio"))).alias("last_year"))


@query(_YEARS_SQL + "SELECT o_orderkey, row_number() OVER (PARTITION BY stratum ORDER BY coalesce(-try_cast(anio AS INT), 0), o_orderkey) AS place FROM y")
def q05_composite_sort(spark, d):
    order = selection.newest_first("anio")
    year = F.coalesce(-selection.year_number(F.col("anio")), F.lit(0))
    some = F.floor(F.col("o_orderkey") / 1_000_000)  # so many keys are sorted together
    return selection.ranked(_years(spark, d), ["stratum"], [year, some], [order, F.col("o_orderkey")]).select("o_orderkey", "place")


@query("""WITH r AS (SELECT doc_id, lang, n_chars, CASE WHEN text ILIKE '%license%' THEN 0 WHEN n_chars > 2000 THEN 1 ELSE 2 END AS rel FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY rel, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 9 END, n_chars DESC, doc_id) AS place FROM r WHERE rel < 2)
SELECT doc_id, rel, place FROM o WHERE place <= 12""")
def q06_priority_top(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars", "text")
    rel = F.when(F.contains(F.lower("text"), F.lit("license")), 0).when(F.col("n_chars") > 2000, 1).otherwise(2)
    order = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(9)
    rows = docs.withColumns({"rel": rel, "o": order}).where("rel < 2").select("doc_id", "rel", "o", "n_chars").orderBy("rel", "o", F.desc("n_chars"), "doc_id").limit(12)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("rel", "o", F.desc("n_chars"), "doc_id"))).select("doc_id", "rel", "place")


_TOPIC = "the general license or thereation with public inhibitors"


@query(f"""WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, left(text, 600) AS body FROM documents),
w AS (SELECT doc_id, list_filter(regexp_extract_all(lower('{_TOPIC}'), '[a-z]{{4,}}'), lambda x: x NOT IN ('with', 'inhibitor', 'inhibitors')) AS topic, regexp_extract_all(lower(title), '[a-z]{{4,}}') AS a, regexp_extract_all(lower(body), '[a-z]{{4,}}') AS b FROM t)
SELECT doc_id, CASE WHEN list_has_any(topic, a) THEN 0 WHEN list_has_any(topic, b) THEN 1 ELSE 2 END AS rel FROM w""")
def q07_topic_relevance(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", text.relevance(F.lit(_TOPIC), F.split("text", "\n")[0], F.substring("text", 1, 600)).alias("rel"))


@query("SELECT doc_id, 'left_only' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def q09_orphans(spark, d):
    return selection.orphans(table(spark, d, "documents", "doc_id"), table(spark, d, "labels", "doc_id"), "doc_id")


_RULES = [("https://site1", "uno"), ("https://site", "sitio"), ("http", "otro")]


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://site1') THEN 'uno' WHEN starts_with(url, 'https://site') THEN 'sitio' WHEN starts_with(url, 'http') THEN 'otro' ELSE 'paywall' END AS reason FROM pages")
def q10_prefix_rule(spark, d):
    return selection.first_rule(table(spark, d, "pages", "page_id", "url"), "url", _RULES, "paywall", "reason").select("page_id", "reason")


# --- text ------------------------------------------------------------------------------
_RED_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\b[0-9]{{1,2}}\.[0-9]{{3}}\.[0-9]{{3}}-[0-9kK]\b', '[RUT]', 'g'), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]*[\p{{L}}\p{{N}}_]', '[EMAIL]', 'g'), '\b[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\b', '[FECHA]', 'g'), '(?i)\b(nombre|paciente|rut)\s*:\s*.+', '\1: [REDACTADO]', 'g')"


@case(f"SELECT id, {_RED_SQL.format('t')} AS clean FROM {values(fx.PRIVATE, 'v(id, t)')}")
def q11_deidentify(spark, d):
    return frame(spark, "id int, t string", fx.PRIVATE).select("id", text.deidentify(F.col("t")).alias("clean"))


@query(f"WITH c AS (SELECT conv_id, turn, text, {_RED_SQL.format('text')} AS clean FROM conversations) SELECT conv_id, turn, md5(clean) AS clean_md5, clean <> text AS changed FROM c")
def q11b_deidentify_conversations(spark, d):
    clean = text.deidentify(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(clean.cast("binary")).alias("clean_md5"), (clean != F.col("text")).alias("changed"))


@query(r"SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+')) AS n_email, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{13,}')) AS n_number FROM documents GROUP BY lang")
def q12_pii_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "lang", "text").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(t.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+")).alias("n_email"), F.count_if(t.rlike("[0-9]{13,}")).alias("n_number"))


_VOCAB = {"legal": ["licen[sc]e", "public"], "names": [r"token\s+=", "password"], "short": ["zzz+"]}


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'licen[sc]e|public') THEN 'legal' END, CASE WHEN regexp_matches(lower(text), 'token\\s+=|password') THEN 'names' END, CASE WHEN regexp_matches(lower(text), 'zzz+') THEN 'short' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def q13_tag_documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(language.tags(F.col("text"), _VOCAB), ",").alias("tags"))


@case(f"SELECT id, tags FROM {values(fx.TAGS_EXPECTED, 'v(id, tags)')}")
def q13b_taxonomy(spark, d):
    return frame(spark, "id int, t string", fx.TAGGED).select("id", F.array_join(language.tags(F.col("t"), language.TAXONOMY), ",").alias("tags"))


def _route_sql(keywords: dict[str, list[str]], col: str, other: str) -> str:
    each = ", ".join(" + ".join(f"contains(lower({col}), '{w}')::INT" for w in ws) for ws in keywords.values())
    names = ", ".join(f"'{a}'" for a in keywords)
    return f"CASE WHEN list_max([{each}]) > 0 AND len(list_filter([{each}], lambda x: x = list_max([{each}]))) = 1 THEN ([{names}])[list_position([{each}], list_max([{each}]))] ELSE '{other}' END"


_WORDS = {"a": ["the", "tion", "ness"], "b": ["der", "ung", "keit"], "c": ["eau", "ment", "elle"], "d": ["ción", "ado"]}


@query(f"SELECT conv_id, turn, {_route_sql(_WORDS, 'text', 'none')} AS agent FROM conversations WHERE role = 'user'")
def q14_route_messages(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", language.route(F.col("text"), _WORDS, "none").alias("agent"))


@case(f"SELECT id, {_route_sql(language.KEYWORDS, 'm', 'research')} AS agent FROM {values(fx.ROUTES, 'v(id, m)')}")
def q14b_route_fixed(spark, d):
    return frame(spark, "id int, m string", fx.ROUTES).select("id", language.route(F.col("m"), language.KEYWORDS, "research").alias("agent"))


@query("SELECT event_id, CASE WHEN regexp_matches(props, '\"k\": ?[0-9]\\}') THEN 'BLOQUEADO' WHEN event_type IN ('purchase', 'error') THEN 'GATE' ELSE 'OK' END AS verdict FROM events")
def q15_guard_events(spark, d):
    return table(spark, d, "events", "event_id", "event_type", "props").select("event_id", language.guard(F.col("event_type"), F.col("props"), r'"k": ?[0-9]\}', ["purchase", "error"]).alias("verdict"))


@case(f"SELECT id, CASE WHEN regexp_matches(args, '{language.DESTRUCTIVE}') THEN 'BLOQUEADO' WHEN tool IN ({', '.join(repr(g) for g in language.GATED)}) THEN 'GATE' ELSE 'OK' END AS verdict FROM {values(fx.CALLS, 'v(id, tool, args)')}")
def q15b_guard_calls(spark, d):
    return frame(spark, "id int, tool string, args string", fx.CALLS).select("id", language.guard(F.col("tool"), F.col("args")).alias("verdict"))


# --- traces and costs ------------------------------------------------------------------
@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS sessions, sum(try_cast(json_extract_string(props, '$.k') AS INT))::BIGINT AS tools, round(sum(coalesce(CASE WHEN event_type = 'purchase' THEN value END, 0.0)), 6) AS cost_usd FROM events GROUP BY 1")
def q16_trace_daily(spark, d):
    tools = F.get_json_object("props", "$.k").try_cast("int")
    return traces.daily(table(spark, d, "events"), "ts", tools, F.when(F.col("event_type") == "purchase", F.col("value"))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_PRICES = [("click", 3.0, 15.0), ("purchase", 15.0, 75.0)]


@query(f"SELECT event_id, round((user_id * coalesce(p.i, 0.0) + event_id * coalesce(p.o, 0.0)) / 1e6, 6) AS cost_usd FROM events LEFT JOIN {values(_PRICES, 'p(m, i, o)')} ON event_type = p.m")
def q17_token_cost(spark, d):
    prices = frame(spark, "event_type string, i double, o double", _PRICES)
    rows = table(spark, d, "events", "event_id", "user_id", "event_type").join(F.broadcast(prices), "event_type", "left")
    return rows.select("event_id", numbers.token_cost(F.col("user_id"), F.col("event_id"), F.col("i"), F.col("o")).alias("cost_usd"))


@query("""WITH a AS (SELECT event_id, value AS p, value + 10.0 AS cif FROM events), b AS (SELECT *, CASE WHEN p >= 41.0 THEN cif * 0.06::DOUBLE ELSE 0.0 END AS duty FROM a), c AS (SELECT *, CASE WHEN p >= 41.0 THEN (cif + duty) * 0.19::DOUBLE ELSE 0.0 END AS tax FROM b)
SELECT event_id, round(cif, 6) AS cif_usd, round(duty, 6) AS duty_usd, round(tax, 6) AS tax_usd, round(cif + duty + tax, 6) AS total_usd, round((cif + duty + tax) * 950.0, 4) AS total_local, p >= 41.0 AS is_taxed FROM c""")
def q18_import_cost(spark, d):
    got = numbers.import_cost(F.col("value"), F.lit(10.0), F.lit(950.0))
    return table(spark, d, "events", "event_id", "value").select("event_id", *[(F.round(c, 4 if k == "total_local" else 6) if k != "is_taxed" else c).alias(k) for k, c in got.items()])


# --- states ----------------------------------------------------------------------------
@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def q19_latest_state(spark, d):
    return states.latest(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_type", "ts")


def _entities(spark, d):
    return table(spark, d, "events", "event_id", "event_type", "user_id").select(F.concat(F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat("event_type", F.lit("."))), F.concat(F.lit("u"), "user_id")).alias("entity"), "event_id", "event_type")


_ENT = "SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE event_type || '.' END || 'u' || user_id AS entity, event_id, event_type FROM events"
_DOM = "CASE WHEN contains(entity, '.') THEN split_part(entity, '.', 1) ELSE 'otros' END"


@query(f"SELECT {_DOM} AS domain, count(*) AS n, arg_min(entity, event_id) AS sample FROM ({_ENT}) GROUP BY 1")
def q20_inventory(spark, d):
    return states.inventory(_entities(spark, d), "entity", "event_id")


@query(f"SELECT {_DOM} AS domain, count(*) AS n, md5('## ' || {_DOM} || ' (' || count(*) || ')' || chr(10) || string_agg(entity || ' = ' || event_type, chr(10) ORDER BY event_id)) AS block_md5 FROM (SELECT entity, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM ({_ENT}) GROUP BY 1) GROUP BY 1")
def q20b_blocks(spark, d):
    now = states.latest(_entities(spark, d), "entity", "event_id", "event_id")
    return states.blocks(now, "entity", "event_type", "event_id").select("domain", "n", F.md5(F.col("block").cast("binary")).alias("block_md5"))


@query("SELECT p_partkey, p_name LIKE 'part%' AND NOT (contains(lower(p_name || ' ' || p_type), 'brass') OR contains(lower(p_name || ' ' || p_type), '7')) AS picked FROM part")
def q21_exclusion(spark, d):
    return table(spark, d, "part").select("p_partkey", states.excluded(F.col("p_name"), F.col("p_type"), "part", ["brass", "7"]).alias("picked"))


@case(f"SELECT entity FROM {values(fx.SWITCHES, 'v(entity, name, state)')} WHERE starts_with(entity, 'switch.') AND NOT regexp_matches(lower(entity || ' ' || coalesce(name, '')), '{'|'.join(states.NOT_LIGHT)}') AND entity <> 'switch.exterior' AND state = 'on'")
def q22_lights_to_turn_off(spark, d):
    rows = frame(spark, "entity string, name string, state string", fx.SWITCHES)
    keep = states.keep_list(" switch.exterior, ,switch.other")
    return rows.where(states.excluded(F.col("entity"), F.col("name"), "switch.", states.NOT_LIGHT) & ~F.col("entity").isin(keep) & (F.col("state") == "on")).select("entity")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def q22b_keep_list_join(spark, d):
    keep = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").join(keep, "c_nationkey", "left_anti").select("c_custkey")


@query("WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, event_type FROM l WHERE before <> event_type")
def q23_transitions(spark, d):
    return states.transitions(table(spark, d, "events", "event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", "event_type").select("event_id", "before", "event_type")


@query("""WITH o AS (SELECT *, event_type = 'error' AS c, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w FROM events),
e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM o WHERE w IS NULL OR c <> w)
SELECT user_id, ts AS start, e AS "end", ts + INTERVAL 6 HOUR AS fired FROM e WHERE c AND e - ts >= INTERVAL 6 HOUR""")
def q24_held_for(spark, d):
    return states.held(table(spark, d, "events", "event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", F.col("event_type") == "error", 6 * 3600)


@query("""WITH a AS (SELECT s.user_id, s.event_id AS id, (SELECT arg_min(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts > s.ts AND p.ts <= s.ts + INTERVAL 24 HOUR) AS answer FROM events s WHERE s.event_type = 'signup')
SELECT user_id, id, CASE WHEN answer IS NULL THEN 'timeout' ELSE 'answered' END AS status, answer::VARCHAR AS answer FROM a""")
def q25_wait_timeout(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("time"), "event_type", F.col("event_id").cast("string").alias("answer"))
    return states.wait(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", 24 * 3600)


@query("SELECT user_id, event_type, count(*) AS n, bool_or(value > 400) AS corrected FROM events GROUP BY ALL HAVING count(*) >= 12 OR bool_or(value > 400)")
def q26_recurrence(spark, d):
    return traces.recurrent(table(spark, d, "events"), ["user_id", "event_type"], F.col("value") > 400, 12)


@query("SELECT n_nationkey, CASE WHEN n_regionkey IN (1, 3) THEN 'RECHAZADA_AUTOMATICA' ELSE 'PENDIENTE' END AS status FROM nation")
def q27_protected(spark, d):
    return table(spark, d, "nation").select("n_nationkey", traces.verdict(F.col("n_regionkey"), [1, 3]).alias("status"))


@case(f"SELECT v, split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.' || (split_part(v, '.', 3)::INT + 1) AS patch, split_part(v, '.', 1) || '.' || (split_part(v, '.', 2)::INT + 1) || '.0' AS minor FROM {values(fx.VERSIONS, 't(v)')}")
def q28_version_bump(spark, d):
    return frame(spark, "v string", fx.VERSIONS).select("v", text.bump(F.col("v")).alias("patch"), text.bump(F.col("v"), "minor").alias("minor"))


# --- Markdown and reports --------------------------------------------------------------
def _expected(rows, names):
    return f"SELECT * FROM {values(rows, names)}"


@case(_expected(fx.TABLES_EXPECTED, "v(id, t)"))
def q29_md_tables(spark, d):
    return frame(spark, "id int, t string", fx.TABLES).select("id", markdown.tables(F.col("t")).alias("t"))


@case(_expected(fx.ESCAPES_EXPECTED, "v(id, t)"))
def q30_md_escape(spark, d):
    return frame(spark, "id int, t string", fx.ESCAPES).select("id", markdown.escape_citations(F.col("t")).alias("t"))


@case(_expected(fx.QUOTES_EXPECTED, "v(id, t)"))
def q31_quote_merge(spark, d):
    return frame(spark, "id int, t string", fx.QUOTES).select("id", markdown.join_quotes(F.col("t")).alias("t"))


@case(_expected(fx.CONVERSIONS_EXPECTED, "v(id, title, t)"))
def q31b_md_convert(spark, d):
    return frame(spark, "id int, t string", fx.CONVERSIONS).select("id", markdown.title(F.col("t")).alias("title"), markdown.convert(F.col("t")).alias("t"))


@case(f"SELECT id, \"check\", status, detail FROM {values(fx.REPORTS_EXPECTED, 'v(id, \"check\", status, detail)')}")
def q32_report_checks(spark, d):
    return report.checks(frame(spark, "id int, t string", fx.REPORTS), "id", "t")


@case(f"SELECT id, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'aviso') AS n_warn, count(*) FILTER (WHERE status = 'FALLO') AS n_fail, max((status = 'FALLO')::INT) AS exit_status FROM {values(fx.REPORTS_EXPECTED, 'v(id, c, status, detail)')} GROUP BY id")
def q32b_report_tally(spark, d):
    return report.tally(report.checks(frame(spark, "id int, t string", fx.REPORTS), "id", "t"), "id")


_REGISTRY = [("101", "Título", None), ("102", "Completamente distinto asunto", None), ("5", "x", "not found"), ("103", "123", None)]


@case(_expected([(1, "101", "ok"), (1, "102", "mismatch"), (1, "103", "ok"), *[(1, str(100 + k), "absent") for k in range(4, 9)], (2, "5", "absent")], "v(id, pmid, verdict)"))
def q32c_cited_titles(spark, d):
    return report.cited_titles(frame(spark, "id int, t string", fx.REPORTS), frame(spark, "pmid string, title string, error string", _REGISTRY), "id", "t")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^#{4,}\\s')) AS deep, len(string_split(text, chr(10))) AS lines FROM documents")
def q32d_document_shape(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.regexp_count("text", F.lit(r"(?md)^#{4,}\s")).alias("deep"), F.size(F.split("text", "\n", -1)).alias("lines"))


@case(_expected(fx.SECTIONED_EXPECTED, 'v(id, start, "end")'))
def q32e_section_lines(spark, d):
    return report.section_lines(frame(spark, "id int, t string", fx.SECTIONED), "id", "t", 2)


@case(_expected(fx.POLICY_EXPECTED, "v(agent, version, mode, protected)"))
def q32f_metadata(spark, d):
    got = report.metadata(F.col("t"))
    return frame(spark, "agent string, t string", fx.POLICY).select("agent", got["version"].alias("version"), got["mode"].alias("mode"), F.array_join(got["protected"].cast("array<string>"), ",").alias("protected"))


@query("SELECT page_id, md5(trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS text_md5 FROM pages")
def q33_html_inner_text(spark, d):
    return table(spark, d, "pages", "page_id", "html").select("page_id", F.md5(text.inner_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS last_text FROM conversations GROUP BY conv_id")
def q34_last_assistant(spark, d):
    return traces.last_of(table(spark, d, "conversations"), "conv_id", "turn", "role", "assistant", "text")


@query("SELECT conv_id, string_agg(role || ': ' || left(text, 300), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q35_ordered_compose(spark, d):
    rows = table(spark, d, "conversations").withColumn("line", F.concat("role", F.lit(": "), F.substring("text", 1, 300)))
    return outputs.lines_joined(rows, "turn", "line", "conv_id")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q35c_whole_compose(spark, d):
    """Whole turns, where q35 takes the first 300 characters of each."""
    rows = table(spark, d, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    return outputs.lines_joined(rows, "turn", "line", "conv_id")


@query("SELECT conv_id, '{\"n\":' || count(*) || ',\"records\":[' || string_agg('{\"role\":\"' || role || '\",\"n\":' || length(text) || '}', ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY conv_id")
def q35b_envelope(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return outputs.envelope_json(rows, "conv_id", "turn")


@case(_expected([("A", "1", 1), ("C", "x y", 5), ("D", "a=b", 6), ("E", "q", 8)], "v(key, value, ord)"))
def q36_key_values(spark, d):
    return files.key_values(frame(spark, "ord int, line string", fx.ENV))


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS services FROM events GROUP BY user_id")
def q37_service_list(spark, d):
    return table(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("services"))


_CITES = [("P Q, R S. Uno. Rev A. 2020. doi:10.1/a. PMID: 1.",), ("A A, B B, C C, D D, E E, F F, et al. Dos. PMID: 2.",), ("Rev C. in press. doi:10.1016/c.",)]


@case(_expected(_CITES, "v(cite)"))
def q38_citations(spark, d):
    rows = frame(spark, "pmid string, doi string, pmcid string, title string, journal string, year string, authors array<string>", fx.RECORDS)
    return rows.select(text.citation(*[F.col(c) for c in ("authors", "title", "journal", "year", "doi", "pmid")]).alias("cite"))


@case(_expected(fx.NAMES_EXPECTED, "v(id, name)"))
def q38b_file_names(spark, d):
    return frame(spark, "a string, y string, id string", fx.NAMES).select("id", text.file_name(F.col("a"), F.col("y"), F.col("id")).alias("name"))


@query("SELECT doc_id, i - 1 AS place, p AS paragraph FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, trim(unnest(string_split(text, chr(10)))) AS p FROM documents) WHERE p <> ''")
def q39_paragraphs(spark, d):
    return traces.paragraphs(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", "\n")


@case(_expected([(1, "Tema"), (2, "Contexto Clínico"), (3, "Objetivos"), (4, "Estudio 1: Metodología"), (5, "Estudio 1: Resultados"), (6, "Estudio 2: Metodología"), (7, "Estudio 2: Resultados"), (8, "Discusión"), (9, "Conclusiones"), (10, "Bibliografía"), (11, "Análisis Secundario"), (12, "Análisis Secundario")], "v(slide, title)"))
def q40_deck_plan(spark, d):
    return traces.deck(frame(spark, "id int", [(1,)]), "id", F.lit("Tema"), F.lit(2)).select("slide", "title")


@case(_expected([("one", "Uno", "hace algo"), ("two", "two", "x"), ("three", "text", "")], "v(folder, name, description)"))
def q41_front_matter(spark, d):
    return files.front_matter(frame(spark, "folder string, text string", fx.SKILLS)).select("folder", "name", "description")


@case(_expected([("7", "10.1/x", "PMC3", "Uno", "J A", "1998", "Paz A;Grupo", "AIM: x END: y")], "v(pmid, doi, pmcid, titulo, revista, anio, autores, abstract)"))
def q42_xml_records(spark, d):
    schema = f"PubmedArticle array<struct<{files.ARTICLE.replace('MedlineCitation struct', 'MedlineCitation:struct', 1).replace('PubmedData struct', 'PubmedData:struct', 1)}>>"
    rows = frame(spark, "x string", [(fx.ARTICLES,)]).select(F.explode(F.from_xml("x", schema)["PubmedArticle"]).alias("a")).select("a.*")
    got = files.flat(rows)
    return got.select("pmid", "doi", "pmcid", "titulo", "revista", "anio", F.array_join("autores", ";").alias("autores"), "abstract")


@query("SELECT page_id, regexp_replace(url, '^([a-z]+://)[^/?#]+', '\\1' || replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.', '-') || '.proxy.example.org') AS url FROM pages")
def q43_proxied_urls(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", text.proxied(F.col("url"), ".proxy.example.org").alias("url"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') || '_' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS proposal_id, o_orderkey FROM (SELECT o_orderdate, o_orderkey, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey) AS k FROM orders)")
def q44_proposal_ids(spark, d):
    return traces.proposal_ids(table(spark, d, "orders", "o_orderdate", "o_orderkey"), F.col("o_orderdate"), "o_orderkey", [F.floor(F.col("o_orderkey") / 10_000)]).select("proposal_id", "o_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'oa' ELSE 'paywall' END AS a FROM documents) WHERE a NOT IN ('pmc', 'oa', 'manual') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def q45_missing_files(spark, d):
    rows = table(spark, d, "documents", "doc_id").withColumn("a", F.when(F.col("doc_id") % 3 == 0, "oa").otherwise("paywall"))
    return selection.missing(rows, table(spark, d, "labels", "doc_id"), "a", "doc_id").select("doc_id")


@query("SELECT user_id, string_agg(lower(event_type), ' ' ORDER BY event_id) AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p <= 4 GROUP BY user_id")
def q46_first_pages(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "event_type")
    rows = e.withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return files.first_pages(rows, "user_id", "page", "event_type")
