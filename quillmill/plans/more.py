"""More queries of the catalogue: composition, arrivals, automations, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import composition, report, selection, signals, states
from quillmill.plans import fixtures as fx
from quillmill.plans.catalog import SQL, _expected, case, query, table
from quillmill.plans.fixtures import frame, values
from quillmill.plans import landed  # noqa: F401  whose SQL the streams' is
from quillmill.sources import outputs
from quillmill.streaming import runs


@query("SELECT n.n_nationkey, concat_ws(chr(10), r.r_name, n.n_name, CASE WHEN s.best IS NOT NULL THEN '# ' || s.best END) AS context FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT s_nationkey, max(s_name) AS best FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s.s_nationkey = n.n_nationkey")
def q47_context(spark, d):
    best = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("best"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(best, "n_nationkey", "left")
    return rows.select("n_nationkey", composition.context([F.col("r_name"), F.col("n_name"), F.concat(F.lit("# "), "best")]).alias("context"))


@query("SELECT doc_id, left(text, 600) AS text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE contains(text, 'th') ORDER BY n_chars DESC, doc_id LIMIT 10")
def q48_search_top(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "n_chars")
    return composition.top(docs, F.contains("text", F.lit("th")), [F.desc("n_chars"), F.col("doc_id")], 10, "text").select("doc_id", "text", "rank")


_BIB = "1. P Q, R S. Uno. Rev A. 2020. doi:10.1/a. PMID: 1. — *guias* · Open access\n   - Texto completo: u1\n2. A A, B B, C C, D D, E E, F F, et al. Dos. PMID: 2. — *ensayos* · PMC (libre)\n3. Rev C. in press. doi:10.1016/c. — *ensayos* · raro"


@case(_expected([(_BIB,)], "v(text)"))
def q49_bibliography(spark, d):
    rows = [(k, *r, *x) for k, (r, x) in enumerate(zip(fx.RECORDS, [("guias", "oa", "u1"), ("ensayos", "pmc", ""), ("ensayos", "raro", "")]), 1)]
    got = frame(spark, "k int, pmid string, doi string, pmcid string, title string, journal string, year string, authors array<string>, stratum string, access string, url string", rows)
    cite = text.citation(*[F.col(c) for c in ("authors", "title", "journal", "year", "doi", "pmid")])
    return outputs.lines_joined(got.withColumn("line", outputs.bibliography_line(F.col("k"), cite, F.col("stratum"), F.col("access"), F.col("url"))), "k", "line")


@query("WITH c AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS p FROM documents GROUP BY lang) SELECT '| Estrato | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY p) AS text FROM c")
def q50_summary_table(spark, d):
    counts = selection.counts_first_seen(table(spark, d, "documents", "doc_id", "lang"), "lang", "doc_id")
    head = frame(spark, "ord int, line string", [(-1, "| Estrato | n |"), (0, "|---|---|")])
    return outputs.lines_joined(head.unionByName(composition.count_table(counts, "lang", "n", "place")), "ord", "line")


@query("""WITH r AS (SELECT doc_id, lang, n_chars, CASE WHEN n_chars > 4000 THEN 0 WHEN n_chars > 1000 THEN 1 ELSE 2 END AS rel FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rel, n_chars DESC, doc_id) AS place FROM r)
SELECT lang, CASE WHEN rel >= 2 THEN 'off' WHEN place <= 12 THEN 'priority' ELSE 'secondary' END AS section, place, '- ' || doc_id || ' (' || lang || ')' AS line FROM o""")
def q51_pending_sections(spark, d):
    rel = F.when(F.col("n_chars") > 4000, 0).when(F.col("n_chars") > 1000, 1).otherwise(2)
    rows = table(spark, d, "documents", "doc_id", "lang", "n_chars").withColumn("rel", rel)
    rows = selection.ranked(rows, ["lang"], [F.col("rel"), -F.col("n_chars")], [F.col("rel"), F.desc("n_chars"), F.col("doc_id")])
    line = F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(" ("), "lang", F.lit(")"))
    got = composition.sectioned(rows, "rel", "place", line, 12)
    return got.withColumn("lang", F.regexp_extract("line", r"\((.*)\)$", 1))


@case(_expected([("switch.a", "switch.a (Cocina) = on\n  attrs: {\"w\":\"5\"}"), ("light.b", "light.b (light.b) = off")], "v(entity, line)"))
def q52_state_lines(spark, d):
    rows = frame(spark, "entity string, state string, a map<string,string>", [("switch.a", "on", {"friendly_name": "Cocina", "w": "5"}), ("light.b", "off", {})])
    return rows.select("entity", composition.state_line(F.col("entity"), F.col("state"), F.col("a")).alias("line"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'bad' END AS verdict FROM labels)
SELECT e.doc_id, CASE WHEN verdict IS NULL THEN 'missing' WHEN verdict = 'ok' THEN 'arrived' ELSE 'invalid' END AS status FROM documents e LEFT JOIN f USING (doc_id)
UNION ALL SELECT doc_id, 'stray' FROM f WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = f.doc_id)""")
def q53_arrivals(spark, d):
    found = table(spark, d, "labels", "doc_id", "quality").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("bad").alias("verdict"))
    return composition.arrivals(table(spark, d, "documents", "doc_id"), found, "doc_id")


@case(_expected([(1, "## 1. A\nx\n\n---\n## 2. B\ny\nz\nNEW\n\n\n"), (2, "intro\n## 2. only\nNEW\n")], "v(id, t)"))
def q54_insert_line(spark, d):
    docs = frame(spark, "id int, t string", fx.SECTIONED)
    return docs.select("id", composition.inserted(F.col("t"), report.section(F.col("t"), 2)["end"], "NEW").alias("t")).where("t IS NOT NULL")


@case(f"SELECT s AS stratum, '(asma) AND (' || s || ') AND (\"2000\"[dp] : \"3000\"[dp])' AS q FROM {values([(s,) for s, _ in selection.STRATA], 'v(s)')}")
def q55_query_texts(spark, d):
    return frame(spark, "stratum string", [(s,) for s, _ in selection.STRATA]).select("stratum", composition.query_text(F.lit("asma"), F.col("stratum"), 2000).alias("q"))


@case(_expected([(1, "https://a.b/c.png,http://d/e")], "v(id, urls)"))
def q56_image_urls(spark, d):
    rows = frame(spark, "id int, t string", [(1, "![x](https://a.b/c.png) [no](https://n) ![](http://d/e \"t\") ![f](file.png)")])
    return rows.select("id", F.array_join(report.image_urls(F.col("t")), ",").alias("urls"))


@case(_expected([("A", "9", 1), ("B", "2", 2), ("N", "n", 3)], "v(key, value, place)"))
def q57_merge_keys(spark, d):
    old = frame(spark, "key string, value string, ord int", [("A", "1", 4), ("B", "2", 7)])
    return composition.merge_keys(old, frame(spark, "key string, value string, ord int", [("N", "n", 1), ("A", "9", 2)]))


@query("SELECT event_type, count(*) FILTER (WHERE json_valid(j)) AS good, count(*) FILTER (WHERE NOT json_valid(j)) AS bad FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN left(props, 4) ELSE props END AS j FROM events) GROUP BY 1")
def q58_invalid_json(spark, d):
    j = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    ok = composition.valid_json(j)
    return table(spark, d, "events", "event_id", "event_type", "props").groupBy("event_type").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@query("SELECT conv_id, turn, i - 1 AS place, b AS bullet FROM (SELECT conv_id, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS b FROM conversations)")
def q59_bullets(spark, d):
    rows = table(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return composition.bullets(rows, "k", "text").select("k.conv_id", "k.turn", "place", "bullet")


@query("SELECT user_id, strftime(ts::DATE + 1, '%Y-%m-%d') AS midnight, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id, ts::DATE")
def q60_midnight_states(spark, d):
    got = composition.at_midnight(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")
    return got.withColumn("midnight", F.date_format("midnight", "yyyy-MM-dd"))


_CALENDAR_SQL = """WITH l AS (SELECT user_id, ts::DATE AS d, arg_max(event_type, (ts, event_id)) AS s FROM events GROUP BY ALL),
c AS (SELECT user_id, unnest(generate_series(min(d), (SELECT (max(ts) + INTERVAL 47 HOUR)::DATE - 1 FROM events), INTERVAL 1 DAY))::DATE AS d FROM l GROUP BY user_id)
SELECT c.user_id, strftime(c.d + 1, '%Y-%m-%d') AS midnight, last_value(s IGNORE NULLS) OVER (PARTITION BY c.user_id ORDER BY c.d) AS state FROM c LEFT JOIN l ON l.user_id = c.user_id AND l.d = c.d"""


@query(_CALENDAR_SQL)
def q60b_calendar_midnights(spark, d):
    """Each user's state at every midnight, on days without rows too."""
    got = composition.calendar_midnights(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type", F.max("ts") + F.expr("INTERVAL 47 HOURS"))
    return got.withColumn("midnight", F.date_format("midnight", "yyyy-MM-dd"))


def _midnights(spark, d):
    return runs.over(spark, table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "ts", lambda e: runs.midnights(e, "user_id", "ts", "event_id", F.col("event_type")))


@query(_CALENDAR_SQL)
def q60c_midnight_stream(spark, d):
    """The same by a stream with timers, an hour behind a row two days after the last."""
    got = _midnights(spark, d).where("kind = 'midnight'")
    return got.select(F.col("key").cast("long").alias("user_id"), F.date_format("at", "yyyy-MM-dd").alias("midnight"), "state")


@query(SQL["q23_transitions"])
def q23b_transition_stream(spark, d):
    got = _midnights(spark, d).where("kind = 'transition'")
    return got.select(F.col("id").cast("long").alias("event_id"), "before", F.col("state").alias("event_type"))


@query(SQL["q78_abort_branch"])
def q78b_abort_stream(spark, d):
    """Questions, waits and what they lead to, by a stream with state and timers."""
    rows = table(spark, d, "events", "user_id", "ts", "event_id", "event_type", "value")
    answer = F.when(F.col("value") > 100, "keep").otherwise("off")
    got = runs.over(spark, rows, "ts", lambda e: runs.waits(e, "user_id", "ts", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", answer, 24 * 3600))
    return states.after_answer(got, "keep", "turn_off").select(F.col("key").cast("long").alias("user_id"), F.col("id").cast("long").alias("id"), "action")


@query("SELECT e.event_id, CASE event_type WHEN 'error' THEN 'turn_off' ELSE 'turn_on' END AS action, t.x AS target FROM events e, (VALUES ('l1'), ('l3')) AS t(x) WHERE event_type IN ('error', 'signup')")
def q61_choose_and_apply(spark, d):
    return composition.actions(table(spark, d, "events", "event_id", "event_type"), "event_type", {"error": "turn_off", "signup": "turn_on"}, ["l1", "l2", "l3"], ["l2"]).select("event_id", "action", "target")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, ts + INTERVAL 24 HOUR AS busy, true AS runs FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.ts >= r.busy THEN e.ts + INTERVAL 24 HOUR ELSE r.busy END, e.ts >= r.busy FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE runs""")
def q62_single_mode(spark, d):
    return composition.single(table(spark, d, "events"), "user_id", "ts", "event_id", 24 * 3600)


@query(SQL["q62_single_mode"])
def q62b_single_stream(spark, d):
    """The same by the stream: every row asks, none answers, and one run goes on at a time."""
    rows = table(spark, d, "events", "user_id", "ts", "event_id")
    got = runs.over(spark, rows, "ts", lambda e: runs.waits(e, "user_id", "ts", "event_id", F.lit(True), F.lit(False), F.lit(None), 24 * 3600, single=True))
    return got.select(F.col("key").cast("long").alias("user_id"), F.col("id").cast("long").alias("event_id"))


def _band_pass_sql() -> str:
    """The filter sample by sample: two recursions over places, forwards and backwards."""
    sos = signals.sections(4, 20, 500, 2048)
    pad = 3 * (2 * len(sos) + 1)

    def first(x: str) -> str:
        out = []
        for k, (b0, b1, b2, a1, a2) in enumerate(sos.tolist()):
            u = x if not k else f"y{k - 1}"
            out.append(f"{u} * {(b0 + b1 + b2) / (1 + a1 + a2)!r} AS y{k}, {b1!r} * {u} - {a1!r} * y{k} + {b2!r} * {u} - {a2!r} * y{k} AS s{k}, {b2!r} * {u} - {a2!r} * y{k} AS r{k}")
        return ", ".join(out)

    def then(x: str) -> str:
        out = []
        for k, (b0, b1, b2, a1, a2) in enumerate(sos.tolist()):
            u = x if not k else f"z{k - 1}"
            out.append(f"{b0!r} * {u} + l.s{k} AS z{k}, {b1!r} * {u} - {a1!r} * z{k} + l.r{k} AS t{k}, {b2!r} * {u} - {a2!r} * z{k} AS q{k}")
        return ", ".join(out)

    def run(name: str, source: str) -> str:
        listed = ", ".join(f"y{k}, s{k}, r{k}" for k in range(len(sos)))
        kept = ", ".join(f"z{k}, t{k}, q{k}" for k in range(len(sos)))
        return f"{name} AS (SELECT c, w, {listed} FROM (SELECT c, w, {first('x')} FROM {source} WHERE w = 0) UNION ALL SELECT c, w, {kept} FROM (SELECT s.c, s.w, {then('s.x')} FROM {name} l JOIN {source} s ON s.c = l.c AND s.w = l.w + 1))"

    last = len(sos) - 1
    return f"""WITH RECURSIVE e AS (SELECT user_id AS c, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS x FROM events WHERE value IS NOT NULL),
g AS (SELECT *, least(n - 1, {pad}) AS p, first_value(x) OVER (PARTITION BY c ORDER BY i) AS a, first_value(x) OVER (PARTITION BY c ORDER BY i DESC) AS z FROM e),
wide AS (SELECT c, i + p AS w, x FROM g WHERE n > 1 UNION ALL SELECT c, p - i, 2 * a - x FROM g WHERE n > 1 AND i BETWEEN 1 AND p UNION ALL SELECT c, p + n + (n - 2 - i), 2 * z - x FROM g WHERE n > 1 AND i BETWEEN n - 1 - p AND n - 2),
{run('fore', 'wide')},
turned AS (SELECT f.c, m.top - f.w AS w, y{last} AS x FROM fore f JOIN (SELECT c, max(w) AS top FROM wide GROUP BY c) m ON m.c = f.c),
{run('back', 'turned')}
SELECT g.c AS user_id, g.event_id, round(coalesce(y{last}, 0.0), 4) + 0.0 AS value FROM g LEFT JOIN back b ON b.c = g.c AND b.w = g.n + 2 * g.p - 1 - (g.i + g.p)"""


@query(_band_pass_sql())
def q63_band_pass(spark, d):
    """Each user's values as a signal of 2,048 samples a second, from 20 to 500 Hz."""
    rows = table(spark, d, "events", "user_id", "ts", "event_id", "value")
    out = signals.band_pass(rows, 2048, channel="user_id", by=["ts", "event_id"], value="value", coarse=[F.to_date("ts")])
    return out.select("user_id", "event_id", (F.round("value", 4) + 0.0).alias("value"))


@query("SELECT role, count(*) FILTER (WHERE length(text) > 40) AS passed, count(*) FILTER (WHERE length(text) <= 40) AS failed FROM conversations GROUP BY role")
def q64_totals(spark, d):
    ok = F.length("text") > 40
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


_LEARNED = [('{"titulo":"a","seccion_objetivo":2,"evidencia":["x"]}',), ('{"titulo":"b","seccion_objetivo":3}',), ("not json",)]


@case(_expected([("a", 2, "PENDIENTE"), ("b", 3, "RECHAZADA_AUTOMATICA")], "v(titulo, seccion, status)"))
def q65_learnings(spark, d):
    from quillmill.operators.traces import verdict

    rows = frame(spark, "j string", _LEARNED).where(composition.valid_json(F.col("j"))).select(F.from_json("j", "titulo string, seccion_objetivo int, evidencia array<string>").alias("x"))
    return rows.select("x.titulo", F.col("x.seccion_objetivo").alias("seccion"), verdict(F.col("x.seccion_objetivo"), [1, 3, 7]).alias("status"))


@query("""WITH u AS (SELECT event_id, props AS a, CASE WHEN c_custkey IS NULL THEN '{}' WHEN event_id % 3 = 0 THEN '{"k":"' || c_mktsegment || '","' || lower(c_mktsegment) || '":' || c_nationkey || '}' ELSE '{"' || lower(c_mktsegment) || '":{"n":' || c_nationkey || ',"x":null}}' END AS b FROM events LEFT JOIN customer ON c_custkey = user_id)
SELECT event_id, '{' || array_to_string(list_transform(list_sort(list_distinct(json_keys(a) || json_keys(b))), lambda k: '"' || k || '":' || coalesce(json_extract(b, '$."' || k || '"')::VARCHAR, json_extract(a, '$."' || k || '"')::VARCHAR)), ',') || '}' AS props FROM u""")
def q72b_merged_json(spark, d):
    """Events' properties with fields of their customers, under names that are data."""
    e, c = table(spark, d, "events", "event_id", "user_id", "props"), table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    name, n = F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")
    both = F.concat(F.lit('{"k":"'), "c_mktsegment", F.lit('","'), name, F.lit('":'), n, F.lit("}"))
    one = F.concat(F.lit('{"'), name, F.lit('":{"n":'), n, F.lit(',"x":null}}'))
    more = F.when(F.col("c_custkey").isNull(), "{}").when(F.col("event_id") % 3 == 0, both).otherwise(one)
    return e.join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", composition.merged_json(F.col("props"), more).alias("props"))
