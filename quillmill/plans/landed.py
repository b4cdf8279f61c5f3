"""Queries of what is landed and read back, of searches' summaries and of proposals."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.functions.numbers import token_cost
from quillmill.operators import composition, language, selection, states, traces
from quillmill.plans.catalog import _ACCESS_SQL, _access, query, table
from quillmill.plans.fixtures import frame, values
from quillmill.sources import files, outputs
from quillmill.streaming import log

_TOPIC_OF = "source || '-' || (doc_id // 1000)"


def _envelopes(spark, d):
    """One envelope a source and thousand of ids, with all records' columns."""
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "text")
    known = {"pmid": F.col("doc_id").cast("string"), "titulo": F.split("text", "\n")[0], "estrato": F.col("lang")}
    kinds = dict(x.split(" ") for x in files.RECORD.split(", "))
    record = F.struct(*[known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    topic = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("tema")
    rows = docs.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("doc_id", record.alias("r")))).alias("x"))
    return rows.select("tema", F.lit("todo").alias("enfoque"), F.lit("2024-01-01").alias("generado"), F.size("x").alias("n_fuentes"), F.col("x.r").alias("fuentes"))


@query(f"SELECT {_TOPIC_OF} AS tema, 'todo' AS enfoque, (row_number() OVER (PARTITION BY {_TOPIC_OF} ORDER BY doc_id) - 1)::INT AS seq, doc_id::VARCHAR AS pmid, string_split(text, chr(10))[1] AS titulo, lang AS estrato FROM documents")
def q66_envelope_read_back(spark, d):
    path = outputs.new_folder(spark)
    outputs.overwrite_json(_envelopes(spark, d), path)
    return files.envelope(spark, path, lines=True).select("tema", "enfoque", "seq", "pmid", "titulo", "estrato")


@query(f"SELECT {_TOPIC_OF} AS tema, count(*)::INT AS n_fuentes, 'revisado' AS enfoque FROM documents GROUP BY 1")
def q67_envelope_updated(spark, d):
    """Read, changed and put in the place of what was read."""
    path = outputs.new_folder(spark)
    outputs.overwrite_json(_envelopes(spark, d), path)
    rows = spark.read.schema(files.ENVELOPE).json(path)
    outputs.overwrite_json(rows.withColumn("enfoque", F.lit("revisado")), path)
    return spark.read.schema(files.ENVELOPE).json(path).select("tema", F.size("fuentes").alias("n_fuentes"), "enfoque")


def _traces(spark, d):
    usage = F.struct(F.lit("m").alias("model"), F.col("event_id").alias("input"), F.col("user_id").alias("output"), token_cost(F.col("event_id"), F.col("user_id"), F.lit(3.0), F.lit(15.0)).alias("cost_usd"))
    return table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("agent"), F.col("user_id").cast("string").alias("project"), usage.alias("usage"), F.round(F.col("value") / 7, 2).alias("latency_s"))


_DAY_SQL = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS agent, user_id::VARCHAR AS project, round(event_id * 3.0 / 1e6 + user_id * 15.0 / 1e6, 6) AS cost_usd, round(value / 7, 2) AS latency_s
FROM events WHERE ts::DATE = DATE '2024-01-15'"""


@query(_DAY_SQL)
def q68_day_log(spark, d):
    """Traces appended to the logs of all days, in two goes, and one day's read back."""
    traces_, path = _traces(spark, d), outputs.new_folder(spark)
    for some in (F.col("agent") == "error", F.col("agent") != "error"):
        outputs.append_log(traces_.where(some), path, "ts")
    return files.day_rows(spark, path, "2024-01-15").select("ts", "agent", "project", "usage.cost_usd", "latency_s")


@query(_DAY_SQL)
def q68b_log_once(spark, d):
    """The same by a stream whose first attempt dies between a batch's files and its entry,
    and which is started again on its checkpoint."""
    landed, path = outputs.new_folder(spark), outputs.new_folder(spark)
    traces_ = _traces(spark, d)
    traces_.repartition(3).write.parquet(landed)
    stream = lambda: spark.readStream.schema(traces_.schema).option("maxFilesPerTrigger", 1).parquet(landed)

    def die(batch: int) -> None:
        if batch == 1:
            raise RuntimeError("between files and entry")

    try:
        log.append(stream(), path, "ts", f"{path}/checkpoint", die).awaitTermination()
    except StreamingQueryException:
        pass
    log.append(stream(), path, "ts", f"{path}/checkpoint").awaitTermination()
    return log.read(spark, path, files.TRACE, "2024-01-15").select("ts", "agent", "project", "usage.cost_usd", "latency_s")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no existe' WHEN n_chars * 20 < 20000 THEN 'demasiado pequeño' WHEN quality <> 1 THEN 'no es PDF' ELSE 'ok' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id)")
def q69_pdf_verdict(spark, d):
    rows = table(spark, d, "documents", "doc_id", "n_chars", "text").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")
    head = F.when(F.col("quality") == 1, "%PDF-1.7").otherwise(F.substring("text", 1, 8)).cast("binary")
    length = F.when(F.col("quality").isNotNull(), F.col("n_chars") * 20)
    return rows.select("doc_id", files.pdf_verdict(length, head).alias("verdict"))


@query("SELECT lang, row_number() OVER (ORDER BY lang) AS place, count(*) AS n FROM documents GROUP BY lang")
def q70_sorted_glob(spark, d):
    """A file a language, listed in order, each with the rows that are read from it."""
    path = outputs.new_folder(spark)
    docs = table(spark, d, "documents", "doc_id", "lang")
    docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("k", F.col("lang")).coalesce(1).write.partitionBy("k").json(path)
    listed = files.sorted_files(spark, path, "*.json").select(F.regexp_extract("path", "k=([^/]+)/", 1).alias("lang"))
    place = F.monotonically_increasing_id()  # a row a file: one partition, in order
    counts = spark.read.schema("lang string, n long").json(path)
    return listed.coalesce(1).withColumn("place", place + 1).join(counts, "lang").select("lang", "place", "n")


@query("SELECT conv_id, 'Conversation ' || conv_id AS title, 'md' AS format, count(*)::INT AS n_sections, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def q71_spec_beside(spark, d):
    """Documents with their specs beside them, which are read again."""
    path = outputs.new_folder(spark)
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("heading"), F.col("text").alias("content")))).alias("x"))
    docs = turns.select("conv_id", F.concat(F.lit("Conversation "), "conv_id").alias("title"), F.lit("md").alias("format"), F.transform("x", lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"))).alias("sections"), F.array_join(F.col("x.content"), "\n").alias("body"))
    outputs.with_spec(docs, ["conv_id", "title", "format", "sections"], path)
    got = files.specs(spark, path + ".spec", "conv_id bigint, title string, format string, sections array<struct<heading:string,content:string>>")
    chars = F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.length(s["content"]))
    return got.select("conv_id", "title", "format", F.size("sections").alias("n_sections"), chars.alias("n_chars"))


@query("""WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'pptx' WHEN conv_id % 3 = 1 THEN 'docx' END AS format, list(CASE WHEN turn % 4 = 3 THEN NULL ELSE role END ORDER BY turn) AS heads, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN format = 'pptx' THEN 'slides' ELSE 'sections' END AS shape, array_to_string(list_transform(heads, lambda h: coalesce(h, '')), '|') AS titles,
  md5(array_to_string(CASE WHEN format = 'pptx' THEN flatten(list_transform(texts, lambda t: string_split(t, chr(10)))) ELSE texts END, '|')) AS parts_md5,
  len(CASE WHEN format = 'pptx' THEN flatten(list_transform(texts, lambda t: string_split(t, chr(10)))) ELSE texts END)::INT AS n_parts FROM c""")
def q71b_shapes(spark, d):
    """Sections as slides with bullets, or as bodies, by the format."""
    section = F.struct("turn", F.when(F.col("turn") % 4 != 3, F.col("role")).alias("heading"), F.col("text").alias("content"))
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(section)).alias("x"))
    fmt = F.when(F.col("conv_id") % 3 == 0, "pptx").when(F.col("conv_id") % 3 == 1, "docx")
    rows = docs.select("conv_id", composition.shaped(fmt, F.col("x")).alias("s"))
    parts = F.coalesce(F.flatten("s.slides.bullets"), F.col("s.sections.body"))
    return rows.select("conv_id", F.when(F.col("s.slides").isNotNull(), "slides").otherwise("sections").alias("shape"), F.array_join(F.coalesce("s.slides.title", "s.sections.heading"), "|").alias("titles"), F.md5(F.array_join(parts, "|").cast("binary")).alias("parts_md5"), F.size(parts).alias("n_parts"))


@query("SELECT conv_id, turn, role AS heading, upper(role) AS agent, md5(text) AS content_md5 FROM conversations")
def q72_struct_merge(spark, d):
    """Sections with their text and agent put in; what they have stays."""
    section = F.struct(F.col("role").alias("heading"), F.lit("?").alias("agent"))
    rows = table(spark, d, "conversations").withColumn("s", composition.merged(section, agent=F.upper("role"), content=F.col("text")))
    return rows.select("conv_id", "turn", "s.heading", "s.agent", F.md5(F.col("s.content").cast("binary")).alias("content_md5"))


_PROPOSED = "SELECT conv_id, turn, conv_id || '_' || turn AS id, (turn % 8)::INT AS seccion, CASE WHEN turn % 8 IN (1, 3, 7) THEN 'RECHAZADA_AUTOMATICA' ELSE 'PENDIENTE' END AS status, left(text, 60) AS title, text FROM conversations"


def _proposals(spark, d):
    rows = table(spark, d, "conversations").withColumn("seccion", (F.col("turn") % 8).cast("int"))
    return rows.select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("id"), "seccion", traces.verdict(F.col("seccion"), [1, 3, 7]).alias("status"), F.substring("text", 1, 60).alias("title"), "text")


@query(f"SELECT id, md5('# ' || id || chr(10) || '- titulo: ' || title || chr(10) || '- seccion: ' || seccion || chr(10) || '- estado: ' || status || chr(10) || chr(10) || text) AS md FROM ({_PROPOSED})")
def q73_proposals(spark, d):
    md = outputs.proposal(F.col("id"), F.col("title"), F.col("seccion"), F.col("text"), F.col("status"))
    return _proposals(spark, d).select("id", F.md5(md.cast("binary")).alias("md"))


@query(f"SELECT id, '1.' || seccion || '.' || (turn + 1) AS version, md5('## 1.' || seccion || '.' || (turn + 1) || ' (2024-02-03)' || chr(10) || '- ' || title || chr(10) || '## 1.0.0') AS log FROM ({_PROPOSED}) WHERE status = 'PENDIENTE'")
def q74_bulk_apply(spark, d):
    """What isn't rejected is applied: the version goes up, the change log gets an entry."""
    rows = traces.applicable(_proposals(spark, d), "status")
    version = text.bump(F.concat_ws(".", F.lit("1"), F.col("seccion").cast("string"), F.col("turn").cast("string")))
    log = outputs.changelog(version, F.lit("2024-02-03").cast("date"), F.col("title"), F.lit("## 1.0.0"))
    return rows.select("id", version.alias("version"), F.md5(log.cast("binary")).alias("log"))


_AGED = _ACCESS_SQL + ", y AS (SELECT x.*, lang AS stratum, CASE WHEN x.doc_id % 9 = 0 THEN 'in press' ELSE (1990 + x.doc_id % 35)::VARCHAR END AS anio, CASE WHEN pmcid <> '' THEN 'pmc' WHEN o THEN 'oa' ELSE 'paywall' END AS access FROM x JOIN documents USING (doc_id))"
_LOG = [(k, s, f"consulta {k}", 3 * k) for k, (s, _) in enumerate(selection.STRATA)]


@query(_AGED + " SELECT doc_id, doi FROM y WHERE access = 'paywall' AND doi <> ''")
def q75_paywalled(spark, d):
    return selection.paywalled(_access(spark, d)).select("doc_id", "doi")


@query(_AGED + f""", n AS (SELECT *, try_cast(anio AS INT) AS year FROM y)
SELECT 'total' AS part, 1::BIGINT AS place, 'asma: ' || count(*) || ' · ' || min(year) || '-' || max(year) AS line FROM n
UNION ALL SELECT 'stratum', row_number() OVER (ORDER BY count(*) DESC, min(doc_id)), '| ' || stratum || ' | ' || count(*) || ' |' FROM n GROUP BY stratum
UNION ALL SELECT 'access', row_number() OVER (ORDER BY count(*) DESC, min(doc_id)), '| ' || access || ' | ' || count(*) || ' |' FROM n GROUP BY access
UNION ALL SELECT 'log', ord, '| ' || s || ' | ' || hits || ' | `' || q || '` |' FROM {values(_LOG, "v(ord, s, q, hits)")}
UNION ALL SELECT 'paywalled', doc_id, '- ' || doi FROM n WHERE access = 'paywall' AND doi <> ''""")
def q76_search_summary(spark, d):
    rows = _access(spark, d).withColumns({"stratum": F.col("lang"), "seq": F.col("doc_id"), "anio": F.when(F.col("doc_id") % 9 == 0, "in press").otherwise((1990 + F.col("doc_id") % 35).cast("string"))})
    return selection.search_summary(rows, frame(spark, "ord int, stratum string, query string, hits int", _LOG), "asma")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 12 AS top, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 9 END AS rank FROM documents")
def q77_top_and_rest(spark, d):
    """The first twelve, the remainder, and a rank with nine for what it doesn't name."""
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    got = selection.top_and_rest(docs, [F.desc("n_chars"), F.col("doc_id")], 12, "doc_id")
    return got.select("doc_id", "top", selection.rank_of(F.col("lang"), {"en": 0, "de": 1}).alias("rank"))


@query("""WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
a AS (SELECT s.user_id, s.event_id AS id, (SELECT arg_min(CASE WHEN p.value > 100 THEN 'keep' ELSE 'off' END, (p.ts, p.event_id)) FROM events p WHERE p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts > s.ts AND p.ts <= s.ts + INTERVAL 24 HOUR) AS answer FROM s)
SELECT user_id, id, CASE WHEN answer = 'keep' THEN 'abort' ELSE 'turn_off' END AS action FROM a""")
def q78_abort_branch(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("time"), "event_type", F.when(F.col("value") > 100, "keep").otherwise("off").alias("answer"))
    waits = states.wait(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", 24 * 3600)
    return states.after_answer(waits, "keep", "turn_off").select("user_id", "id", "action")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS place FROM customer")
def q79_by_entity(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_name")
    got = selection.ranked(rows, [], [F.substring("c_name", 1, 14)], [F.col("c_name")])
    return states.by_entity(got, "c_name").select("c_custkey", "place")


@query("SELECT event_id, CASE WHEN bad THEN 'JSON inválido: ' || left(j, 200) END AS error, CASE WHEN bad THEN -1 ELSE (j::JSON ->> 'k')::INT END AS k FROM (SELECT event_id, event_id % 9 = 0 AS bad, CASE WHEN event_id % 9 = 0 THEN left(props, 4) ELSE props END AS j FROM events)")
def q80_excerpts(spark, d):
    j = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = table(spark, d, "events", "event_id", "props").withColumn("j", j)
    return files.parsed(rows, "j", "k int").select("event_id", "error", F.coalesce("value.k", F.lit(-1)).alias("k"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'research' END AS agent FROM conversations")
def q81_allowed(spark, d):
    answer = F.concat(F.lit("  "), F.upper("role"), F.lit("\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", language.allowed(answer, ["user", "assistant"], "research").alias("agent"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://doi.org/10.' || page_id ELSE url END AS url FROM pages")
def q82_identifier_url(spark, d):
    ident = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10."), "page_id")).otherwise(F.col("url"))
    return table(spark, d, "pages", "page_id", "url").select("page_id", text.identifier_url(ident).alias("url"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS answer FROM conversations")
def q83_defenced(spark, d):
    fenced = F.concat(F.lit(" ```json\n"), "text", F.lit("\n```\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.defenced(fenced).cast("binary")).alias("answer"))


@query("SELECT event_type, '{\"params\":{\"least\":100,\"kind\":\"' || event_type || '\"},\"metrics\":{\"n\":' || count(*) || ',\"above\":' || count(*) FILTER (WHERE value > 100) || '}}' AS result FROM events GROUP BY event_type")
def q84_result_struct(spark, d):
    n = table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("above"))
    got = composition.result({"least": F.lit(100), "kind": F.col("event_type")}, {"n": F.col("n"), "above": F.col("above")})
    return n.select("event_type", F.to_json(got).alias("result"))


@query(r"SELECT item_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10)) AS text_md5, strlen(regexp_replace(text, '\r\n?', chr(10), 'g')) + 1 AS n_bytes FROM benchmark")
def q85_whole_text_files(spark, d):
    """A text file an item, read whole."""
    path = outputs.new_folder(spark)
    table(spark, d, "benchmark", "item_id", "text").withColumn("k", F.col("item_id")).select("k", "text").write.partitionBy("k").text(path)
    read = files.studies(spark, path, "*.txt").where("error IS NULL")
    return read.select(F.regexp_extract("path", "k=([0-9]+)/", 1).cast("long").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""WITH p AS (SELECT p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS t FROM part)
SELECT p_brand AS brand, c::INT AS channel, t::INT AS t, CASE c WHEN 0 THEN p_size ELSE p_retailprice END::DOUBLE AS v FROM p, (VALUES (0), (1)) x(c)""")
def q86_csv_matrices(spark, d):
    """A CSV matrix a brand, read as channels and samples."""
    path = outputs.new_folder(spark)
    rows = table(spark, d, "part", "p_brand", "p_partkey", "p_size", "p_retailprice").withColumn("k", F.col("p_brand"))
    rows.repartition("k").sortWithinPartitions("k", "p_partkey").select("k", "p_size", "p_retailprice").write.partitionBy("k").csv(path)
    brand = F.url_decode(F.url_decode(F.regexp_extract("path", "k=([^/]+)/", 1)))
    return files.matrices(spark, path).select(brand.alias("brand"), "channel", "t", "v")
