"""Queries whose texts are built of table rows in Spark, while their SQL puts the results
together from the same rows, without reading the texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions import text
from quillmill.operators import composition, language, markdown, report, states, traces
from quillmill.plans import fixtures as fx
from quillmill.plans.catalog import _route_sql, query, table
from quillmill.sources import files, outputs


def _cat(*parts: Column | str | int) -> Column:
    """Strings are literal text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(choices: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (by % len(choices) + 1).cast("int"))


def _pick_sql(choices: list, by: str) -> str:
    listed = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in choices)
    return f"([{listed}])[{by} % {len(choices)} + 1]"


def _times(part: str, n: Column) -> Column:
    return F.repeat(F.lit(part), n.cast("int"))


def _id(name: str) -> Column:
    return F.col(name)


# --- texts -----------------------------------------------------------------------------
@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' sin datos' ELSE 'Nombre: [REDACTADO]\nvisto el [FECHA] en sala\ncorreo [EMAIL], ficha [RUT]\n' || c_mktsegment END AS clean FROM customer")
def q11_deidentify(spark, d):
    k, three = _id("c_custkey"), lambda x: F.lpad((x % 1000).cast("string"), 3, "0")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    rut = _cat(k % 90 + 10, ".", three(k * 7), ".", three(k * 13), "-", F.when(k % 11 == 10, "K").otherwise((k % 11).cast("string")))
    note = _cat("Nombre: ", F.col("c_name"), "\nvisto el ", two(k % 28 + 1), "/", two(k % 12 + 1), "/2021 en sala\ncorreo c", k, ".x@uno.example.org, ficha ", rut, "\n", F.col("c_mktsegment"))
    rows = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    return rows.select("c_custkey", text.deidentify(F.when(k % 5 == 0, _cat(F.col("c_name"), " sin datos")).otherwise(note)).alias("clean"))


_PHRASES = [t for _, t in fx.TAGGED] + ["clinical trial of efficacy and safety", "esclerosis lateral amiotrófica", "Guillain-Barré, pronóstico", "revisión sistemática de biomarkers"]


def _tags_sql(col: str) -> str:
    one = lambda patterns: "|".join(patterns).replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")
    listed = ", ".join(f"CASE WHEN regexp_matches(lower({col}), '{one(p)}') THEN '{tag}' END" for tag, p in sorted(language.TAXONOMY.items()))
    return f"array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {_tags_sql('t')} AS tags FROM (SELECT doc_id, text || ' ' || {_pick_sql(_PHRASES, 'doc_id')} AS t FROM documents)")
def q13b_taxonomy(spark, d):
    t = _cat(F.col("text"), " ", _pick(_PHRASES, _id("doc_id")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(language.tags(t, language.TAXONOMY), ",").alias("tags"))


_ASKED = [m for _, m in fx.ROUTES]


@query(f"SELECT conv_id, turn, {_route_sql(language.KEYWORDS, 't', 'research')} AS agent FROM (SELECT conv_id, turn, text || ' ' || {_pick_sql(_ASKED, '(conv_id + turn)')} AS t FROM conversations WHERE role = 'user')")
def q14b_route_fixed(spark, d):
    t = _cat(F.col("text"), " ", _pick(_ASKED, _id("conv_id") + _id("turn")))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", language.route(t, language.KEYWORDS, "research").alias("agent"))


_TOOLS, _ARGS = [t for _, t, _ in fx.CALLS], [a for *_, a in fx.CALLS]


@query(f"SELECT event_id, CASE WHEN regexp_matches({_pick_sql(_ARGS, 'event_id')} || props, '{language.DESTRUCTIVE}') THEN 'BLOQUEADO' WHEN {_pick_sql(_TOOLS, 'user_id')} IN ({', '.join(repr(g) for g in language.GATED)}) THEN 'GATE' ELSE 'OK' END AS verdict FROM events")
def q15b_guard_calls(spark, d):
    rows = table(spark, d, "events", "event_id", "user_id", "props")
    return rows.select("event_id", language.guard(_pick(_TOOLS, _id("user_id")), _cat(_pick(_ARGS, _id("event_id")), F.col("props"))).alias("verdict"))


_ROOMS = [None, "Cocina", "Backlight A", "Enchufe TV", "Lámpara"]


@query(f"""WITH s AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'light.' ELSE 'switch.' END || lower(c_mktsegment) || '_' || c_custkey AS entity, {_pick_sql(_ROOMS, 'c_custkey')} AS name, c_custkey % 3 > 0 AS is_on FROM customer)
SELECT entity FROM s WHERE is_on AND starts_with(entity, 'switch.') AND NOT regexp_matches(lower(entity || ' ' || coalesce(name, '')), '{'|'.join(states.NOT_LIGHT)}') AND entity NOT IN ('switch.building_1', 'switch.machinery_5', 'switch.household_10')""")
def q22_lights_to_turn_off(spark, d):
    k = _id("c_custkey")
    rows = table(spark, d, "customer", "c_custkey", "c_mktsegment").select(
        _cat(F.when(k % 4 == 0, "light.").otherwise("switch."), F.lower("c_mktsegment"), "_", k).alias("entity"), _pick(_ROOMS, k).alias("name"), F.when(k % 3 == 0, "off").otherwise("on").alias("state"))
    keep = states.keep_list(" switch.building_1, ,switch.machinery_5,switch.household_10 ")
    return rows.where(states.excluded(F.col("entity"), F.col("name"), "switch.", states.NOT_LIGHT) & ~F.col("entity").isin(keep) & (F.col("state") == "on")).select("entity")


@query("SELECT p_partkey, p_partkey % 7 || '.' || p_size || '.' || (p_partkey + 1) AS patch, p_partkey % 7 || '.' || (p_size + 1) || '.0' AS minor FROM part")
def q28_version_bump(spark, d):
    v = _cat(_id("p_partkey") % 7, ".", F.col("p_size"), ".", _id("p_partkey"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", text.bump(v).alias("patch"), text.bump(v, "minor").alias("minor"))


_NAMES = ["García López", "Núñez", "O'Brien Ana", "Müller-Lüdtke", "", "Çelik"]


@query(f"""WITH n AS (SELECT c_custkey, c_nationkey, regexp_replace(strip_accents(lower(string_split({_pick_sql(_NAMES, 'c_custkey')}, ' ')[1])), '[^a-z]', '', 'g') AS a FROM customer)
SELECT c_custkey, CASE WHEN a = '' THEN 'anon' ELSE a END || '_' || (2000 + c_nationkey) || '_' || c_custkey || '.pdf' AS name FROM n""")
def q38b_file_names(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey")
    return rows.select("c_custkey", text.file_name(_pick(_NAMES, _id("c_custkey")), _cat(F.col("c_nationkey") + 2000), _cat(_id("c_custkey"))).alias("name"))


_CITE_SQL = """array_to_string(list_filter([array_to_string(list_transform(range(1, least(p_partkey % 9, 6) + 1), lambda i: 'A' || i || ' B'), ', ') || CASE WHEN p_partkey % 9 > 6 THEN ', et al' ELSE '' END,
  p_name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END, (1990 + p_size)::VARCHAR], lambda x: x <> ''), '. ') || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '. doi:10.1/' || p_partkey END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '. PMID: ' || p_partkey END || '.'"""


def _cite() -> Column:
    k = _id("p_partkey")
    authors = F.transform(F.slice(F.sequence(F.lit(0), k % 9), F.lit(2), F.lit(9)), lambda i: _cat("A", i, " B"))
    return text.citation(authors, _cat(F.col("p_name"), "."), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), _cat(F.col("p_size") + 1990), F.when(k % 3 == 0, "").otherwise(_cat("10.1/", k)), F.when(k % 2 == 0, "").otherwise(_cat(k)))


@query(f"SELECT p_partkey, {_CITE_SQL} AS cite FROM part")
def q38_citations(spark, d):
    return table(spark, d, "part").select("p_partkey", _cite().alias("cite"))


_CLASSES = ["pmc", "oa", "paywall", "raro"]


@query(f"""SELECT p_partkey, p_partkey || '. ' || {_CITE_SQL} || ' — *' || p_type || '* · ' || {_pick_sql(['PMC (libre)', 'Open access', 'Paywall — requiere proxy UC', 'raro'], 'p_partkey')} || CASE WHEN p_size % 2 = 0 THEN '' ELSE '\n   - Texto completo: u' || p_partkey END AS line FROM part""")
def q49_bibliography(spark, d):
    k = _id("p_partkey")
    url = F.when(F.col("p_size") % 2 == 0, "").otherwise(_cat("u", k))
    return table(spark, d, "part").select("p_partkey", outputs.bibliography_line(k, _cite(), F.col("p_type"), _pick(_CLASSES, k), url).alias("line"))


@query("SELECT doc_id, '(' || lang || ') AND (' || source || ') AND (\"2000\"[dp] : \"3000\"[dp])' AS q FROM documents")
def q55_query_texts(spark, d):
    return table(spark, d, "documents", "doc_id", "lang", "source").select("doc_id", composition.query_text(F.col("lang"), F.col("source"), 2000).alias("q"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^)\s]+$') THEN url || ',' ELSE '' END || 'http://d/' || page_id AS urls FROM pages")
def q56_image_urls(spark, d):
    t = _cat("![x](", F.col("url"), ") [no](https://n) ![](http://d/", _id("page_id"), ' "t") ![f](file.png)')
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.array_join(report.image_urls(t), ",").alias("urls"))


# --- Markdown --------------------------------------------------------------------------
_OPEN = '<table fit-page-width="true" header-row="true">\n'


def _row_sql(*cells: str) -> str:
    return "'\t<tr>\n" + "\n".join(f"\t\t<td>' || {c} || '</td>" for c in cells) + "\n\t</tr>'"


@query(f"""SELECT l_orderkey, md5('pedido ' || l_orderkey || '\n{_OPEN}' || {_row_sql("'n'", "'parte'", "'estado'")} || '\n' || string_agg({_row_sql("l_linenumber", "l_partkey || '|' || l_suppkey", "l_returnflag")}, '\n' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) || '\n</table>\nfin') AS t_md5 FROM lineitem GROUP BY l_orderkey""")
def q29_md_tables(spark, d):
    line = _cat("| ", F.col("l_linenumber"), " | ", F.col("l_partkey"), "\\|", F.col("l_suppkey"), " |", F.col("l_returnflag"), "|")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("o"), line.alias("line"))
    of = outputs.lines_joined(rows, "o", "line", "l_orderkey")
    t = _cat("pedido ", _id("l_orderkey"), "\n| n | parte | estado |\n|---|:-:|---|\n", F.col("text"), "\nfin")
    return of.select("l_orderkey", F.md5(markdown.tables(t).cast("binary")).alias("t_md5"))


@query(r"""SELECT doc_id, 'ver \[' || n_chars || ', ' || doc_id || '\] y [' || lang || '](u/' || doc_id || ') `[' || doc_id || ']` ![i](p) \[7\]
```
[' || n_chars || ']
```
\[' || doc_id || '\] [2-4]' AS t FROM documents""")
def q30_md_escape(spark, d):
    k, n = _id("doc_id"), F.col("n_chars")
    t = _cat("ver [", n, ", ", k, "] y [", F.col("lang"), "](u/", k, ") `[", k, "]` ![i](p) [7]\n```\n[", n, "]\n```\n[", k, "] [2-4]")
    return table(spark, d, "documents", "doc_id", "lang", "n_chars").select("doc_id", markdown.escape_citations(t).alias("t"))


@query("""WITH l AS (SELECT conv_id, turn, turn % 4 > 0 AS q, turn || ' ' || length(text) AS x FROM conversations),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, q ORDER BY turn) AS island FROM l),
m AS (SELECT conv_id, min(turn) AS turn, CASE WHEN q THEN '> ' || string_agg(x, '<br>' ORDER BY turn) ELSE string_agg(x, chr(10) ORDER BY turn) END AS t FROM g GROUP BY conv_id, q, island)
SELECT conv_id, string_agg(t, chr(10) ORDER BY turn) AS t FROM m GROUP BY conv_id""")
def q31_quote_merge(spark, d):
    line = _cat(F.when(_id("turn") % 4 > 0, "> ").otherwise(""), _id("turn"), " ", F.length("text"))
    got = outputs.lines_joined(table(spark, d, "conversations").withColumn("line", line), "turn", "line", "conv_id")
    return got.select("conv_id", markdown.join_quotes(F.col("text")).alias("t"))


@query(rf"""SELECT doc_id, source || ' ' || doc_id AS title, 'intro \[' || n_chars || '\]
> q<br>' || lang || '
#### deep
{_OPEN}' || {_row_sql(r"'a \[' || doc_id || '\]'")} || '
' || {_row_sql("n_chars")} || '
</table>
```mermaid
flowchart
A[x<br>y]
```
' AS t FROM documents""")
def q31b_md_convert(spark, d):
    k, n = _id("doc_id"), F.col("n_chars")
    t = _cat("# ", F.col("source"), " ", k, "\n\nintro [", n, "]\n> q\n> ", F.col("lang"), "\n##### deep\n| a [", k, "] |\n|---|\n| ", n, " |\n```mermaid\nflowchart\nA[x\\ny]\n```\n")
    return table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").select("doc_id", markdown.title(t).alias("title"), markdown.convert(t).alias("t"))


# --- reports ---------------------------------------------------------------------------
def _reports(spark, d):
    """Reports with faults that depend on the id."""
    k = _id("doc_id")
    when = lambda m, part: F.when(k % m == 0, part).otherwise("")
    parts = F.array_join(F.transform(F.sequence(F.lit(1), F.when(k % 3 == 0, 7).otherwise(8)), lambda i: _cat("## ", i, ". Parte\nTexto [", i, "]\n")), "")
    listed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: _cat(i, ". Uno. Título. Rev. ", i + k % 20 + 1995, ". PMID: ", i + 100, ".\n")), "")
    second = F.when(k % 5 == 0, "").otherwise("```mermaid\ngraph\nB[z]\n```\n")
    t = F.concat(parts, when(4, "#### hondo\n"), when(6, "$$x$$\n"), when(7, "| a | b |\n|---|\n"), F.lit('```mermaid\nflowchart\nA["x, y"]\n```\n'), second, F.lit("## Referencias\n"), listed, when(2, "## Qué quedó fuera\nnada [9]\n"))
    return table(spark, d, "documents", "doc_id").select("doc_id", t.alias("t"))


def _check_sql(name: str, fails: str, detail: str, bad: str = "FALLO") -> str:
    return f"SELECT doc_id, '{name}' AS \"check\", CASE WHEN {fails} THEN '{bad}' ELSE 'ok' END AS status, {detail} AS detail FROM documents"


_OLD = "list_filter(list_transform(range(1, 9), lambda i: 1995 + doc_id % 20 + i), lambda y: y < 2000)"
_CHECKS_SQL = " UNION ALL ".join([
    _check_sql("sections", "doc_id % 3 = 0", "CASE WHEN doc_id % 3 = 0 THEN '1,2,3,4,5,6,7' ELSE '1,2,3,4,5,6,7,8' END"), _check_sql("section Referencias", "false", "''"), _check_sql("section Qué quedó fuera", "doc_id % 2 > 0", "''"),
    *[_check_sql(name, f"doc_id % {m} = 0", f"CASE WHEN doc_id % {m} = 0 THEN '1' ELSE '0' END") for name, m in (("headings", 4), ("formulas", 6), ("tables", 7), ("diagrams", 5))],
    _check_sql("citations", "doc_id % 2 = 0", "CASE WHEN doc_id % 2 = 0 THEN '9' ELSE '' END"), _check_sql("references", "doc_id % 3 = 0", "CASE WHEN doc_id % 3 = 0 THEN '8' ELSE '' END", "aviso"),
    _check_sql("years", f"len({_OLD}) > 0", f"CASE WHEN len({_OLD}) > 0 THEN array_to_string({_OLD}, ',') ELSE (1996 + doc_id % 20) || '-' || (2003 + doc_id % 20) END"),
])


@query(_CHECKS_SQL)
def q32_report_checks(spark, d):
    return report.checks(_reports(spark, d), "doc_id", "t")


@query(f"SELECT doc_id, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'aviso') AS n_warn, count(*) FILTER (WHERE status = 'FALLO') AS n_fail, max((status = 'FALLO')::INT) AS exit_status FROM ({_CHECKS_SQL}) GROUP BY doc_id")
def q32b_report_tally(spark, d):
    return report.tally(report.checks(_reports(spark, d), "doc_id", "t"), "doc_id")


@query("""WITH w AS (SELECT p_partkey, p_size, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{5,}')) AS r, list_distinct(regexp_extract_all(lower(p_name), '[a-z]{5,}')) AS c FROM part)
SELECT l_orderkey, p_partkey::VARCHAR AS pmid, CASE WHEN p_size % 10 = 0 THEN 'absent' WHEN len(r) > 0 AND len(CASE WHEN l_linenumber % 3 = 0 THEN [] ELSE list_intersect(r, c) END) / len(r) < 0.34 THEN 'mismatch' ELSE 'ok' END AS verdict FROM lineitem JOIN w ON l_partkey = p_partkey""")
def q32c_cited_titles(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size")
    cited = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    line = _cat(F.col("l_linenumber"), ". ", F.when(F.col("l_linenumber") % 3 == 0, "abc").otherwise(F.col("p_name")), ". PMID: ", _id("p_partkey"), ".")
    docs = outputs.lines_joined(cited.select("l_orderkey", F.struct("l_linenumber", "p_partkey").alias("o"), line.alias("line")), "o", "line", "l_orderkey")
    registry = part.select(_cat(_id("p_partkey")).alias("pmid"), _cat(F.col("p_name"), " ", F.col("p_type")).alias("title"), F.when(F.col("p_size") % 10 == 0, "not found").alias("error"))
    return report.cited_titles(docs.select("l_orderkey", _cat("## Referencias\n", F.col("text")).alias("t")), registry, "l_orderkey", "t")


def _sectioned(spark, d):
    k = _id("doc_id")
    t = F.concat(_times("intro\n", k % 3), F.lit("## 1. A\n"), _times("x\n", k % 4), F.lit("\n---\n## 2. B\n"), _times("y\n", k % 5), F.lit("\n---\n\n"), F.when(k % 2 > 0, "## 3. C\nz").otherwise(""))
    return table(spark, d, "documents", "doc_id").select("doc_id", t.alias("t"))


@query('SELECT doc_id, (doc_id % 3 + doc_id % 4 + 3)::INT AS start, (doc_id % 3 + doc_id % 4 + doc_id % 5 + 4)::INT AS "end" FROM documents')
def q32e_section_lines(spark, d):
    return report.section_lines(_sectioned(spark, d), "doc_id", "t", 2)


@query("""SELECT doc_id, repeat('intro\n', doc_id % 3) || '## 1. A\n' || repeat('x\n', doc_id % 4) || '\n---\n## 2. B\n' || repeat('y\n', doc_id % 5) || 'NEW\n\n\n---\n\n' || CASE WHEN doc_id % 2 > 0 THEN '## 3. C\nz' ELSE '' END AS t FROM documents""")
def q54_insert_line(spark, d):
    docs = _sectioned(spark, d)
    end = report.section(F.col("t"), 2)["end"]
    return docs.select("doc_id", composition.inserted(F.col("t"), end, "NEW").alias("t")).where("t IS NOT NULL")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '1.' || p_size || '.' || p_partkey ELSE '0.0.0' END AS version, CASE WHEN p_partkey % 3 = 0 THEN 'open' ELSE 'gated' END AS mode, CASE WHEN p_partkey % 3 = 0 THEN '1,3,' || p_partkey % 9 ELSE '' END AS protected FROM part")
def q32f_metadata(spark, d):
    k = _id("p_partkey")
    full = _cat("x\n```yaml\nversion: 1.", F.col("p_size"), ".", k, "\nself_modification: open\nprotected_sections: [1, 3, ", k % 9, "]\n```\n")
    got = report.metadata(F.when(k % 3 == 0, full).when(k % 3 == 1, "```yaml\nself_modification: gated\nk: v\n```").otherwise("none"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", got["version"].alias("version"), got["mode"].alias("mode"), F.array_join(got["protected"].cast("array<string>"), ",").alias("protected"))


# --- landed rows -----------------------------------------------------------------------
@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus ELSE 'a=' || o_orderkey END AS v FROM orders WHERE o_orderkey % 5 IN (1, 2, 4))
SELECT 'C' || o_custkey AS key, arg_min(v, o_orderkey) AS value, min(o_orderkey) AS ord FROM l GROUP BY 1""")
def q36_key_values(spark, d):
    k, c = _id("o_orderkey"), F.col("o_custkey")
    line = F.when(k % 5 == 0, _cat("# C", c, "=x")).when(k % 5 == 1, _cat("C", c, '="', F.col("o_orderpriority"), '"')).when(k % 5 == 2, _cat("  C", c, " = ", F.col("o_orderstatus"), " ")).when(k % 5 == 3, "no equals").otherwise(_cat("C", c, "=a=", k))
    return files.key_values(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").select(k.alias("ord"), line.alias("line")))


@query("SELECT 'p' || p_partkey AS folder, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'p' || p_partkey ELSE 'text' END AS name, CASE p_partkey % 3 WHEN 0 THEN p_type || ' x' WHEN 1 THEN p_brand ELSE '' END AS description FROM part")
def q41_front_matter(spark, d):
    k = _id("p_partkey")
    t = F.when(k % 3 == 0, _cat("---\nname: ", F.col("p_name"), "\ndescription: ", F.col("p_type"), " x\n---\n")).when(k % 3 == 1, _cat("description:\n", F.col("p_brand"))).otherwise("name: \ntext")
    return files.front_matter(table(spark, d, "part").select(_cat("p", k).alias("folder"), t.alias("text"))).select("folder", "name", "description")


_ARTICLE = f"PubmedArticle struct<{files.ARTICLE.replace('MedlineCitation struct', 'MedlineCitation:struct', 1).replace('PubmedData struct', 'PubmedData:struct', 1)}>"


_RECORDS_SQL = """SELECT doc_id::VARCHAR AS pmid, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'PMC' || doc_id END AS pmcid, source || ' ' || doc_id AS titulo, 'J ' || lang AS revista, (1950 + doc_id % 70)::VARCHAR AS anio,
  array_to_string(list_transform(range(1, doc_id % 3 + 1), lambda i: 'Paz' || i || ' A') || ['Grupo'], ';') AS autores, 'AIM: ' || n_chars || ' END: y' AS abstract, array_to_string(list_transform(range(1, least(doc_id % 15, 12) + 1), lambda i: 'M' || i), ';') AS mesh FROM documents"""


def _article():
    k = _id("doc_id")
    many = lambda n, part: F.array_join(F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(2), F.lit(20)), part), "")
    authors = many(k % 3, lambda i: _cat("<Author><LastName>Paz", i, "</LastName><Initials>A</Initials></Author>"))
    mesh = many(k % 15, lambda i: _cat("<MeshHeading><DescriptorName>M", i, "</DescriptorName></MeshHeading>"))
    year = F.when(k % 4 == 0, _cat("<MedlineDate>", k % 70 + 1950, " Dec-1999 Jan</MedlineDate>")).otherwise(_cat("<Year>", k % 70 + 1950, "</Year>"))
    pmc = F.when(k % 2 == 0, "").otherwise(_cat('<ArticleId IdType="pmc">PMC', k, "</ArticleId>"))
    return _cat(
        "<Set><PubmedArticle><MedlineCitation><PMID>", k, "</PMID><Article><Journal><ISOAbbreviation>J ", F.col("lang"), "</ISOAbbreviation><JournalIssue><PubDate>", year, "</PubDate></JournalIssue></Journal><ArticleTitle>", F.col("source"), " ", k,
        '</ArticleTitle><Abstract><AbstractText Label="AIM">', F.col("n_chars"), '</AbstractText><AbstractText Label="END">y</AbstractText></Abstract><AuthorList>', authors, "<Author><CollectiveName>Grupo</CollectiveName></Author><Author><Initials>Z</Initials></Author></AuthorList></Article><MeshHeadingList>", mesh,
        '</MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/', k, "</ArticleId>", pmc, "</ArticleIdList></PubmedData></PubmedArticle></Set>")


@query(_RECORDS_SQL)
def q42_xml_records(spark, d):
    rows = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").select(F.from_xml(_article(), _ARTICLE)["PubmedArticle"].alias("a")).select("a.*")
    return files.flat(rows).select("pmid", "doi", "pmcid", "titulo", "revista", "anio", F.array_join("autores", ";").alias("autores"), "abstract", F.array_join("mesh", ";").alias("mesh"))


@query(f"""WITH r AS ({_RECORDS_SQL}), asked AS (SELECT doc_id::VARCHAR AS pmid, doc_id % 7 = 0 AS bad FROM labels UNION ALL SELECT 'b' || item_id, false FROM benchmark)
SELECT a.pmid, CASE WHEN r.pmid IS NULL THEN 'missing' WHEN bad THEN 'broken' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN doi END AS doi, CASE WHEN NOT bad THEN titulo END AS titulo, CASE WHEN NOT bad THEN autores END AS autores FROM asked a LEFT JOIN r ON r.pmid = a.pmid""")
def q42b_fetched_records(spark, d):
    """Records landed in files of 150, some of them broken, and fetched by ids of which
    some were never landed."""
    path = outputs.new_folder(spark)
    inner = F.regexp_replace(_article(), "</?Set>", "")
    broken = F.when(_id("doc_id") % 7 == 0, F.regexp_replace(inner, "</ArticleTitle>", "</Title>")).otherwise(inner)
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars").select("doc_id", broken.alias("x"))
    outputs.land_xml(docs, "doc_id", "x", path, [F.floor(F.col("id") / 10_000)])
    ids = table(spark, d, "labels", "doc_id").select(F.col("doc_id").cast("string").alias("pmid")).unionByName(table(spark, d, "benchmark", "item_id").select(_cat("b", _id("item_id")).alias("pmid")))
    return files.fetch(spark, path, ids, "pmid").select("pmid", "status", "doi", "titulo", F.array_join("autores", ";").alias("autores"))


@query("""SELECT 'switch.' || c_custkey AS entity, 'switch.' || c_custkey || ' (' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'switch.' || c_custkey END || ') = ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '\n  attrs: {"w":"' || c_nationkey || '"}' END AS line FROM customer""")
def q52_state_lines(spark, d):
    k = _id("c_custkey")
    named = F.when(k % 2 == 0, F.create_map(F.lit("friendly_name"), F.col("c_name"))).otherwise(F.create_map().cast("map<string,string>"))
    more = F.when(k % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("w"), F.col("c_nationkey").cast("string")))
    rows = table(spark, d, "customer").select(_cat("switch.", k).alias("entity"), F.col("c_mktsegment").alias("state"), F.map_concat(named, more).alias("a"))
    return rows.select("entity", composition.state_line(F.col("entity"), F.col("state"), F.col("a")).alias("line"))


@query("""WITH e AS (SELECT n_name AS key, 'old' AS v, n_nationkey AS o FROM nation WHERE n_regionkey < 3), u AS (SELECT n_name AS key, 'new' || n_nationkey AS v, n_nationkey AS o FROM nation WHERE n_regionkey >= 2)
SELECT key, coalesce(u.v, e.v) AS value, row_number() OVER (ORDER BY e.o IS NULL, e.o, u.o)::INT AS place FROM e FULL JOIN u USING (key)""")
def q57_merge_keys(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("ord"), "n_regionkey")
    old = nation.where("n_regionkey < 3").select("key", F.lit("old").alias("value"), "ord")
    return composition.merge_keys(old, nation.where("n_regionkey >= 2").select("key", _cat("new", F.col("ord")).alias("value"), "ord"))


@query("SELECT event_id, event_type AS titulo, (user_id % 9)::INT AS seccion, CASE WHEN user_id % 9 IN (1, 3, 7) THEN 'RECHAZADA_AUTOMATICA' ELSE 'PENDIENTE' END AS status FROM events WHERE event_id % 3 > 0")
def q65_learnings(spark, d):
    k = _id("event_id")
    j = F.when(k % 3 == 0, "not json").otherwise(_cat('{"titulo":"', F.col("event_type"), '","seccion_objetivo":', _id("user_id") % 9, F.when(k % 3 == 1, ',"evidencia":["x"]}').otherwise("}")))
    rows = files.parsed(table(spark, d, "events", "event_id", "user_id", "event_type").withColumn("j", j), "j", "titulo string, seccion_objetivo int, evidencia array<string>").where("error IS NULL")
    return rows.select("event_id", "value.titulo", F.col("value.seccion_objetivo").alias("seccion"), traces.verdict(F.col("value.seccion_objetivo"), [1, 3, 7]).alias("status"))


@query("""WITH x AS (SELECT c_custkey, [c_name, 'Contexto Clínico', 'Objetivos'] || flatten(list_transform(range(1, c_custkey % 6 + 1), lambda i: ['Estudio ' || i || ': Metodología', 'Estudio ' || i || ': Resultados'])) || ['Discusión', 'Conclusiones', 'Bibliografía'] AS a FROM customer),
y AS (SELECT c_custkey, a || list_transform(range(0, greatest(0, 12 - len(a))), lambda i: 'Análisis Secundario') AS a FROM x)
SELECT c_custkey, unnest(range(1, len(a) + 1))::INT AS slide, unnest(a) AS title FROM y""")
def q40_deck_plan(spark, d):
    return traces.deck(table(spark, d, "customer", "c_custkey", "c_name"), "c_custkey", F.col("c_name"), (_id("c_custkey") % 6).cast("int"))
