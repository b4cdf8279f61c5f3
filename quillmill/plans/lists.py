"""Queries whose vocabularies, titles and rules are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import language, matching, vocabulary
from quillmill.plans.built import _ASKED, _PHRASES, _cat, _id, _pick, _pick_sql, _tags_sql
from quillmill.plans.catalog import _route_sql, query, table
from quillmill.plans.fixtures import frame


@query(f"SELECT doc_id, {_tags_sql('t')} AS tags FROM (SELECT doc_id, text || ' ' || {_pick_sql(_PHRASES, 'doc_id')} AS t FROM documents)")
def q13c_taxonomy_table(spark, d):
    """The taxonomy as (tag, pattern) rows: one automaton of the patterns' literal parts."""
    tags = frame(spark, "tag string, pattern string", [(t, p) for t, ps in language.TAXONOMY.items() for p in ps])
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.lower(_cat(F.col("text"), " ", _pick(_PHRASES, _id("doc_id")))).alias("t"))
    return vocabulary.labelled(rows, F.col("t"), tags, "tag", "pattern").select("doc_id", F.array_join("found.label", ",").alias("tags"))


@query(f"SELECT conv_id, turn, {_route_sql(language.KEYWORDS, 't', 'research')} AS agent FROM (SELECT conv_id, turn, text || ' ' || {_pick_sql(_ASKED, '(conv_id + turn)')} AS t FROM conversations WHERE role = 'user')")
def q14c_route_table(spark, d):
    """The routers' words as (agent, word) rows."""
    words = frame(spark, "agent string, word string", [(a, w) for a, ws in language.KEYWORDS.items() for w in ws])
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lower(_cat(F.col("text"), " ", _pick(_ASKED, _id("conv_id") + _id("turn")))).alias("t"))
    found = vocabulary.labelled(rows, F.col("t"), words, "agent", "word", plain=True)
    return found.select("conv_id", "turn", vocabulary.route(F.col("found"), "research").alias("agent"))


@query("""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM conversations) GROUP BY w ORDER BY n DESC, w LIMIT 5000)
SELECT doc_id, 'n' || length(w) AS label, count(*)::INT AS n FROM documents JOIN w ON contains(lower(text), w) GROUP BY doc_id, label""")
def q14d_common_words(spark, d):
    """How many of the 5,000 commonest words of the conversations each document holds, by length."""
    words = table(spark, d, "conversations", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    words = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(5000).select(F.concat(F.lit("n"), F.length("w").cast("string")).alias("label"), "w")
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("t"))
    found = vocabulary.labelled(docs, F.col("t"), words, "label", "w", plain=True)
    return found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.label", "x.n")


@query("""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS a FROM benchmark),
c AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS b FROM documents),
m AS (SELECT doc_id, item_id, len(list_intersect(a, b)) / len(a) AS ratio FROM c, w WHERE len(a) > 0)
SELECT doc_id, coalesce(arg_min(item_id, [-ratio, item_id]) FILTER (WHERE ratio >= 0.34), -1) AS item_id, coalesce(max(ratio) FILTER (WHERE ratio >= 0.34), 0) AS ratio,
  count(*) FILTER (WHERE ratio >= 0.34) + (SELECT count(*) FROM w WHERE len(a) = 0) AS n_match
FROM m GROUP BY doc_id""")
def q08_title_overlap(spark, d):
    """The title of `benchmark` that each document holds most of, and how many it holds."""
    docs, titles = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")
    found = matching.best_titles(docs, titles, "doc_id", "text", "item_id", "text")
    return found.select("doc_id", F.coalesce("best", F.lit(-1)).alias("item_id"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"), "n_match")


@query("""WITH p AS (SELECT DISTINCT left(url, n::INT) AS prefix FROM pages, (VALUES (9), (12), (14), (15), (17), (20), (24), (28)) v(n) WHERE length(url) >= n),
r AS (SELECT prefix, 'r' || length(prefix) || right(prefix, 3) AS reason, row_number() OVER (ORDER BY md5(prefix)) AS ord FROM p QUALIFY ord <= 1000)
SELECT page_id, coalesce(arg_min(reason, ord), 'paywall') AS reason FROM pages LEFT JOIN r ON starts_with(url, prefix) GROUP BY page_id""")
def q10b_prefix_rules(spark, d):
    """Reasons by a table of 1,000 prefixes that nest; the rule that comes first counts."""
    pages = table(spark, d, "pages", "page_id", "url")
    cut = F.filter(F.array(*map(F.lit, (9, 12, 14, 15, 17, 20, 24, 28))), lambda n: n <= F.length("url"))
    prefixes = pages.select(F.explode(F.transform(cut, lambda n: F.substring(F.col("url"), F.lit(1), n))).alias("prefix")).distinct()
    rules = prefixes.select("prefix", F.md5(F.col("prefix").cast("binary")).alias("ord"), F.concat(F.lit("r"), F.length("prefix").cast("string"), F.right("prefix", F.lit(3))).alias("reason"))
    rules = rules.orderBy("ord").limit(1000)
    return matching.first_rule_of(pages, "page_id", F.col("url"), rules, "prefix", "ord", "reason", "paywall", "reason").select("page_id", "reason")
