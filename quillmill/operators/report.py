"""Checks of Markdown reports, many at once: one row per document and check.

Statuses are ok, FALLO (fails) and aviso (warns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import overlap_ratio
from quillmill.operators.markdown import SEPARATOR

#: Patterns of the report format.
REFERENCES = "## Referencias"
CITED = r"\[(\d+(?:\s*,\s*\d+)*)\]"
DIAGRAM = r"(?U)\A\s*(flowchart|graph|sequenceDiagram|classDiagram|stateDiagram)"
SECTIONS = 8


def without_code(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "")


def references(text: Column) -> Column:
    """The list of references: from its heading to the next one."""
    rest = F.get(F.split(text, REFERENCES, 2), F.lit(1))
    return F.when(F.contains(text, F.lit(REFERENCES)), F.split(rest, r"(?md)^## ", 2)[0]).otherwise("")


def body(text: Column) -> Column:
    """All but the list of references; what follows it belongs to the body."""
    parts = F.split(text, REFERENCES, 2)
    after = F.split(F.get(parts, F.lit(1)), r"(?md)^## ", 2)
    return F.when(F.contains(text, F.lit(REFERENCES)), F.concat(parts[0], F.when(F.size(after) > 1, F.concat(F.lit("## "), F.get(after, F.lit(1)))).otherwise(""))).otherwise(text)


def cited_numbers(text: Column) -> Column:
    groups = F.regexp_extract_all(body(text), F.lit(CITED), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).try_cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def reference_count(text: Column) -> Column:
    """The largest number in the list, not how many there are."""
    n = F.transform(F.regexp_extract_all(references(text), F.lit(r"(?md)^(\d+)\.\s"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.coalesce(F.array_max(n), F.lit(0))


def _row(name: str, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.alias("status"), detail.cast("string").alias("detail"))


def checks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, check, status and detail: sections, headings, formulas, tables, diagrams,
    citations and years. All are expressions over one scan of the text."""
    t = F.col(text_col)
    plain = without_code(t)
    rows = docs.select(
        id_col, t.alias("__t"),
        F.transform(F.regexp_extract_all(t, F.lit(r"(?md)^## (\d)\.\s+(.+)$"), F.lit(1)), lambda x: x.cast("int")).alias("sections"),
        F.regexp_count(plain, F.lit(r"(?md)^#{4,}\s")).alias("deep"),
        F.regexp_count(plain, F.lit(r"(?s)\$\$.+?\$\$")).alias("formulas"),
        F.split(plain, "\n").alias("lines"),
        F.regexp_extract_all(t, F.lit(r"(?s)```mermaid\n(.*?)```"), F.lit(1)).alias("diagrams"),
        cited_numbers(t).alias("cited"), reference_count(t).alias("n_refs"),
        F.transform(F.regexp_extract_all(references(t), F.lit(r"\.\s(19\d{2}|20\d{2})\."), F.lit(1)), lambda x: x.cast("int")).alias("years"),
    )
    pipes = lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    pairs = F.arrays_zip(F.slice("lines", F.lit(1), F.size("lines") - 1).alias("a"), F.slice("lines", F.lit(2), F.size("lines") - 1).alias("b"))
    skewed = F.size(F.filter(pairs, lambda p: p["b"].rlike(SEPARATOR) & F.ltrim(p["a"]).startswith("|") & (pipes(p["a"]) != pipes(p["b"]))))
    bad_label = lambda b: F.exists(F.regexp_extract_all(b, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda x: ~x.startswith('"') & x.rlike(r"[(),:]"))
    bad = F.size(F.filter("diagrams", lambda b: ~b.rlike(DIAGRAM) | F.contains(b, F.lit("<br>")) | F.contains(b, F.lit("<BR>")) | bad_label(b)))
    fails = lambda c: F.when(c, "FALLO").otherwise("ok")
    orphan = F.filter("cited", lambda n: n > F.col("n_refs"))
    unused = F.array_except(F.when(F.col("n_refs") > 0, F.sequence(F.lit(1), F.greatest(F.col("n_refs"), F.lit(1)))).otherwise(F.array().cast("array<int>")), F.col("cited"))
    old = F.filter("years", lambda y: y < 2000)
    show = lambda a: F.array_join(a.cast("array<string>"), ",")
    found = [
        _row("sections", fails(F.col("sections") != F.array(*[F.lit(k) for k in range(1, SECTIONS + 1)])), show(F.col("sections"))),
        *[_row(f"section {name}", fails(~F.col("__t").rlike(rf"(?m)^## {name}")), F.lit("")) for name in ("Referencias", "Qué quedó fuera")],
        _row("headings", fails(F.col("deep") > 0), F.col("deep")),
        _row("formulas", fails(F.col("formulas") > 0), F.col("formulas")),
        _row("tables", fails(skewed > 0), skewed),
        _row("diagrams", fails((F.size("diagrams") < 2) | (bad > 0)), F.when(F.size("diagrams") < 2, F.size("diagrams")).otherwise(bad)),
        _row("citations", fails(F.size(orphan) > 0), show(orphan)),
        _row("references", F.when(F.size(unused) > 0, "aviso").otherwise("ok"), show(unused)),
        _row("years", fails(F.size(old) > 0), F.when(F.size(old) > 0, show(old)).otherwise(F.concat_ws("-", F.array_min("years").cast("string"), F.array_max("years").cast("string")))),
    ]
    return rows.select(id_col, F.explode(F.array(*found)).alias("c")).select(id_col, "c.check", "c.status", "c.detail")


def tally(found: DataFrame, id_col: str) -> DataFrame:
    return found.groupBy(id_col).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "aviso").alias("n_warn"), F.count_if(F.col("status") == "FALLO").alias("n_fail"),
        F.max(F.when(F.col("status") == "FALLO", 1).otherwise(0)).alias("exit_status"),
    )


def cited_titles(docs: DataFrame, registry: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pmid and verdict of each reference with a PMID: absent from the registry,
    mismatch (under 34 % of the registry title's words are cited) or ok.

    registry: pmid, title, error; one row a pmid."""
    entry = r"(?mds)^\d+\.\s+(.*?)PMID:\s*(\d+)"
    block = references(F.col(text_col))
    pairs = F.arrays_zip(F.regexp_extract_all(block, F.lit(entry), F.lit(1)).alias("cite"), F.regexp_extract_all(block, F.lit(entry), F.lit(2)).alias("pmid"))
    rows = docs.select(id_col, F.explode(pairs).alias("x")).select(id_col, F.col("x.cite").alias("cite"), F.col("x.pmid").alias("pmid"))
    known = registry.where(F.col("error").isNull() & (F.coalesce("title", F.lit("")) != "")).select("pmid", "title")
    ratio = overlap_ratio(F.col("title"), F.col("cite"))
    return rows.join(known, "pmid", "left").select(id_col, "pmid", F.when(F.col("title").isNull(), "absent").when(ratio < 0.34, "mismatch").otherwise("ok").alias("verdict"))


def image_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\((https?://[^)\s]+)"), F.lit(1))


def section(text: Column, number: int) -> Column:
    """(start, end) line numbers of section `number` (from 0, the end exclusive), without
    blank lines and rules at its end; null without such a section. Positions in arrays of
    one row: no line leaves it."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith(f"## {number}.")), True).cast("int")
    rest = F.slice(lines, F.greatest(at, F.lit(0)) + 1, F.size(lines))
    other = F.array_position(F.transform(rest, lambda x: x.startswith("## ")), True).cast("int")
    own = F.when(other > 0, F.slice(rest, F.lit(1), F.greatest(other - 1, F.lit(0)))).otherwise(rest)
    blank = F.array_position(F.reverse(F.transform(own, lambda x: ~F.trim(x).isin("", "---"))), True).cast("int")
    solid = F.when(blank > 0, F.size(own) - blank + 1).otherwise(0)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at + solid).alias("end")))


def section_lines(docs: DataFrame, id_col: str, text_col: str, number: int) -> DataFrame:
    """id, start and end of section `number` of the texts that have it."""
    return docs.select(id_col, section(F.col(text_col), number).alias("s")).where("s IS NOT NULL").select(id_col, "s.start", "s.end")


def metadata(text: Column) -> dict[str, Column]:
    """version, mode and protected sections of the fenced block that speaks of self_modification."""
    block = F.regexp_extract(text, r"(?s)```yaml\n((?:(?!```).)*?self_modification.*?)\n```", 1)
    pick = lambda p, other: F.coalesce(F.nullif(F.regexp_extract(block, p, 1), F.lit("")), F.lit(other))
    listed = F.regexp_extract(block, r"protected_sections:\s*\[([^\]]*)\]", 1)
    return {"version": pick(r"version:\s*([\d.]+)", "0.0.0"), "mode": pick(r"self_modification:\s*(\w+)", "gated"), "protected": F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))}
