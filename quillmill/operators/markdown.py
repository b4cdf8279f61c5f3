"""Markdown to the dialect of a block editor, as Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import interleave, strip

#: Fixed value: the row between a table's head and its body.
SEPARATOR = r"^\s*\|[\s:|-]+\|\s*$"
#: Fixed value, what escaping leaves alone: code blocks, tables, links and images, inline code.
SHIELDED = r"(?s)```.*?```|<table.*?</table>|!?\[[^\]]*\]\([^)]*\)|`[^`\n]+`"


def title(text: Column) -> Column:
    """The first heading of level one, wherever it is."""
    return strip(F.regexp_extract(text, r"(?md)^#\s+(.+)$", 1))


def without_title(text: Column) -> Column:
    """Only a heading at the very start goes."""
    return F.regexp_replace(text, r"(?d)\A#\s+.+\n+", "")


def cells(row: Column) -> Column:
    """Cells of a table row; an escaped pipe is text."""
    inner = F.regexp_replace(F.regexp_replace(strip(row), r"\A\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), strip)


def _with_before(items: Column) -> Column:
    """(x, before) for each item: every part of it is made once, not once an item."""
    shifted = F.slice(F.concat(F.array(F.lit("")), items), F.lit(1), F.size(items))
    return F.arrays_zip(items.alias("x"), shifted.alias("before"))


def join_quotes(text: Column) -> Column:
    """Neighbouring lines that start with '>' become one, joined by <br>; empty ones go."""
    inner = lambda line: strip(F.substring(line, 2, 1 << 30))
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.startswith(">") | (inner(x) != ""))

    def piece(p: Column) -> Column:
        line = F.when(p["before"].startswith(">"), F.concat(F.lit("<br>"), inner(p["x"]))).otherwise(F.concat(F.lit("\n> "), inner(p["x"])))
        return F.when(p["x"].startswith(">"), line).otherwise(F.concat(F.lit("\n"), p["x"]))

    return F.substring(F.array_join(F.transform(_with_before(lines), piece), ""), 2, 1 << 30)


def diagrams(text: Column) -> Column:
    r"""In diagrams, a written \n becomes <br>. Pieces at fences alternate: text, block."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```mermaid\n(.*?)```"), F.lit(0))
    between = F.split(text, r"(?s)```mermaid\n.*?```", -1)
    fixed = F.transform(blocks, lambda b: F.replace(b, F.lit("\\n"), F.lit("<br>")))
    return interleave(between, fixed)


def escape_citations(text: Column) -> Column:
    """Brackets of citations are escaped, but not in what is shielded."""
    shielded = F.regexp_extract_all(text, F.lit(SHIELDED), F.lit(0))
    between = F.transform(F.split(text, SHIELDED, -1), lambda x: F.regexp_replace(x, r"\[(\d+(?:\s*,\s*\d+)*)\]", r"\\[$1\\]"))
    return interleave(between, shielded)


def _once(value: Column, then) -> Column:
    """then(value), in which the value is made once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def _runs(text: Column, kind) -> Column:
    """Texts of neighbouring lines of one kind. Lines are joined with a mark after the line
    end, which no line holds, that says whether the kind changes."""
    kinds = lambda lines: F.transform(lines, lambda x: F.struct(x.alias("x"), kind(x).alias("kind")))
    mark = lambda y, k, of: F.when(y["kind"] == F.coalesce(F.get(of, k - 1)["kind"], F.lit(False)), "S").otherwise("C")
    marked = _once(kinds(F.split(text, "\n", -1)), lambda of: F.array_join(F.transform(of, lambda y, k: F.concat(mark(y, k, of), y["x"])), "\n"))
    return F.transform(F.split(F.substring(marked, 2, 1 << 30), "\nC", -1), lambda x: F.replace(x, F.lit("\nS"), F.lit("\n")))


def tables(text: Column) -> Column:
    """Pipe tables become XML tables; rows aren't padded. A table begins at the first line
    of a run of lines with pipes that a separator follows, and ends with the run."""

    def row(line: Column) -> Column:
        return F.concat(F.lit("\t<tr>\n"), F.array_join(F.transform(cells(line), lambda c: F.concat(F.lit("\t\t<td>"), F.replace(c, F.lit("\\|"), F.lit("|")), F.lit("</td>"))), "\n"), F.lit("\n\t</tr>"))

    def parts(lines: Column, first: Column, run: Column) -> Column:
        # fixed values: the tags of a table
        head = F.concat(F.lit('<table fit-page-width="true" header-row="true">\n'), row(F.get(lines, first - 1)))
        every = F.concat(F.slice(lines, F.lit(1), first - 1), F.array(head), F.transform(F.slice(lines, first + 2, F.size(lines)), row), F.array(F.lit("</table>")))
        return F.when(first > 0, F.array_join(every, "\n")).otherwise(run)

    def table(run: Column) -> Column:
        def of(lines: Column) -> Column:
            ahead = F.slice(lines, F.lit(2), F.size(lines))
            first = F.array_position(F.transform(ahead, lambda x: x.rlike(SEPARATOR)), True).cast("int")
            return _once(first, lambda k: parts(lines, k, run))

        return F.when(strip(run).startswith("|"), _once(F.split(run, "\n", -1), of)).otherwise(run)

    return F.array_join(F.transform(_runs(text, lambda x: strip(x).startswith("|")), table), "\n")


def convert(text: Column) -> Column:
    """Title, diagrams, quotes, escapes, tables, deep headings: in this order, for cells
    must be escaped before they are shielded as tables."""
    out = tables(escape_citations(join_quotes(diagrams(without_title(text)))))
    return F.concat(strip(F.regexp_replace(out, r"(?md)^#{5,}\s", "#### ")), F.lit("\n"))
