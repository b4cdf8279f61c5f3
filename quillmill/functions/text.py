"""Text functions as Column expressions.

Python-style patterns need flags in Java: (?U) for Unicode classes, (?d) so that '.' and
line ends know '\\n' only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted, in this order, and by what.
REDACTIONS = [
    (r"(?U)\b\d{1,2}\.\d{3}\.\d{3}-[\dkK]\b", "[RUT]"),
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    (r"(?U)\b\d{2}/\d{2}/\d{4}\b", "[FECHA]"),
    (r"(?idU)\b(nombre|paciente|rut)\s*:\s*.+", "$1: [REDACTADO]"),
]
#: Words of a topic that say nothing.
STOP = ["and", "or", "not", "the", "for", "with", "inhibitor", "inhibitors"]


#: White space, as Unicode has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.btrim(text, F.lit(SPACES))


def deidentify(text: Column) -> Column:
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def tokens(text: Column, least: int = 4, stop: list[str] | None = None) -> Column:
    """Distinct words of a-z of at least `least` letters, less the stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP if stop is None else stop)))


def relevance(topic: Column, title: Column, rest: Column) -> Column:
    """0: a topic word is in the title (or there is none); 1: in the first 600 characters
    of the rest; 2: in neither."""
    t = tokens(topic)
    return F.when(F.size(t) == 0, 0).when(F.arrays_overlap(t, tokens(title)), 0).when(F.arrays_overlap(t, tokens(rest)), 1).otherwise(2)


def overlap_ratio(real: Column, cited: Column) -> Column:
    """Share of the real title's words (five letters or more) that are cited; null without words."""
    a, b = tokens(real, 5, []), tokens(cited, 5, [])
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def interleave(between: Column, parts: Column) -> Column:
    """What lies between the parts of a text, and the parts, in turn."""
    longer = F.concat(parts, F.array(F.lit("")))  # there is one more between than there are parts
    return F.array_join(F.transform(F.arrays_zip(between.alias("a"), longer.alias("b")), lambda x: F.concat(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit("")))), "")


#: The entities that XML predefines.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_ENTITY = r"&(?:lt|gt|quot|apos|amp|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});"


def _character(entity: Column) -> Column:
    """What an entity stands for; a number that is no character stays as it is."""
    code = F.when(entity.startswith("&#x"), F.conv(F.regexp_extract(entity, "x([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(entity, "#([0-9]+)", 1)).try_cast("int")
    known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    out = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)
    for name, char in ENTITIES.items():
        out = F.when(entity == name, char).otherwise(out)
    return out


def _once(value: Column, use) -> Column:
    """use(value), the value being made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def decode_entities(text: Column) -> Column:
    """Predefined and numeric entities, each once: &amp;lt; becomes &lt;."""

    def decoded(x: Column) -> Column:
        found, named = F.regexp_extract_all(x, F.lit(_ENTITY), F.lit(0)), x
        for name, char in ENTITIES.items():  # the ampersand comes last, so nothing is decoded twice
            named = F.replace(named, F.lit(name), F.lit(char))
        return F.when(F.contains(x, F.lit("&#")), interleave(F.split(x, _ENTITY, -1), F.transform(found, _character))).otherwise(named)

    return _once(text, decoded)


def inner_text(markup: Column) -> Column:
    """Text of a node without its tags and comments, with entities decoded; what CDATA
    sections hold is text as it stands."""
    section = r"(?s)<!\[CDATA\[(.*?)\]\]>"
    outside = lambda x: decode_entities(F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]+>", ""))
    held = F.regexp_extract_all(markup, F.lit(section), F.lit(1))
    mixed = interleave(F.transform(F.split(markup, section, -1), outside), held)
    return strip(F.when(F.contains(markup, F.lit("<![CDATA[")), mixed).otherwise(outside(markup)))


def citation(authors: Column, title: Column, journal: Column, year: Column, doi: Column, pmid: Column) -> Column:
    """Up to six authors, title, journal and year, then the identifiers that there are."""
    names = F.array_join(F.slice(authors, 1, 6), ", ")
    signed = F.when(F.size(authors) > 6, F.concat(names, F.lit(", et al"))).otherwise(names)
    parts = F.filter(F.array(signed, F.rtrim(title, F.lit(".")), journal, year), lambda x: x != "")
    return F.concat(
        F.array_join(parts, ". "),
        F.when(doi != "", F.concat(F.lit(". doi:"), doi)).otherwise(""),
        F.when(pmid != "", F.concat(F.lit(". PMID: "), pmid)).otherwise(""),
        F.lit("."),
    )


def file_name(author: Column, year: Column, ident: Column) -> Column:
    """author_year_id.pdf, the first word of the author without accents; NFKD has no
    built-in function, so names are decomposed in Arrow batches."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def plain(names):
        return names.fillna("").str.lower().str.split().str[0].fillna("").str.normalize("NFKD").str.replace("[^a-z]", "", regex=True)

    surname = plain(author)
    return F.concat(F.when(surname == "", "anon").otherwise(surname), F.lit("_"), year, F.lit("_"), ident, F.lit(".pdf"))


def identifier_url(ident: Column) -> Column:
    return F.when(ident.startswith("10."), F.concat(F.lit("https://doi.org/"), ident)).otherwise(ident)


def proxied(url: Column, suffix: str) -> Column:
    """The URL with its host's dots as dashes and a suffix; all other parts stay."""
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)
    return F.when(host == "", url).otherwise(F.regexp_replace(url, r"^([a-z]+://)[^/?#]+", F.concat(F.lit("$1"), F.replace(host, F.lit("."), F.lit("-")), F.lit(suffix))))


def bump(version: Column, part: str = "patch") -> Column:
    n = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    two, three = (n[1] + 1, F.lit(0)) if part == "minor" else (n[1], n[2] + 1)
    return F.concat_ws(".", n[0].cast("string"), two.cast("string"), three.cast("string"))


def domain(entity: Column) -> Column:
    return F.when(F.contains(entity, F.lit(".")), F.substring_index(entity, ".", 1)).otherwise("otros")


def defenced(answer: Column) -> Column:
    """An answer without the fences around it."""
    return strip(F.regexp_replace(strip(answer), r"(?md)^```(?:json)?|```$", ""))
