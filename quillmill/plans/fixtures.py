"""Small tables given in the text, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """(VALUES ...) AS names, for a FROM clause."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return repr(x)
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS {names}"


ROUTES = [(1, "revisa la evidencia en PubMed"), (2, "EMG del paciente, diagnóstico"), (3, "señal hd-semg y descomposición"), (4, "costo del proyecto"), (5, "dieta y entrenamiento"), (6, "redacta un informe"), (7, "enciende la luz"), (8, "hola"), (9, "paper y plan"), (10, "emg con semg")]
CALLS = [(1, "shell", '{"cmd":"rm -rf /"}'), (2, "send_email", '{"to":"a"}'), (3, "shell", '{"cmd":"ls -la"}'), (4, "git_push", '{"cmd":"shutdown now"}'), (5, "ha_lights_off", "{}"), (6, "read", '{"cmd":"echo x > /dev/sda"}')]
PRIVATE = [(1, "RUT 12.345.678-9 y correo ana.b@uno.example.org"), (2, "visto el 03/04/2021 en sala"), (3, "Nombre: Ana Soto\nedad 40"), (4, "RUT:\n 1.234.567-K fin"), (5, "sin datos"), (6, "rut: a\rb"), (7, "paciente : Núñez ñandú")]
TAGGED = [(1, "Metaanálisis de neuropatía"), (2, "SLA y EMG"), (3, "Unión neuromuscular, tratamiento"), (4, "cohort study of dementia outcomes"), (5, "nada")]
TAGS_EXPECTED = [(1, "Neuro_NM_Neuropatia,Tipo_Metaanalisis"), (2, ""), (3, "Neuro_NM_UnionNM,Obj_Tratamiento"), (4, "Neuro_Cognitivo,Obj_Pronostico,Tipo_Original"), (5, "")]
VERSIONS = [("1.2.3",), ("0.9.10",), ("10.0.0",)]
ENV = [(1, "A=1"), (2, ""), (3, "# B=2"), (4, "no equals"), (5, 'C="x y"'), (6, "D=a=b"), (7, " A = 9 "), (8, "E='q'")]
QUOTES = [(1, "> a\n> b\n>\ntext\n> c"), (2, "no quote"), (3, "x\n> only"), (4, ">one\n>two")]
QUOTES_EXPECTED = [(1, "> a<br>b\ntext\n> c"), (2, "no quote"), (3, "x\n> only"), (4, "> one<br>two")]
ESCAPES = [(1, "see [1, 2] and [x](u) `[3]`"), (2, "```\n[1]\n```\n[4]"), (3, "plain [2-4] [5]"), (4, "![i](p) [7]")]
ESCAPES_EXPECTED = [(1, "see \\[1, 2\\] and [x](u) `[3]`"), (2, "```\n[1]\n```\n\\[4\\]"), (3, "plain [2-4] \\[5\\]"), (4, "![i](p) \\[7\\]")]
TABLES = [(1, "a\n| h | k |\n|---|---|\n| 1 | x\\|y |\n| 2 |\nend"), (2, "| no | sep |\n| 1 | 2 |"), (3, "| h |\n|:-:|")]
_T = '<table fit-page-width="true" header-row="true">'
TABLES_EXPECTED = [
    (1, f"a\n{_T}\n\t<tr>\n\t\t<td>h</td>\n\t\t<td>k</td>\n\t</tr>\n\t<tr>\n\t\t<td>1</td>\n\t\t<td>x|y</td>\n\t</tr>\n\t<tr>\n\t\t<td>2</td>\n\t</tr>\n</table>\nend"),
    (2, "| no | sep |\n| 1 | 2 |"),
    (3, f"{_T}\n\t<tr>\n\t\t<td>h</td>\n\t</tr>\n</table>"),
]
CONVERSIONS = [(1, "# T\n\nintro [1]\n> q\n> r\n##### deep\n"), (2, "p\n# Later\n```mermaid\nflowchart\nA[x\\ny]\n```\n"), (3, "| a [2] |\n|---|\n| b |")]
CONVERSIONS_EXPECTED = [
    (1, "T", "intro \\[1\\]\n> q<br>r\n#### deep\n"),
    (2, "Later", "p\n# Later\n```mermaid\nflowchart\nA[x<br>y]\n```\n"),
    (3, "", f"{_T}\n\t<tr>\n\t\t<td>a \\[2\\]</td>\n\t</tr>\n\t<tr>\n\t\t<td>b</td>\n\t</tr>\n</table>\n"),
]
_GOOD = "".join(f"## {k}. Parte\nTexto [{k}]\n" for k in range(1, 9)) + "```mermaid\nflowchart\nA[\"x, y\"]\n```\n```mermaid\ngraph\nB[z]\n```\n## Referencias\n" + "".join(f"{k}. Uno. Título. Rev. 20{10 + k}. PMID: {100 + k}.\n" for k in range(1, 9)) + "## Qué quedó fuera\nnada [2]\n"
REPORTS = [(1, _GOOD), (2, "## 1. A\n#### hondo\n$$x$$\n| a | b |\n|---|\ncita [1, 4]\n## Referencias\n1. X. T. R. 1999. PMID: 5.\n2. Y.\n"), (3, "nada")]
_SECTIONS = ["section Referencias", "section Qué quedó fuera"]
REPORTS_EXPECTED = [
    (1, "sections", "ok", "1,2,3,4,5,6,7,8"), *[(1, s, "ok", "") for s in _SECTIONS], (1, "headings", "ok", "0"), (1, "formulas", "ok", "0"), (1, "tables", "ok", "0"), (1, "diagrams", "ok", "0"), (1, "citations", "ok", ""), (1, "references", "ok", ""), (1, "years", "ok", "2011-2018"),
    (2, "sections", "FALLO", "1"), (2, _SECTIONS[0], "ok", ""), (2, _SECTIONS[1], "FALLO", ""), (2, "headings", "FALLO", "1"), (2, "formulas", "FALLO", "1"), (2, "tables", "FALLO", "1"), (2, "diagrams", "FALLO", "0"), (2, "citations", "FALLO", "4"), (2, "references", "aviso", "2"), (2, "years", "FALLO", "1999"),
    (3, "sections", "FALLO", ""), *[(3, s, "FALLO", "") for s in _SECTIONS], (3, "headings", "ok", "0"), (3, "formulas", "ok", "0"), (3, "tables", "ok", "0"), (3, "diagrams", "FALLO", "0"), (3, "citations", "ok", ""), (3, "references", "ok", ""), (3, "years", "ok", ""),
]
POLICY = [("a", "x\n```yaml\nversion: 1.4.2\nself_modification: open\nprotected_sections: [1, 3, 7]\n```\n"), ("b", "```yaml\nself_modification: gated\nk: v\n```"), ("c", "none")]
POLICY_EXPECTED = [("a", "1.4.2", "open", "1,3,7"), ("b", "0.0.0", "gated", ""), ("c", "0.0.0", "gated", "")]
SECTIONED = [(1, "## 1. A\nx\n\n---\n## 2. B\ny\nz\n\n"), (2, "intro\n## 2. only"), (3, "## 1. none")]
SECTIONED_EXPECTED = [(1, 4, 7), (2, 1, 2)]
RECORDS = [("1", "10.1/a", "", "Uno.", "Rev A", "2020", ["P Q", "R S"]), ("2", "", "PMC9", "Dos", "", "", ["A A", "B B", "C C", "D D", "E E", "F F", "G G"]), ("", "10.1016/c", "", "", "Rev C", "in press", [])]
SKILLS = [("one", "---\nname: Uno\ndescription: hace algo\n---\n"), ("two", "description:\nx"), ("three", "name: \ntext")]
SWITCHES = [("switch.cocina", "Cocina", "on"), ("switch.enchufe_tv", "TV", "on"), ("light.x", "X", "on"), ("switch.a", "Backlight A", "off"), ("switch.exterior", "Exterior", "on"), ("switch.pasillo", None, "off")]
NAMES = [("García López", "2020", "1"), ("Øster", "2019", "2"), ("Núñez", "", "3"), ("", "2001", "4")]
NAMES_EXPECTED = [("1", "garcia_2020_1.pdf"), ("2", "ster_2019_2.pdf"), ("3", "nunez__3.pdf"), ("4", "anon_2001_4.pdf")]
ARTICLES = """<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><ISOAbbreviation>J A</ISOAbbreviation><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Uno</ArticleTitle><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText Label="END">y</AbstractText></Abstract><AuthorList><Author><LastName>Paz</LastName><Initials>A</Initials></Author><Author><CollectiveName>Grupo</CollectiveName></Author><Author><Initials>Z</Initials></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC3</ArticleId></ArticleIdList></PubmedData></PubmedArticle></Set>"""
