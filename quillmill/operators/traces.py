"""Session traces, learnings and documents made of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.selection import ranked


def daily(traces: DataFrame, time: str, tools: Column, cost: Column) -> DataFrame:
    """day, sessions, tool calls and cost, a missing cost being 0."""
    return traces.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("sessions"), F.sum(tools).alias("tools"), F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 6).alias("cost_usd"))


def recurrent(rows: DataFrame, keys: list[str], correction: Column, least: int = 3) -> DataFrame:
    """Groups that come up at least so often, or were corrected once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(correction).alias("corrected")).where((F.col("n") >= least) | F.col("corrected"))


def verdict(section: Column, protected: list[int]) -> Column:
    """Proposals for protected sections are rejected."""
    return F.when(section.isin(protected), "RECHAZADA_AUTOMATICA").otherwise("PENDIENTE")


def applicable(proposals: DataFrame, status: str) -> DataFrame:
    """Proposals that a bulk run applies: those that no rule has rejected."""
    return proposals.where(~F.contains(F.col(status), F.lit("RECHAZADA")))


def last_of(messages: DataFrame, key: str, seq: str, role: str, among: str, text: str) -> DataFrame:
    """The last text of a role in each conversation, '' without any."""
    return messages.groupBy(key).agg(F.coalesce(F.max_by(F.when(F.col(role) == among, F.col(text)), F.when(F.col(role) == among, F.col(seq))), F.lit("")).alias("last_text"))


def proposal_ids(rows: DataFrame, day: Column, order: str, coarse: list[Column] | None = None) -> DataFrame:
    """date_NN, numbered within the date. `coarse` is the beginning of the order in few
    values (see ranked()), so that a day is more than one task."""
    rows = ranked(rows.withColumn("day", F.date_format(day, "yyyy-MM-dd")), ["day"], coarse or [], [F.col(order)], "__number")
    return rows.withColumn("proposal_id", F.format_string("%s_%02d", F.col("day"), F.col("__number"))).drop("__number")


#: Slide titles of a deck.
_FIRST, _STUDY, _LAST, _FILLER = ["Contexto Clínico", "Objetivos"], ["Metodología", "Resultados"], ["Discusión", "Conclusiones", "Bibliografía"], "Análisis Secundario"


def deck(rows: DataFrame, key: str, title: Column, n_studies: Column, template: int = 0, least: int = 12) -> DataFrame:
    """key, slide (from 1) and title of each slide: cover, context, aims, two for each
    study, discussion, conclusions, bibliography, and fillers up to the least number."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    study = lambda k: F.array(*[F.concat(F.lit("Estudio "), k.cast("string"), F.lit(f": {part}")) for part in _STUDY])
    count = F.slice(F.sequence(F.lit(0), n_studies), F.lit(2), F.greatest(n_studies, F.lit(0)))
    named = F.concat(F.array(title), strings(_FIRST), F.flatten(F.transform(count, study)), strings(_LAST))
    filled = F.concat(named, F.array_repeat(F.lit(_FILLER), F.greatest(F.lit(0), F.lit(least - template) - F.size(named))))
    return rows.select(key, F.posexplode(filled).alias("place", "title")).select(key, (F.col("place") + 1).alias("slide"), "title")


def paragraphs(docs: DataFrame, id_col: str, text_col: str, cut: str = "\n\n") -> DataFrame:
    """id, place and paragraph, blank ones left out."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, cut, -1)).alias("place", "p"))
    return rows.select(id_col, "place", F.trim("p").alias("paragraph")).where(F.col("paragraph") != "")
