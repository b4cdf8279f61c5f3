"""Tags, routes and guards of messages and texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.operators.vocabulary import literal

#: Patterns of a tag; texts are lower-cased first, so upper-case ones never match.
TAXONOMY = {
    "Neuro_NM_Neuropatia": [r"neuropat\w+", r"neuropathy", r"neuropathies", r"polineuropat\w+", r"polyneuropathy", r"axonopat\w+", r"guillain[- ]barr\w+", r"charcot[- ]marie"],
    "Neuro_NM_Miopatia": [r"miopat\w+", r"myopath\w+", r"distrofia\s+muscular", r"dystrophy", r"miositis", r"myositis", r"rabdomiol\w+", r"rhabdomyolysis"],
    "Neuro_NM_Motoneurona": [r"motoneurona", r"motor\s+neuron", r"SLA", r"ALS", r"esclerosis\s+lateral\s+amiotr\w+", r"amyotrophic\s+lateral\s+sclerosis", r"AME", r"spinal\s+muscular\s+atrophy"],
    "Neuro_NM_UnionNM": [r"uni\w+\s+neuromuscular", r"neuromuscular\s+junction", r"NMJ", r"miastenia", r"myasthenia", r"eaton[- ]lambert", r"botulismo", r"botulism"],
    "Neuro_Cognitivo": [r"cognit\w+", r"alzheimer", r"demencia\w+", r"dementia", r"afasia\w+", r"aphasia", r"deterioro\s+cognit\w+"],
    "Tipo_Metaanalisis": [r"metaan\w+lisis", r"meta[- ]anal\w+", r"prisma\s+statement"],
    "Tipo_Revision": [r"revisi\w+\s+sistem\w+tica", r"systematic\s+review", r"narrative\s+review", r"overview", r"amstar"],
    "Tipo_Original": [r"original\s+article", r"art\w+culo\s+original", r"clinical\s+trial", r"ensayo\s+cl\w+nico", r"cohort\s+study", r"estudio\s+de\s+cohorte"],
    "Obj_Fisiopatologia": [r"fisiopatol\w+", r"pathophysiology", r"pathogenesis", r"patogenia", r"mecanismo\s+molecular", r"molecular\s+mechanism"],
    "Obj_Pronostico": [r"pron\w+stico", r"prognosis", r"prognostic", r"survival", r"supervivencia", r"mortalidad", r"outcomes", r"evoluci\w+n"],
    "Obj_Epidemiologia": [r"epidemiol\w+", r"incidence", r"incidencia", r"prevalence", r"prevalencia", r"burden\s+of\s+disease"],
    "Obj_Clinica": [r"manifestaciones\s+cl\w+nicas", r"clinical\s+features", r"case\s+report", r"caso\s+cl\w+nico", r"phenotype", r"fenotipo", r"presentation"],
    "Obj_Tratamiento": [r"tratamiento", r"treatment", r"therap\w+", r"terap\w+utica", r"efficacy", r"eficacia", r"safety", r"seguridad", r"f\w+rmaco"],
    "Obj_Diagnostico": [r"diagn\w+stico", r"diagnosis", r"diagnostic", r"criteria", r"sensitivity", r"sensibilidad", r"especificidad", r"specificity", r"biomarker", r"electrophysiology", r"EMG", r"electromiograf\w+"],
}
#: Words that speak for an agent, wherever they occur.
KEYWORDS = {
    "med": ["emg", "ncs", "ultrasonido", "nmus", "clínico", "diagnóstico", "paciente"],
    "research": ["revisión", "pubmed", "paper", "investiga", "bibliografía", "evidencia"],
    "biz": ["negocio", "directorio", "costo", "proyecto", "presupuesto", "plan"],
    "signals": ["señal", "hd-semg", "semg", "descomposición", "descompón", "cadwell", ".sd", "unidad motora"],
    "coach": ["entrenamiento", "nutrición", "dieta", "bmr", "recuperación"],
    "docs": ["documento", "presentación", "informe", "reporte", "deck", "slides", "redacta", "compón"],
    "home": ["domótica", "home assistant", "hogar", "luz", "luces", "enciende", "apaga", "switch", "sensor", "termostato", "clima", "automatización", "entidad", "escena"],
}
#: What blocks a call, and the tools that ask first.
DESTRUCTIVE = r"(rm\s+-rf|mkfs|dd\s+if=|:\(\)\s*\{|shutdown|reboot|>\s*/dev/sd)"
GATED = ["send_email", "post", "publish", "write_file", "delete", "vps_write", "git_push", "ha_call_service", "ha_lights_off"]


def tags(text: Column, taxonomy: dict[str, list[str]]) -> Column:
    """Sorted tags; a tag's patterns, joined, are tried only on texts that hold a literal
    part of one of them. The text is lower-cased once."""

    def may(low: Column, patterns: list[str]) -> Column:
        sure = [literal(p)[0] if "(?" not in p else "" for p in patterns]
        return reduce(or_, [F.contains(low, F.lit(x)) for x in sure]) if all(sure) else F.lit(True)

    def found(low: Column) -> Column:
        return F.array(*[F.when(may(low, patterns) & low.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(tag)) for tag, patterns in sorted(taxonomy.items())])

    return F.filter(F.transform(F.array(F.lower(text)), found)[0], lambda x: x.isNotNull())


def scores(message: Column, keywords: dict[str, list[str]]) -> list[Column]:
    """By agent, how many of its words the message holds, each counted once."""
    low = F.lower(message)
    return [sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int")) for words in keywords.values()]


def route(message: Column, keywords: dict[str, list[str]], other: str) -> Column:
    """The agent with the one highest score above zero, or `other`."""
    got = F.array(*scores(message, keywords))
    top = F.array_max(got)
    alone = F.size(F.filter(got, lambda x: x == top)) == 1
    names = F.array(*map(F.lit, keywords))
    return F.when((top > 0) & alone, F.get(names, (F.array_position(got, top) - 1).cast("int"))).otherwise(other)


def guard(tool: Column, args: Column, destructive: str = DESTRUCTIVE, gated: list[str] = GATED) -> Column:
    """The arguments are looked at before the name."""
    return F.when(args.rlike(destructive), "BLOQUEADO").when(tool.isin(gated), "GATE").otherwise("OK")


def allowed(answer: Column, values: list[str], other: str) -> Column:
    from quillmill.functions.text import strip

    low = F.lower(strip(answer))
    return F.when(low.isin(values), low).otherwise(other)
