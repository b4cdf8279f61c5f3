"""Stratified selection, access classes, orderings and lists of evidence records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.numbers import quota

#: Strata in order of priority, with their weights.
STRATA = [("guias", 0.20), ("revisiones_sistematicas", 0.22), ("revisiones", 0.20), ("ensayos", 0.18), ("originales", 0.20)]
FOCUS = ("enfoque_dirigido", 0.25)
#: Order of strata in lists of what is to be fetched; others come ninth.
PRIORITY = {"guias": 0, "enfoque_dirigido": 1, "revisiones_sistematicas": 2, "ensayos": 3, "revisiones": 4, "originales": 5}


def weights(strata: list[tuple[str, float]], focus: str | None = None) -> list[tuple[str, float]]:
    """With a focus, its stratum comes first and the others keep three quarters."""
    return [(focus, FOCUS[1]), *[(s, w * 0.75) for s, w in strata]] if focus else list(strata)


def greedy_select(rows: DataFrame, strata: list[tuple[str, Column, float]], n: int, order: list[Column], key: str) -> DataFrame:
    """Rows with their stratum: strata in turn take the best that none took before, out of
    three times their quota; what did not fit may be taken later.

    One scan tags rows with all their strata, and a limited rank keeps 3 * quota of each
    before they are shuffled. What is left is bounded by n, so that one array of it is
    folded, a stratum after another. `order` must order all rows."""
    quotas = [quota(n, w) for _, _, w in strata]
    tags = F.array_compact(F.array(*[F.when(among, F.lit(k)) for k, (_, among, _) in enumerate(strata)]))
    tagged = rows.withColumn("__s", F.explode(tags))
    best = tagged.withColumn("__rank", F.row_number().over(Window.partitionBy("__s").orderBy(*order))).where(F.col("__rank") <= 3 * max(quotas))
    limit = F.element_at(F.array(*[F.lit(3 * q) for q in quotas]), F.col("__s") + 1)
    best = best.where(F.col("__rank") <= limit).select(F.struct("__s", "__rank", F.struct(*rows.columns).alias("r")).alias("c"))
    found = best.agg(F.array_sort(F.collect_list("c")).alias("c"))  # 3 * quota rows a stratum

    def step(acc: Column, x: Column) -> Column:
        used = F.when(acc["cur"] == x["__s"], acc["used"]).otherwise(0)
        room = used < F.element_at(F.array(*map(F.lit, quotas)), x["__s"] + 1)
        take = room & ~F.exists(acc["taken"], lambda t: t["r"][key] == x["r"][key])
        return F.struct(F.when(take, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"), x["__s"].alias("cur"), (used + F.when(take, 1).otherwise(0)).alias("used"))

    start = F.struct(F.slice("c", 1, 0).alias("taken"), F.lit(-1).alias("cur"), F.lit(0).alias("used"))
    chosen = found.select(F.explode(F.aggregate("c", start, step, lambda acc: acc["taken"])).alias("x"))
    names = F.element_at(F.array(*[F.lit(s) for s, _, _ in strata]), F.col("x.__s") + 1)
    return chosen.select("x.r.*", names.alias("stratum"), F.col("x.__s").alias("stratum_ord"))


def ranked(rows: DataFrame, group: list[str], coarse: list[Column], order: list[Column], place: str = "place") -> DataFrame:
    """Adds the place of each row within its group, by `order`. `coarse` is the beginning
    of that order, ascending, in as many values as make groups small: rows are numbered
    within one of them and counted on from those before, so that a group isn't sorted in
    one task. Rows and their counts are shuffled by the same columns."""
    cols = [f"__c{k}" for k in range(len(coarse))]
    rows = rows.withColumns(dict(zip(cols, coarse)))
    counts = rows.groupBy(*group, *cols).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy(*cols)) - F.col("__n")
    counts = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*group, *cols])], before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(*group, *cols).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*group, *cols])], F.lit(True))
    out = rows.withColumn("__within", within).join(counts, same)
    return out.withColumn(place, (F.col("__before") + F.col("__within")).cast("long")).drop("__before", "__within", *cols, *[f"__k{i}" for i in range(len(group) + len(cols))])


def rank_of(name: Column, ranks: dict[str, int] | None = None, other: int = 9) -> Column:
    """The place of a name in a fixed order; others come last."""
    ranks = PRIORITY if ranks is None else ranks
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), name), F.lit(other))


def top_and_rest(rows: DataFrame, order: list[Column], n: int, key: str) -> DataFrame:
    """All rows with `top`: whether they are among the first n. `order` must order all."""
    first = rows.orderBy(*order).limit(n).select(F.col(key).alias("__k"))  # n rows
    return rows.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("top", F.col("__k").isNotNull()).drop("__k")


def paywalled(rows: DataFrame, access_col: str = "access", doi: str = "doi") -> DataFrame:
    """Records to be fetched by hand that have an identifier."""
    return rows.where((F.col(access_col) == "paywall") & (F.col(doi) != ""))


def search_summary(records: DataFrame, log: DataFrame, topic: str, year: str = "anio") -> DataFrame:
    """part, place and line of a search's summary: totals and years, tables of strata and
    access, the log of queries, and identifiers that are paywalled, in order.

    records: stratum, access, doi, seq and the year; log: ord, stratum, query, hits."""
    n = year_number(F.col(year))
    total = records.agg(F.count("*").alias("n"), F.min(n).alias("a"), F.max(n).alias("b"))
    years = F.when(F.col("a").isNull(), "s/d").otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    out = [total.select(F.lit("total").alias("part"), F.lit(1).cast("long").alias("place"), F.concat(F.lit(f"{topic}: "), F.col("n").cast("string"), F.lit(" · "), years).alias("line"))]
    for part in ("stratum", "access"):
        counts = counts_first_seen(records, part, "seq")
        out.append(counts.select(F.lit(part), F.col("place").cast("long"), row(F.col(part), F.col("n").cast("string"))))
    out.append(log.select(F.lit("log"), F.col("ord").cast("long"), row("stratum", F.col("hits").cast("string"), F.concat(F.lit("`"), "query", F.lit("`")))))
    out.append(paywalled(records).select(F.lit("paywalled"), F.col("seq").cast("long"), F.concat(F.lit("- "), "doi")))
    return reduce(DataFrame.union, out)


def year_number(year: Column) -> Column:
    return F.when(year.rlike(r"^[0-9]+$"), year.try_cast("int"))


def since(rows: DataFrame, year: str, least: int) -> DataFrame:
    """Years that aren't numbers stay."""
    n = year_number(F.col(year))
    return rows.where(n.isNull() | (n >= least))


def newest_first(year: str) -> Column:
    """Within a group, years that aren't numbers come last."""
    return F.coalesce(-year_number(F.col(year)), F.lit(0)).asc()


def access(rows: DataFrame, registry: DataFrame, key: str = "doi") -> DataFrame:
    """access, url_pdf and url_text: a central copy wins; else an open one in the registry
    (flag and place are needed); else it is paywalled.

    registry: key, is_oa, url_for_pdf, url_for_landing_page, url, license; one row a key."""
    reg = registry.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("is_oa", "url_for_pdf", "url_for_landing_page", "url", "license")])
    out = rows.join(reg, (F.col(key) == F.col("__k")) & (F.col(key) != "") & (F.col("pmcid") == ""), "left")
    central, resolver = F.col("pmcid") != "", F.when(F.col(key) != "", F.concat(F.lit("https://doi.org/"), F.col(key))).otherwise("")
    place = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), F.col("pmcid"), F.lit("/"))
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    open_ = F.coalesce(F.col("__is_oa"), F.lit(False)) & some("__url_for_pdf", "__url_for_landing_page", "__url").isNotNull()
    return out.withColumns({
        "access": F.when(central, "pmc").when(open_, "oa").otherwise("paywall"),
        "url_pdf": F.when(central, F.concat(place, F.lit("pdf/"))).when(open_, F.coalesce("__url_for_pdf", F.lit(""))).otherwise(""),
        "url_text": F.when(central, place).when(open_, F.coalesce(some("__url_for_landing_page", "__url"), resolver)).otherwise(resolver),
        "license": F.when(open_ & ~central, F.coalesce("__license", F.lit(""))).otherwise(""),
    }).drop("__k", *[f"__{c}" for c in ("is_oa", "url_for_pdf", "url_for_landing_page", "url", "license")])


def counts_first_seen(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key, n and place: by count, then by first appearance. A row per group is ordered."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("__first"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "__first"))).drop("__first")


def missing(rows: DataFrame, files: DataFrame, access_col: str, name: str) -> DataFrame:
    """Records without an open copy whose file isn't there."""
    return rows.where(~F.col(access_col).isin("pmc", "oa", "manual")).join(files.select(name).distinct(), name, "left_anti")


def first_rule(rows: DataFrame, text: str, rules: list[tuple[str, str]], other: str, out: str) -> DataFrame:
    """The value of the first rule, in their order, whose prefix the text has."""
    case = reduce(lambda c, r: c.when(F.col(text).startswith(r[0]), r[1]), rules[1:], F.when(F.col(text).startswith(rules[0][0]), rules[0][1]))
    return rows.withColumn(out, case.otherwise(other))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side: keys of either table that the other has not."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
