"""Joins of texts with lists: titles whose words a text holds, and rules by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import tokens
from quillmill.sources.outputs import new_folder


def best_titles(docs: DataFrame, titles: DataFrame, key: str, text: str, title_key: str, title: str, least: float = 0.34) -> DataFrame:
    """For each row of `docs`: key, best (the title of which it holds the largest share of
    words of five letters or more, ties to the least title key), ratio, and n_match, how
    many titles it holds to `least`. Titles without such words match everything, and are
    never the best; best and ratio are null where no title with words matches.

    A title that is held shares one of its prefix: all its words but the `need` - 1 that
    most texts have. Only pairs that meet there are counted on, over the rest of the title's
    words, by equal (text, word): no pair is made that shares nothing rare, and no text's
    words are held in a row. Keys of both tables are unique."""
    spark = docs.sparkSession
    words = lambda c: tokens(F.col(c), 5, [])
    listed = titles.select(F.col(title_key).alias("t"), words(title).alias("w")).withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    some = listed.where("n > 0").withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9)).cast("int"))
    parts = some.select("t", "n", "need", F.explode("w").alias("word"))
    path = new_folder(spark)
    held = docs.select(F.col(key).alias("d"), F.explode(words(text)).alias("word")).join(parts.select("word").distinct(), "word", "left_semi")
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)

    often = held.groupBy("word").agg(F.count("*").alias("df"))
    ordered = parts.join(often, "word").withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy("df", "word")))
    # words that no text has were dropped: they are the rarest, and come before the others
    ordered = ordered.withColumn("gone", F.col("n") - F.count("*").over(Window.partitionBy("t")))
    rare = F.col("place") + F.col("gone") <= F.col("n") - F.col("need") + 1
    pairs = held.join(ordered.where(rare).select("t", "n", "word"), "word").groupBy("d", "t", "n").agg(F.count("*").alias("hits"))
    rest = pairs.select("d", "t").join(ordered.where(~rare).select("t", "word"), "t").join(held, ["d", "word"]).groupBy("d", "t").agg(F.count("*").alias("more"))
    counted = pairs.join(rest, ["d", "t"], "left").select("d", "t", ((F.col("hits") + F.coalesce("more", F.lit(0))) / F.col("n")).alias("ratio"))
    best = counted.where(F.col("ratio") >= least).groupBy("d").agg(F.count("*").alias("m"), F.max("ratio").alias("ratio"), F.min_by("t", F.struct(-F.col("ratio"), F.col("t"))).alias("best"))
    wordless = listed.agg(F.count_if(F.col("n") == 0).alias("z"))  # one row
    out = docs.select(F.col(key).alias("d")).join(best, "d", "left").crossJoin(F.broadcast(wordless))
    return out.select(F.col("d").alias(key), "best", "ratio", (F.coalesce("m", F.lit(0)) + F.col("z")).alias("n_match"))


def first_rule_of(rows: DataFrame, key: str, text: Column, rules: DataFrame, prefix: str, order: str, value: str, other: str, out: str) -> DataFrame:
    """Adds `out`: the value of the rule of least `order` whose prefix the text begins with,
    or `other`. Keys of `rows` are unique and not null.

    Prefixes are looked up by equality, a text being cut to each length that a rule has (a
    few numbers, whatever the number of rules), so that no text is held against all rules."""
    lengths = sorted(r[0] for r in rules.select(F.length(prefix)).where(F.col(prefix).isNotNull()).distinct().collect())
    if not lengths:
        return rows.withColumn(out, F.lit(other))
    tried = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text))
    probes = rows.select(F.col(key).alias("__k"), F.explode(F.transform(tried, lambda n: F.substring(text, F.lit(1), n))).alias("__p"))
    least = rules.groupBy(F.col(prefix).alias("__p")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("__r"))
    first = probes.join(least, "__p").groupBy("__k").agg(F.min("__r").alias("__r"))
    return rows.join(first, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce(F.col("__r.v"), F.lit(other))).drop("__k", "__r")
