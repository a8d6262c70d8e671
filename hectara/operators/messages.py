"""Rules over chat messages. Word lists are fixed and small, so they become Column expressions; nothing is joined."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hectara.functions import constants as C
from hectara.functions import texts as T
from hectara.functions.labels import contains_any


def user_turns(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "user").withColumn("c", F.lower("text"))


def numeric_wishes(messages: DataFrame) -> DataFrame:
    n = user_turns(messages).select("conv_id", "turn", T.budget(F.col("c")).alias("budget"), T.plot_size(F.col("c")).alias("size_m2"))
    return n.select("*", F.floor(F.col("size_m2") * 0.8).cast("int").alias("size_min"), F.floor(F.col("size_m2") * 1.2).cast("int").alias("size_max"))


def keyword_wishes(messages: DataFrame) -> DataFrame:
    """Per conversation the largest weight of each dimension and the distinct hints."""
    m = user_turns(messages)
    dims = sorted({d for _, d, _ in C.PREFERENCE_WORDS})
    found = F.concat(
        F.array(*[F.struct(F.lit("weight").alias("kind"), F.lit(d).alias("name"), T.preference(F.col("c"), d).alias("value")) for d in dims]),
        F.transform(T.hints(F.col("c")), lambda h: F.struct(F.lit("hint").alias("kind"), h.alias("name"), F.lit(None).cast("double").alias("value"))),
    )
    long = m.select("conv_id", F.inline(found)).filter((F.col("kind") == "hint") | F.col("value").isNotNull())
    return long.groupBy("conv_id", "kind", "name").agg(F.max("value").alias("value"))


def session_facts(messages: DataFrame) -> DataFrame:
    return user_turns(messages).select("conv_id", F.inline(T.rule_facts(F.col("c")))).distinct()


def parsed_feedback(messages: DataFrame) -> DataFrame:
    c = F.col("c")
    return user_turns(messages).select(
        "conv_id", "turn", T.feedback_choice(c).alias("choice"), F.array_join(T.liked_features(c), "|").alias("liked"),
        F.array_join(T.listed(c, C.REQUIREMENT_WORDS), "|").alias("wanted"), F.array_join(T.listed(c, C.DISLIKED_WORDS), "|").alias("disliked"),
    )


def style_tags(messages: DataFrame) -> DataFrame:
    """Latest length preference and every focus a user has shown."""
    m = user_turns(messages)
    length = F.when(F.length("text") < 20, "short").when(F.length("text") > 200, "long")
    tagged = m.select("conv_id", "turn", length.alias("len"), *[contains_any(F.col("c"), words).alias(n) for n, words in C.STYLE_WORDS.items()])
    latest = F.max_by("len", F.when(F.col("len").isNotNull(), F.col("turn")))
    return tagged.groupBy("conv_id").agg(latest.alias("response_length"), *[F.bool_or(n).alias(n) for n in C.STYLE_WORDS])


def adjusted_criteria(searches: DataFrame, wording: Column) -> DataFrame:
    """Criteria after a spoken adjustment. Lists are pipe-joined."""
    df = searches.withColumn("c", F.lower(wording))
    c = F.col("c")

    def says(*words: str) -> Column:
        return contains_any(c, list(words))

    low, high = F.coalesce("min_area", F.lit(0)).cast("double"), F.coalesce("max_area", F.lit(10000)).cast("double")
    bigger, smaller, calm, green = says("większ", "duż"), says("mniejsz", "mał"), says("cich", "spok"), says("natur", "las", "zielen")
    a = F.when(bigger, low * 1.5).otherwise(F.col("min_area").cast("double"))
    b = F.when(bigger & (low * 1.5 >= high), low * 1.5 * 1.5).otherwise(F.col("max_area").cast("double"))
    a = F.when(smaller & (low >= high * 0.7), high * 0.7 * 0.5).otherwise(a)
    b = F.when(smaller, high * 0.7).otherwise(b)
    df = df.withColumn("a", a).withColumn("b", b)
    crossed = F.coalesce("a", F.lit(0.0)) > F.coalesce("b", F.lit(10000.0))
    industrial = F.coalesce(F.when(F.col("industrial_m") != 0, F.col("industrial_m")), F.lit(500)) + 500
    return df.select(
        "search_id",
        F.round(F.when(crossed, F.col("b")).otherwise(F.col("a")), 3).alias("min_area"),
        F.round(F.when(crossed, F.col("a")).otherwise(F.col("b")), 3).alias("max_area"),
        F.when(calm, "bardzo_cicha|cicha").otherwise(F.col("quiet_cats")).alias("quiet_cats"),
        F.when(calm, "rzadka|bardzo_rzadka").otherwise(F.col("density_cats")).alias("density_cats"),
        F.when(green, "bardzo_zielona|zielona").otherwise(F.col("nature_cats")).alias("nature_cats"),
        F.when(green & (F.coalesce("forest_m", F.lit(0)) == 0), 500).otherwise(F.col("forest_m")).alias("forest_m"),
        F.when(says("dojazd", "sklep", "szkol"), "doskonala|dobra").otherwise(F.col("access_cats")).alias("access_cats"),
        F.when(says("przemysł", "fabryk", "hałas"), industrial).otherwise(F.col("industrial_m")).alias("industrial_m"),
        says("mpzp", "plan").alias("has_pog"),
    )
