"""Two-objective parameter searches: front, distance to the ideal, generations."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspeak.config import TopicModel

PARAMETERS = ("n_components", "n_neighbors", "min_dist", "min_cluster_size", "min_samples")


def scored(trials: DataFrame) -> DataFrame:
    """Trials with both scores, each number once (its first row by scores and settings), with topics = n_topics - 1."""
    by = Window.partitionBy("trial_number").orderBy(F.desc("objective_cv"), F.desc("embedding_coherence"), *PARAMETERS)
    clean = trials.where("trial_number IS NOT NULL AND embedding_coherence IS NOT NULL AND objective_cv IS NOT NULL")
    return clean.withColumn("nth", F.row_number().over(by)).where("nth = 1").drop("nth").withColumn("topics", F.col("n_topics") - 1)


def on_front(trials: DataFrame) -> DataFrame:
    """Scored trials with on_front: no other trial is at least as good in both scores and better in one.

    Scores are first reduced to the best cv of each coherence; a running maximum over falling coherence then tells which of
    them is beaten. Many distinct coherences are ranged by a sort, in chunks whose own maxima are run over first.
    """
    best = trials.groupBy("embedding_coherence").agg(F.max("objective_cv").alias("best"))
    chunk = best.repartitionByRange("embedding_coherence").withColumn("chunk", F.spark_partition_id())
    from loomspeak.runtime import stage

    chunk = stage(chunk, "coherences")
    tops = chunk.groupBy("chunk").agg(F.max("best").alias("top"))  # one row a partition
    higher = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("above_chunk", F.max("top").over(higher)).drop("top")
    within = Window.partitionBy("chunk").orderBy(F.desc("embedding_coherence")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = chunk.withColumn("above", F.max("best").over(within)).join(F.broadcast(tops), "chunk")
    higher_cv = ranked.select("embedding_coherence", "best", F.greatest("above", "above_chunk").alias("above"))
    joined = trials.join(higher_cv, "embedding_coherence")
    beaten = (F.col("objective_cv") < F.col("best")) | F.coalesce(F.col("objective_cv") <= F.col("above"), F.lit(False))
    return joined.withColumn("on_front", ~beaten).drop("best", "above")


def pareto_front(trials: DataFrame, baseline: float | None = None) -> DataFrame:
    """The front, equal settings and scores once: (solution, trial_number, scores, above_baseline, topics, settings, distance, balanced).

    Sorted by cv, then trial number. distance is to the best of both scores, each by its range (a range of 0 is 1);
    balanced marks the nearest, if there are more than two.
    """
    front = on_front(scored(trials)).where("on_front")
    same = Window.partitionBy("objective_cv", "embedding_coherence", *PARAMETERS).orderBy("trial_number")
    once = front.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    ends = once.agg(*[f(c).alias(f"{n}_{c}") for c in ("objective_cv", "embedding_coherence") for n, f in (("hi", F.max), ("lo", F.min))], F.count("*").alias("n"))
    span = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise(F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    gap = lambda c: (F.col(f"hi_{c}") - F.col(c)) / span(c)
    placed = once.crossJoin(F.broadcast(ends)).withColumn("distance", F.sqrt(gap("objective_cv") ** 2 + gap("embedding_coherence") ** 2))  # one row
    by_cv = Window.orderBy(F.desc("objective_cv"), "trial_number")  # a front is a few rows
    nearest = Window.orderBy("distance", F.desc("objective_cv"), "trial_number")
    return placed.select(
        F.row_number().over(by_cv).alias("solution"), "trial_number", "objective_cv", "embedding_coherence",
        (F.col("embedding_coherence") > F.lit(baseline)).alias("above_baseline") if baseline is not None else F.lit(None).cast("boolean").alias("above_baseline"),
        "topics", *PARAMETERS, "distance", ((F.row_number().over(nearest) == 1) & (F.col("n") > 2)).alias("balanced"),
    )


def generations(trials: DataFrame, size: int = 50) -> DataFrame:
    """(generation, first_trial, last_trial, completed, best_cv, best_emb, median_topics, front_solutions) of runs of `size` trials."""
    return (
        on_front(scored(trials)).groupBy((F.floor(F.col("trial_number") / size) + 1).cast("int").alias("generation")).agg(
            F.min("trial_number").alias("first_trial"), F.max("trial_number").alias("last_trial"), F.count("*").alias("completed"), F.max("objective_cv").alias("best_cv"),
            F.max("embedding_coherence").alias("best_emb"), F.percentile("topics", F.lit(0.5)).alias("median_topics"), F.count_if("on_front").alias("front_solutions"),
        )
    )


def search_summary(trials: DataFrame, size: int = 50) -> DataFrame:
    """(started, completed, cv and coherence ranges, median_topics, last_front_share, improving): improving if the last generation holds more than 40 % of the front."""
    done = on_front(scored(trials))
    ends = done.agg(F.max(F.floor(F.col("trial_number") / size)).alias("last"))
    front = done.crossJoin(F.broadcast(ends))  # one row
    return front.agg(
        (F.max("trial_number") + 1).alias("started"), F.count("*").alias("completed"), F.min("objective_cv").alias("cv_min"), F.max("objective_cv").alias("cv_max"),
        F.min("embedding_coherence").alias("emb_min"), F.max("embedding_coherence").alias("emb_max"), F.percentile("topics", F.lit(0.5)).alias("median_topics"),
        (F.count_if(F.col("on_front") & (F.floor(F.col("trial_number") / size) == F.col("last"))) / F.nullif(F.count_if("on_front"), F.lit(0))).alias("last_front_share"),
    ).withColumn("improving", F.col("last_front_share") > 0.4)


def parameter_grid(spark: SparkSession, model: TopicModel = TopicModel()) -> DataFrame:
    """All settings of a model's ranges: a fixed, small table."""
    names = list(model.ranges)
    values = [range(int(lo), int(hi) + 1, int(step)) for lo, hi, step in model.ranges.values()]
    return spark.createDataFrame(list(itertools.product(*values)), ", ".join(f"{n} int" for n in names))


def topic_terms(docs: DataFrame, topic: str, text_col: str, model: TopicModel = TopicModel(), stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(topic, term, count, weight, place): class-based tf-idf of one and two word terms by topic.

    A term's weight is its share in the topic times log(1 + mean words of a topic / its count in all topics). A topic is one
    document here: terms in more than max_df of the topics or in fewer than min_df are left out.
    """
    from loomspeak.functions import text as T

    w = F.filter(T.words(F.col(text_col)), lambda x: ~x.isin(*stopwords) if stopwords else F.lit(True))
    lists = docs.where(F.col(text_col).isNotNull() & F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), w.alias("w"))
    grams = F.col("w")
    if model.ngrams[1] >= 2:
        pairs = F.transform(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(F.get("w", i), F.lit(" "), x))
        grams = F.concat("w", pairs)
    counts = lists.select("topic", F.explode(grams).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("count"))
    n_topics = lists.select("topic").distinct().agg(F.count("*").alias("n_topics"))
    overall = counts.groupBy("term").agg(F.sum("count").alias("total"), F.count("*").alias("df"))
    sizes = counts.groupBy("topic").agg(F.sum("count").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    kept = overall.crossJoin(F.broadcast(n_topics)).where((F.col("df") >= model.min_df) & (F.col("df") <= model.max_df * F.col("n_topics"))).select("term", "total")  # one row
    weighed = counts.join(kept, "term").join(sizes, "topic").crossJoin(F.broadcast(mean)).withColumn(  # one row
        "weight", F.col("count") / F.col("size") * F.log(1 + F.col("mean") / F.col("total"))
    )
    place = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 12)), "term")
    return weighed.withColumn("place", F.row_number().over(place)).where(F.col("place") <= model.top_words).select("topic", "term", "count", "weight", "place")
