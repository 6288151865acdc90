"""Sentence tags by word lists, and what they make of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study
from loomspeak.functions import text as T
from loomspeak.functions.regex import any_of, java


def _markers(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(java(f"({pattern})", True)), 1), F.lower)


def tag(sentence: Column, study: Study = DEFAULT) -> Column:
    """Struct of tag, first_person, autobiographical, and the markers of experience, narrative and own life in their order.

    Experience: a judgement, the own life, or a word of experience said of oneself or of no one else.
    """
    own = _markers(sentence, study.autobiographical)
    experience, judged = _markers(sentence, any_of(study.experience)), _markers(sentence, any_of(study.evaluation))
    behind = "".join(rf"(?<!\b{w}\s)" for w in study.not_narrative_after)
    narrative = _markers(F.regexp_replace(sentence, java(study.autobiographical, True), " "), behind + any_of(study.narrative))
    first = sentence.rlike(java(study.first_person, True))
    felt = (F.size(judged) > 0) | (F.size(own) > 0) | ((F.size(experience) > 0) & (first | (F.size(narrative) == 0)))
    told = F.size(narrative) > 0
    kind = F.when(felt & told, "mixed").when(felt, "experiential").when(told, "narrative").otherwise("other")
    return F.struct(
        kind.alias("tag"), first.alias("first_person"), (F.size(own) > 0).alias("autobiographical"), F.concat(experience, judged).alias("experience_markers"),
        narrative.alias("narrative_markers"), own.alias("autobiographical_markers"),
    )


def tag_sentences(answers: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(answer_id, sentence_no, sentence, tag, …) of answers (answer_id, clean)."""
    cut = answers.select("answer_id", F.posexplode(T.split_sentences(F.col("clean"))).alias("at", "sentence"))
    return cut.withColumn("t", tag(F.col("sentence"), study)).select("answer_id", (F.col("at") + 1).alias("sentence_no"), "sentence", "t.*")


def tag_answers(sentences: DataFrame) -> DataFrame:
    """(answer_id, n_experiential, n_mixed, n_narrative, n_other, n_sentences, n_autobiographical, narrative_share, answer_type)."""
    kinds = ("experiential", "mixed", "narrative", "other")
    out = sentences.groupBy("answer_id").agg(
        *[F.count_if(F.col("tag") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_sentences"), F.count_if("autobiographical").alias("n_autobiographical")
    )
    felt, told = F.col("n_experiential") + F.col("n_mixed") > 0, F.col("n_narrative") + F.col("n_mixed") > 0
    return out.withColumn("narrative_share", F.bround(F.col("n_narrative") / F.col("n_sentences"), 3)).withColumn(
        "answer_type", F.when(felt & told, "mixed").when(felt, "experiential").when(told, "narrative").otherwise("other")
    )


def unmatched_words(texts: DataFrame, text_col: str, study: Study = DEFAULT, top: int = 30) -> DataFrame:
    """(word, n): the most frequent longer words of texts that no scene keyword covers; a report of `top` words."""
    known = [p for strong, weak in study.scenes.values() for p in (*strong, *weak)]
    rest = F.regexp_replace(F.col(text_col), java(any_of(known), True), " ")
    found = texts.select(F.explode(T.words(rest)).alias("word")).where((F.length("word") > 3) & ~F.col("word").isin(*study.stopwords))
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
