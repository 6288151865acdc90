"""Queries of the operators of this subpackage over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspeak.functions.unicode_words import APOSTROPHES, HYPHENS
from loomspeak.llm import clusters, mixing, packing, sentences, term_frequency, text_quality, turns, vector_search
from loomspeak.llm.tokens import token_sizes
from loomspeak.runtime import first_delivery, stage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean turns of every transcript."""
    return turns.clean_turns(table(spark, sf_dir, "turns"), table(spark, sf_dir, "sessions"))


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined templates of the raw fields with their counts: the worth of a time's slots in seconds, the place of a label's slot."""
    people = turns.people_of(table(spark, sf_dir, "sessions"))
    rows = [
        (t["field"], " ".join(t["tokens"]), t["count"], len(t["shapes"]), list(t["slot"] or []) if t["field"] == "time" else None, t["slot"] if t["field"] == "speaker" else None)
        for t in turns.mined(table(spark, sf_dir, "turns"), people)
    ]
    return spark.createDataFrame(rows, "field string, template string, lines long, shapes long, slot_seconds array<int>, label_slot int")


def _long_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All deliveries of an answer have its text and moment, so the operator's dropping of repetitions is enough.
    return clusters.clustered(table(spark, sf_dir, "answers"), "answer_id", "moment", "cleaned_reflection")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answers of one moment that belong together."""
    return _long_answers(spark, sf_dir).select("cluster_key", F.col("id").alias("answer_id")).distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its moment, size and most typical answers."""
    return clusters.described(stage(_long_answers(spark, sf_dir), "members")).withColumnRenamed("key", "moment")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a cosine of at least 0.85 of which one is among the five nearest of the other."""
    vectors = table(spark, sf_dir, "answer_embeddings")
    return vector_search.pairs_found(vector_search.similar_vectors(vectors, "answer_id", "embedding"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every answer."""
    return vector_search.similar_vectors(table(spark, sf_dir, "answer_embeddings"), "answer_id", "embedding")


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the five nearest against brute force, for the rows divisible by 50 against all rows."""
    vectors = table(spark, sf_dir, "answer_embeddings")
    near = stage(vector_search.similar_vectors(vectors, "answer_id", "embedding"), "neighbours")
    return vector_search.recall(vectors, near, "answer_id", "embedding")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be of use."""
    return term_frequency.found(table(spark, sf_dir, "answers"))


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term."""
    answers = table(spark, sf_dir, "answers").select("answer_id", "loaded_at", "cleaned_reflection")
    once = first_delivery(answers, ["answer_id"], ["loaded_at"])
    return term_frequency.term_frequency(once, "cleaned_reflection").drop("term_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every answer."""
    return sentences.sentences(table(spark, sf_dir, "answers"), "answer_id", "loaded_at", "cleaned_reflection").withColumnRenamed("id", "answer_id")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents packed into the windows of every container."""
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows each container took, and how full they are."""
    containers = table(spark, sf_dir, "containers")
    return packing.report(stage(packing.packed(table(spark, sf_dir, "documents"), containers, "doc_id", "text"), "packed"), containers)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that each source has its target share, in the largest total that allows it."""
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text").withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that p7_mixture really reaches."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(stage(mixing.mixture(table(spark, sf_dir, "documents"), targets, "doc_id", "source", "text"), "drawn"), targets)


def p7_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached when as many tokens are drawn as the documents of all sources hold together."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    total = token_sizes(documents, "doc_id", "text").agg(F.sum("n_tokens")).first()[0]
    return mixing.shares(stage(mixing.mixture(documents, targets, "doc_id", "source", "text", total_tokens=total), "drawn"), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly not prose, with their kind."""
    kinds = text_quality.document_kinds(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kinds.where("kind <> 'prose'").select(kinds.id.alias("doc_id"), "kind")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics, component and kind of every document."""
    return text_quality.document_kinds(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_templates": p1_templates,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_recall": p3_recall,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p6_packed": p6_packed,
    "p6_report": p6_report,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_shares_full": p7_shares_full,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}
_CLEAN = (
    r"lower(nfc_normalize(translate(regexp_replace(cleaned_reflection, '[\p{Cf}\x{34f}\x{fe00}-\x{fe0f}]', '', 'g'), '" + APOSTROPHES + HYPHENS + "', '" + "''" * len(APOSTROPHES) + "-" * len(HYPHENS) + "')))"
)
_ONCE = "a AS (SELECT answer_id, any_value(moment) AS moment, any_value(cleaned_reflection) AS cleaned_reflection FROM answers GROUP BY answer_id)"
_TERMS = (
    rf"WITH {_ONCE}, r AS (SELECT answer_id, regexp_extract_all({_CLEAN}, '(\p{{Latin}}+(?:[''-]\p{{Latin}}+)*)') AS t FROM a WHERE cleaned_reflection IS NOT NULL AND trim(cleaned_reflection, ' ' || chr(9) || chr(10) || chr(160)) <> ''), "
    "n AS (SELECT count(*) AS n FROM r), x AS (SELECT answer_id, unnest(t) AS term FROM r), c AS (SELECT term, count(*) AS occurrences, count(DISTINCT answer_id) AS records FROM x GROUP BY term), "
    "m AS (SELECT term, occurrences, records, n AS n_records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * n THEN 'common' END AS mark FROM c, n) "
)
_VECTORS = (
    "v AS (SELECT answer_id AS id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM answer_embeddings WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY answer_id), "
    "p AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbour) AS r FROM p)"
)

SQL: dict[str, str] = {
    "p2_found": (
        rf"WITH RECURSIVE {_ONCE}, w AS (SELECT answer_id, moment, list_distinct(regexp_extract_all({_CLEAN}, '([\p{{L}}\p{{M}}\p{{N}}]+(?:[''-][\p{{L}}\p{{M}}\p{{N}}]+)*)')) AS w FROM a WHERE moment IS NOT NULL AND cleaned_reflection IS NOT NULL), "
        "l AS (SELECT * FROM w WHERE len(w) > 55), p AS (SELECT x.answer_id AS a, y.answer_id AS b, len(list_intersect(x.w, y.w)) AS shared, len(x.w) + len(y.w) AS total FROM l x JOIN l y ON x.moment = y.moment AND x.answer_id < y.answer_id), "
        "e AS MATERIALIZED (SELECT a, b FROM p WHERE shared >= 0.55 * (total - shared)), d AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (SELECT a, a AS b FROM d UNION SELECT r.a, d.b FROM reach r JOIN d ON r.b = d.a) "
        "SELECT min(b) AS cluster_key, a AS answer_id FROM reach GROUP BY a"
    ),
    "p3_found": f"WITH {_VECTORS} SELECT DISTINCT least(id, neighbour) AS answer_a, greatest(id, neighbour) AS answer_b FROM k WHERE r <= 5 AND c >= 0.85",
    "p5_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p5_terms": _TERMS + "SELECT term, occurrences, records, n_records, mark FROM m",
}
