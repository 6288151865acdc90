"""Queries of the transcript operators over the whole tables of a folder, with the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, TopicModel
from loomspeak.functions import text as T
from loomspeak.operators import answers as A
from loomspeak.operators import quality, scenes, search, segments, similarity, tagging
from loomspeak.runtime import first_delivery, stage, table
from loomspeak.sources import sinks, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Blanks of all scripts for RE2.
BLANKS = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: First deliveries of turns and answers in SQL.
TURNS = 'turns1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, turn_idx ORDER BY loaded_at) AS nth FROM turns) WHERE nth = 1)'
ANSWERS = "answers1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY loaded_at NULLS LAST, segment) AS nth FROM answers) WHERE nth = 1)"
N_WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"
WORDS = r"regexp_extract_all(lower(replace({}, '’', '''')), '([\p{{L}}\p{{Nl}}\p{{No}}]+(?:[''-][\p{{L}}\p{{Nl}}\p{{No}}]+)*)')"
SENTENCES = "list_filter(string_split(regexp_replace(cleaned_reflection, '([.!?…])[" + BLANKS + "]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '[" + BLANKS + "]+', '', 'g') <> '')"


def turns_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "turns"), ["file", "turn_idx"], ["loaded_at"])


def answers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_delivery(table(spark, sf_dir, "answers"), ["answer_id"], ["loaded_at", "segment"])


@query(
    f"WITH {TURNS}, w AS (SELECT file, speaker, count(*) AS turns, max(CASE WHEN coalesce(regexp_matches(speaker, '(?i)^sub-p\\d+$'), false) THEN 'participant' ELSE 'interviewer' END) AS role, "
    f"CAST(sum(coalesce({N_WORDS.format('text')}, 0)) AS BIGINT) AS words FROM turns1 GROUP BY file, speaker) "
    "SELECT file, speaker, role, turns, words, round_even(words / nullif(sum(words) OVER (PARTITION BY file), 0), 3) AS word_share FROM w"
)
def speaker_word_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, words and share of words by speaker label of every file."""
    return quality.speaker_shares(segments.with_roles(turns_once(spark, sf_dir)))


@query(
    f"WITH {TURNS}, t AS (SELECT file, turn_idx, start_s, end_s, coalesce(lag(start_s) OVER (PARTITION BY file ORDER BY turn_idx), -1) AS before FROM turns1) "
    "SELECT file, turn_idx, 'end_before_start' AS issue FROM t WHERE end_s < start_s UNION ALL SELECT file, turn_idx, 'start_before_previous' FROM t WHERE start_s < before"
)
def timestamp_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that end before they start, or start before the one before."""
    return quality.timestamp_issues(turns_once(spark, sf_dir))


@query(f"WITH {TURNS} SELECT file, turn_idx, loaded_at FROM turns1")
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delivery of every turn."""
    return turns_once(spark, sf_dir).select("file", "turn_idx", "loaded_at")


@query(
    "SELECT file, turn_idx, loaded_at, CASE WHEN regexp_matches(trim(start), '^\\d{1,2}:\\d{2}:\\d{2}$') THEN CAST(split_part(trim(start), ':', 1) AS INT) * 3600 + CAST(split_part(trim(start), ':', 2) AS INT) * 60 "
    "+ CAST(split_part(trim(start), ':', 3) AS INT) END AS seconds FROM turns"
)
def strict_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of times in standard form."""
    return table(spark, sf_dir, "turns").select("file", "turn_idx", "loaded_at", T.to_seconds(F.trim("start")).alias("seconds"))


@query(
    f"SELECT answer_id, segment, loaded_at, CAST({N_WORDS.format('cleaned_reflection')} AS INT) AS words, CAST(len(regexp_extract_all(cleaned_reflection, '[^{BLANKS}]+')) AS INT) AS tokens, "
    f"CAST(round_even({N_WORDS.format('cleaned_reflection')} * 1.4, 0) AS INT) AS approx_tokens FROM answers"
)
def word_count_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, blank-separated pieces and approximate tokens of every answer row."""
    c = F.col("cleaned_reflection")
    n = T.n_words(c)
    return table(spark, sf_dir, "answers").select("answer_id", "segment", "loaded_at", n.alias("words"), T.n_tokens(c).alias("tokens"), T.approximate_tokens(n).alias("approx_tokens"))


@query(
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\([^()\\[\\]]*\\)|\\[[^()\\[\\]]*\\]|\\([^()\\[\\]]{0,20}\\]|\\[[^()\\[\\]]{0,20}\\)')) AS INT) AS annotations FROM documents"
)
def annotation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed annotations of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.count(F.col("text"), T.ANNOTATION).alias("annotations"))


@query(f"WITH {ANSWERS} SELECT answer_id, CAST(i AS INT) AS sentence_no, s[i] AS sentence FROM (SELECT answer_id, {SENTENCES} AS s FROM answers1), unnest(generate_series(1, len(s))) AS u(i)")
def sentence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every answer by end marks and blanks."""
    cut = answers_once(spark, sf_dir).select("answer_id", F.posexplode(T.split_sentences(F.col("cleaned_reflection"))).alias("at", "sentence"))
    return cut.select("answer_id", (F.col("at") + 1).alias("sentence_no"), "sentence")


@query(
    f"WITH {ANSWERS}, s AS (SELECT len(regexp_extract_all(x, '[^{BLANKS}]+')) AS n FROM (SELECT unnest({SENTENCES}) AS x FROM answers1)) "
    "SELECT count(*) AS n, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS median, CAST(min(n) AS INT) AS min, round(quantile_cont(n, 0.05), 4) AS p5, round(quantile_cont(n, 0.95), 4) AS p95, CAST(max(n) AS INT) AS max FROM s"
)
def sentence_length_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and exact quantiles of the words of sentences."""
    return quality.describe(sentence_explode(spark, sf_dir).select(T.n_tokens(F.col("sentence")).alias("n")), "n")


@query(
    f"WITH {ANSWERS}, s AS (SELECT x, len(regexp_extract_all(x, '[^{BLANKS}]+')) AS n FROM (SELECT unnest({SENTENCES}) AS x FROM answers1)) "
    "SELECT count(*) AS n, count(*) FILTER (n < 3) AS below_min, count(*) FILTER (n < 5) AS below_5, count(*) FILTER (n > 60) AS long, count(*) FILTER (NOT regexp_matches(x, '[.!?…][\"''”’)]*$')) AS unpunctuated FROM s"
)
def sentence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are short, long or without end mark."""
    return quality.sentence_lengths(sentence_explode(spark, sf_dir))


_STOP = sorted((set(DEFAULT.stopwords) - {"won"}) | {"won't"})
_FILL = sorted({"actually", "basically", "well", "okay", "ok", "yeah", "like"} | (set(DEFAULT.backchannels) - {"i", "see", "good"}))
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_CONTENT = f"length(w) >= 3 AND w NOT IN {_IN(sorted({*_STOP, *_FILL}))} AND NOT regexp_matches(w, '^(?:{'|'.join(DEFAULT.hesitations)})$') AND split_part(w, '''', 1) NOT IN {_IN(_STOP)}"


@query(
    f"WITH {ANSWERS}, w AS (SELECT participant_id, moment, unnest({WORDS.format('cleaned_reflection')}) AS w FROM answers1), n AS (SELECT count(DISTINCT participant_id) AS n FROM answers1) "
    f"SELECT w AS word, count(*) AS count_all, count(*) FILTER (moment = 1) AS count_m1, count(*) FILTER (moment = 2) AS count_m2, count(*) FILTER (moment = 3) AS count_m3, count(DISTINCT participant_id) AS n_participants, "
    f"round_even(count(DISTINCT participant_id) / (SELECT n FROM n), 2) AS participant_share FROM w WHERE {_CONTENT} GROUP BY w"
)
def content_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words by moment, and how many participants use them."""
    return quality.content_words(answers_once(spark, sf_dir), "cleaned_reflection")


@query(
    f"WITH {ANSWERS}, w AS (SELECT unnest({WORDS.format('cleaned_reflection')}) AS w FROM answers1) SELECT w AS word, count(*) AS n FROM w WHERE {_CONTENT} GROUP BY w ORDER BY n DESC, w LIMIT {DEFAULT.top_n}"
)
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent content words, a report of top_n rows; ties by word."""
    found = answers_once(spark, sf_dir).select(F.explode(T.words(F.col("cleaned_reflection"))).alias("word")).where(T.is_content_word(F.col("word")))
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(DEFAULT.top_n)


_REAL = "regexp_replace(cleaned_reflection, '(?i)\\b(?:" + "|".join(DEFAULT.not_filler[:-1]) + ")\\b|\\bwell-', ' ', 'g')"
_FILLERS = {k: (f"len(regexp_extract_all({_REAL}, '(?i)\\b(?:" + "|".join(v).replace("'", "''") + ")\\b'))") for k, v in DEFAULT.fillers.items()}
_SUMS = ", ".join(f'CAST(sum({v}) AS BIGINT) AS "{k}"' for k, v in _FILLERS.items())


@query(
    f"WITH {ANSWERS} SELECT participant_id, moment, CAST(sum({N_WORDS.format('cleaned_reflection')}) AS BIGINT) AS words, {_SUMS}, "
    f"CAST(sum(len(regexp_extract_all(cleaned_reflection, '(?i)\\b(?:{'|'.join(DEFAULT.hesitations)})\\b'))) AS BIGINT) AS hesitation FROM answers1 WHERE cleaned_reflection IS NOT NULL GROUP BY ALL"
)
def filler_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers by category, participant and moment."""
    rates = quality.filler_rates(answers_once(spark, sf_dir), ["participant_id", "moment"], "cleaned_reflection")
    return rates.select("participant_id", "moment", "words", *DEFAULT.fillers, "hesitation")


@query(
    f"WITH {ANSWERS}, f AS (SELECT participant_id, CAST(sum({N_WORDS.format('cleaned_reflection')}) AS BIGINT) AS words, {_SUMS} FROM answers1 WHERE cleaned_reflection IS NOT NULL GROUP BY ALL) "
    "SELECT participant_id, words, " + ", ".join(f'round(100 * "{k}" / nullif(words, 0), 2) AS "{k}_per100w"' for k in DEFAULT.fillers) + " FROM f"
)
def filler_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers per 100 words."""
    rates = quality.filler_rates(answers_once(spark, sf_dir), ["participant_id"], "cleaned_reflection")
    return rates.select("participant_id", "words", *[f"{k}_per100w" for k in DEFAULT.fillers])


@query()
def repetition_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words said again at once, which takes a back-reference that RE2 hasn't."""
    rates = quality.filler_rates(answers_once(spark, sf_dir), ["participant_id"], "cleaned_reflection")
    return rates.select("participant_id", "words", "repetitions", "repetitions_per100w", "hesitation", "hesitation_per100w")


@query(
    f"WITH {ANSWERS}, m(moment, nr) AS (VALUES ('1', 1), ('2', 2), ('3', 3), ('all', NULL)), p AS (SELECT DISTINCT participant_id FROM answers1), "
    "t AS (SELECT p.participant_id, m.moment, count(a.answer_id) AS answers_total, count(a.answer_id) FILTER (a.n_words >= 3) AS answers_kept, CAST(coalesce(sum(a.n_words), 0) AS BIGINT) AS words_all, "
    "CAST(coalesce(sum(a.n_words) FILTER (a.n_words >= 3), 0) AS BIGINT) AS words_kept FROM p CROSS JOIN m LEFT JOIN answers1 a ON a.participant_id IS NOT DISTINCT FROM p.participant_id AND (m.nr IS NULL OR a.moment = m.nr) GROUP BY p.participant_id, m.moment) "
    "SELECT *, round_even(words_kept / nullif(words_all, 0), 3) AS retention FROM t"
)
def totals_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and words by participant and moment, with subtotals and retention."""
    return quality.totals(answers_once(spark, sf_dir).withColumn("kept", F.col("n_words") >= DEFAULT.min_words))


_STUDY = r"trim(regexp_replace(lower(coalesce(source, '?')), '[\s_-]+', '_', 'g'), '_')"


@query(f"SELECT coalesce(lang, '?') AS lang, {_STUDY} AS source, count(*) AS n FROM documents GROUP BY ALL")
def crosstab_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a crosstab in long form over all values, null keys shown as ?, sources in one spelling."""
    source = F.btrim(F.regexp_replace(F.lower(F.coalesce("source", F.lit("?"))), r"[\s_-]+", "_"), F.lit("_"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang"), source.alias("source")).agg(F.count("*").alias("n"))


@query(
    f"WITH {ANSWERS}, p AS (SELECT participant_id, count(*) AS k FROM answers1 WHERE participant_id IS NOT NULL AND n_words >= 3 GROUP BY 1) "
    "SELECT count(*) AS n, round(avg(k), 4) AS mean, round(quantile_cont(k, 0.5), 4) AS median, min(k) AS min, round(quantile_cont(k, 0.05), 4) AS p5, round(quantile_cont(k, 0.95), 4) AS p95, max(k) AS max FROM p"
)
def answers_per_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kept answers participants have."""
    per = answers_once(spark, sf_dir).where("participant_id IS NOT NULL AND n_words >= 3").groupBy("participant_id").agg(F.count("*").alias("k"))
    return quality.describe(per, "k")


@query(f"WITH {ANSWERS} SELECT moment, moment_source, count(*) AS n, count(DISTINCT file) AS files FROM answers1 GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and files by moment and where the moment comes from."""
    return answers_once(spark, sf_dir).groupBy("moment", "moment_source").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query(
    f"WITH {ANSWERS}, p AS (SELECT moment, participant_id, count(*) AS n, sum(n_words) AS w FROM answers1 WHERE n_words >= 3 AND moment BETWEEN 1 AND 3 GROUP BY ALL) "
    "SELECT moment, count(DISTINCT participant_id) FILTER (w > 0) AS participants, CAST(sum(n) AS BIGINT) AS answers_kept, CAST(sum(w) AS BIGINT) AS words_kept, quantile_cont(w, 0.5) AS median_words FROM p GROUP BY moment"
)
def moment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants, kept answers and words by moment."""
    a = answers_once(spark, sf_dir).withColumn("kept", F.col("n_words") >= DEFAULT.min_words)
    none = spark.createDataFrame([], "m1_duration_s int, m2_duration_s int, m3_duration_s int")
    return quality.moment_summary(none, a).select("moment", "participants", "answers_kept", "words_kept", F.col("median_words").cast("double").alias("median_words"))


_LIST = (
    "l AS (SELECT line_no, trim(participant_id) AS raw, trim(regexp_replace(regexp_extract(trim(participant_id), '^[^,;\\t ]*'), '[\"'']', '', 'g')) AS participant_id FROM participant_list WHERE participant_id IS NOT NULL), "
    "ids AS (SELECT participant_id, min(line_no) AS line_no, regexp_matches(participant_id, '(?i)^sub-p\\d+$') AS accepted FROM l WHERE participant_id <> '' AND raw NOT LIKE '#%' GROUP BY participant_id)"
)


@query(f"WITH {_LIST} SELECT * FROM ids")
def participant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the list by their first line, and which lines are no ids."""
    return transcripts.participant_list(table(spark, sf_dir, "participant_list"))


@query(
    f"WITH {ANSWERS}, {_LIST}, keys AS (SELECT DISTINCT lower(participant_id) AS k FROM ids WHERE accepted) SELECT answer_id, CASE WHEN lower(participant_id) IN (SELECT k FROM keys) THEN 'listed' ELSE 'not listed' END AS status FROM answers1 WHERE participant_id IS NOT NULL "
    "UNION ALL SELECT participant_id, 'without answer' FROM ids WHERE accepted AND lower(participant_id) NOT IN (SELECT lower(participant_id) FROM answers1 WHERE participant_id IS NOT NULL)"
)
def list_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of listed participants, of others, and listed participants without any."""
    ids = participant_ids(spark, sf_dir).where("accepted")
    answers = answers_once(spark, sf_dir).where("participant_id IS NOT NULL")
    inside, without = quality.listed(answers, ids)
    outside = answers.withColumn("key", F.lower("participant_id")).join(ids.select(F.lower("participant_id").alias("key")).distinct(), "key", "left_anti")
    row = lambda df, c, s: df.select(F.col(c).alias("answer_id"), F.lit(s).alias("status"))
    return row(inside, "answer_id", "listed").union(row(outside, "answer_id", "not listed")).union(row(without, "participant_id", "without answer"))


@query(
    f"WITH {ANSWERS}, {_LIST}, i AS (SELECT DISTINCT lower(participant_id) AS k FROM ids WHERE accepted), s AS (SELECT DISTINCT lower(participant_id) AS k FROM sessions), a AS (SELECT DISTINCT lower(participant_id) AS k FROM answers1 WHERE n_words >= 3) "
    "SELECT CASE WHEN i.k NOT IN (SELECT k FROM s WHERE k IS NOT NULL) THEN 'no transcript' WHEN i.k NOT IN (SELECT k FROM a WHERE k IS NOT NULL) THEN 'no answer' ELSE 'done' END AS status, count(*) AS n FROM i GROUP BY 1"
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listed participants have a transcript and kept answers."""
    key = F.lower("participant_id").alias("k")
    listed = participant_ids(spark, sf_dir).where("accepted").select(key).distinct()
    seen = table(spark, sf_dir, "sessions").select(key).distinct().withColumn("transcript", F.lit(True))
    kept = answers_once(spark, sf_dir).where("n_words >= 3").select(key).distinct().withColumn("answered", F.lit(True))
    status = F.when(F.col("transcript").isNull(), "no transcript").when(F.col("answered").isNull(), "no answer").otherwise("done")
    return listed.join(seen, "k", "left").join(kept, "k", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "SELECT participant_id, list_sort(list(file)) AS files, count(*) AS n FROM (SELECT DISTINCT regexp_extract(file, '(?i)(sub-[a-z]*\\d+)', 1) AS participant_id, file FROM sessions) GROUP BY participant_id"
)
def files_of_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files whose names hold a participant's id."""
    s = table(spark, sf_dir, "sessions")
    ids = s.select(F.regexp_extract("file", r"(?i)(sub-[a-z]*\d+)", 1).alias("participant_id")).distinct()
    return sinks.file_of_participant(s.select("file"), ids)


@query("SELECT participant_id, count(*) AS n, string_agg(file, ', ' ORDER BY file) AS files FROM (SELECT DISTINCT participant_id, file FROM sessions WHERE participant_id IS NOT NULL) GROUP BY participant_id HAVING count(*) > 1")
def participants_in_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with more than one file."""
    s = table(spark, sf_dir, "sessions").where("participant_id IS NOT NULL").select("participant_id", "file").distinct()
    return s.groupBy("participant_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("files")).where("n > 1")


@query(
    f"WITH {ANSWERS} SELECT participant_id, segment, string_agg(cleaned_reflection, ' ' ORDER BY answer_id) AS document FROM answers1 WHERE n_words >= 3 AND cleaned_reflection IS NOT NULL AND participant_id IS NOT NULL GROUP BY ALL"
)
def participant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept answers of a participant and segment as one text."""
    a = answers_once(spark, sf_dir).where("participant_id IS NOT NULL AND cleaned_reflection IS NOT NULL")
    return sinks.documents(a.select("participant_id", "segment", F.col("answer_id").alias("answer_no"), F.col("cleaned_reflection").alias("clean"), "question", (F.col("n_words") >= 3).alias("kept")), ["participant_id", "segment"])


@query(
    f"WITH {ANSWERS} SELECT participant_id, sha256(string_agg(cleaned_reflection || chr(0), '' ORDER BY answer_id))[1:16] AS fingerprint FROM answers1 WHERE cleaned_reflection IS NOT NULL AND participant_id IS NOT NULL GROUP BY ALL"
)
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of a participant's texts in order."""
    a = answers_once(spark, sf_dir).where("participant_id IS NOT NULL AND cleaned_reflection IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("answer_id", "cleaned_reflection"))), lambda x: x["cleaned_reflection"])
    return a.groupBy("participant_id").agg(T.fingerprint(ordered).alias("fingerprint"))


_UNIT = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.label AS la, b.label AS lb, coalesce(list_cosine_similarity(a.e, b.e), 0) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id)"


@query(
    f"WITH {_UNIT} SELECT 'any two' AS baseline, count(*) AS pairs, round(avg(c), 6) AS mean_similarity, round(stddev_samp(c), 6) AS sd, round(quantile_cont(c, 0.05), 6) AS p05, round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.95), 6) AS p95 FROM p"
)
def similarity_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of any two vectors; mean and deviation from sums, quantiles from blocks of pairs."""
    out = similarity.overall(table(spark, sf_dir, "embeddings"), quantiles=True)
    return out.select("baseline", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_similarity", "sd", "p05", "median", "p95")])


@query(
    f"WITH {_UNIT}, g AS (SELECT la, count(*) AS n, avg(c) AS m FROM p WHERE la = lb GROUP BY la) SELECT 'label' AS baseline, count(*) AS groups, CAST(sum(n) AS BIGINT) AS pairs, round(avg(m), 6) AS mean_similarity, round(stddev_samp(m), 6) AS sd, "
    "round(quantile_cont(m, 0.5), 6) AS median, (SELECT round(avg(c), 6) FROM p WHERE la <> lb) AS between_groups_mean FROM g"
)
def similarity_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity within and between groups of one label."""
    out = similarity.by_group(table(spark, sf_dir, "embeddings"), "label")
    return out.select("baseline", "groups", "pairs", *[F.round(c, 6).alias(c) for c in ("mean_similarity", "sd", "median", "between_groups_mean")])


_ANSWER_PAIRS = (
    "v AS (SELECT row, moment, CAST(embedding AS DOUBLE[]) AS e FROM answer_embeddings WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))), "
    "p AS (SELECT a.moment AS la, b.moment AS lb, CASE WHEN isnan(list_cosine_similarity(a.e, b.e)) THEN 0 ELSE coalesce(list_cosine_similarity(a.e, b.e), 0) END AS c FROM v a JOIN v b ON a.row < b.row)"
)


@query(
    f"WITH {_ANSWER_PAIRS}, g AS (SELECT la, count(*) AS n, avg(c) AS m FROM p WHERE la = lb GROUP BY la) SELECT 'any two' AS baseline, CAST(NULL AS BIGINT) AS groups, count(*) AS pairs, round(avg(c), 6) AS mean_similarity, round(stddev_samp(c), 6) AS sd FROM p "
    "UNION ALL SELECT 'moment', count(*), CAST(sum(n) AS BIGINT), round(avg(m), 6), round(stddev_samp(m), 6) FROM g"
)
def similarity_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N02, N03 over the answers' vectors, by moment: sums only, one pass however many vectors there are."""
    v = table(spark, sf_dir, "answer_embeddings")
    both = similarity.overall(v).withColumn("groups", F.lit(None).cast("long")).unionByName(similarity.by_group(v, "moment").select("baseline", "groups", "pairs", "mean_similarity", "sd"))
    return both.select("baseline", "groups", "pairs", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("sd", 6).alias("sd"))


_SCORED = (
    "s AS (SELECT *, n_topics - 1 AS topics FROM (SELECT *, row_number() OVER (PARTITION BY trial_number ORDER BY objective_cv DESC, embedding_coherence DESC, n_components, n_neighbors, min_dist, min_cluster_size, min_samples) AS nth "
    "FROM trials WHERE trial_number IS NOT NULL AND embedding_coherence IS NOT NULL AND objective_cv IS NOT NULL) WHERE nth = 1), "
    "f AS (SELECT *, NOT EXISTS (SELECT 1 FROM s b WHERE b.objective_cv >= a.objective_cv AND b.embedding_coherence >= a.embedding_coherence AND (b.objective_cv > a.objective_cv OR b.embedding_coherence > a.embedding_coherence)) AS on_front FROM s a)"
)


@query(
    f"WITH {_SCORED}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY objective_cv, embedding_coherence, n_components, n_neighbors, min_dist, min_cluster_size, min_samples ORDER BY trial_number) AS k FROM f WHERE on_front) WHERE k = 1), "
    "e AS (SELECT max(objective_cv) AS hc, min(objective_cv) AS lc, max(embedding_coherence) AS he, min(embedding_coherence) AS le, count(*) AS n FROM o), "
    "d AS (SELECT o.*, n, sqrt(power((hc - objective_cv) / CASE WHEN hc = lc THEN 1 ELSE hc - lc END, 2) + power((he - embedding_coherence) / CASE WHEN he = le THEN 1 ELSE he - le END, 2)) AS distance FROM o, e) "
    "SELECT CAST(row_number() OVER (ORDER BY objective_cv DESC, trial_number) AS INT) AS solution, trial_number, objective_cv, embedding_coherence, topics, n_components, n_neighbors, min_dist, min_cluster_size, min_samples, "
    "round(distance, 9) AS distance, row_number() OVER (ORDER BY distance, objective_cv DESC, trial_number) = 1 AND n > 2 AS balanced FROM d"
)
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front of the search and its balanced solution."""
    return search.pareto_front(table(spark, sf_dir, "trials")).drop("above_baseline").withColumn("distance", F.round("distance", 9))


@query(
    f"WITH {_SCORED} SELECT CAST(trial_number // 50 + 1 AS INT) AS generation, min(trial_number) AS first_trial, max(trial_number) AS last_trial, count(*) AS completed, max(objective_cv) AS best_cv, max(embedding_coherence) AS best_emb, "
    "quantile_cont(topics, 0.5) AS median_topics, count(*) FILTER (on_front) AS front_solutions FROM f GROUP BY 1"
)
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by generations of 50 trials."""
    return search.generations(table(spark, sf_dir, "trials"))


@query(
    f"WITH {_SCORED} SELECT max(trial_number) + 1 AS started, count(*) AS completed, min(objective_cv) AS cv_min, max(objective_cv) AS cv_max, min(embedding_coherence) AS emb_min, max(embedding_coherence) AS emb_max, quantile_cont(topics, 0.5) AS median_topics, "
    "count(*) FILTER (on_front AND trial_number // 50 = (SELECT max(trial_number) // 50 FROM f)) / nullif(count(*) FILTER (on_front), 0) AS last_front_share, "
    "count(*) FILTER (on_front AND trial_number // 50 = (SELECT max(trial_number) // 50 FROM f)) / nullif(count(*) FILTER (on_front), 0) > 0.4 AS improving FROM f"
)
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, and whether the last generation still improves."""
    return search.search_summary(table(spark, sf_dir, "trials"))


@query(
    "SELECT CAST(a AS INT) AS n_components, CAST(b AS INT) AS n_neighbors, CAST(c AS INT) AS min_cluster_size, CAST(d AS INT) AS min_samples FROM generate_series(5, 20, 5) AS w(a), generate_series(5, 25, 5) AS x(b), generate_series(5, 10) AS y(c), generate_series(1, 5) AS z(d)"
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All settings of the search's ranges."""
    return search.parameter_grid(spark, TopicModel())


_GRAMS = f"g AS (SELECT moment, answer_id, list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM (SELECT moment, answer_id, list_filter({WORDS.format('cleaned_reflection')}, lambda x: x NOT IN {_IN(DEFAULT.stopwords)}) AS w FROM answers1 WHERE cleaned_reflection IS NOT NULL AND moment IS NOT NULL))"


@query(
    f"WITH {ANSWERS}, {_GRAMS}, x AS (SELECT moment AS topic, answer_id, unnest(t) AS term FROM g), c AS (SELECT topic, term, count(*) AS count FROM x GROUP BY ALL), n AS (SELECT count(DISTINCT moment) AS n FROM g), "
    "o AS (SELECT term, count(DISTINCT topic) AS df, count(*) AS total FROM x GROUP BY term), s AS (SELECT topic, sum(count) AS size FROM c GROUP BY topic), m AS (SELECT avg(size) AS mean FROM s), "
    "w AS (SELECT topic, term, count, count / size * ln(1 + mean / total) AS weight FROM c JOIN o USING (term) JOIN s USING (topic), m, n WHERE df <= 0.95 * n.n), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS place FROM w) SELECT topic, term, count, round(weight, 9) AS weight, CAST(place AS INT) AS place FROM r WHERE place <= 15"
)
def keyword_ctfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and word pairs that tell moments apart."""
    return search.topic_terms(answers_once(spark, sf_dir), "moment", "cleaned_reflection", stopwords=DEFAULT.stopwords).withColumn("weight", F.round("weight", 9))


@query(
    f"WITH {TURNS}, c AS (SELECT file, turn_idx, coalesce(regexp_matches(text, '(?i)celebration'), false) AS candidate FROM turns1), n AS (SELECT *, max(candidate) OVER (PARTITION BY file ORDER BY turn_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS shown FROM c) "
    "SELECT file, turn_idx, candidate FROM n WHERE shown"
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns about a topic with two turns around them."""
    return segments.candidates(turns_once(spark, sf_dir), "celebration", 2).select("file", "turn_idx", "candidate")


@query(
    f"WITH {TURNS}, p AS (SELECT *, coalesce(regexp_matches(speaker, '(?i)^sub-p\\d+$'), false) AS is_p FROM turns1) SELECT file, min_by(CASE WHEN is_p THEN speaker END, turn_idx) FILTER (is_p) AS participant_id, "
    "min_by(speaker, turn_idx) FILTER (NOT is_p AND speaker <> 'UNKNOWN') AS interviewer, min(turn_idx) FILTER (NOT is_p AND regexp_matches(text, '(?i)\\bmost\\s+intense\\b')) AS opening FROM p GROUP BY file"
)
def people_and_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks in a file, and where the interview proper opens."""
    t = segments.with_roles(turns_once(spark, sf_dir))
    opening = t.groupBy("file").agg(F.min(F.when(~F.col("is_participant") & F.col("text").rlike(r"(?i)\bmost\s+intense\b"), F.col("turn_idx"))).alias("opening"))
    return segments.file_people(t).join(opening, "file")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_text_flags(segments.with_roles(turns_once(spark, sf_dir)))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment(_flagged(spark, sf_dir))


@query()
def moment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moment, leading readiness replies and unrecognised announcements of every turn."""
    return _segmented(spark, sf_dir).select("file", "turn_idx", "is_participant", "moment", "evocation", "unrecognised")


@query()
def built_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all transcripts with question, counts and drop reason."""
    turns = _segmented(spark, sf_dir)
    return A.with_ids(A.build_answers(turns), segments.file_people(segments.with_roles(turns_once(spark, sf_dir))))


@query()
def sentence_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged sentences of every answer."""
    return tagging.tag_sentences(answers_once(spark, sf_dir).select("answer_id", F.col("cleaned_reflection").alias("clean")).where("clean IS NOT NULL"))


@query()
def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tags of its sentences make of an answer."""
    return tagging.tag_answers(sentence_tags(spark, sf_dir))


_KEYWORDS = "|".join(w for pair in DEFAULT.scenes.values() for words in pair for w in words).replace("'", "''")
_UNNAMED = "regexp_replace(cleaned_reflection, '(?i)\\b(?:" + _KEYWORDS + ")\\b', ' ', 'g')"


@query(
    f"WITH {ANSWERS}, w AS (SELECT unnest({WORDS.format(_UNNAMED)}) AS word FROM answers1 WHERE moment = 1) "
    f"SELECT word, count(*) AS n FROM w WHERE length(word) > 3 AND word NOT IN {_IN(DEFAULT.stopwords)} GROUP BY word ORDER BY n DESC, word LIMIT 30"
)
def scene_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words that no scene keyword covers, a report."""
    return tagging.unmatched_words(answers_once(spark, sf_dir).where("moment = 1"), "cleaned_reflection")


@query()
def scene_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene of every transcript's first moment."""
    return scenes.moment1_scenes(_segmented(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns with text flags, people, segmented turns, answers and the sources of moments, each worked out once."""
    flagged = stage(_flagged(spark, sf_dir), "flagged")
    people = stage(segments.file_people(flagged), "people")
    turns = stage(segments.segment(flagged), "segmented")
    answers = stage(A.with_ids(A.build_answers(turns), people), "answers")
    return flagged, people, turns, answers, A.moment_sources(answers, scenes.moment1_scenes(turns), turns.where("unrecognised"))


@query()
def moment_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each moment's answers come from, why, with notes, and whether a file is complete."""
    return _decided(spark, sf_dir)[4]


@query()
def segment_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept answers by segment, copies keeping moment and id."""
    *_, answers, sources = _decided(spark, sf_dir)
    return A.materialise(answers, sources).select("segment", "answer_id", "file", "moment", "moment_source", "clean", "n_words")


@query()
def moment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration and kept words of every file's moments."""
    _, _, turns, answers, _ = _decided(spark, sf_dir)
    return quality.moment_report(turns, answers)


@query()
def moment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, participants and words by moment, over the segmented transcripts."""
    _, _, turns, answers, _ = _decided(spark, sf_dir)
    return quality.moment_summary(quality.moment_report(turns, answers), answers)


@query()
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file with bounds of moments, counts, sources, scene and status, files left out included."""
    return quality.file_report(*_decided(spark, sf_dir))


@query()
def scene_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by scene of the first moment, confidence and status."""
    return file_report(spark, sf_dir).groupBy("scene", "confidence", "status").agg(F.count("*").alias("n"))


@query()
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-rows, O01, U01, J05: the flags of all rules with their rank and folder, the worst first; structure rules over transcripts rebuilt from the turns."""
    flagged, people, segmented, answers, sources = _decided(spark, sf_dir)
    turns = flagged.join(segmented.where("unrecognised").select("file", "turn_idx", "unrecognised"), ["file", "turn_idx"], "left")
    issues = transcripts.structure_issues(transcripts.lines(_rebuilt(spark, sf_dir)))
    out = quality.flags(turns, answers, people, table(spark, sf_dir, "sessions").select("file").distinct(), sources, issues.join(people, "file", "left"))
    folders = people.where("participant_id IS NOT NULL").select(F.regexp_replace("file", r"\.[^.]*$", "").alias("folder"))
    return stage(quality.routed(out, folders), "flags").orderBy("rank", "file")  # staged, as a sort reads its input twice


@query()
def qc_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by severity and check."""
    return quality.flag_counts(qc_flags(spark, sf_dir))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): transcripts written again from all turns: a timestamp line where both times are in standard form, then label and text."""
    standard = lambda c: F.trim(c).rlike(r"^\d{1,2}:\d{2}:\d{2}$")
    time = F.when(standard(F.col("start")) & standard(F.col("end")), F.concat(F.trim("start"), F.lit(" - "), F.trim("end"), F.lit("\n")))
    said = F.concat(F.when(F.trim("speaker") != "", F.concat("speaker", F.lit(": "))).otherwise(""), F.coalesce("text", F.lit("")))
    rows = turns_once(spark, sf_dir).where("file IS NOT NULL").select("file", F.struct("turn_idx", F.concat(F.coalesce(time, F.lit("")), F.coalesce(said, F.lit(""))).alias("line")).alias("row"))
    return rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["line"]), "\n").alias("content"))


@query()
def parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts of all turns, parsed again."""
    return transcripts.parse_transcripts(transcripts.lines(_rebuilt(spark, sf_dir)))


@query()
def raw_structure_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before the first timestamp and labels within turns of all transcripts."""
    return transcripts.structure_issues(transcripts.lines(_rebuilt(spark, sf_dir)))


@query()
def clean_text_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text without annotations and hesitations, and how many there were; takes look-ahead, which RE2 hasn't."""
    notes, brackets, sounds = T.annotation_counts(F.col("text"))
    return turns_once(spark, sf_dir).select(
        "file", "turn_idx", T.clean_text(F.col("text"), True).alias("clean"), notes.alias("n_annotations"), brackets.alias("n_stray_brackets"), sounds.alias("n_hesitations")
    )


@query(
    f"WITH {TURNS}, t AS (SELECT *, coalesce(lag(start_s) OVER (PARTITION BY file ORDER BY turn_idx), -1) AS before FROM turns1), i AS (SELECT file FROM t WHERE end_s < start_s UNION ALL SELECT file FROM t WHERE start_s < before), "
    "p AS (SELECT file, min_by(speaker, turn_idx) FILTER (coalesce(regexp_matches(speaker, '(?i)^sub-p\\d+$'), false)) AS pid FROM turns1 GROUP BY file), a AS (SELECT DISTINCT participant_id AS folder FROM answers) "
    "SELECT coalesce(CASE WHEN regexp_replace(i.file, '\\.[^.]*$', '') IN (SELECT folder FROM a WHERE folder IS NOT NULL) THEN regexp_replace(i.file, '\\.[^.]*$', '') END, pid) AS folder, count(*) AS n FROM i LEFT JOIN p USING (file) GROUP BY 1"
)
def flags_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp flags by the folder they go to."""
    turns = segments.with_roles(turns_once(spark, sf_dir))
    noted = quality.timestamp_issues(turns).join(segments.file_people(turns), "file", "left")
    folders = table(spark, sf_dir, "answers").where("participant_id IS NOT NULL").select(F.col("participant_id").alias("folder"))
    return quality.routed(noted, folders).groupBy("folder").agg(F.count("*").alias("n"))


@query()
def embedded_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of any two answers by vectors of a pluggable model, here hashed words."""
    vectors = similarity.embedded(answers_once(spark, sf_dir), "answer_id", "cleaned_reflection")
    return similarity.overall(vectors)
