"""Quality flags, each one frame of (file, participant_id, check, severity, detail), and the tables behind the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study
from loomspeak.functions import text as T
from loomspeak.functions.regex import java

SEVERITY = ("ERROR", "WARN", "INFO")


def _flag(df: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    pid = F.col("participant_id") if "participant_id" in df.columns else F.lit(None).cast("string")
    return df.select("file", pid.alias("participant_id"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def speaker_shares(turns: DataFrame) -> DataFrame:
    """(file, speaker, role, turns, words, word_share): share of all words of the file, to three decimals."""
    per = turns.groupBy("file", "speaker").agg(
        F.max(F.when(F.col("is_participant"), "participant").otherwise("interviewer")).alias("role"), F.count("*").alias("turns"), F.sum(F.coalesce(T.n_words(F.col("text")), F.lit(0))).cast("long").alias("words")
    )
    return per.withColumn("word_share", F.bround(F.col("words") / F.nullif(F.sum("words").over(Window.partitionBy("file")), F.lit(0)), 3))


def timestamp_issues(turns: DataFrame) -> DataFrame:
    """(file, turn_idx, issue): a turn that ends before it starts, or starts before the one before it."""
    by = Window.partitionBy("file").orderBy("turn_idx")
    before = F.coalesce(F.lag("start_s").over(by), F.lit(-1))
    t = turns.select("file", "turn_idx", "start_s", "end_s", before.alias("before"))
    found = F.array_compact(F.array(F.when(F.col("end_s") < F.col("start_s"), "end_before_start"), F.when(F.col("start_s") < F.col("before"), "start_before_previous")))
    return t.select("file", "turn_idx", F.explode(found).alias("issue"))


def totals(answers: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(participant_id, moment, answers_total, answers_kept, words_all, words_kept, retention), moment as text, with 'all' rows.

    Every participant has a row for each of moments 1 to 3, of zeros where there is no answer, and retention is null without words.
    """
    base = answers.select("participant_id", "moment", "kept", F.coalesce("n_words", F.lit(0)).alias("w"))
    in_ = lambda m: F.lit(True) if m == "all" else F.coalesce(F.col("moment") == m, F.lit(False))
    moments = (1, 2, 3, "all")
    per = base.groupBy("participant_id").agg(*[
        F.struct(
            F.lit(str(m)).alias("moment"), F.count_if(in_(m)).alias("answers_total"), F.count_if(in_(m) & F.col("kept")).alias("answers_kept"),
            F.sum(F.when(in_(m), F.col("w")).otherwise(0)).cast("long").alias("words_all"), F.sum(F.when(in_(m) & F.col("kept"), F.col("w")).otherwise(0)).cast("long").alias("words_kept"),
        ).alias(f"m{m}") for m in moments
    ])
    return per.select("participant_id", F.inline(F.array(*[f"m{m}" for m in moments]))).withColumn("retention", F.bround(F.col("words_kept") / F.nullif("words_all", F.lit(0)), 3))


def filler_rates(texts: DataFrame, keys: list[str], text_col: str, study: Study = DEFAULT) -> DataFrame:
    """By keys: words, fillers by category, repetitions, and each per 100 words (null without words)."""
    c = F.col(text_col)
    counts = T.filler_counts(c, study) | {"repetitions": T.n_repetitions(c)}
    per = texts.where(c.isNotNull()).groupBy(*keys).agg(F.sum(T.n_words(c)).cast("long").alias("words"), *[F.sum(v).cast("long").alias(k) for k, v in counts.items()])
    return per.select("*", *[F.round(100 * F.col(k) / F.nullif("words", F.lit(0)), 2).alias(f"{k}_per100w") for k in counts])


def content_words(answers: DataFrame, text_col: str, study: Study = DEFAULT) -> DataFrame:
    """(word, count_all, count_m1, count_m2, count_m3, n_participants, participant_share) of content words."""
    n = answers.agg(F.countDistinct("participant_id").alias("n"))
    found = answers.select("participant_id", "moment", F.explode(T.words(F.col(text_col))).alias("word")).where(T.is_content_word(F.col("word"), study))
    # First by word and participant, so that a frequent word is spread over the participants.
    per = found.groupBy("word", "participant_id").agg(F.count("*").alias("c"), *[F.count_if(F.col("moment") == m).alias(f"m{m}") for m in (1, 2, 3)])
    words = per.groupBy("word").agg(F.sum("c").alias("count_all"), *[F.sum(f"m{m}").alias(f"count_m{m}") for m in (1, 2, 3)], F.count("participant_id").alias("n_participants"))
    return words.crossJoin(F.broadcast(n)).withColumn("participant_share", F.bround(F.col("n_participants") / F.nullif("n", F.lit(0)), 2)).drop("n")  # one row


def rare_words(answers: DataFrame, text_col: str, frequency: DataFrame | None, below: float = 2.0, study: Study = DEFAULT) -> DataFrame | None:
    """(word, count, example_participant, example_moment, context) of words below a frequency, with the first place they stand.

    frequency: (word, zipf); words it doesn't have are rare. Without it there is no such table.
    """
    if frequency is None:
        return None
    found = answers.select("participant_id", "moment", F.col(text_col).alias("t"), F.explode(F.array_distinct(T.words(F.col(text_col)))).alias("word")).where(T.is_content_word(F.col("word"), study))
    per = found.groupBy("word").agg(F.count("*").alias("count"), F.min(F.struct("participant_id", "moment", "t")).alias("first"))
    rare = per.join(frequency, "word", "left").where(F.coalesce("zipf", F.lit(0.0)) < below)
    return rare.select("word", "count", F.col("first.participant_id").alias("example_participant"), F.col("first.moment").alias("example_moment"), T.context(F.col("first.t"), F.col("word")).alias("context"))


def describe(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, median, min, p5, p95, max with exact quantiles."""
    q = lambda p: F.percentile(column, F.lit(p))
    return df.where(F.col(column).isNotNull()).groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(q(0.5), 4).alias("median"), F.min(column).alias("min"), F.round(q(0.05), 4).alias("p5"), F.round(q(0.95), 4).alias("p95"), F.max(column).alias("max")
    )


def sentence_lengths(sentences: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(n, below_min, below_5, long, unpunctuated) of sentences."""
    n = T.n_tokens(F.col("sentence"))
    return sentences.agg(
        F.count("*").alias("n"), F.count_if(n < study.min_sentence_words).alias("below_min"), F.count_if(n < 5).alias("below_5"), F.count_if(n > study.long_sentence).alias("long"),
        F.count_if(~F.col("sentence").rlike("[.!?…][\"'”’)]*$")).alias("unpunctuated"),
    )


def flags(turns: DataFrame, answers: DataFrame, people: DataFrame, files: DataFrame, sources: DataFrame | None = None, issues: DataFrame | None = None, unreadable: DataFrame | None = None, study: Study = DEFAULT) -> DataFrame:
    """The union of all rules, with rank of severity; turns labelled and segmented where they have an opening.

    turns: all turns with roles and text flags, answers: with participant_id; people: file_people(); files: (file) of
    all files read; sources: moment_sources(); issues: structure_issues(); unreadable: (file) of files that failed.
    """
    c = F.col
    by_file = turns.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if("is_participant").alias("n_p"), F.count_if(c("speaker") == study.no_label).alias("n_unlabelled"),
        F.min_by("is_participant", "turn_idx").alias("p_first"),
        F.min(F.when(~c("is_participant") & c("text").rlike(java(study.opening, True)), c("turn_idx"))).alias("opens"),
        F.count_if(c("is_participant") & c("text").rlike(java(study.guide, True))).alias("n_guide"),
    ).join(people, "file", "left")
    shares = speaker_shares(turns).where("role = 'participant'").groupBy("file").agg(F.sum("word_share").alias("share")).join(people, "file", "left")
    times = timestamp_issues(turns.withColumn("start_s", T.to_seconds(c("start"))).withColumn("end_s", T.to_seconds(c("end")))).join(people, "file", "left")
    per_moment = answers.where("kept").groupBy("file", "participant_id", "moment").agg(F.sum("n_words").alias("w"))
    per_moment = per_moment.withColumn("share", c("w") / F.sum("w").over(Window.partitionBy("file")))
    id_of_file = F.regexp_extract("file", r"(?i)^(sub-[a-z]*\d+)", 1)
    kept_words = totals(answers).where("moment = 'all'").withColumn("file", F.lit(None).cast("string"))
    several = people.where("participant_id IS NOT NULL").groupBy("participant_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("files")).where("n > 1")
    sentences = answers.where("kept").select("file", "participant_id", F.explode(T.split_sentences(c("clean"))).alias("s"))
    of_file = [  # all rules over one row a file, in one pass
        (c("n_p") == 0, "speakers", "ERROR", F.lit("no participant speaker")),
        (c("n_unlabelled") > 0, "speakers", "WARN", F.format_string("%d turns without label", "n_unlabelled")),
        (c("p_first"), "speakers", "INFO", F.lit("participant speaks first")),
        ((id_of_file != "") & (F.lower(id_of_file) != F.lower("participant_id")), "speakers", "ERROR", F.lit("file name and label differ")),
        (c("n_guide") > 0, "speakers", "WARN", F.format_string("%d guide phrases in participant turns", "n_guide")),
        (c("opens").isNull(), "moments", "ERROR", F.lit("opening not found")),
        (c("opens") == 0, "moments", "WARN", F.lit("nothing before the opening")),
        (c("opens") > study.max_intro_share * c("n"), "moments", "WARN", F.lit("opening after half of the turns")),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))) for when, check, severity, detail in of_file]))
    frames = [
        by_file.select("file", "participant_id", F.inline(found)),
        _flag(files.join(turns.select("file").distinct(), "file", "left_anti"), "parsing", "ERROR", F.lit("no timestamped turns")),
        _flag(shares.where(c("share") < study.min_participant_share), "speakers", "WARN", F.format_string("participant word share %.3f", "share")),
        _flag(times, "timestamps", "WARN", F.format_string("%s at turn %d", "issue", "turn_idx")),
        _flag(per_moment.where((c("w") < study.min_moment_words) | (c("share") < study.min_moment_share)), "moments", "WARN", F.format_string("moment %d has %d words", "moment", "w")),
        _flag(several.withColumn("file", F.lit(None).cast("string")), "speakers", "ERROR", F.concat(F.lit("several files: "), "files")),
        _flag(kept_words.where(c("retention") < study.min_retention), "totals", "INFO", F.format_string("retention %.3f", "retention")),
        _flag(sentences.where(T.n_tokens(c("s")) > study.long_sentence), "sentences", "INFO", F.left("s", F.lit(80))),
    ]
    if "unrecognised" in turns.columns:
        frames.append(_flag(turns.where("unrecognised").select("file", "turn_idx").join(people, "file", "left"), "moments", "WARN", F.format_string("unrecognised announcement at turn %d", "turn_idx")))
    if issues is not None:
        kind = {"before_first_timestamp": "WARN", "label_inside_turn": "ERROR"}
        frames += [_flag(issues.where(c("issue") == i), "parsing", s, F.format_string("line %d: %s", "line_no", F.left("line", F.lit(60)))) for i, s in kind.items()]
    if sources is not None:
        noted = sources.select("file", F.inline("notes")).join(people, "file", "left")
        frames.append(noted.select("file", "participant_id", "check", "severity", "detail"))
    if unreadable is not None:
        frames.append(_flag(unreadable, "parsing", "ERROR", F.lit("file can't be read")))
    union = reduce(DataFrame.unionByName, frames)
    rank = F.when(c("severity") == "ERROR", 0).when(c("severity") == "WARN", 1).otherwise(2)
    return union.withColumn("rank", rank)


def moment_report(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """(file, m1_duration_s, m1_words, … m3_words, n_moments): seconds and kept words of the moments of every segmented file.

    A moment lasts from its first turn's start to that of the next moment there is, or to the last turn's end; null where a time isn't in
    standard form, 0 without the moment. turns: with file, turn_idx, start, end, moment; answers: with file, moment, kept, n_words.
    """
    t = turns.select("file", "turn_idx", "moment", T.to_seconds(F.trim("start")).alias("s"), T.to_seconds(F.trim("end")).alias("e"))
    first = lambda m: F.min_by(F.when(F.col("moment") == m, F.struct("s")), F.when(F.col("moment") == m, F.col("turn_idx")))
    at = t.groupBy("file").agg(*[first(m).alias(f"b{m}") for m in (1, 2, 3)], F.max_by(F.struct("e"), "turn_idx").alias("last"))
    words = answers.groupBy("file").agg(*[F.sum(F.when(F.col("kept") & (F.col("moment") == m), F.col("n_words")).otherwise(0)).cast("long").alias(f"m{m}_words") for m in (1, 2, 3)])
    until = {1: F.when(F.col("b2").isNotNull(), F.col("b2.s")).when(F.col("b3").isNotNull(), F.col("b3.s")).otherwise(F.col("last.e")), 2: F.when(F.col("b3").isNotNull(), F.col("b3.s")).otherwise(F.col("last.e")), 3: F.col("last.e")}
    n = lambda m: F.coalesce(f"m{m}_words", F.lit(0)).cast("long")
    return at.join(words, "file", "left").select(
        "file", *[x for m in (1, 2, 3) for x in (F.when(F.col(f"b{m}").isNull(), 0).otherwise(until[m] - F.col(f"b{m}.s")).alias(f"m{m}_duration_s"), n(m).alias(f"m{m}_words"))],
        sum(((n(m) > 0).cast("int") for m in (1, 2, 3)), F.lit(0)).alias("n_moments"),
    )


def moment_summary(report: DataFrame, answers: DataFrame) -> DataFrame:
    """(moment, files, median_s, min_s, max_s, participants, answers_kept, words_kept, median_words) of moments 1 to 3; times over values above 0."""
    long_ = report.select(F.inline(F.array(*[F.struct(F.lit(m).alias("moment"), F.col(f"m{m}_duration_s").alias("s")) for m in (1, 2, 3)]))).where("s > 0")
    times = long_.groupBy("moment").agg(F.count("*").alias("files"), F.percentile("s", F.lit(0.5)).alias("median_s"), F.min("s").alias("min_s"), F.max("s").alias("max_s"))
    per = answers.where("kept AND moment BETWEEN 1 AND 3").groupBy("participant_id", "moment").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    words = per.groupBy("moment").agg(
        F.countDistinct(F.when(F.col("w") > 0, F.col("participant_id"))).alias("participants"), F.sum("n").alias("answers_kept"), F.sum("w").alias("words_kept"), F.percentile("w", F.lit(0.5)).alias("median_words")
    )
    return words.join(times, "moment", "full").select("moment", "files", "median_s", "min_s", "max_s", "participants", "answers_kept", "words_kept", "median_words")


def file_report(turns: DataFrame, people: DataFrame, segmented: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, participant_id, interviewer, m1_start … m3_start, evocations, answers, words, source1 … source3, scene, confidence, status): one row a file.

    status names why a file is left out: no participant speaks, no opening, or the name of the file holds another id (without case);
    else it is that of its sources.
    """
    starts = segmented.groupBy("file").agg(*[F.min(F.when(F.col("moment") == m, F.col("turn_idx"))).alias(f"m{m}_start") for m in (1, 2, 3)], F.count_if("evocation").alias("evocations"))
    counts = answers.groupBy("file").agg(F.count_if("kept").alias("answers"), F.sum(F.when(F.col("kept"), F.col("n_words")).otherwise(0)).cast("long").alias("words"))
    all_of = turns.select("file").distinct().join(people, "file", "left").join(starts, "file", "left").join(counts, "file", "left").join(sources.drop("notes", "outcome", "evidence", "present"), "file", "left")
    named = F.regexp_extract("file", r"(?i)^(sub-[a-z]*\d+)", 1)
    status = (
        F.when(F.col("participant_id").isNull(), "left out: no participant").when(F.col("m1_start").isNull(), "left out: no opening")
        .when((named != "") & (F.lower(named) != F.lower("participant_id")), "left out: another id").otherwise(F.coalesce("status", F.lit("review")))
    )
    return all_of.withColumn("status", status)


def routed(flagged: DataFrame, folders: DataFrame) -> DataFrame:
    """Flags with folder: the one of the file's name without ending if there is one of (folder), else the participant's."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return flagged.withColumn("stem", stem).join(folders.select(F.col("folder").alias("stem"), F.col("folder").alias("own")).distinct(), "stem", "left").withColumn("folder", F.coalesce("own", "participant_id")).drop("stem", "own")


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("severity", "check").agg(F.count("*").alias("n"))


def listed(results: DataFrame, participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of listed participants, listed participants without result), ids compared without case."""
    ids = participants.select(F.lower("participant_id").alias("key")).distinct()
    keyed = results.withColumn("key", F.lower("participant_id"))
    return keyed.join(ids, "key", "left_semi").drop("key"), participants.withColumn("key", F.lower("participant_id")).join(keyed.select("key").distinct(), "key", "left_anti").drop("key")
