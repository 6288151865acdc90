"""Answers from labelled turns: gaps and islands by windows over the file, without joining turns back to themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study
from loomspeak.functions import text as T


def build_answers(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """One row per answer of segmented turns: (file, answer_no, moment, start, end, question, raw, clean, counts, drop_reason, kept).

    Participant turns are one answer if they follow each other, are parted only by acknowledgements of the
    interviewer, or by at most continuation_words words with marks of continuation on both sides. The interviewer's turns since the
    last answer with content are its question. A lone acknowledgement or question of the participant stays open for nothing.
    """
    c = F.col
    spoken = turns.where("moment > 0")
    by = Window.partitionBy("file").orderBy("turn_idx")
    # A participant turn and the interviewer's turns before it share a gap.
    gap = spoken.withColumn("g", F.coalesce(F.sum(c("is_participant").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = F.struct("turn_idx", "moment", "evocation", "backchannel", "asks", "start", "end", F.coalesce("text", F.lit("")).alias("text"))
    asked = F.struct("turn_idx", "moment", "backchannel", T.n_words(T.clean_text(F.coalesce("text", F.lit("")), False, study)).alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    rows = gap.groupBy("file", "g").agg(
        F.max(F.when(c("is_participant"), turn)).alias("t"),
        F.array_sort(F.collect_list(F.when(~c("is_participant"), asked))).alias("gap"),
    ).where("t IS NOT NULL").select("file", "g", "t.*", "gap")
    order = Window.partitionBy("file").orderBy("g")
    before = F.lag(F.struct("moment", "evocation", "text")).over(order)
    rows = rows.withColumn("before", before)
    marks = c("before.text").rlike(T.ENDS_OPEN) & c("text").rlike(T.STARTS_OPEN)
    bridge = F.forall(F.transform("gap", lambda x, i: F.struct(x["backchannel"].alias("b"), ((i == 0) & (x["n"] <= study.continuation_words)).alias("short"))), lambda x: x["b"] | (x["short"] & marks))
    same = (c("before.moment") == c("moment")) & (c("before.evocation") == c("evocation")) & F.forall("gap", lambda x: x["moment"] == c("moment"))
    rows = rows.withColumn("link", F.coalesce(same & bridge, F.lit(False))).withColumn("free", ~c("evocation") & (c("backchannel") | c("asks")))
    # Open: a turn with content is; one without is if it continues an open one.
    known = F.when(~c("free"), F.lit(True)).when(~c("link"), F.lit(False))
    rows = rows.withColumn("open", F.last(known, ignorenulls=True).over(order))
    rows = rows.withColumn("joins", c("link") & F.coalesce(F.lag("open").over(order), F.lit(False)))
    rows = rows.withColumn("answer_no", F.sum((~c("joins")).cast("int")).over(order))
    starts = (~c("joins") & ~c("evocation") & ~c("free")).cast("int")
    rows = rows.withColumn("q", F.coalesce(F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buffer = Window.partitionBy("file", "q").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    none = F.slice("gap", 1, 0)
    heard = F.flatten(F.collect_list(F.when(~c("joins"), c("gap")).otherwise(none)).over(buffer))
    rows = rows.withColumn("heard", F.filter(heard, lambda x: x["moment"] == c("moment")))
    question = F.array_join(F.transform("heard", lambda x: x["text"]), " ")
    answers = rows.groupBy("file", "answer_no").agg(
        F.min_by(F.struct("moment", "start", "evocation", "backchannel", "asks", question.alias("question")), "g").alias("first"), F.max_by("end", "g").alias("end"),
        F.transform(F.array_sort(F.collect_list(F.struct("g", "text"))), lambda x: x["text"]).alias("texts"), F.count("*").cast("int").alias("n_turns_merged"),
        F.sum(F.when(c("joins"), F.size("gap")).otherwise(0)).cast("int").alias("n_interviewer_turns_bridged"),
    )
    raw = answers.select(
        "file", "answer_no", "first.moment", "first.start", "end", T.clean_text(c("first.question"), False, study).alias("question"), T.join_continuation(c("texts")).alias("raw"), c("first.evocation").alias("evocation"),
        (c("first.backchannel") & ~c("first.evocation")).alias("backchannel"), (c("first.asks") & ~c("first.evocation") & ~c("first.backchannel")).alias("participant_question"),
        "n_turns_merged", "n_interviewer_turns_bridged",
    )
    notes, brackets, sounds = T.annotation_counts(c("raw"), study)
    out = raw.withColumn("clean", T.clean_text(c("raw"), not study.keep_hesitations, study)).select(
        "*", notes.alias("n_annotations"), brackets.alias("n_stray_brackets"), sounds.alias("n_hesitations"), T.n_words(c("clean")).alias("n_words")
    )
    reason = (
        F.when(c("evocation"), "evocation").when(c("backchannel"), "backchannel").when(c("participant_question"), "participant question")
        .when(c("n_words") < study.min_words, "too short").otherwise("")
    )
    return out.withColumn("drop_reason", reason).withColumn("kept", c("drop_reason") == "")


def with_ids(answers: DataFrame, people: DataFrame) -> DataFrame:
    """Answers with participant_id, interviewer and answer_id; numbers run over the whole file, dropped answers included."""
    named = answers.join(people, "file")
    return named.withColumn("answer_id", F.format_string("%s_m%d_a%03d", "participant_id", "moment", "answer_no"))


def moment_sources(answers: DataFrame, scenes: DataFrame, unrecognised: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(file, source1, source2, source3, outcome, scene, confidence, evidence, present, notes, status) of every file with answers.

    A source is own, copied_from_moment1, missing or ambiguous. If exactly one of moments 2 and 3 has no kept answers while moment 1
    has some, outcome says why it is copied or not: ambiguous (an announcement went unrecognised), elsewhere (moment 1 is clearly
    about another scene), off (no_fill), else copied: confirmed, among several, unconfirmed or unknown. notes holds (severity,
    check, detail) of F17 to F27. status is ok if every source is own or copied, else review.
    """
    c = F.col
    kept = answers.groupBy("file").agg(*[F.coalesce(F.bool_or(c("kept") & (c("moment") == m)), F.lit(False)).alias(f"has{m}") for m in (1, 2, 3)])
    odd = unrecognised.groupBy("file").agg(F.min("turn_idx").alias("odd"))
    s = kept.join(scenes, "file", "left").join(odd, "file", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    s = s.withColumn("lone", F.when(c("has1") & c("has2") & ~c("has3"), 3).when(c("has1") & c("has3") & ~c("has2"), 2))
    s = s.withColumn("wanted", F.coalesce(*[F.when(c("lone") == m, scene) for m, scene in study.skipped.items()]))
    inside, clear, several = F.array_contains("present", c("wanted")), c("confidence") == "clear", F.size("present") > 1
    s = s.withColumn(
        "outcome",
        F.when(c("lone").isNull(), None).when(c("odd").isNotNull(), "ambiguous").when(clear & ~inside, "elsewhere").when(F.lit(study.no_fill), "off")
        .when(clear & (c("scene") == c("wanted")), "confirmed").when(inside & several, "among several").when(inside, "unconfirmed").otherwise("unknown"),
    )
    copied = c("outcome").isin("confirmed", "among several", "unconfirmed", "unknown")
    source = lambda m: (
        F.when(c(f"has{m}"), "own").when((c("lone") == m) & copied, "copied_from_moment1").when((c("lone") == m) & (c("outcome") == "ambiguous"), "ambiguous").otherwise("missing")
    )
    none = ~c("has2") & ~c("has3")
    twice = F.get(F.array_intersect("present", F.array(*map(F.lit, study.skipped.values()))), F.lit(0))
    said = [
        (~c("has1"), "ERROR", F.lit("no text of moment 1")),
        (c("outcome") == "ambiguous", "ERROR", F.format_string("moment %d missing, announcement at turn %d unrecognised", "lone", "odd")),
        (c("outcome") == "elsewhere", "WARN", F.format_string("moment %d missing, moment 1 is about %s", "lone", "scene")),
        (c("outcome") == "confirmed", "INFO", F.format_string("moment %d copied, scene %s confirmed", "lone", "wanted")),
        (c("outcome") == "among several", "INFO", F.format_string("moment %d copied, %s among several scenes", "lone", "wanted")),
        (c("outcome") == "unconfirmed", "WARN", F.format_string("moment %d copied, %s not confirmed", "lone", "wanted")),
        (c("outcome") == "unknown", "WARN", F.format_string("moment %d copied, scene %s is not %s", "lone", "scene", "wanted")),
        (none, "ERROR", F.lit("moments 2 and 3 missing")),
        (c("lone").isNull() & ~none & c("odd").isNotNull(), "WARN", F.format_string("announcement at turn %d unrecognised, check the moments' bounds", "odd")),
        (c("has1") & c("has2") & c("has3") & twice.isNotNull(), "INFO", F.format_string("scene %s told twice", twice)),
        (several & (F.coalesce("outcome", F.lit("")) != "among several"), "INFO", F.concat(F.lit("moment 1 covers "), F.array_join("present", "+"))),
    ]
    notes = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit("moments").alias("check"), detail.alias("detail"))) for when, severity, detail in said]))
    good = lambda m: c(f"source{m}").isin("own", "copied_from_moment1")
    out = s.select("file", *[source(m).alias(f"source{m}") for m in (1, 2, 3)], "outcome", "scene", "confidence", "evidence", "present", notes.alias("notes"))
    return out.withColumn("status", F.when(good(1) & good(2) & good(3), "ok").otherwise("review"))


def materialise(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Kept answers by segment: full has every answer once; a copied moment has the answers of moment 1, which keep moment and id."""
    kept = answers.where("kept")
    plan = sources.select("file", F.explode(F.array(
        *[F.struct(F.lit("full").alias("segment"), F.lit(m).alias("moment"), F.lit("own").alias("moment_source")) for m in (1, 2, 3)],
        *[F.struct(F.lit(f"moment{m}").alias("segment"), F.when(F.col(f"source{m}") == "copied_from_moment1", 1).otherwise(m).alias("moment"), F.col(f"source{m}").alias("moment_source")) for m in (1, 2, 3)],
    )).alias("s")).select("file", "s.*").where("moment_source IN ('own', 'copied_from_moment1')")
    return kept.join(plan, ["file", "moment"])
