"""Phases of an interview: opening, prompts, moment labels, leading readiness replies, candidates with context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study
from loomspeak.functions import text as T
from loomspeak.functions.regex import java


def with_roles(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Turns with is_participant by the speaker label."""
    return turns.withColumn("is_participant", F.coalesce(F.col("speaker").rlike(java(study.participant, True)), F.lit(False)))


def with_text_flags(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Turns with what the rules ask of a text, computed once: clean_h, ready, backchannel, question, transition, reply."""
    c = F.col("clean_h")
    return turns.withColumn("clean_h", T.clean_text(F.coalesce("text", F.lit("")), True, study)).select(
        "*", T.is_ready(c, study).alias("ready"), T.is_backchannel(c, study).alias("backchannel"), T.is_question(c, study).alias("asks"),
        T.is_transition(c, study).alias("transition"), T.is_prompt_reply(c, study).alias("reply"),
    )


def file_people(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(file, participant_id, interviewer): the first participant label, and the first label that is neither that nor missing."""
    return turns.groupBy("file").agg(
        F.min_by(F.when(F.col("is_participant"), F.col("speaker")), F.when(F.col("is_participant"), F.col("turn_idx"))).alias("participant_id"),
        F.min_by("speaker", F.when(~F.col("is_participant") & (F.col("speaker") != study.no_label), F.col("turn_idx"))).alias("interviewer"),
    )


def with_prompts(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Turns with prompt: the interviewer's words from here until the participant's first real answer, and prompt_turns."""
    ahead = Window.partitionBy("file").orderBy("turn_idx").rowsBetween(0, study.prompt_turns - 1)
    seen = F.collect_list(F.struct((F.col("is_participant") & ~F.col("reply")).alias("answers"), "is_participant", F.coalesce("text", F.lit("")).alias("text"))).over(ahead)
    numbered = F.transform(F.col("ahead"), lambda x, i: F.struct(x["answers"].alias("answers"), i.alias("i")))
    # The turn itself belongs to its prompt whatever it is.
    stop = F.coalesce(F.get(F.filter(numbered, lambda x: x["answers"] & (x["i"] > 0)), F.lit(0))["i"], F.size("ahead"))
    return turns.withColumn("ahead", seen).withColumn("prompt_turns", stop).withColumn(
        "prompt", F.array_join(F.transform(F.filter(F.slice("ahead", F.lit(1), F.col("prompt_turns")), lambda x: ~x["is_participant"]), lambda x: x["text"]), " ")
    ).drop("ahead")


def segment(turns: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Turns of files with an opening, with moment (0: before it), evocation, unrecognised, and the starts of the moments.

    Moment 2 begins at the first announcement whose prompt is about topic 2 and not topic 3; moment 3 at the first about
    topic 3 after that. evocation: readiness replies before the participant's first real answer of a moment.
    unrecognised: an announcement that is part of neither prompt. Needs with_roles and with_text_flags.
    """
    of_file = Window.partitionBy("file")
    interviewer = ~F.col("is_participant")
    prompts = with_prompts(turns, study)
    m1 = F.min(F.when(interviewer & F.col("text").rlike(java(study.opening, True)), F.col("turn_idx"))).over(of_file)
    announced = interviewer & F.col("transition")
    about2 = F.col("prompt").rlike(java(study.topic2, True)) & ~F.col("prompt").rlike(java(study.topic3, True))
    about3 = F.col("prompt").rlike(java(study.topic3, True))
    out = prompts.withColumn("m1", m1).where("m1 IS NOT NULL")
    out = out.withColumn("m2", F.min(F.when(announced & about2 & (F.col("turn_idx") >= F.col("m1")), F.col("turn_idx"))).over(of_file))
    after = F.coalesce("m2", F.col("m1") - 1)
    out = out.withColumn("m3", F.min(F.when(announced & about3 & (F.col("turn_idx") > after), F.col("turn_idx"))).over(of_file))
    moment = (
        F.when(F.col("turn_idx") < F.col("m1"), 0).when(F.col("turn_idx") >= F.col("m3"), 3).when(F.col("turn_idx") >= F.col("m2"), 2).otherwise(1)
    )
    so_far = Window.partitionBy("file", "moment").orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    real = (F.col("is_participant") & ~F.col("ready") & ~F.col("backchannel") & ~F.col("asks")).cast("int")
    ends = lambda m: F.max(F.when(F.col("turn_idx") == F.col(m), F.col(m) + F.col("prompt_turns"))).over(of_file)
    covered = lambda m: F.coalesce((F.col("turn_idx") >= F.col(m)) & (F.col("turn_idx") < F.col(f"{m}_end")), F.lit(False))
    out = out.withColumn("moment", moment).withColumn("real_before", F.sum(real).over(so_far)).withColumn("m2_end", ends("m2")).withColumn("m3_end", ends("m3"))
    return out.withColumn(
        "evocation", F.col("is_participant") & F.col("ready") & (F.col("moment") > 0) & (F.col("real_before") == 0)
    ).withColumn("unrecognised", announced & (F.col("moment") > 0) & ~covered("m2") & ~covered("m3")).drop("real_before", "m2_end", "m3_end", "prompt", "prompt_turns")


def candidates(turns: DataFrame, pattern: str, around: int = 0) -> DataFrame:
    """Turns whose text matches pattern, and `around` turns on either side: candidate tells which."""
    hit = F.coalesce(F.col("text").rlike(java(pattern, True)), F.lit(False))
    near = Window.partitionBy("file").orderBy("turn_idx").rowsBetween(-around, around)
    return turns.withColumn("candidate", hit).withColumn("shown", F.max("candidate").over(near)).where("shown").drop("shown")
