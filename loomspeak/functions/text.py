"""Scalar text functions as columns: everything stays in the JVM. A null text gives null, or false for predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspeak.config import DEFAULT, Study
from loomspeak.functions.regex import BLANK, WORD, any_of, java

ANNOTATION = java(r"\([^()\[\]]*\)|\[[^()\[\]]*\]|\([^()\[\]]{0,20}\]|\[[^()\[\]]{0,20}\)")
BRACKET = java(r"[()\[\]]")
CONTINUES = r"(?:\.\.\.|…|[-–—])"
ENDS_OPEN = java(rf"{CONTINUES}\s*$")
STARTS_OPEN = java(rf"^\s*{CONTINUES}")
REPETITION = java(r"\b(\w+)(?:[\s,.-]+\1\b)+", True)
LETTERS = r"[\p{L}\p{Nl}\p{No}]"


def strip(c: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(c, rf"(?Ud)^[{BLANK}]+|[{BLANK}]+$", "")


def stray_annotation(study: Study = DEFAULT) -> str:
    return java(rf"[(\[]\s*(?:{study.annotation_words})\b|\b(?:{study.annotation_words})\s*[)\]]", True)


def hesitation(study: Study = DEFAULT) -> str:
    return java(r"(?:,\s*)?" + any_of(study.hesitations) + r"(?:\s*,)?", True)


def remove_annotations(c: Column, study: Study = DEFAULT) -> Column:
    """Bracketed notes, notes with one bracket missing, then any bracket left."""
    c = F.regexp_replace(c, ANNOTATION, " ")
    c = F.regexp_replace(c, stray_annotation(study), " ")
    return F.regexp_replace(c, BRACKET, " ")


#: Tidying steps in order: pattern and replacement.
TIDY = (
    (r"\s+", " "),
    (r"([.!?…])\s+[.!?…]", "$1"),
    (r"\s+([,.!?;:…])", "$1"),
    (r",\s*(?=[,.!?;:…])", ""),
    (r"([.!?…])\s*,", "$1"),
    (r"^[\s,.;:!?…\-–—]+", ""),
    (r"(?:\s+[-–—]+|[–—]+)$", ""),
)


def clean_text(c: Column, hesitations: bool = False, study: Study = DEFAULT) -> Column:
    """Without annotations and, if asked, hesitations; punctuation tidied in fixed order."""
    c = remove_annotations(c, study)
    if hesitations:
        c = F.regexp_replace(c, hesitation(study), " ")
    for pattern, by in TIDY:
        c = F.regexp_replace(c, java(pattern), by)
    return strip(c)


def n_words(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(c, F.lit(f"[{WORD}]+"))


def n_tokens(c: Column) -> Column:
    """Pieces between blanks."""
    return F.regexp_count(c, F.lit(rf"(?Ud)[^{BLANK}]+"))


def words(c: Column) -> Column:
    """Lower-case words, joined by inner apostrophes or hyphens."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, "’", "'")), F.lit(rf"({LETTERS}+(?:['-]{LETTERS}+)*)"), 1)


def _plain_words(clean: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean), F.lit("([a-z]+)"), 1)


def is_ready(clean: Column, study: Study = DEFAULT) -> Column:
    """1 to ready_words words, all of readiness; of a text cleaned with hesitations removed."""
    w = _plain_words(clean)
    return F.coalesce(F.size(w).between(1, study.ready_words) & F.forall(w, lambda x: x.isin(*study.ready)), F.lit(False))


def is_backchannel(clean: Column, study: Study = DEFAULT) -> Column:
    """At most backchannel_words words, all acknowledgements; an empty text is one."""
    w = _plain_words(clean)
    return F.coalesce((F.size(w) <= study.backchannel_words) & F.forall(w, lambda x: x.isin(*study.backchannels)), F.lit(False))


def is_question(clean: Column, study: Study = DEFAULT) -> Column:
    """A short question."""
    return F.coalesce(clean.endswith("?") & n_words(clean).between(1, study.question_words), F.lit(False))


def is_transition(clean: Column, study: Study = DEFAULT) -> Column:
    """Announces another phase and doesn't put it off."""
    return F.coalesce(clean.rlike(java(study.transition, True)) & ~clean.rlike(java(study.deferral, True)), F.lit(False))


def is_prompt_reply(clean: Column, study: Study = DEFAULT) -> Column:
    """A reply that doesn't end the interviewer's prompt."""
    return is_backchannel(clean, study) | is_ready(clean, study) | is_question(clean, study) | F.coalesce(n_words(clean) <= study.reply_words, F.lit(False))


def join_continuation(texts: Column) -> Column:
    """One text of an ordered array of parts, without marks of continuation where they meet."""
    join = lambda a, b: F.concat(
        F.regexp_replace(F.regexp_replace(a, ENDS_OPEN, ""), rf"(?Ud)[{BLANK}]+$", ""), F.lit(" "), F.regexp_replace(F.regexp_replace(b, STARTS_OPEN, ""), rf"(?Ud)^[{BLANK}]+", "")
    )
    return F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), F.get(texts, F.lit(0)), join)


def split_sentences(c: Column) -> Column:
    """Parts after an end mark and blanks, without blank ones."""
    return F.filter(F.split(c, rf"(?Ud)(?<=[.!?…])[{BLANK}]+"), lambda s: strip(s) != "")


def to_seconds(c: Column) -> Column:
    """Seconds of H:MM:SS; null if it isn't that."""
    part = lambda i: F.get(F.split(c, ":"), F.lit(i)).cast("int")
    return F.when(c.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), part(0) * 3600 + part(1) * 60 + part(2))


def is_content_word(word: Column, study: Study = DEFAULT) -> Column:
    """Three letters or more, no stop word, filler or hesitation, and no contraction of a stop word."""
    fillers = {"actually", "basically", "well", "okay", "ok", "yeah", "like"} | (set(study.backchannels) - {"i", "see", "good"})
    stop = (set(study.stopwords) - {"won"}) | {"won't"}
    sound = "^(?:" + "|".join(study.hesitations) + ")$"
    return (F.length(word) >= 3) & ~word.isin(*sorted(stop | fillers)) & ~word.rlike(sound) & ~F.substring_index(word, "'", 1).isin(*sorted(stop))


def approximate_tokens(words_: Column, study: Study = DEFAULT) -> Column:
    return F.bround(words_ * F.lit(study.tokens_per_word), 0).cast("int")


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def annotation_counts(c: Column, study: Study = DEFAULT) -> tuple[Column, Column, Column]:
    """Numbers of annotations, stray brackets and hesitations, each on the text without the ones before."""
    rest = F.regexp_replace(c, ANNOTATION, " ")
    stray = stray_annotation(study)
    return (
        count(c, ANNOTATION) + count(rest, stray),
        count(F.regexp_replace(rest, stray, " "), BRACKET),
        count(remove_annotations(c, study), hesitation(study)),
    )


def filler_counts(c: Column, study: Study = DEFAULT) -> dict[str, Column]:
    """Occurrences by category, of hesitations too; phrases that only look like fillers don't count."""
    real = F.regexp_replace(c, java(any_of(study.not_filler[:-1]) + r"|\bwell-", True), " ")
    return {"hesitation": count(c, java(any_of(study.hesitations), True))} | {k: count(real, java(any_of(v), True)) for k, v in study.fillers.items()}


def n_repetitions(c: Column) -> Column:
    """Words said again at once."""
    return count(c, REPETITION)


def context(c: Column, word: Column, around: int = 40) -> Column:
    """The first occurrence of a word with `around` characters on either side; null without one."""
    at = F.call_function("instr", F.lower(c), F.lower(word))
    first = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, c.substr(first, at - first + F.length(word) + F.lit(around)))


def fingerprint(texts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the texts in order, each ended by NUL."""
    return F.left(F.sha2(F.concat(F.array_join(texts, "\0"), F.lit("\0")), 256), F.lit(16))
