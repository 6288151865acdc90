from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomspeak.llm import sentences as S

MODEL = S.Model(frozenset({"approx"}), frozenset({"the", "it", "some"}))
CASES = [
    ["He came back.", "For some reason the door was open."],
    ["It was 8.30 a.m. when the bell rang.", "It took approx. 3.4 minutes, maybe less."],
    ["We met at St. Varvotan on Mon. morning.", "Prof. Agor and Mrs. Tin were there."],
    ["P. F. Riretan used to sing.", "No, no, not that!!", "What was it doing there?!", "the clip ended."],
    ["I thought of No. 23 on the list.", "All came back: the cup, the light, etc.", "The moss, the oar etc. and so on, all green."],
    ["She called out \"No!\" and the gate shut.", "He whispered, \"Stop now. Stay here.\" and left."],
    ["My brother said, “It is only a wind.”", "It ended there."],
    ["“Why the raft? Why now?” she kept saying.", "\"Is it gone?\" I asked myself.", "Maybe."],
    ["It was (how do I say this?) almost low.", "(It sounds odd, I know.)", "The end"],
    ["I felt it ... not sharp, just open.", "It simply dissolved...", "The rest was calm…", "Nothing"],
    ["it was... how to put it, thin.", "some of it was loud."],
    ["She told me 'leave it. leave it.' and rattled.", "Fine."],
    ["Es dauerte ca. 3,9 Minuten, z. B. wie hier.", "Am 16. April war ich da.", "Hr. Braluwen fragte: „War das alles?“ und ging.", "„Bleib hier. Bitte.“, sagte er."],
    ["La Sra. Fem dijo: «Espera. No mires.» y se fue.", "¿Por qué?", "—¿Y la vela? —pregunté en voz baja.", "Duró aprox. 5,2 minutos, p. ej. aquí."],
    ["M. Loth a dit : « Restez ici. Ne bougez pas. » et la bougie est tombée.", "« Où est-elle ? » ai-je pensé.", "Quelle porte !", "Oui."],
    ["Γιατί ήταν τόσο ελαφρύ;", "Ο κ. Βελμάς είπε: «Μείνε εδώ. Μη μιλάς.» και έφυγε."],
    ["डॉ. वेलमा ने कहा, \"रुको। यहीं रहो।\" और सब चुप रहे।", "यह 8.6 मिनट चला।"],
    ["قال د. فلمار إنه كان هنا.", "قالت: «توقف. ابق هنا.» ثم مضت.", "هل كان حقا؟"],
    ["ለምን ከባድ ሆነ፧", "ደረቴ ከባድ ነበር።"],
    ["ฉันรู้สึกว่าหน้าอกเย็นมากค่ะ", "มันนานประมาณ 1.3 นาทีครับ", "ตอนนั้นดูมืดจริง ๆ ค่ะ"],
]
JOINED = [["他说：“停下。别动。”然后屋顶碎了。", "真的太轻松了！", "“钟声在哪里？”我问自己。"], ["「もういい。帰ろう。」と彼は言いました。", "（鐘のことです。）", "えっと…鋭いような、うまく言えません。", "本当に怖かった！"]]


@pytest.mark.parametrize("want", CASES, ids=lambda c: c[0][:20])
def test_sentences_between_blanks(want):
    for gap in (" ", "  ", " "):
        text = gap + gap.join(want) + " "
        assert [text[a:b] for a, b in S.split(text, MODEL)] == want


@pytest.mark.parametrize("want", JOINED, ids=lambda c: c[0][:6])
def test_sentences_without_blanks(want):
    text = "".join(want)
    assert [text[a:b] for a, b in S.split(text, MODEL)] == want


def test_no_blank_after_the_mark_and_long_text():
    text = "The water was calm.Some tenderness came.It ended."
    assert [text[a:b] for a, b in S.split(text)] == ["The water was calm.", "Some tenderness came.", "It ended."]
    long = "A short one came by. " * 20_000
    assert len(S.split(long)) == 20_000


@given(st.text(alphabet="aB .!?…\"“”()'«»。「」1,\n​ๆค", max_size=60))
def test_spans_cover_all_but_blanks(text):
    spans = S.split(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    rest = list(text)
    for a, b in spans:
        assert not text[a].isspace() and not text[b - 1].isspace()
        rest[a:b] = [" "] * (b - a)
    assert not "".join(rest).strip(" \n​")


def test_document_evidence_beats_the_corpus():
    model = S.Model(frozenset({"oar"}), frozenset())
    assert len(S.split("I took the oar, it was wet. I lost the oar. it sank.", model)) == 3
    assert len(S.split("He lost the oar. it sank.", model)) == 1


def test_frame(spark):
    rows = [("a", 2, "late. Text."), ("a", 1, "One. Two"), ("b", 1, None), ("c", 1, " \n "), (None, 1, "Hm."), ("d", 1, ""), ("e", 1, "x")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "answer_id string, loaded_at int, cleaned_reflection string, spans int")
    got = sorted((str(r.id), r.start_char, r.end_char) for r in S.sentences(df, "answer_id", "loaded_at", "cleaned_reflection").collect())
    assert got == [("None", 0, 3), ("a", 0, 4), ("a", 5, 8), ("e", 0, 1)]
    assert S.sentences(df.limit(0), "answer_id", "loaded_at", "cleaned_reflection").collect() == []


def test_model_is_learned_from_the_corpus(spark):
    texts = ["It took blrg. 3 days. Then we left home.", "about blrg. two hours. Then rain fell.", "with blrg. four. Then he slept. “No.” then he left."] * 3
    model = S.learn(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert "blrg" in model.abbreviations and "then" in model.starters and "home" not in model.abbreviations


def test_quotations_and_words_of_any_length():
    for inner in (30, 60, 400):
        text = "He said “" + "I saw it there. " * inner + "Now go” and left. Then it rained."
        assert S.split(text) == [(0, text.index("Then it rained") - 1), (text.index("Then it rained"), len(text))]
    assert len(S.split("He said “I saw it. Then it fell.\n\nA door opened. “Go” was all.")) == 4  # never closed in its paragraph
    assert len(S.split("x" * 60_000 + ". " + "Then he left.")) == 2
    assert S.split("a.b." * 20_000)


def test_bare_uses_in_other_partitions_count(spark):
    texts = ["we saw the oar. 5 more came"] * 4 + ["we took an oar and left"] * 40
    df = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in texts], 11), "t string")
    assert "oar" not in S.learn(df, "t").abbreviations


def test_the_model_is_not_cut(spark):
    texts = ["It took blrg. 3 days. Then we left home.", "with blrg. four. Some slept. He said “no.” some left."] * 3
    texts += ["with krtz. 4 men. Then it fell. Then it rose. Then it ended."] * 5
    model = S.learn(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert {"blrg", "krtz"} <= model.abbreviations and "some" in model.starters


def test_an_abbreviation_of_the_document_goes_on_before_its_names():
    proof = "It was in abcd. 5, near Berlin again. "
    assert len(S.split(proof + "He left abcd. Berlin at night.")) == 2
    assert len(S.split("It was abcd., we saw Berlin. He left abcd. Berlin at night.")) == 2
    assert len(S.split(proof + "He left the abcd. Then it rained.")) == 3
    assert len(S.split("We saw Berlin and an abcd near it. He left the abcd. Berlin was dark.")) == 3


def test_a_listed_abbreviation_goes_on_before_a_name_only():
    assert len(S.split("We met Varvotan there. We saw approx. Varvotan as he was.", MODEL)) == 2
    assert len(S.split("It took approx. Varvotan as he was.", MODEL)) == 2
    assert len(S.split("We met Varvotan there. We had oars, cups etc. Varvotan was there.", MODEL)) == 3
    assert len(S.split("He said Some and some more. We had approx. Some were there.", MODEL)) == 3
