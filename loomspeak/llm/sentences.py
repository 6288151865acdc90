"""Sentence boundaries across languages and scripts.

Every mark that may end a sentence is judged by unambiguous occurrences elsewhere:

* in the document: a word that stands elsewhere without a full stop is no abbreviation, one that stands elsewhere with a
  full stop before a digit or a comma is one; a word capitalised within a sentence and nowhere written small is a name,
  before which an abbreviation goes on, unless it is one that mostly closes a phrase (CLOSING);
* in the corpus, where the document has nothing: the same counts over all texts, gathered in one pass that leaves one
  row a word and block. What is kept is all words of at most LONGEST letters nearly always followed by a full stop that mostly
  doesn't end a sentence, and all words that begin sentences and stand after a closing mark, where they are asked for;
* by script: ideographic, Devanagari, Ethiopic and Arabic marks, the Greek question mark, Thai polite particles.

Marks inside a quotation or bracket, of any length within its paragraph, don't end the sentence around it. A quotation that opens a sentence is followed by
whom it is ascribed to; one at the end of a sentence ends it if another begins after it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspeak.runtime import first_delivery, stage

#: Letters of the longest abbreviation that the corpus may teach.
LONGEST = 12
#: Of a longer chain of letters and full stops only the end is looked at: neither an abbreviation nor a number is as long.
LONG_FORM = 64

#: Common abbreviations. TITLES stand before a name or number, so even a capital after them goes on.
TITLES = frozenset(
    "dr prof mr mrs ms mx messrs st rev gen col sgt capt lt hon sr sra srta dra dña d hr fr frl mme mlle m mm me pr ing dipl "
    "no nos nr fig figs ver vol vols pp art abs kap bd tab eq sec ch ed cf vgl núm num pág págs p s "
    "mon tue tues wed thu thur thurs fri sat sun jan feb mar apr jun jul aug sep sept oct okt nov dec dez "
    "κ κα δρ καθ σελ д г डॉ श्री د أ".split()
)
ABBREVIATIONS = frozenset(
    "approx etc min max vs ca env aprox ej ex e.g i.e a.m p.m u.a z.b d.h usw bzw evtl ggf inkl inc ltd corp dept est "
    "ung std sek hrs hr mins secs tel ext resp u.s u.k a.d b.c d.c al ibid op cit π.χ κ.λπ κλπ δηλ".split()
)
#: Of these, what mostly closes a phrase: a name after it may well begin a sentence.
CLOSING = frozenset("etc usw κ.λπ κλπ a.m p.m al inc ltd corp dept u.s u.k a.d b.c d.c hrs hr mins min secs sek std".split())
#: Of these, ordinary words too: written small and not before a number they count as words unless the corpus says otherwise.
ORDINARY = frozenset("sun sat art ed sec mar cap me ing abs tab hon col rev gen ch fig wed max inc est ext tel".split())
#: Words after a closing quotation that carry the sentence on.
CARRY_ON = frozenset(
    "and but or nor then as while before because so when until with without though although "
    "y e o pero mientras cuando sin con luego et mais ou puis pendant quand sans und aber oder dann während wobei als ohne "
    "και αλλά ή μετά e ma o mas".split()
)
SAYING = frozenset(
    "asked thought said wondered whispered cried shouted replied answered told yelled called added murmured kept muttered "
    "pensé pregunté dije dijo preguntó pensó grité susurré pensai demandai dit demanda pensa dachte fragte sagte rief flüsterte".split()
)
#: German: a number and a full stop after these are an ordinal.
ORDINAL_AFTER = frozenset("am im der die das den dem des vom zum beim ab bis seit jeder jede jedes jeden zur ihr ihre ihren sein seine seinen mein meine meinem meinen unser und".split())
THAI_FINAL = ("ค่ะ", "คะ", "ครับ", "จ้ะ", "จ๊ะ", "จ้า", "ฮะ", "นะ", "ขา")

OPEN = {"“": "”“", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "【": "】", "（": "）", "(": ")", "[": "]", "‘": "’", '"': '"', "'": "'", "‚": "‘’"}
BRACKETS = frozenset("([（【")
CLOSERS = frozenset("”»›」』》】）)]\"’“")
HARD = "。！？｡．॥।።፧፨؟۔‼⁇⁈⁉"
INVISIBLE = "­​‌‍‎‏⁠﻿"
_SKIP = rf"[\s{INVISIBLE}]*"
EVENT = re.compile(
    rf"\.(?=\d)|…[….]*|\.[{INVISIBLE}]*\.[.…]*|[.!?{HARD}][!?{HARD}]*|[;;]|[“”„«»‹›「」『』《》【】（）()\[\]‘‚\"]|(?<![\w])'(?=\w)|(?<=[.!?,;])[’'](?!\w)|\n\s*\n"
    rf"|(?<=[฀-๿])[    ]+"
)
GAP = re.compile(_SKIP)
WORD = re.compile(rf"[^\W_][\w’'{INVISIBLE}]*")
_INV = re.compile(f"[{INVISIBLE}]")
_NO_END = re.compile(r"(?<=[^\W\d_])\.(?:,|\s\d)")
_INSIDE = re.compile(r"([^\W\d_])(?=,?[^\S\r\n]+([^\W\d_]+))")
_LETTERS = re.compile(r"[^\W\d_]+")
_FIND = {"paragraph": re.compile(r"\n\s*\n"), "opening": re.compile(r"(?<!\w)'(?=\w)"), "closing": re.compile(r"(?<=[.!?,])'(?!\w)")}


@dataclass(frozen=True)
class Model:
    """What the corpus says of words: abbreviations, and words that begin sentences, in lower case."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()


@dataclass
class _Document:
    """Evidence of the document itself, gathered when first asked for."""

    text: str
    _bare: Counter | None = field(default=None)
    _abbreviated: set[str] | None = field(default=None)
    _names: set[str] | None = field(default=None)
    _places: dict[str, list[int]] = field(default_factory=dict)
    _seen: tuple[int, int] = (-2, -2)

    def left(self, at: int) -> int:
        """Where the word before `at` begins, inner full stops included; a word is walked through once, however many stops it has."""
        text, j = self.text, at
        while j > 0:
            if j == self._seen[0] + 1 and text[j - 1] == ".":
                j = self._seen[1]
                break
            c = text[j - 1]
            if not (c.isalnum() or c == "." or c in INVISIBLE or unicodedata.combining(c) or unicodedata.category(c)[0] == "M"):
                break
            j -= 1
        self._seen = (at, j)
        while j < at and text[j] == ".":
            j += 1
        return j

    def after(self, what: str, at: int) -> int:
        """The first place at or beyond `at` of a mark or of what _FIND calls so; the text's length without one."""
        if what not in self._places:
            self._places[what] = [m.start() for m in (_FIND[what] if what in _FIND else re.compile(re.escape(what))).finditer(self.text)]
        places = self._places[what]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else len(self.text)

    def closes(self, mark: str, at: int) -> bool:
        """Whether what the mark before `at` opens is closed: in the same paragraph, and a quotation before the next one opens."""
        end = self.after("paragraph", at)
        if mark == "'":
            closing = self.after("closing", at)
            return closing < end and closing < self.after("opening", at)
        closing = min(self.after(x, at) for x in OPEN[mark])
        return closing < end and (mark in BRACKETS or mark in OPEN[mark] or closing < self.after(mark, at))

    def bare(self, word: str) -> bool:
        """Stands elsewhere within a sentence without a full stop."""
        if self._bare is None:
            self._bare = Counter(w for w, stop in re.findall(r"([^\W\d_]+)(\.?)(?=\s+\w|,)", self.text) if not stop)
        return self._bare[word] > 0

    def abbreviated(self, word: str) -> bool:
        """Stands elsewhere with a full stop that ends nothing, before a comma or a number, and nowhere without."""
        if self._abbreviated is None:
            stops = (m.start() for m in _NO_END.finditer(self.text))
            self._seen = (-2, -2)
            self._abbreviated = {_INV.sub("", self.text[max(self.left(at), at - LONG_FORM) : at]) for at in stops}
            self._seen = (-2, -2)
        return word in self._abbreviated and not self.bare(word)

    def name(self, word: str) -> bool:
        """Stands elsewhere capitalised within a sentence, and nowhere in lower case."""
        if self._names is None:
            inside = {w for before, w in _INSIDE.findall(self.text) if before.islower() and w[0].isupper()}
            self._names = {w for w in inside if w != "I"} - {w.capitalize() for w in _LETTERS.findall(self.text) if w.islower()}
        return word in self._names


def _ends_with_stop(doc: _Document, text: str, at: int, nxt: int, model: Model) -> bool:
    """Whether the single full stop at `at` ends a sentence; text[nxt] is the next visible character."""
    c = text[nxt]
    if c in ",;:)]…" or (c in "-–—" and text[nxt + 1 : nxt + 2].isspace() is False and nxt == at + 1):
        return False
    gap = nxt > at + 1
    first = doc.left(at)
    if first == at:
        return True  # after a bracket, a symbol
    left = text[max(first, at - LONG_FORM) : at]
    if not left.isascii():
        left = _INV.sub("", left)
    low = left.lower()
    if gap and len(left) > 2 and c.isupper() and left.isalpha() and (
        (low not in TITLES and low not in ABBREVIATIONS or low in ORDINARY and left == low) and low not in model.abbreviations
        and not (len(left) <= 5 and doc.abbreviated(left))
    ):
        return True
    word = WORD.match(text, nxt)
    right = _INV.sub("", word.group()) if word else ""
    upper = bool(right) and right[0].isupper()
    lower = bool(right) and right[0].islower()
    if left.isdigit() or left.replace(".", "").isdigit():
        if not gap and c.isdigit():
            return False
        before = re.search(r"([^\W\d_]+)\s+$", text[max(0, first - 14) : first])
        if len(left) <= 2 and before and before.group(1).lower() in ORDINAL_AFTER and right:
            return False
        return gap or upper
    letters = left.replace(".", "")
    if len(letters) == 1 and "." not in left:
        if letters == "I" and not (len(right) == 1):
            return not lower
        return not right  # an initial, or part of a shortened form such as "p. ej."
    if not gap and lower and len(right) == 1:
        return False  # "e.g", "a.m"
    known = low in TITLES or low in ABBREVIATIONS or low in model.abbreviations or ("." in left and len(letters) <= 4)
    if low == "no" and not c.isdigit():
        known = False
    if known and low not in TITLES and low not in ABBREVIATIONS and doc.bare(left):
        known = False
    if low in ORDINARY and left == low and not c.isdigit() and low not in model.abbreviations:
        known = False
    if not known:
        known = (upper or lower or c.isdigit()) and len(left) <= 5 and doc.abbreviated(left)
    if known:
        if low in TITLES:
            return not right
        if low == "etc" and lower:
            return right not in CARRY_ON
        if upper and low not in CLOSING and doc.name(re.split("['’]", right)[0]):
            return False
        return not lower and not c.isdigit() if right else c in "“„«\"'(¿¡—「（‘["
    if not gap:
        return upper or (lower and len(right) > 1) or not right or not c.isascii()
    return True


def _goes_on(text: str, nxt: int) -> bool:
    """A dash and a lower-case word: a remark and whom it is ascribed to."""
    m = re.compile(rf"[-–—―]+{_SKIP}").match(text, nxt)
    return bool(m) and text[m.end() : m.end() + 1].islower()


def _after_quote(text: str, nxt: int, bracket: bool, opened: bool, model: Model) -> bool:
    """Whether a sentence ends where a quotation or bracket with its own end mark closes.

    opened: it began the sentence; text[nxt] is the next visible character.
    """
    c = text[nxt]
    if c in ",;:.!?…" or c in HARD:
        return False
    if bracket and opened:
        return True
    if _goes_on(text, nxt):
        return False
    word = WORD.match(text, nxt)
    right = _INV.sub("", word.group()) if word else ""
    if not right:
        return c not in "-–—"
    if right[0].islower():
        if opened or bracket or right in CARRY_ON:
            return False
        return right in model.starters
    if right[0].isupper():
        if opened:
            following = [m.group().lower() for m in islice(_LETTERS.finditer(text, nxt), 3)]
            return not any(w in SAYING for w in following[1:])
        return not (bracket and right == "I")
    return right[0].isdigit() and not bracket  # scripts without case carry on


def split(text: str, model: Model = Model()) -> list[tuple[int, int]]:
    """(start, end) of the sentences of text, in code points; none for a blank text."""
    doc = _Document(text)
    n = len(text)
    out: list[tuple[int, int]] = []
    begin = GAP.match(text).end()
    stack: list[tuple[str, int, bool]] = []
    inner = -1  # end of the last end mark within the open quotation

    def cut(end: int) -> None:
        nonlocal begin
        while end < n and text[end] in CLOSERS and (text[end] not in "\"“" or not (end + 1 < n and (text[end + 1].isalnum()))):
            end += 1
        if end > begin:
            out.append((begin, end))
            begin = GAP.match(text, end).end()

    for m in EVENT.finditer(text):
        s, e = m.span()
        if s < begin:
            continue
        mark = text[s]
        if mark == "\n":
            stack.clear()
            if text[begin:s].strip():
                cut(len(text[:s].rstrip()))
            continue
        if mark.isspace():
            if not stack and text[:s].endswith(THAI_FINAL) and not text.startswith("ๆ", e):
                cut(s)
            continue
        if stack and mark in OPEN[stack[-1][0]] and not (mark in "’'" and text[e : e + 1].isalnum()):
            kind, _, opened = stack.pop()
            if not stack and inner >= 0 and not text[inner:s].strip(f"    {INVISIBLE}"):
                nxt = GAP.match(text, e).end()
                if nxt >= n or _after_quote(text, nxt, kind in BRACKETS, opened, model):
                    cut(e)
            inner = -1
            continue
        if mark in OPEN and not (mark == '"' and s and not text[s - 1].isspace() and text[s - 1] not in "([（—–-" and text[s - 1].isascii() and text[s - 1] not in ".!?"):
            if doc.closes(mark, e):
                stack.append((mark, s, s == begin))
                inner = -1
            continue
        if mark in OPEN or mark in CLOSERS or mark == "'":
            continue
        if mark in ";;":
            if not stack and s and "Ͱ" <= text[s - 1] <= "῿" and (mark == ";" or e >= n or text[e].isspace()):
                cut(e)
            continue
        if stack:
            inner = e
            continue
        nxt = GAP.match(text, e).end()
        if nxt >= n:
            cut(e)
            break
        if e - s == 1 and mark == ".":
            if not text.startswith(tuple("0123456789"), e) and _ends_with_stop(doc, text, s, nxt, model):
                cut(e)
            elif text[e : e + 1].isdigit() and s and text[s - 1].isalpha() and s - doc.left(s) > 2:
                cut(e)
        elif mark == "…" or text[s : s + 2] == "..":
            c = text[nxt]
            quoted = c in "“„«\"(¿¡「（—" and not _goes_on(text, nxt)
            if c.isupper() or quoted or (c.isdigit() and nxt > e and s and not text[s - 1].isspace()):
                cut(e)
        elif text[nxt] in ",;:" or _goes_on(text, nxt):
            continue
        else:
            cut(e)
    if begin < n and text[begin:].strip(f" \t\r\n   　{INVISIBLE}"):
        end = n
        while end > begin and (text[end - 1].isspace() or text[end - 1] in INVISIBLE):
            end -= 1
        if re.search(r"\w", text[begin:end]) or not out:
            out.append((begin, end))
        else:
            out[-1] = (out[-1][0], end)
    return out


_TOKEN = re.compile(r"([^\W\d_]+(?:\.[^\W\d_]{1,2})*)(\.(?!\.)\s*(\S)?)?")
_START = re.compile(r"[.!?]\s+([^\W\d_]+)\s")
_AFTER = re.compile(rf"[{re.escape(''.join(sorted(set(''.join(OPEN.values())))))}](?={_SKIP}({WORD.pattern}))")


def learn(texts: DataFrame, text_col: str) -> Model:
    """Corpus counts of words before a full stop and of words that begin sentences, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare: Counter = Counter()
        stop: Counter = Counter()
        inside: Counter = Counter()
        start: Counter = Counter()
        after: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(bare.keys() | stop.keys() | inside.keys() | start.keys() | after.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (bare, stop, inside, start, after))],
                names=["word", "bare", "stop", "inside", "start", "after"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for w, dot, nxt in _TOKEN.findall(text):
                    if not dot:
                        bare[w.lower()] += 1
                    elif nxt:
                        w = w.lower()
                        stop[w] += 1
                        if nxt.islower() or nxt.isdigit() or nxt in ",;:":
                            inside[w] += 1
                for w in _START.findall(text):
                    if w[0].isupper():
                        start[w.lower()] += 1
                for w in _AFTER.findall(text):
                    if w[0].islower():
                        after[_INV.sub("", w)] += 1
        yield from out()

    columns = ("bare", "stop", "inside", "start", "after")
    counts = (
        texts.select(F.col(text_col)).where(f"`{text_col}` IS NOT NULL").mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in columns))
        .groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))
    )
    words = stage(
        counts.withColumn("abbreviation", (F.col("stop") >= 4) & (F.length("word") <= LONGEST) & (F.col("bare") * 8 <= F.col("stop")) & (F.col("inside") * 2 >= F.col("stop")))
        .withColumn("starter", (F.col("start") >= 3) & (F.col("after") > 0))  # asked only of words after a quotation
        .where("abbreviation OR starter").select("word", "abbreviation", "starter"),
        "sentence-words",
    )
    rows = words.collect()
    return Model(frozenset(r.word for r in rows if r.abbreviation), frozenset(r.word for r in rows if r.starter))


def sentences(df: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """(id, start_char, end_char): the sentences of the first delivery of every record, in code points of the raw text.

    Null and blank texts have no row; rows without id are records of their own; of an id given several times the row first
    by order_col counts; an empty table gives no rows. Texts of any length are read whole. Other columns aren't read.
    """
    part = df.select(F.col(id_col).alias("id"), F.col(order_col).alias("at"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    model = df.sparkSession.sparkContext.broadcast(learn(part, "t"))  # words, not texts: abbreviations of at most 6 letters, and what begins sentences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            spans = [split(t, m) for t in batch.column(2).to_pylist()]
            flat = [[x for s in one for x in s] for one in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int32()))], names=["id", "at", "spans"])

    types = dict(part.dtypes)
    cut = part.mapInArrow(run, f"id {types['id']}, at {types['at']}, spans array<int>")
    once = first_delivery(cut, ["id"], ["at"])
    return once.where("size(spans) > 0").select("id", F.explode(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1)).alias("k"), "spans").select(
        "id", F.get("spans", F.col("k") * 2).alias("start_char"), F.get("spans", F.col("k") * 2 + 1).alias("end_char")
    )
