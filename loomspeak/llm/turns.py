"""Speech transcripts into clean speaker turns.

Mining    Each raw field of a turn that has a layout (start, end, speaker label) is a line. Its tokens are masked: runs of
          digits are D, words W, marks stand for themselves. Executors fold lines to masked shapes and count them, so
          that a few rows a field come to the driver: the MAX_SHAPES most frequent shapes of times and labels. There a
          tree of fixed depth (field, number of tokens, first tokens) leads a shape to its leaf; within a leaf it joins the most
          similar template with slots at the same places that doesn't contradict it, whose differing tokens become <*>, or
          begins one. All other shapes share a template <*> by their number of slots.
Inference The digits of a time shape are slots of hours, minutes, seconds or fractions. Every reading that fits the
          number of slots is tried on all rows whose other time is in standard form; the one that agrees on most rows
          is the shape's. A shape without such rows has that of the template it joins, or the one that most rows of as many
          slots agree with. The parts of a label between brackets and other marks are its slots; the slot that most often
          names a person of the row's file is the template's. What is in the slot is compared with the people of the file
          by name, by id, by role, by initial, and with one edit; only where it says nothing are the other slots asked.
Rules     Pieces are cut at labels of another person, pieces in which nothing is said vanish, repetitions go, rows are put
          into spoken order and runs of one person's pieces become turns, by windows over the file.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspeak.runtime import first_delivery, stage

MAX_SHAPES = 2000
#: Files that the driver counts before it sends their people to all executors.
SMALL_FILES = 300_000
#: Tokens that lead to a leaf, children of a node before the wildcard takes over, and the share of equal tokens that joins.
DEPTH, CHILDREN, SIMILAR = 2, 40, 0.5

#: Words for the roles, in lower case without marks.
ROLES = {
    "participant": "participant", "interviewee": "participant", "subject": "participant", "respondent": "participant", "p": "participant", "part": "participant", "sub": "participant",
    "interviewer": "interviewer", "int": "interviewer", "i": "interviewer", "iv": "interviewer",
    "observer": "observer", "obs": "observer", "o": "observer", "observer1": "observer",
}
#: Sounds of hesitation; a letter may be drawn out.
HESITATION = re.compile(r"(?:u+h*m+|u+h+|e+r+m*|h+m+|m+h+m+|m+|ä+h*m*|ö+h*m*|e+h+m*|e+u+h+|h+e+u+|h+u+m+|a+h+m*|えっと|えーと|ええと|あのー|嗯+|呃+|อืม|เอ่อ)")
#: A note in brackets of a kind that is used for nothing else, or in single parentheses without an end mark.
NOTE = re.compile(r"\(\([^()]*\)\)|\[[^\[\]()]*[\])]|\{[^{}]*\}|<[^<>]*>|\*[^*\n]{1,40}\*|♪[^♪]*♪|\([^()\[\].!?。！？]{0,40}[\])]")
STANDARD = r"^\d{1,2}:\d{2}:\d{2}$"
_MARKS = re.compile(r"[\W_]+")

#: Readings of the slots of a time by their number: seconds that one unit of each slot is worth, 0 for a fraction.
READINGS = {1: ((1,), (60,)), 2: ((60, 1), (3600, 60), (1, 0)), 3: ((3600, 60, 1), (60, 1, 0)), 4: ((3600, 60, 1, 0),)}


class TokenTree:
    """Templates of token lists: a tree of fixed depth whose leaves hold templates with wildcards."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.templates: list[dict] = []

    def add(self, field: str, tokens: list[str], count: int, slot: object = None) -> int:
        """The number of the template that the tokens belong to from now on; slot: what the shape's own rows say of it, or None."""
        first = tokens[:DEPTH] if field == "speaker" else ["D" if t == "D" else "<*>" for t in tokens[:DEPTH]]
        node = self.root.setdefault(field, {}).setdefault(len(tokens), {})
        for token in first:
            key = token if token in node or len(node) < CHILDREN else "<*>"
            node = node.setdefault(key, {})
        leaf = node.setdefault("templates", [])
        variable = lambda ts: [t in "DW" for t in ts]
        alike = lambda i: sum(x == y for x, y in zip(self.templates[i]["tokens"], tokens)) / max(1, len(tokens))
        fits = [
            i for i in leaf
            if alike(i) >= SIMILAR and variable(self.templates[i]["mask"]) == variable(tokens) and (slot is None or self.templates[i]["slot"] in (None, slot))
        ]
        if fits:
            best = max(fits, key=alike)
            known = self.templates[best]
            known["tokens"] = [x if x == y else "<*>" for x, y in zip(known["tokens"], tokens)]
            known["count"] += count
            known["slot"] = slot if known["slot"] is None else known["slot"]
            return best
        self.templates.append({"field": field, "tokens": list(tokens), "mask": list(tokens), "count": count, "slot": slot})
        leaf.append(len(self.templates) - 1)
        return len(self.templates) - 1


def _shape(c: Column) -> Column:
    """The masked tokens of a time, blanks between them; most times are in standard form."""
    text = F.regexp_replace(F.lower(F.trim(c)), r"\d+", "D")
    text = F.regexp_replace(text, r"[\p{L}\p{M}&&[^D]]{2,}", "W")
    return F.when(F.trim(c).rlike(STANDARD), F.lit("D : D : D")).otherwise(F.trim(F.regexp_replace(text, r"(\S)\s*", "$1 ")))


def _numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), 1)


_PART = re.compile(r"\d+|[^\W\d_]+|\S")
_BETWEEN = re.compile(r"[()\[\]<>{}:：;,/|*#=]+")


def label_shape(label: str) -> str:
    """The masked tokens of a speaker label."""
    return " ".join("D" if t[0].isdigit() else "W" if len(t) > 1 or t.isalpha() else t for t in _PART.findall(label.lower()))


def label_slots(label: str) -> list[str]:
    """The label whole, then its parts between brackets and other marks."""
    return [label, *(p for p in map(str.strip, _BETWEEN.split(label)) if p)]


def _reading(numbers: Column, weights: tuple[int, ...]) -> Column:
    """Whole seconds of a time's numbers by the weights of its slots; null if a number is no long."""
    return sum((F.get(numbers, F.lit(i)).try_cast("long") * w for i, w in enumerate(weights) if w), F.lit(0).cast("long"))


TRIED = [w for n in READINGS for w in READINGS[n]]


def _time_shapes(turns: DataFrame) -> DataFrame:
    """(shape, slots, n, r0, r1, …): the shapes of both times, and on how many rows each of TRIED agrees with the other time."""
    n = turns.select("start", "end", _numbers(F.col("start")).alias("ns"), _numbers(F.col("end")).alias("ne"))
    std = lambda x, numbers: F.when(F.trim(x).rlike(STANDARD), _reading(F.col(numbers), (3600, 60, 1)))
    line = lambda x, numbers, other: F.struct(F.col(x).alias("x"), F.col(numbers).alias("numbers"), other.alias("other"))
    lines = n.select(F.inline(F.array(line("start", "ns", std("end", "ne")), line("end", "ne", std("start", "ns"))))).where("x IS NOT NULL AND trim(x) <> ''")
    agree = [F.count_if((F.col("slots") == len(w)) & (F.abs(_reading(F.col("numbers"), w) - F.col("other")) <= 120)).alias(f"r{i}") for i, w in enumerate(TRIED)]
    return lines.select(_shape(F.col("x")).alias("shape"), F.size("numbers").alias("slots"), "numbers", "other").groupBy("shape", "slots").agg(F.count("*").alias("n"), *agree)


def people_of(sessions: DataFrame) -> DataFrame:
    """(file, who): the people of every file, sent to all executors if they are counted to be at most SMALL_FILES files."""
    people = first_delivery(sessions.select("file", "participant_id", "interviewer", "observer"), ["file"], ["interviewer"]).select(
        "file", F.struct("participant_id", "interviewer", "observer").alias("who")
    )
    return F.broadcast(people) if sessions.count() <= SMALL_FILES else people


def _label_shapes(turns: DataFrame, people: DataFrame) -> DataFrame:
    """(shape, n, slot, votes): the shapes of the labels, and on how many rows a slot names a person of the file."""
    labels = turns.where("speaker IS NOT NULL AND trim(speaker) <> ''").groupBy("file", "speaker").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        votes: Counter = Counter()
        for batch in batches:
            for label, n, who in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shape, people = label_shape(label), People.of_file(who)
                total[shape] += n
                for k, part in enumerate(label_slots(label)):
                    if people.exact(part):
                        votes[shape, k] += n
        rows = [(shape, n, -1, 0) for shape, n in total.items()] + [(shape, 0, k, n) for (shape, k), n in votes.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], names=["shape", "n", "slot", "votes"])

    counted = labels.join(people, "file", "left").select("speaker", "n", "who").mapInArrow(run, "shape string, n long, slot int, votes long")
    return (
        counted.groupBy("shape", "slot").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))
        .groupBy("shape").agg(F.sum("n").alias("n"), F.max_by(F.when(F.col("votes") > 0, F.col("slot")), F.struct("votes", (-F.col("slot")).alias("slot"))).alias("slot"))
    )


def mined(turns: DataFrame, people: DataFrame) -> list[dict]:
    """Templates of the fields time and speaker: {field, tokens, count, shapes, slot}.

    slot is the worth of a time's slots in seconds, or the place of a label's slot among label_slots. The last templates, of the
    token <*> and without shapes, stand for all times of some number of slots beyond the most frequent shapes.
    """
    tree, held = TokenTree(), {}
    shapes = stage(_time_shapes(turns), "time-shapes")
    best = lambda row: max(((row[f"r{i}"], -i, w) for i, w in enumerate(TRIED) if len(w) == row.slots), default=(0, 0, None))
    for row in shapes.orderBy(F.desc("n"), "shape").limit(MAX_SHAPES).collect():
        votes, _, reading = best(row)
        t = tree.add("time", row["shape"].split(" "), row.n, reading if votes else None)
        held.setdefault(t, []).append(row["shape"])
    for row in _label_shapes(turns, people).orderBy(F.desc("n"), "shape").limit(MAX_SHAPES).collect():
        t = tree.add("speaker", row["shape"].split(" "), row.n, row.slot)
        held.setdefault(t, []).append(row["shape"])
    rest = {r.slots: best(r)[2] for r in shapes.groupBy("slots").agg(F.sum("n").alias("n"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(TRIED))]).where(F.col("slots") <= max(READINGS)).collect()}
    out = [t | {"shapes": held[i], "slot": t["slot"] or (rest.get(t["mask"].count("D")) if t["field"] == "time" else t["slot"])} for i, t in enumerate(tree.templates)]
    return out + [{"field": "time", "tokens": ["<*>"], "mask": ["D"] * n, "count": 0, "shapes": [], "slot": w} for n, w in sorted(rest.items()) if w]


def _start_seconds(shape: Column, numbers: Column, templates: list[dict]) -> Column:
    """Whole seconds of a time by its shape's template, or, beyond the mined shapes, by its number of slots."""
    times = [t for t in templates if t["field"] == "time" and t["slot"]]
    out = F.lit(None).cast("long")
    for t in times:
        if not t["shapes"]:
            out = F.when(F.size(numbers) == len(t["slot"]), _reading(numbers, t["slot"])).otherwise(out)
    by_slot: dict[tuple, list[str]] = {}
    for t in times:
        by_slot.setdefault(t["slot"], []).extend(t["shapes"])
    for weights, known in sorted(by_slot.items(), key=lambda x: len(x[1])):
        if known:
            out = F.when(shape.isin(known), _reading(numbers, weights)).otherwise(out)
    return out


def _fold(text: str) -> str:
    """A label without marks and blanks, in lower case and compatible form."""
    return _MARKS.sub("", unicodedata.normalize("NFKC", text)).lower()


def _digits(text: str) -> str:
    """The letter o for a zero within an id, leading zeros dropped."""
    m = re.fullmatch(r"(?:sub)?p?([0-9o]+)", text)
    return m.group(1).replace("o", "0").lstrip("0") if m and re.search(r"\d", m.group(1)) else ""


def _near(a: str, b: str) -> bool:
    """One edit apart: a letter more, less or other, or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


class People:
    """The people of one file and the spellings of their labels."""

    def __init__(self, participant: str | None, interviewer: str | None, observer: str | None, slots: dict[str, int] | None = None):
        self.slots = slots or {}
        self.number = _digits(_fold(participant or ""))
        self.id = _fold(participant or "")
        self.names = {role: _fold(n) for role, n in (("interviewer", interviewer), ("observer", observer)) if n and _fold(n)}
        self.known: dict[object, str | None] = {}

    @classmethod
    def of_file(cls, who: dict | None, slots: dict[str, int] | None = None) -> People:
        who = who or {}
        return cls(who.get("participant_id"), who.get("interviewer"), who.get("observer"), slots)

    def exact(self, part: str) -> str | None:
        """The person that a part of a label names by name, id or role word."""
        x = _fold(part)
        if not x:
            return None
        for role, name in self.names.items():
            if x == name:
                return role
        if x == self.id or (self.number and _digits(x) == self.number):
            return "participant"
        if x in ROLES:
            role = ROLES[x]
            if len(x) > 1 or role == "participant" or x != "o" or role in self.names:
                return role
        return None

    def of(self, label: str | None) -> str | None:
        """The person that the field of a row names in any spelling, or None: by the slot of its layout, then by the others."""
        if not label:
            return None
        if label in self.known:
            return self.known[label]
        parts = label_slots(label)
        slot = self.slots.get(label_shape(label), 0)
        return self._kept(label, [parts[slot], *parts[:slot], *parts[slot + 1 :]] if slot < len(parts) else parts)

    def within(self, label: str) -> str | None:
        """The person that a label within a text names: whole, without or by what it holds in parentheses."""
        if (label,) in self.known:
            return self.known[(label,)]
        return self._kept((label,), [label, re.sub(r"\(.*\)", "", label), *re.findall(r"\(([^)]*)\)", label)])

    def _kept(self, key: object, parts: list[str]) -> str | None:
        if key not in self.known:
            if len(self.known) > 5000:
                self.known.clear()
            self.known[key] = self._of(parts)
        return self.known[key]

    def _of(self, parts: list[str]) -> str | None:
        for part in parts:
            who = self.exact(part)
            if who:
                return who
            x = _fold(part)
            if len(x) == 1:
                for role, name in self.names.items():
                    if x == name[0]:
                        return role
            for role, name in self.names.items():
                if _near(x, name):
                    return role
        return None


_OPENING = re.compile(r"\s*(?:\[\s*([^\[\]:]{1,40}?)\s*\]|<\s*([^<>:]{1,40}?)\s*>|([^\[\]<>:{}*♪]{1,40}?)\s*(?::|：|\s[-–—]\s))\s*:?")
_INSIDE = re.compile(
    r"\[\s*([^\[\]:]{1,40}?)\s*\]:?|<\s*([^<>:]{1,40}?)\s*>:?"
    r"|(?:(?<=\n)|(?<=//)|(?<=[.!?。！？।።፧؟…)\]}>»”\"'*♪—–-])|(?<=[^\x00-ɏ]\s))\s*([^\W_][^\[\]<>:{}*♪/\n.!?,;。！？]{0,40}?)\s*[:：]"
)


#: What any label within a text needs.
_MAY = re.compile(r"[:：\[<]|\s[-–—]\s")


def pieces(speaker: str | None, text: str | None, people: People) -> tuple[list[tuple[str, bool]], int]:
    """(person, something is said) of the pieces of a row, cut at labels of another person; and where the text begins after its label."""
    text = text or ""
    person = people.of(speaker)
    if not _MAY.search(text):
        return [(person or "unknown", said(text))], 0
    m = _OPENING.match(text)
    label = people.within(m.group(1) or m.group(2) or m.group(3)) if m else None
    at = 0
    if label:
        at = m.end()
        if person is None:
            person = label
    out: list[tuple[str, bool]] = []
    begin, now = at, person or "unknown"
    if label and person != label:  # the row's label names one person, its text opens with another
        now = label
    for m in _INSIDE.finditer(text, at):
        who = people.within(m.group(1) or m.group(2) or m.group(3))
        if who and who != now:
            out.append((now, said(text[begin : m.start()])))
            now, begin = who, m.end()
        elif who:
            text = text[: m.start()] + " " * (m.end() - m.start()) + text[m.end() :]
    out.append((now, said(text[begin:])))
    return out, at


_WORD = re.compile(r"[^\W_]+")
_NOTED = re.compile(r"[(\[{<*♪]")


def said(text: str) -> bool:
    """Whether any word is left without notes, hesitation sounds and marks."""
    for m in _WORD.finditer(NOTE.sub(" ", text) if _NOTED.search(text) else text):
        if not HESITATION.fullmatch(m.group().lower()):
            return True
    return False


def row_pieces(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(file, turn_idx, sec, person, words, pieces): every row of turns once, with its pieces and what makes it a repetition."""
    people = people_of(sessions)
    templates = mined(turns, people)
    slots = {shape: t["slot"] for t in templates if t["field"] == "speaker" and t["slot"] for shape in t["shapes"]}
    rows = first_delivery(turns.select("file", "turn_idx", "loaded_at", "start", "speaker", "text"), ["file", "turn_idx"], ["loaded_at"])
    read = rows.withColumn("shape", _shape(F.col("start"))).withColumn("numbers", _numbers(F.col("start")))
    joined = read.join(people, "file", "left").select(
        "file", "turn_idx", _start_seconds(F.col("shape"), F.col("numbers"), templates).alias("sec"), "speaker", "text", "who"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        met: dict[str | None, People] = {}
        for batch in batches:
            who, marks, persons, cut = batch.column(5), [], [], []
            for i, (file, speaker, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                people = met.get(file)
                if people is None:
                    if len(met) > 2000:
                        met.clear()
                    people = met[file] = People.of_file(who[i].as_py(), slots)
                got, at = pieces(speaker, text, people)
                body = (text or "")[at:]
                same = body.lower() if body.isascii() else (body if unicodedata.is_normalized("NFC", body) else unicodedata.normalize("NFC", body)).casefold()
                marks.append(xxh3_64_intdigest("".join(same.split())) - (1 << 63))
                persons.append(got[0][0])
                cut.append([p for p, s in got if s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(persons, pa.string()), pa.array(marks, pa.int64()), pa.array(cut, pa.list_(pa.string()))],
                names=["file", "turn_idx", "sec", "person", "words", "pieces"],
            )

    return joined.mapInArrow(run, "file string, turn_idx int, sec long, person string, words long, pieces array<string>")


def clean_turns(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(file, first_turn_idx, last_turn_idx, speaker): the clean turns of every file.

    A row delivered twice counts once, by loaded_at. Null and blank texts, and rows without text but notes, say nothing.
    Rows without file or turn_idx stay rows of their own under the null file. A file without session has no names:
    role words and ids still tell. Of rows equal in start second, person and words the smallest turn_idx counts; a row
    without a usable start repeats nothing. Files of any size are sorted, not collected. Empty tables give no rows.
    """
    return _runs(row_pieces(turns, sessions)).groupBy("file", "run").agg(
        F.min_by("turn_idx", "place").alias("first_turn_idx"), F.max_by("turn_idx", "place").alias("last_turn_idx"), F.first("who").alias("speaker")
    ).drop("run")


def _runs(rows: DataFrame) -> DataFrame:
    by_idx = Window.partitionBy("file").orderBy("turn_idx")
    anchor = F.last(F.when(F.col("sec").isNotNull(), F.struct("sec", "turn_idx")), ignorenulls=True).over(by_idx)
    again = Window.partitionBy("file", "sec", "person", "words").orderBy("turn_idx")
    placed = (
        rows.withColumn("anchor", anchor)
        .withColumn("nth", F.row_number().over(again)).where("sec IS NULL OR nth = 1")
        .where("size(pieces) > 0")
        .select("file", "turn_idx", "anchor", F.posexplode("pieces").alias("piece", "who"))
    )
    spoken = Window.partitionBy("file").orderBy(F.col("anchor").asc_nulls_first(), "turn_idx", "piece")
    return (
        placed.withColumn("place", F.row_number().over(spoken)).withColumn("new", (F.col("who") != F.lag("who", 1, "").over(spoken)).cast("int"))
        .withColumn("run", F.sum("new").over(spoken.rowsBetween(Window.unboundedPreceding, 0)))
        .select("file", "run", "turn_idx", "who", "place")
    )
