"""Statistics of documents: words, symbols, lines and repetition, counted over the whole texts of a batch at once.

A batch of texts becomes one array of code points, their classes and running sums; a figure of a document, line or token is a
difference of sums, so no text is walked through character by character in Python.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import numpy as np

#: Words that running text of a language can hardly do without.
COMMON_WORDS = frozenset(
    """the of and to in a is was it that for on as with at by from or be this not are but had his her my our their an they which you we there
    i me up so how like were been if more one some into than when while could would then just about what who did do she he its that's it's there's
    ohne diesen dieser diesem diese dieses hätte wäre jemand niemand keiner keine kein etwas zwischen nichts wirkte dabei sonst wenig unter weil während nachdem wobei warum blieb noch nur schon hier dann über wenn man will sei ca meinte gesehen durfte aber
    quand pourquoi si où comment dit sont était-il ai-je ensuite puis plus rien début cela été j'ai m'a c'était comme dans aux
    cuando porque había nada luego dijo sentí después cómo no qué duró entre todo casi una esta ese por era
    der die das und in zu den von mit ist war ein eine nicht auf sich als auch es an er sie dem des so wie bei ich mir mich aus nach wurde hatte einen einer im am vom zum ging kam
    le la les de des et un une du est en que qui dans pour pas sur au ce il elle je ne plus par avec se son sa ses mais était à ai cette comme
    el los las y una por con no su al lo como más pero sus me mi se era estaba en qué del ya sin esa ese muy
    και το τα η ο οι του της την τον στο στη με για από που δεν ήταν να μου ένα μια είπε τόσο έμεινε θυμάμαι
    في من على أن إن كان كانت هذا هذه ثم ما لا قال قالت هل ذلك كل شيء حقا جدا صار إلى عن
    है था थी और में से को का की के वह यह ने क्या हो गया गई मन सच पर मेरा फिर नहीं चला हुआ
    ነበር ነው እና ላይ ውስጥ ነበረ ከዚያ በጣም ለምን ሆነ ያህል ቆየ አየሁ""".split()
)
#: Characters of unspaced scripts that running text is full of, and frequent triples of Thai.
COMMON_CHARS = "のにはをがたでてとしれさいなかもよら的了我是在很着就不也这那他她有得为么到说。"
THAI_TRIPLES = ("ค่ะ", "ครั", "รับ", "ที่", "และ", "มัน", "ล้ว", "ฉัน", "มาก", "ไม่", "ป็น", "ของ", "ว่า", "ถึง", "ได้", "นั้")
THAI_ENDS = ("ค่ะ", "รับ", "คะ")
#: Words of page furniture.
FURNITURE = frozenset(
    """login logout log sign register home menu search next previous prev page back top bottom cookie cookies notice policy privacy terms settings share
    help upload download file print contact subscribe newsletter sitemap copyright rights reserved accept reject skip content close read less edit delete save cancel submit
    click account cart checkout loading error""".split()
)
#: Marks.
ENDS = ".!?…。！？｡।॥።፧؟;:"
STOPS = ".!?…。！？｡।॥።፧؟"
CLOSERS = "\"'”’»)]」』）"
BULLETS = "-–—*•‣◦·+>→⇒▪■□☐☑☒✓✔✗✘○●◯"
TICKS = "•‣◦▪■□☐☑☒✓✔✗✘○●◯→⇒"
SEPARATORS = ",;·•|/、，"
DAMAGE = "#$%&@^~|*=+_{}\\§¤¬¦�"
BROKEN = "¡¢£¤¥¦§¨©ª¬®¯±²³´µ¶¸¹º¼½¾ÂÃ€™�ðŸ"
NEWLINES = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "

BLANK, NEWLINE, LETTER, MARK, DIGIT, OTHER = range(6)
#: Names of the figures of a document, in order.
NAMES = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "share_lines_punctuated", "share_common_words", "mean_words_per_line", "share_distinct_words",
    "words_per_segment", "share_stops", "share_repeated_segments", "share_aligned_lines", "share_marked_lines", "share_short_lines", "share_dotted",
    "share_damaged_words", "share_leading_marks", "share_drawn_out", "share_single_letters", "share_bracketed", "share_furniture", "share_broken_characters",
    "share_coded_words", "longest_token",
)


def _weights() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """By code point below 65,536: class, lower case and membership of the sets above; the last entry stands for all others."""
    n = 1 << 16
    kind = np.full(n + 2, OTHER, np.uint8)
    low = np.arange(n + 2, dtype=np.uint32)
    for i in range(n):
        ch = chr(i)
        if ch in NEWLINES:
            kind[i] = NEWLINE
        elif ch.isspace():
            kind[i] = BLANK
        else:
            kind[i] = {"L": LETTER, "M": MARK, "N": DIGIT}.get(unicodedata.category(ch)[0], OTHER)
        x = ch.lower()
        if len(x) == 1:
            low[i] = ord(x)
    kind[n] = LETTER
    sets = {}
    for name, chars in (("ends", ENDS), ("stops", STOPS), ("closers", CLOSERS), ("bullets", BULLETS), ("ticks", TICKS), ("separators", SEPARATORS), ("damage", DAMAGE), ("broken", BROKEN), ("common", COMMON_CHARS), ("joins", "'’-‐‑")):
        sets[name] = np.zeros(n + 2, bool)
        sets[name][[ord(c) for c in chars if ord(c) < n]] = True
    codes = np.arange(n + 2)
    sets["cjk"] = ((codes >= 0x3040) & (codes <= 0x30FF)) | ((codes >= 0x3400) & (codes <= 0x9FFF)) | ((codes >= 0xF900) & (codes <= 0xFAFF))
    sets["thai"] = (codes >= 0x0E00) & (codes <= 0x0E7F)
    r = _weights()
    word = lambda w: int(sum((int(low[ord(c)]) * int(r[min(i, 31)]) for i, c in enumerate(w)), 0) % (1 << 64))
    triple = lambda t: (ord(t[0]) << 42) | (ord(t[1]) << 21) | ord(t[2])
    return sets | {
        "kind": kind, "low": low, "common_words": np.sort(np.array([word(w) for w in COMMON_WORDS], np.uint64)), "furniture": np.sort(np.array([word(w) for w in FURNITURE], np.uint64)),
        "thai_triples": np.sort(np.array([triple(t) for t in THAI_TRIPLES], np.int64)),
    }


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _sums(flags: np.ndarray) -> np.ndarray:
    """Running sums that begin with 0."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def repeated(text: str) -> float:
    """How far the three commonest segments make up the text: 0 if nothing comes twice, 1 if there is nothing else."""
    segments = [s for x in re.split(r"[.!?…。！？।።፧؟\n|]+", text.lower()) if (s := x.strip())]
    if len(segments) < 5:
        return 0.0
    top = Counter(segments).most_common(3)
    return (sum(c for _, c in top) - len(top)) / (len(segments) - len(top)) if len(segments) > len(top) else 0.0


def statistics(texts: list[str]) -> np.ndarray:
    """A row of the numbers of NAMES for each text; texts aren't blank. Shares of lines are of their characters."""
    t = _tables()
    joined = "\n".join(texts) + "\n"
    wide = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    c = np.where(wide < 65536, wide, np.where(wide < 0x1F000, 65536, 65537)).astype(np.uint32)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begin[1:])
    kind = t["kind"][c]
    visible = kind > NEWLINE
    n_visible = _sums(visible)
    of_doc = lambda s: s[begin[1:]] - s[begin[:-1]]  # noqa: E731  a running sum over characters, by document
    chars = np.maximum(of_doc(n_visible), 1).astype(float)
    letter = (kind == LETTER) | (kind == MARK)
    digit = kind == DIGIT
    after = lambda x: np.concatenate([x[1:], x[:1]])
    before = lambda x: np.concatenate([x[-1:], x[:-1]])

    # Tokens: runs between blanks.
    ts = np.flatnonzero(visible & ~before(visible))
    te = np.flatnonzero(visible & ~after(visible)) + 1
    doc_tokens = np.searchsorted(ts, begin)
    by_doc = lambda flags: (s := _sums(flags))[doc_tokens[1:]] - s[doc_tokens[:-1]]  # noqa: E731  tokens, by document
    tokens = np.maximum(np.diff(doc_tokens), 1).astype(float)
    n_letter, n_digit = _sums(letter), _sums(digit)
    length, t_letters, t_digits = te - ts, n_letter[te] - n_letter[ts], n_digit[te] - n_digit[ts]
    first, last = c[ts], c[te - 1]

    # Words: runs of letters with inner apostrophes or hyphens; characters of unspaced scripts are counted on their own.
    cjk, thai = t["cjk"][c] & letter, t["thai"][c] & visible
    spaced = letter & ~cjk & ~thai
    part = spaced | (t["joins"][c] & before(spaced) & after(spaced))
    ws = np.flatnonzero(part & ~before(part))
    we = np.flatnonzero(part & ~after(part)) + 1
    at = np.flatnonzero(part)
    place = np.minimum(at - np.repeat(ws, we - ws), 31)
    plain = np.where(c[at] == ord("’"), ord("'"), t["low"][c[at]]).astype(np.uint64)
    hashes = np.add.reduceat(plain * _weights()[place], np.cumsum(we - ws) - (we - ws)) if len(ws) else np.zeros(0, np.uint64)
    doc_words = np.searchsorted(ws, begin)
    by_word = lambda flags: (s := _sums(flags))[doc_words[1:]] - s[doc_words[:-1]]
    n_spaced_words = np.diff(doc_words)
    n_cjk, n_thai, n_spaced = of_doc(_sums(cjk)), of_doc(_sums(thai)), of_doc(_sums(spaced))
    words = n_spaced_words + n_cjk / 2 + n_thai / 4
    some = np.maximum(words, 1)
    triple = (c.astype(np.int64) << 42) | (after(c).astype(np.int64) << 21) | after(after(c)).astype(np.int64)
    hits = np.zeros(len(c), bool)
    in_thai = np.flatnonzero(thai)
    hits[in_thai] = _within(triple[in_thai], t["thai_triples"])
    common_spaced = by_word(_within(hashes, t["common_words"])) / np.maximum(n_spaced_words, 1)
    common_cjk = np.minimum(1, 1.3 * of_doc(_sums(t["common"][c] & cjk)) / np.maximum(n_cjk, 1))
    common_thai = np.minimum(1, 8 * of_doc(_sums(hits)) / np.maximum(n_thai, 1))
    common = (common_spaced * n_spaced + common_cjk * n_cjk + common_thai * n_thai) / np.maximum(n_spaced + n_cjk + n_thai, 1)
    distinct = np.array([len(np.unique(hashes[a:b])) / max(1, b - a) for a, b in zip(doc_words[:-1], doc_words[1:])])

    # Lines that hold anything.
    ls = np.concatenate([[0], np.flatnonzero(kind == NEWLINE)[:-1] + 1])
    line_tokens = np.searchsorted(ts, np.concatenate([ls, [len(c)]]))
    full = np.diff(line_tokens) > 0
    f, e = line_tokens[:-1][full], line_tokens[1:][full]  # first token and the one after the last
    l_begin, l_end = ts[f], te[e - 1]
    size = (n_visible[l_end] - n_visible[l_begin]).astype(float)
    doc_lines = np.searchsorted(l_begin, begin)
    per_doc = lambda v: (s := np.concatenate([[0.0], np.cumsum(v)]))[doc_lines[1:]] - s[doc_lines[:-1]]  # noqa: E731  lines, by document
    lines = np.maximum(np.diff(doc_lines), 1).astype(float)
    end = l_end - 1
    for _ in range(2):
        end = np.where(t["closers"][c[end]] & (end > l_begin), end - 1, end)
    thai_end = np.zeros(len(end), bool)
    for mark in THAI_ENDS:
        match = end - len(mark) + 1 >= l_begin
        for i, ch in enumerate(mark):
            match &= c[np.maximum(end - len(mark) + 1 + i, 0)] == ord(ch)
        thai_end |= match
    ended = t["ends"][c[end]] | thai_end
    n_cjk_s, n_thai_s, w_s = _sums(cjk), _sums(thai), np.searchsorted(ws, np.concatenate([l_begin, l_end]))
    l_words = w_s[len(l_begin) :] - w_s[: len(l_begin)] + (n_cjk_s[l_end] - n_cjk_s[l_begin]) / 2 + (n_thai_s[l_end] - n_thai_s[l_begin]) / 4
    # A mark before the line: a bullet, a tick box, a number or a letter with a full stop or bracket.
    f_len, f_first, f_last = length[f], first[f], last[f]
    closing = (f_last == ord(".")) | (f_last == ord(")")) | (f_last == ord(":"))
    opening = (f_first == ord("(")).astype(int)
    numbered = closing & (t_digits[f] > 0) & (t_digits[f] + 1 + opening == f_len) & (f_len <= 6)
    lettered = closing & (t_letters[f] > 0) & (t_letters[f] + 1 + opening == f_len) & (f_len <= 3) & (f_last != ord(":"))
    dots = _sums(c == ord("."))
    nested = (t_digits[f] >= 2) & (dots[te[f]] - dots[ts[f]] >= 1) & (t_digits[f] + dots[te[f]] - dots[ts[f]] == f_len) & (f_len <= 8)
    box = (f_first == ord("[")) & ((f_len == 1) | (f_len == 3) & (f_last == ord("]")))
    alone = (e - f) > 1
    marked = alone & (t["bullets"][f_first] & (f_len == 1) | numbered | lettered | nested | box | (f_first == ord("x")) & (f_len == 1)) | t["ticks"][f_first] & (l_words > 0)
    # Lines aligned with a neighbour: as many separators of one kind.
    next_visible = after(visible)
    counts = [
        c == ord("|"), c == ord("\t"), (c == ord(";")) & next_visible, (c == ord(",")) & next_visible & (after(c) != ord(" ")), c == ord("<"),
        ~visible & (kind == BLANK) & before(~visible) & after(visible) & (before(kind) != NEWLINE),
    ]
    owner = np.repeat(np.arange(len(texts)), np.diff(doc_lines))
    aligned = np.zeros(len(size), bool)
    for i, flags in enumerate(counts):
        s = _sums(flags)
        n = s[l_end] - s[l_begin]
        same = (n[1:] == n[:-1]) & (owner[1:] == owner[:-1]) if i < 5 else (np.minimum(n[1:], n[:-1]) >= 2) & (owner[1:] == owner[:-1])
        near = np.zeros(len(n), bool)
        near[1:] |= same
        near[:-1] |= same
        aligned |= near & (n >= 2)
    short = ~ended & (l_words <= 8) & ~aligned

    stops = t["stops"][c] & (~t["stops"][after(c)]) & (~next_visible | t["closers"][after(c)] | cjk | after(cjk) | (c > 0x3000))
    n_stops = of_doc(_sums(stops))
    separated = t["separators"][c] & (~next_visible | (c > 0x3000))
    boundaries = n_stops + of_doc(_sums(separated)) + lines
    around = before(letter) | after(letter)
    damage = t["damage"][c] & around | digit & (before(spaced) | after(spaced)) & ~t["joins"][before(c)] | (c == ord(";")) & before(letter) & after(letter)
    damage_s = _sums(damage)
    damaged = (damage_s[te] - damage_s[ts] > 0) & (t_letters > 0)
    leading = (length > 1) & (t["ends"][first] | (first == ord(","))) & letter[np.minimum(ts + 1, len(c) - 1)] & ~t["cjk"][c[np.minimum(ts + 1, len(c) - 1)]]
    drawn = (c == before(c)) & (c == before(before(c)))
    one = (length == 1) & (t_letters == 1) & ~t["cjk"][first]
    bracketed = ((first == ord("[")) | (first == ord("(")) | (first == ord("{"))) & ((last == ord("]")) | (last == ord(")")) | (last == ord("}")))
    coded = (t_letters > 0) & (t_digits > 0)
    unspaced_token = (lambda s: s[te] - s[ts] > 0)(_sums(cjk | thai))
    long = np.zeros(len(texts))
    np.maximum.at(long, np.repeat(np.arange(len(texts)), np.diff(doc_tokens)), np.where(unspaced_token, 0, length))
    letters, digits = of_doc(n_letter), of_doc(n_digit)
    return np.column_stack(
        [
            words, n_spaced / np.maximum(n_spaced_words, 1), np.maximum(0, chars - letters - digits) / chars, digits / chars, per_doc(size * ended) / chars, common, words / lines, distinct,
            words / boundaries, n_stops / boundaries, [repeated(x) for x in texts], per_doc(size * aligned) / chars, per_doc(size * marked) / chars, per_doc(size * short) / chars, of_doc(_sums(drawn & (c == ord(".")))) / chars,
            by_doc(damaged) / tokens, by_doc(leading) / tokens, of_doc(_sums(drawn & letter)) / chars, by_doc(one) / tokens, by_doc(bracketed) / tokens, by_word(_within(hashes, t["furniture"])) / some, of_doc(_sums(t["broken"][c])) / chars,
            by_doc(coded) / tokens, long,
        ]
    ).astype(float)
