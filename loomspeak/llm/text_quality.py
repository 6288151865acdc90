"""Per-document text quality: statistics, a Gaussian mixture over them, components named by inspected examples.

Statistics  text_stats counts words, symbols, lines and repetition over every text whole.
Mixture     The statistics are squashed where they are long-tailed, standardised by mean and deviation of all documents, and
            a mixture of Gaussians is fitted to all of them by expectation-maximization. A round is one pass over the staged
            statistics: every partition adds up responsibilities, sums and products, and a tree of aggregates adds up those, so
            that one row reaches the driver.
Start       EXAMPLES, short texts read and judged one by one, are passed through the same statistics. Every form of
            examples begins one component at its mean; each of a bounded sample of SAMPLE documents goes to the nearest
            for the first spread, and SPARE further components begin at sampled documents far from all forms.
Kinds       A component takes the kind of the examples that it is responsible for, or, without any, that of the nearest form.
            A document's kind is that of most of its responsibility. No rule follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspeak.llm.text_stats import NAMES, statistics
from loomspeak.runtime import stage

ROUNDS = 12
SAMPLE = 4000
SPARE = 6
#: What is added to every variance, in squared deviations.
RIDGE = 0.1
#: Standardised values beyond count as this.
FARTHEST = 8.0
#: Texts that are counted together.
BATCH = 400
#: Statistics in the mixture: all but those that say how long a text is.
FEATURES = tuple(n for n in NAMES if n not in ("n_words", "share_distinct_words"))
#: Long tails: a value is cut at this and its logarithm taken.
SQUASHED = {"mean_word_length": 15.0, "mean_words_per_line": 60.0, "words_per_segment": 30.0, "longest_token": 200.0}
KINDS = ("prose", "list", "table", "junk")
#: Examples read and judged for this module: kind, form, text.
EXAMPLES = (
    ("prose", "text", "We walked along the river until the lamps were lit. She said that it was late, and I agreed with her."),
    ("prose", "text", "There was a smell of rain in the yard, and it made my hands cold. I thought that nobody would come, but then the door opened."),
    ("prose", "text", "Als ich nach Hause kam, war das Licht noch an. Er hatte die ganze Zeit auf mich gewartet und sagte nichts."),
    ("prose", "text", "Je ne savais pas si elle était là. Puis la porte est tombée et je me suis assis dans la cuisine."),
    ("prose", "text", "No sabía que la casa estaba tan lejos. Después me quedé en la puerta y esperé a que el tren se fuera."),
    ("prose", "text", "Θυμάμαι το σπίτι και την πόρτα, ήταν τόσο μακριά. Δεν ήταν κανείς στο δρόμο."),
    ("prose", "dialogue", "Anna: How was it for you when the music began?\nP: It was strange. I had the feeling that the room was getting smaller."),
    ("prose", "dialogue", "Mira: And what was the next thing that you saw?\nParticipant: The stairs, I think. They were wet and very steep.\nMira: Did it hurt?\nParticipant: Not really. It was more of a weight."),
    ("prose", "dialogue", "Jon: Was ist dann passiert?\nB: Dann kam der Regen. Ich war ganz ruhig.\nJon: Und wo?\nB: Im Hals und in den Händen."),
    ("prose", "dialogue", "Noor: なぜ雨があんなに強かったのですか？\nB: とても怖かったです。\nNoor: 本当ですか。\nB: 道が見えました。少し楽になりました。"),
    ("prose", "unpunctuated", "and then i went back to the house because it was raining and nobody had told me that they were already gone"),
    ("prose", "unpunctuated", "so it was like i had no hands and the door was open but i did not go in because of the noise and the dark"),
    ("prose", "wrapped", "The first evening was the hardest one of all, and I kept\nthinking that somebody would come up the stairs and ask me\nwhat I was doing there with the lights on."),
    ("prose", "wrapped", "Sentí un peso en el pecho y después una calma en los\ndedos. No quería perder la llave, pero la casa seguía en\nsilencio y el tren se fue sin mí. Duró un minuto o dos."),
    ("prose", "wrapped", "It was the sound that came first, and only then the\npicture of the gate. I was not afraid at all. When they\nasked me I said that it was like a bell in the wood."),
    ("prose", "remark", "Hard to tell."),
    ("prose", "remark", "No, not now."),
    ("prose", "remark", "What a day it was!"),
    ("prose", "remark", "Perhaps the second."),
    ("prose", "remark", "Quelle maison !"),
    ("prose", "short line", "and the miller only looked at the floor"),
    ("prose", "short line", "so my mother simply went back"),
    ("prose", "short line", "that was it then"),
    ("prose", "wrapped", "It was not my fault that the lamp fell, as I had only\nwanted to see the back room."),
    ("prose", "headed", "Notes on the boat\n\nIt was quiet, and the water was black."),
    ("prose", "headed", "After the rain\n\n本当に静かでした。"),
    ("prose", "headed", "Session candle\n\n为什么灯这么远？"),
    ("prose", "headed", "The mill\n\nQuelle chaise ! Je ne savais plus rien."),
    ("prose", "unspaced", "それから雨が降り始めました。とても静かで、少し怖かったです。"),
    ("prose", "unspaced", "「道はどこ？」と思いました。胸が痛い感じがしました。"),
    ("prose", "unspaced", "本当に寒かった！"),
    ("prose", "unspaced", "我觉得那个房间很安静。后来他走了，我们都没有说话。"),
    ("prose", "unspaced", "为什么这么远？他说：“等一下。别走。”然后门关了。"),
    ("prose", "thai", "ฉันรู้สึกว่ามันเงียบมากค่ะ แล้วเขาก็ไม่ได้พูดอะไรค่ะ"),
    ("prose", "thai", "ตอนนั้นถนนดูยาวมากครับ ทำไมถึงเป็นแบบนั้นครับ"),
    ("prose", "script", "كان المساء هادئا جدا. ثم قالت إن كل شيء على ما يرام."),
    ("prose", "script", "यह बहुत धीरे हुआ। फिर मैं घर गया और वह वहाँ नहीं था।"),
    ("prose", "script", "ቤቱ በጣም ሩቅ ነበር። ከዚያ ዝናብ አየሁ። ለምን ጨለማ ሆነ፧"),
    ("prose", "repeating", "قالت: «نعم. اجلس.» ثم ذهبت. هل كان البيت بعيدا حقا؟ قالت: «نعم. اجلس.» ثم ذهبت. كان المطر قويا جدا. قالت: «نعم. اجلس.» ثم ذهبت."),
    ("prose", "repeating", "What was it? It was the rain on the roof. What was it? I had no idea at all. What was it? She said that it was late.\nWhat was it? Nothing."),
    ("prose", "repeating", "वह घर गया। मन शांत हो गया। वह घर गया। फिर सच में रात थी। मन शांत हो गया। वह घर गया।"),
    ("list", "bullets", "- red cup\n- old ladder by the wall\n- rope\n- two candles\n- broken lamp\n- tin"),
    ("list", "bullets", "1. kettle\n2. blue scarf\n3. garden\n4. wet stairs\n5. mirror\n6. low door"),
    ("list", "bullets", "• Eimer\n• Seife, hart\n• Nadeln\n• alte Jacke\n• Kreide\n• Ring, kalt"),
    ("list", "bullets", "[x] stove\n[ ] grey coat\n[ ] bell\n[x] letter\n[ ] short rope"),
    ("list", "bullets", "a) coal\nb) long shelf\nc) cups\n  d) wet towel\n  e) shoe\nf) open drawer"),
    ("list", "bullets", "2.1 brick\n2.2 low wall\n2.3 ash\n3.1 dry hay\n3.2 wheel\n3.3 thin wire"),
    ("list", "times", "- 00:01:10 cold hall\n- 00:02:35 open window\n- 00:04:02 dog\n- 00:05:50 late train\n- 00:07:15 keys"),
    ("list", "row", "apples, pears, warm bread, salt, three eggs, butter, candles, matches, thread"),
    ("list", "row", "cold hall; open window; dog; neighbour; late train; keys; smoke; empty yard"),
    ("list", "row", "Brot, Butter, Salz, Kerzen, Faden, Eimer, Seife, Nadeln, Kamm, Ofen, Draht"),
    ("list", "row", "bread · dry soap · lamp · wet boots · spoon · chair · nail · dark coat"),
    ("list", "row", "tram / long street / bench / bakery / square / church / low bridge / quay"),
    ("list", "bare", "bread\nmilk\ngreen paper\nstring\nold coat\nsmall nails\nglue"),
    ("list", "bare", "cold water\nlamp oil\ntent\nmap of the hills\ntin plate\nknife\nwool"),
    ("list", "bare", "Brot\nalte Schuhe\nSeil\nZange\nkleiner Topf\nLicht"),
    ("list", "bare unspaced", "冷たい水\n古い傘\n小さい石\n青い箱\n白い紙"),
    ("list", "bare unspaced", "寒冷的早晨\n旧雨伞\n白色的石头\n遥远的山\n干净的盘子"),
    ("list", "bare", "Shopping for the week\nbread, dark\nmilk\npaper, green\nstring\ncoat, old\nnails"),
    ("list", "row unspaced", "寒冷的早晨 / 旧雨伞 / 白色的石头 / 遥远的山 / 干净的盘子 / 小鸟"),
    ("list", "row unspaced", "冷たい水、古い傘、小さい石、青い箱、白い紙、長い道"),
    ("list", "row unspaced", "黑色的猫, 安静的湖, 长长的路, 白色的墙, 小小的门, 旧的钟"),
    ("list", "labelled", "joy: lantern, wet road\nfear: dark cellar, rope\npride: new boots, gate\nanger: tin, cold nail"),
    ("list", "leaders", "first lamp ........ 3\ncold bridge ...... 7\nold mill ......... 12\nharbour .......... 15"),
    ("list", "leaders", "Opening .............. 1\nThe long way ......... 4\nRain ................. 9\nHome again ........... 17"),
    ("table", "semicolons", "name;age;town;score\nlea;31;north;0.4\ntom;44;south;1.2\nida;27;east;0.9"),
    ("table", "bars", "| day | walk | mood |\n|---|---|---|\n| 1 | 20 | calm |\n| 2 | 35 | tired |\n| 3 | 10 | calm |"),
    ("table", "quoted", '"id","start","words"\n"a1","00:10:02","88"\n"a2","00:12:40","61"\n"a3","00:15:09","120"'),
    ("table", "tabs", "room\thour\tcount\na\t10:00\t4\nb\t11:30\t9\nc\t12:15\t2"),
    ("table", "blanks", "name      moment    start\nlea       1         00:02:10\ntom       2         00:07:45\nida       3         00:09:30"),
    ("table", "tags", "<tr><td>lea</td><td>1</td><td>20</td></tr>\n<tr><td>tom</td><td>2</td><td>35</td></tr>\n<tr><td>ida</td><td>3</td><td>11</td></tr>"),
    ("table", "boxes", "+------+------+-------+\n| name | age  | town  |\n+------+------+-------+\n| lea  | 31   | north |\n| tom  | 44   | south |\n+------+------+-------+"),
    ("table", "words", "fruit,colour,taste\npear,green,sweet\nplum,blue,sour\nfig,brown,sweet\nlime,green,sharp"),
    ("junk", "coded", "aGVsbG8gd29ybGQhIHRoaXMgaXMgbm90IGEgdGV4dCBidXQgY29kZWQgYnl0ZXM0\nc29tZSBtb3JlIG9mIHRoZSBzYW1lIGtpbmQgdGhhdCBub2JvZHkgd2lsbCByZWFk"),
    ("junk", "hex", "3f 9a 00 c4 71 be 22 d8 41 0c 77 e3\n90 12 fa 5b 6c 3d aa 08 ff 31 d2 64"),
    ("junk", "broken", "cÃ¤ndlÃ© flÂ°wer â€œrâ€™ad mÃ¼rnÃ¤ plâ€™teÂ° gÃ©rdÃ«n lÃ¤ï¿½p stÃ¤irÃ© ropâ€œ"),
    ("junk", "replaced", "o?e�¤ a§n ¬¬ti eo�§ n?a¤¤ �to¬ i§§e a¬¤n o?�t ¤¤e ani�§ t¬?o �§a ¤e?n"),
    ("junk", "furniture", "Home | Login | Help | Settings | Share | Next page | Back to top | Download file | Help"),
    ("junk", "furniture", "Back to top | Help | Upload | Home | Cookie notice | Search | Share | Settings | Home | Login"),
    ("junk", "notes", "[inaudible] [...]\n[inaudible]\n(crosstalk) [inaudible]\n[...] [inaudible]"),
    ("junk", "notes", "(pause)\n[...]\n[inaudible] (crosstalk)\nmhm\n[inaudible]\n[...] [...]"),
    ("junk", "keys", "kj sdlkfj wpeoriu qlsk; fjaw eoriuqw lksjd fpw;oe ruqlskd jfpaow ;eiruq lskdj"),
    ("junk", "keys", "woeiru ;sldkfj alskd;jf qpwo eiru;ty fjdk sla; ;qwpe oriu tyla;ks djf"),
    ("junk", "keys", "wqeriu lakdjfp seow qpeiru ;sldkfja woeiruty qpslkd a;sldkfj ewoiru slkdjfqp"),
    ("junk", "symbols", "q*=|_{9[]#b^~+x/%%{1_c]&*|=$@^~}+_#a{=*\\|/%]1[~+w>{#}*&z^%_\\=5[t}{|~@x+*#%=]c&^{/_7$k~|@=+{a%*#}^&_]"),
    ("junk", "symbols", "u@#*{}=% ^|_~x&+[$]{w\\/=*#3&^%}_|~k@[]+=*{#n%_^|}&~/x =$@*+{#]%^d_&|\\~r}={*/#+[@ %^5_|&s~=]}*{#b+/\\^%@=g*_{|}"),
    ("junk", "symbols", "|/=b@=[^$&~[9^9c_9#=|@ ]_#+^]^$[$x9][~%_ >>a+{=}*&^d#_%|\\~2[@]=+{*&"),
    ("junk", "letters apart", "h e l l o   a n d   g o o d   b y e   t o   a l l   o f   y o u   h e r e"),
    ("junk", "endless", "recording lost\nrecording lost\nrecording lost\nrecording lost\nrecording lost\nrecording lost"),
    ("junk", "endless", "please hold the line\nplease hold the line\nplease hold the line\nplease hold the line\nplease hold the line"),
    ("junk", "endless sentences", "Call ended by system.\nCall ended by system.\nCall ended by system.\nCall ended by system.\nCall ended by system.\nCall ended by system."),
    ("junk", "endless sentences", "The line is busy.\nThe line is busy.\nThe line is busy.\nThe line is busy.\nThe line is busy."),
    ("junk", "backwards", ".thgin ta esuoh eht dehcaer yeht nehw gniniar saw tI .rood eht denepo ydobon dna"),
    ("junk", "backwards", ".etimmits thcin sad dnu ,tlak raw rE .essartS red fua nebeilb eiS ?oW .eniets eiD"),
    ("junk", "drawn out", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa hhhhhhhhhhhhh !!!!!! mmmm"),
    ("junk", "drawn out", "ooooooooooooooooo eeeeeeee mmmmmmmmmm hhhhhhh !!!!"),
    ("junk", "damaged", "T#e r@in ca%e d0wn on t|e ro$f an1 w& ha^ to w8it u~der th3 tre$s un#il it w@s ov3r."),
    ("junk", "damaged", "%o on3 kn^w wh#t h$d ha|pened, b@t t8e d0or w~s op%n an1 th3 li&ht wa$ st#ll o0."),
)
FORMS = tuple(dict.fromkeys((k, f) for k, f, _ in EXAMPLES))


def document_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, the numbers of text_stats.NAMES) of every document whose text isn't null or blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if t.strip()]
            for at in range(0, len(keep), BATCH):
                some = keep[at : at + BATCH]
                numbers = statistics([texts[i] for i in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), *(pa.array(c) for c in numbers.T)], names=["id", *NAMES])

    part = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    return part.mapInArrow(run, f"id {dict(part.dtypes)['id']}, " + ", ".join(f"{n} double" for n in NAMES))


def features(numbers: np.ndarray) -> np.ndarray:
    """The mixture's variables from rows of FEATURES: long tails squashed."""
    x = numbers.copy()
    for name, most in SQUASHED.items():
        i = FEATURES.index(name)
        x[:, i] = np.log1p(np.clip(x[:, i], 0, most))
    return x


def example_features() -> np.ndarray:
    at = [NAMES.index(f) for f in FEATURES]
    return features(statistics([t for _, _, t in EXAMPLES])[:, at])


def standard(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((x - scale[0]) / scale[1], -FARTHEST, FARTHEST)


def log_density(z: np.ndarray, mixture: tuple) -> np.ndarray:
    weights, means, covariances = mixture
    out = np.empty((len(z), len(weights)))
    for k in range(len(weights)):
        inverse = np.linalg.inv(np.linalg.cholesky(covariances[k]))
        y = (z - means[k]) @ inverse.T
        out[:, k] = np.log(weights[k]) - 0.5 * (y * y).sum(1) + np.log(np.diag(inverse)).sum()
    return out


def responsibilities(z: np.ndarray, mixture: tuple) -> np.ndarray:
    log = log_density(z, mixture)
    log -= log.max(1, keepdims=True)
    p = np.exp(log)
    return p / p.sum(1, keepdims=True)


def expected(z: np.ndarray, mixture: tuple) -> np.ndarray:
    """The sums of a round over rows z as one vector: log likelihood, then weights, sums and products by component."""
    log = log_density(z, mixture)
    top = log.max(1, keepdims=True)
    p = np.exp(log - top)
    sums = p.sum(1, keepdims=True)
    fit_of = float((top + np.log(sums)).sum())
    p /= sums
    products = [(z * p[:, j : j + 1]).T @ z for j in range(p.shape[1])]
    return np.concatenate([[fit_of], p.sum(0), (p.T @ z).ravel(), np.array(products).ravel()])


def maximised(total: np.ndarray, mixture: tuple) -> tuple:
    """The mixture of the next round; a component that holds less than one document stays as it is."""
    k, d = mixture[1].shape
    w = np.maximum(total[1 : k + 1], 1e-9)
    means = total[k + 1 : k + 1 + k * d].reshape(k, d) / w[:, None]
    covariances = total[k + 1 + k * d :].reshape(k, d, d) / w[:, None, None] - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
    empty = w < 1
    means[empty], covariances[empty] = mixture[1][empty], mixture[2][empty]
    weights = np.maximum(w, 0.5)
    return weights / weights.sum(), means, covariances


def start(sample: np.ndarray, examples: np.ndarray) -> tuple:
    """A component at the mean of every form, and SPARE ones at documents of the sample far from all; spread as the sample's nearest."""
    forms = np.array([FORMS.index((k, f)) for k, f, _ in EXAMPLES])
    means = [examples[forms == f].mean(0) for f in range(len(FORMS))]
    rng = np.random.default_rng(3)
    near = np.min([((sample - m) ** 2).sum(1) for m in means], axis=0)
    for _ in range(SPARE):
        if near.sum() <= 0:
            break
        means.append(sample[rng.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - means[-1]) ** 2).sum(1))
    means = np.array(means)
    z = np.concatenate([sample, examples])
    own = ((z[:, None] - means[None]) ** 2).sum(2).argmin(1)
    d = z.shape[1]
    weights = np.maximum(np.bincount(own, minlength=len(means)), 1) / len(z)
    spread = [(z[own == k] - means[k]).T @ (z[own == k] - means[k]) / max(1, (own == k).sum()) + RIDGE * np.eye(d) for k in range(len(means))]
    return weights / weights.sum(), means, np.array(spread)


def component_kinds(examples: np.ndarray, mixture: tuple) -> list[str]:
    """The kind of every component: of the examples it is responsible for, or without any of the nearest form's mean."""
    p = responsibilities(examples, mixture)
    forms = np.array([FORMS.index((k, f)) for k, f, _ in EXAMPLES])
    means = np.array([examples[forms == f].mean(0) for f in range(len(FORMS))])
    out = []
    for k in range(p.shape[1]):
        votes = {kind: sum(p[i, k] for i, (x, _, _) in enumerate(EXAMPLES) if x == kind) for kind in KINDS}
        best = max(votes, key=votes.get)
        out.append(best if votes[best] >= 0.5 else FORMS[int(((means - mixture[1][k]) ** 2).sum(1).argmin())][0])
    return out


def _summed(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, groups: int) -> np.ndarray:
    """The sum of of(rows of FEATURES) over all rows: a vector a partition, added up by `groups` tasks before the driver adds theirs."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(features(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += batch.column(0).flatten().to_numpy().reshape(-1, width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    parts = df.select(*FEATURES).mapInArrow(part, "v array<double>").repartition(groups).mapInArrow(add, "v array<double>")
    return np.sum([r.v for r in parts.collect()], axis=0)


def fit(stats: DataFrame, rounds: int = ROUNDS) -> tuple:
    """((mean, deviation), (weights, means, covariances)) of the mixture over all rows of stats, a staged table."""
    d = len(FEATURES)
    groups = max(1, math.isqrt(len(stats.inputFiles())))
    total = _summed(stats, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * d + 1, groups)
    n = total[0]
    mean = total[1 : d + 1] / n
    scale = (mean, np.sqrt(np.maximum(total[d + 1 :] / n - mean**2, 1e-4)))

    share = min(1.0, 2.0 * SAMPLE / n)
    some = stats.select(*FEATURES).where(F.pmod(F.xxhash64(*FEATURES), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE).toArrow()
    examples = standard(example_features(), scale)
    mixture = start(standard(features(np.column_stack([c.to_numpy() for c in some.columns])), scale), examples)
    last = -np.inf
    for _ in range(rounds):
        k = len(mixture[0])
        total = _summed(stats, lambda x, mixture=mixture: expected(standard(x, scale), mixture), 1 + k + k * d + k * d * d, groups)
        mixture = maximised(total, mixture)
        if total[0] - last < 1e-4 * abs(total[0]):
            break
        last = total[0]
    return scale, mixture


def document_kinds(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, component, certainty, the statistics) of every document whose text isn't null or blank.

    kind is prose, list, table or junk; certainty the responsibility of the components of that kind. Null and blank
    texts have no row, repeated texts are documents of their own, texts of any length are read whole; a table without
    any text gives no rows. Other columns, whatever their names, aren't read.
    """
    stats = stage(document_statistics(df, id_col, text_col), "text-statistics")
    types = dict(stats.dtypes)
    schema = f"id {types['id']}, kind string, component int, certainty double, " + ", ".join(f"{n} double" for n in NAMES)
    if not stats.limit(1).count():
        return df.sparkSession.createDataFrame([], schema)
    scale, mixture = fit(stats)
    kinds = component_kinds(standard(example_features(), scale), mixture)
    of = np.array([[kind == x for x in KINDS] for kind in kinds], float)
    at = [NAMES.index(f) for f in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            p = responsibilities(standard(features(x[:, at]), scale), mixture)
            by_kind = p @ of
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([KINDS[i] for i in by_kind.argmax(1)]), pa.array(p.argmax(1), pa.int32()), pa.array(by_kind.max(1)), *batch.columns[1:]],
                names=["id", "kind", "component", "certainty", *NAMES],
            )

    return stats.mapInArrow(run, schema)
