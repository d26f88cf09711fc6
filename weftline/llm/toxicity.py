"""Toxicity by a weighted grammar of finite-state transducers.

A lexicon maps tokens to classes and weights. Transducers for negation, reported speech, targets and threats are composed into one machine that
reads the classes of a clause and writes what was matched: an insult or a threat, aimed at someone or not, denied or only reported. Weights add along
a path: the word's own and those of the transitions that rewrote it. A text's score comes from the sum of its matches' weights, that sum
for the text's length, and how many matches of each sort it holds, however many; how much each counts starts from
the grammar's own and is refitted to labels by logistic regression.

The lexicon is fixed for words of a few languages. Stems of further insults, which take many endings, are learned with their weights for any language: how many times
likelier such words are in toxic texts. Stems and regression are fitted on a sample of SAMPLE labelled rows of each label (the bound is a parameter).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import ROW_KEY, crc_of, map_texts, materialise, with_row_key
from weftline.llm.transducers import Transducer, window

#: The lexicon.
INSULTS = """arse arschloch asshole basura bastard bastardo bitch buffoon cerdo clown connard cretin crétin degenerate despicable
disgusting dreck dumb dumbass dumm dummkopf ekelhaft estúpida estúpido filth filthy fool freak garbage hijueputa idiot idiota idiote
idioten idiotic idiots imbecile imbécil imbécile jerk loser losers maldito miserable moron morons nutjob parasite parasites pathetic pendejo
pig pigs repulsive retard salaud salope scum scumbag slut stupid stupide subhuman trash trottel vermin verräter versager whore widerlich
worthless wretch""".split()
THREATS = """abstechen ahorcar assassinate attack beat bomb burn crush destroy erschießen frapper golpear hang hurt kill matar murder punch shoot
slaughter smash stab strangle töten tuer umbringen verprügeln violar""".split()
WILL = "will shall gonna going must should let 'll werde werden wird vais va vamos voy ich'll".split()
TARGETS = """you your yours yourself u he she they them him her his their these those people everyone women men immigrants migrants foreigners
jews muslims christians blacks whites gays tu toi vous votre ton ta ihr dich dir du euch sie usted ustedes tú te ti ellos ellas""".split()
NEGATIONS = """not no never neither nor isn't aren't wasn't don't doesn't didn't won't wouldn't can't cannot nobody without nicht kein keine keinen
nie niemals ne pas jamais aucun nunca jamás ningún sin""".split()
REPORTS = """said says say saying told tells wrote writes claimed claims called calls calling quoted quotes reported reports according alleged
allegedly word sagte sagt nannte berichtet schrieb laut dit disait appelé écrit selon dijo dice llamó escribió según""".split()
CLASSES = {w: c for c, words in (("WILL", WILL), ("TARGET", TARGETS), ("NEG", NEGATIONS), ("REPORT", REPORTS), ("THREAT", THREATS), ("INSULT", INSULTS)) for w in words}
ALPHABET = ["OTHER", "END", "WILL", "TARGET", "NEG", "REPORT", "THREAT", "INSULT"]

#: What a clause can write, and the sort it stands for.
_WRITES = {"INSULT": "insult", "AIMED": "aimed_insult", "DENIED": "denied_insult", "REPORTED": "reported_insult", "THREAT": "threat", "AIMED_THREAT": "aimed_threat", "DENIED_THREAT": "denied_threat", "REPORTED_THREAT": "reported_threat"}
SORTS = tuple(_WRITES.values())
#: Weights of the lexicon's words by class (of learned stems: their own, at most MOST), and of the transitions that rewrite them.
WORD_WEIGHT, MOST = {"INSULT": 2.0, "THREAT": 0.1}, 4.0
DENIED, REPORTED, AIMED, MEANT = -2.5, -1.7, 1.0, 2.4
BIAS, RIDGE, THRESHOLD = -3.0, 1.0, 0.3
#: What the regression sees: the weights' sum, that sum for PER words of text, and the logarithm of one and the matches of each sort; and what the grammar itself makes of them.
PER = 100
FEATURES = ("weight", "density", *SORTS)
PRIOR = np.array([BIAS, 1.0, 0.0, *[0.0] * len(SORTS)])
#: Rows with crc32(id) mod FOLDS == HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2

#: Learned stems: rows of each label, letters, forms, occurrences in toxic rows, toxic rows, how many times likelier there, and how sure that is (twice the log likelihood ratio), at least.
SAMPLE, STEM_LETTERS, STEM_FORMS, STEM_COUNT, STEM_TEXTS, STEM_RATIO, STEM_SURE = 10_000, (4, 8), 4, 8, 6, 5.0, 40.0
WORD_LETTERS = r"\p{L}+"

#: Words; n't belongs to its verb, other clitics ('ll, l') and what they lean on are tokens of their own.
CLAUSE, TOKEN = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W_]+n['’]t(?![^\W_])|['’]ll(?![^\W_])|[^\W_]+")


def trigger(stems: Iterable[str] = ()) -> re.Pattern:
    """Finds words of the lexicon and words that begin with a stem."""
    words = "|".join(sorted(INSULTS + THREATS, key=lambda w: (-len(w), w)))
    return re.compile(rf"(?<![^\W_])(?:(?:{words})(?![^\W_])" + "".join(f"|{re.escape(x)}" for x in stems) + ")")


def grammar() -> Transducer:
    """Negation and reports look ahead of insults and threats, then targets; a negation ends at a clause or a report."""
    negation = window("NEG", {"INSULT": "DENIED", "THREAT": "DENIED_THREAT"}, 4, DENIED, closes=["REPORT"])
    report = window("REPORT", {"INSULT": "REPORTED", "THREAT": "REPORTED_THREAT"}, 8, REPORTED)
    intent = window("WILL", {"THREAT": "MEANT"}, 4)
    target = window("TARGET", {"INSULT": "AIMED"}, 5, AIMED)
    return negation >> report >> intent >> target >> Transducer(0, _aim)


def _aim(state, symbol: str):
    """A meant threat is written, with the weight of being meant, once its target follows within three symbols, else as a plain one."""
    if symbol == "MEANT":
        return 3, "OTHER" if state == 0 else "THREAT", 0.0
    if state:
        if symbol == "TARGET":
            return 0, "AIMED_THREAT", MEANT
        if state == 1 or symbol == "END":
            return 0, "THREAT" if symbol not in _WRITES else symbol, 0.0
        return state - 1, symbol, 0.0
    return 0, symbol, 0.0


_TABLE, _ = grammar().compiled(ALPHABET)


class Lexicon:
    """Classes and weights of tokens: the fixed words, and learned stems with their weights."""

    def __init__(self, stems: dict[str, float] | None = None):
        self.stems = dict(stems or {})
        self.lengths = sorted({len(x) for x in self.stems}, reverse=True)
        self.found = trigger(sorted(self.stems))

    def read(self, token: str) -> tuple[str, float]:
        if symbol := CLASSES.get(token):
            return symbol, WORD_WEIGHT.get(symbol, 0.0)
        for n in self.lengths:  # the longest stem counts
            if (weight := self.stems.get(token[:n])) is not None:
                return "INSULT", weight
        return "OTHER", 0.0


def matched(text: str | None, lexicon: Lexicon) -> dict[str, float]:
    """How often each sort was matched in a text's clauses, and `weight`, the sum of all matches' weights; `words` if there are any matches."""
    out = dict.fromkeys((*SORTS, "weight", "words"), 0.0)
    lowered = (text or "").lower()
    if not lexicon.found.search(lowered):
        return out
    for clause in CLAUSE.split(lowered):
        tokens = TOKEN.findall(clause)
        out["words"] += len(tokens)
        if not lexicon.found.search(clause):
            continue
        state, own = 0, 0.0
        for token in [*tokens, None]:
            symbol, weight = ("END", 0.0) if token is None else lexicon.read(token.replace("’", "'"))
            own = weight if symbol in WORD_WEIGHT else own  # a threat is written later than it is read
            state, written, path = _TABLE[state][symbol]
            if sort := _WRITES.get(written):
                out[sort] += 1
                out["weight"] += own + path
    return out


def _sampled(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """id and label of at most `sample` rows of each label, those with the smallest digests of their ids; null labels and ids, and held-out rows, are never among them."""
    learn = F.col("label").isin(0.0, 1.0) & F.col("id").isNotNull() & (crc_of(F.col("id")) % FOLDS != HELD_OUT)
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(learn).distinct()
    picked = [ids.where(F.col("label") == x).orderBy(F.xxhash64("id"), "id").limit(sample) for x in (0.0, 1.0)]
    return F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample ids


def learn_stems(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Stems of insults with their weights: beginnings of many different words that are likelier in toxic rows than in clean ones, beyond chance.

    chosen: id and label. A stem must have STEM_FORMS forms in STEM_TEXTS toxic rows, so that the words of one text, or of its copies, don't become stems. All stems that pass are kept.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD_LETTERS), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("id", "label", F.explode(words).alias("word"))
    # a bit for each toxic row, by its digest: as many rows as bits hold a stem, or more
    bit = F.when(F.col("label") > 0, F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))")).otherwise(F.lit(0).cast("long"))
    forms = materialise(rows.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"), F.bit_or(bit).alias("texts")), "forms")
    all_toxic, all_clean = forms.agg(F.sum("toxic"), F.sum("clean")).first()
    if not all_toxic or not all_clean:
        return {}
    lengths = F.array(*[F.lit(n) for n in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1)])
    stems = forms.select("*", F.explode(lengths).alias("n")).where(F.length("word") >= F.col("n")).groupBy(F.col("word").substr(F.lit(1), F.col("n")).alias("stem"))
    stems = stems.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count(F.when(F.col("toxic") > 0, 1)).alias("forms"), F.bit_count(F.bit_or("texts")).alias("texts"))
    share = F.lit(all_toxic / (all_toxic + all_clean))
    both = F.col("t") + F.col("c")
    sure = 2 * (F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - share)))).otherwise(0.0))
    likelier = (F.col("t") / all_toxic) / ((F.col("c") + 0.5) / all_clean)
    good = stems.where((F.col("forms") >= STEM_FORMS) & (F.col("t") >= STEM_COUNT) & (F.col("texts") >= STEM_TEXTS)).withColumns({"sure": sure, "likelier": likelier}).where((F.col("sure") >= STEM_SURE) & (F.col("likelier") >= STEM_RATIO))
    found = {r["stem"]: (r["t"], math.log(r["likelier"])) for r in good.orderBy("stem").collect()}
    # a longer stem stays beside a shorter one only if it is clearly likelier, a shorter one only if it covers more than the longer ones
    kept: dict[str, float] = {}
    for x in sorted(found, key=lambda x: (len(x), x)):
        shorter = max((kept[x[:n]] for n in range(STEM_LETTERS[0], len(x)) if x[:n] in kept), default=None)
        if shorter is None or found[x][1] > shorter + 0.5:
            kept[x] = found[x][1]
    return {x: min(MOST, w) for x, w in kept.items()}


def features(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with a column __wl_<feature> for each of FEATURES; without the text unless keep_text."""

    def work(texts: list[str | None]) -> list[pa.Array]:
        found = [matched(t, lexicon) for t in texts]
        columns = [[f["weight"] for f in found], [PER * f["weight"] / (PER + f["words"]) for f in found], *[[math.log1p(f[s]) for f in found] for s in SORTS]]
        return [pa.array(c, pa.float64()) for c in columns]

    return map_texts(docs, text_col, work, [T.StructField(f"__wl_{f}", T.DoubleType()) for f in FEATURES], keep_text)


def fit(found: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> list[float]:
    """Bias, then a weight for each of FEATURES. found: features(); chosen: id and label. Without labels the grammar's own weights hold."""
    rows = found.select(F.col(id_col).alias("id"), *[f"__wl_{f}" for f in FEATURES]).join(chosen, "id").select("label", *[f"__wl_{f}" for f in FEATURES])
    some = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).toArrow()  # equal rows are summed; as bounded as the sample
    if not some.num_rows:
        return PRIOR.tolist()
    x = np.column_stack([np.ones(some.num_rows), *[some.column(f"__wl_{f}").to_numpy() for f in FEATURES]])
    n, y = some.column("n").to_numpy().astype(float), some.column("label").to_numpy()
    order = np.lexsort((y, *x.T))
    x, n, y = x[order], n[order], y[order]
    w, ridge = PRIOR.copy(), np.full(len(PRIOR), RIDGE)
    ridge[0] = 1e-3
    loss = lambda w: float((n * np.logaddexp(0, (1 - 2 * y) * (x @ w))).sum() + (ridge * (w - PRIOR) ** 2).sum() / 2)
    for _ in range(100):  # Newton's method; the penalty pulls to the grammar's own weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * (w - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w.tolist()


def _score(weights: list[float]) -> Column:
    total = F.lit(weights[0])
    for f, w in zip(FEATURES, weights[1:], strict=True):
        total = total + F.col(f"__wl_{f}") * F.lit(w)
    return 1 / (1 + F.exp(-total))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: ROW_KEY, doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null and empty texts match nothing and get the score of a text without matches. Rows that repeat count as often as they are stored; null ids are
    not held out and not learned from. An empty table gives no rows. Other columns, language and source among them, are not read.
    """
    keyed = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    chosen = _sampled(labels, id_col, label_col, sample)
    found = materialise(features(keyed, Lexicon(learn_stems(keyed, chosen))), "toxic_features")
    weights = fit(found, chosen)
    held = crc_of(F.col("doc_id")) % FOLDS == HELD_OUT
    scored = found.select(*ROW_KEY, "doc_id", held.alias("held_out"), _score(weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that toxicity() predicts; same columns, whatever their names. Nulls, repeats and empty tables are as there.

    All texts are read once, those of the sample twice more; they are never shuffled.
    """
    chosen = _sampled(labels, id_col, label_col, sample)
    lexicon = Lexicon(learn_stems(docs, chosen, id_col, text_col))
    known = docs.select(F.col(id_col).alias("__wl_id"), F.col(text_col).alias("__wl_text")).join(chosen.withColumnRenamed("id", "__wl_id").drop("label"), "__wl_id", "left_semi")
    weights = fit(features(known, lexicon, "__wl_text"), chosen, "__wl_id")
    return features(docs, lexicon, text_col, keep_text=True).where(_score(weights) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
