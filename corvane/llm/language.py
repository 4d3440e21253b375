"""Problem 6: languages of texts and of their parts, by error-correcting output codes.

Every class (a language in one script) has a codeword of bits. For each bit a binary classifier over a word's character
n-grams, fitted to the labelled samples, says which half of the classes the word looks like; loss-weighted decoding turns the
margins into a loss per codeword. A Viterbi pass over the words of a text finds the parts: a change of language costs SWITCH,
and no single word can cost more than CLIP, so names and single foreign words don't make a part. Close decisions are flagged.

The classifiers see only the labelled samples (PER_LANGUAGE of a language at most); every text is labelled whole.

Defined results: a null text, or one without a word, has no part; a language is in a text if a part of at least MIN_WORDS words
is in it; where no part is that long, the text's language is the one with the least loss over all its words.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.minhash import runs
from corvane.llm.plain import is_plain, plain_text
from corvane.llm.samples import labelled
from corvane.session import ship, table

PER_LANGUAGE = 1000
ORDERS, BITS, ALPHA = (1, 2, 3, 4), 15, 0.3
SWITCH, CLIP, MIN_WORDS = 6.0, 4.0, 5
#: How much less likely a bordering word may be in a part's language to count for it.
BORDER = 5.0
#: Parts whose mean loss is this near to the next language's are flagged as ambiguous.
AMBIGUOUS = 0.5
CACHE = 300_000
#: Other spellings of the sample languages' codes, and codes that name no language.
SPELLINGS = {
    "lbe": ("lbe", "lak", "lakku", "лак", "лакский", "лакку", "lakisch", "lac"),
    "ru": ("ru", "rus", "russian", "русский", "russisch", "рус"),
    "en": ("en", "eng", "english", "английский", "englisch", "анг"),
    "av": ("av", "ava", "avar", "avaric", "аварский", "awarisch", "магӀарул"),
    "de": ("de", "deu", "ger", "german", "deutsch", "немецкий", "нем"),
}

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*")


def words_of(text: str) -> list[str]:
    """The words of a text between white space, in lower case and without signs; what holds no letter is no word."""
    text = text if is_plain(text) else plain_text(text)
    return [m[0].lower() for t in text.split() if (m := _WORD.search(t))]


class LanguageCodes:
    """The fitted classifiers and the codewords."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        texts: dict[tuple[str, str], list[str]] = {}
        for lang, text in samples:
            script = "Latn" if len(regex.findall(r"\p{Latin}", text)) > len(text) / 2 else "Cyrl" if regex.search(r"\p{Cyrillic}", text) else "Zyyy"
            texts.setdefault((lang, script), []).extend(words_of(text))
        self.classes = sorted(k for k, w in texts.items() if w)
        self.langs = sorted({lang for lang, _ in self.classes})
        self.of = np.array([self.langs.index(lang) for lang, _ in self.classes], np.int64)
        n, size = len(self.classes), 1 << BITS
        if n <= 6:  # the exhaustive code
            columns = [(1, *c) for c in itertools.product((1, -1), repeat=max(n - 1, 0)) if -1 in c]
        else:
            rng = np.random.RandomState(7)
            columns = [c for c in (tuple(rng.choice([-1, 1], n)) for _ in range(60)) if len(set(c)) == 2]
        self.code = np.array(columns, np.float32).reshape(len(columns), n)
        share = np.zeros((n, len(ORDERS), size))
        for k, key in enumerate(self.classes):
            for o, (h, _) in enumerate(self._grams(texts[key])):
                c = np.bincount(h, minlength=size) + ALPHA / 100
                share[k, o] = c / c.sum()
        plus, minus = self.code > 0, self.code < 0
        w = [[np.log(share[p, o].mean(axis=0)) - np.log(share[m, o].mean(axis=0)) for o in range(len(ORDERS))] for p, m in zip(plus, minus)]
        self.weights = np.array(w, np.float32).transpose(1, 2, 0).copy() if len(columns) else np.zeros((len(ORDERS), size, 0), np.float32)
        self.trust = np.ones(len(columns), np.float32)
        if len(columns):  # a bit counts by how well it tells the sample words apart
            for b in range(len(columns)):
                right = np.concatenate([(self.margins(texts[key])[:, b] * self.code[b, k] > 0) for k, key in enumerate(self.classes)])
                self.trust[b] = max(right.mean() - 0.5, 0.01)
            self.trust /= self.trust.mean() * len(columns)
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def _grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for o in ORDERS:
            h, offsets = runs([f" {w} " if o > 1 else w for w in words], o)
            out.append(((h >> np.uint64(64 - BITS)).astype(np.int64), offsets))
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """(words, bits): log odds of each bit; overlapping runs of several lengths are one piece of evidence."""
        total = np.zeros((len(words), self.weights.shape[2]), np.float32)
        for o, (h, offsets) in enumerate(self._grams(words)):
            n = np.diff(offsets)
            part = np.zeros_like(total)
            some = n > 0
            if some.any():
                part[some] = np.add.reduceat(self.weights[o][h], offsets[:-1][some], axis=0)
            total += part
        return total / len(ORDERS)

    def losses(self, words: list[str]) -> np.ndarray:
        """(words, classes): loss-weighted distance of each codeword from the word's margins."""
        m = self.margins(words)
        return np.stack([(np.logaddexp(0, -m * self.code[:, k]) * self.trust).sum(axis=1) for k in range(len(self.classes))], axis=1) if len(words) else np.zeros((0, len(self.classes)), np.float32)

    def lookup(self, texts: list[list[str]]) -> list[np.ndarray]:
        """(words, classes) losses of each text; words seen lately aren't worked out again."""
        new = [w for w in {w for t in texts for w in t} if w not in self.cache]
        if len(self.cache) > CACHE:
            self.cache.clear()
            new = list({w for t in texts for w in t})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            loss = self.losses(part)
            self.cache.update(zip(part, loss))
        return [np.stack([self.cache[w] for w in t]) if t else np.zeros((0, len(self.classes))) for t in texts]

    def by_language(self, losses: np.ndarray) -> np.ndarray:
        """(words, languages): each language's loss is that of its better script."""
        return np.stack([losses[:, self.of == k].min(axis=1) for k in range(len(self.langs))], axis=1)

    def parts(self, losses: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(from, to, language) of each text's parts, the texts' words worked on side by side. Scripts are told apart on
        the way, so that a word in another script isn't taken for one of its neighbours' language."""
        k, width = len(self.classes), max([1, *map(len, losses)])
        cost = np.zeros((width, len(losses), k), np.float32)
        for j, x in enumerate(losses):
            if len(x):
                cost[: len(x), j] = np.minimum(x - x.min(axis=1, keepdims=True), CLIP)
        score, back = cost[0].copy(), np.zeros((width, len(losses), k), np.int16)
        stay = np.arange(k, dtype=np.int16)
        for t in range(1, width):
            best = score.argmin(axis=1)
            low = score[np.arange(len(losses)), best][:, None] + SWITCH
            move = low < score
            back[t] = np.where(move, best[:, None], stay)
            score = np.where(move, low, score) + cost[t]
        out, state = [], score.argmin(axis=1)
        path = np.empty((width, len(losses)), np.int16)
        for t in range(width - 1, -1, -1):
            path[t] = state
            state = back[t, np.arange(len(losses)), state]
        for j, x in enumerate(losses):
            p = self.of[path[: len(x), j]]
            cut = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            out.append([(a, b, int(p[a])) for a, b in zip(cut, cut[1:]) if b > a])
        return out


def widened(loss: np.ndarray, part: tuple[int, int, int]) -> tuple[int, int, int]:
    """A part one word short of MIN_WORDS takes in a bordering word that is hardly less likely in its language: names at a
    border belong to either side."""
    a, b, lang = part
    if b - a == MIN_WORDS - 1:
        near = [(float(loss[k, lang] - loss[k].min()), k) for k in (a - 1, b) if 0 <= k < len(loss)]
        if near and min(near)[0] <= BORDER:
            return (min(near)[1], b, lang) if min(near)[1] < a else (a, b + 1, lang)
    return part


SCHEMA = pa.schema([("id", pa.string()), ("code", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_())])


def _labeller(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for b in batches:
            ids, codes, texts = (c.to_pylist() for c in b.columns)
            words = [words_of(t) for t in texts]
            order = sorted(range(len(ids)), key=lambda k: len(words[k]))
            rows = []
            for at in range(0, len(order), 2000):
                block = order[at : at + 2000]
                losses = model.lookup([words[k] for k in block])
                for k, loss, parts in zip(block, losses, model.parts(losses)):
                    loss = model.by_language(loss)
                    long = [p for p in map(partial(widened, loss), parts) if p[1] - p[0] >= MIN_WORDS]
                    if not long and len(loss):
                        clipped = np.minimum(loss - loss.min(axis=1, keepdims=True), CLIP).sum(axis=0)
                        long = [(0, len(loss), int(clipped.argmin()))]
                    for a, e, lang in long:
                        mean = loss[a:e].mean(axis=0)
                        p = np.exp(-(mean - mean.min()))
                        next_ = np.sort(mean)[1] if len(mean) > 1 else np.inf
                        rows.append((ids[k], codes[k], a, e - a, model.langs[lang], float(p[lang] / p.sum()), bool(next_ - mean[lang] < AMBIGUOUS)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

    return run


def parts(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, code, first_word, n_words, lang, confidence, ambiguous): the parts of the texts (id, code, text)."""
    spark = texts.sparkSession
    ship(spark)
    model = LanguageCodes(labelled(samples.where("lang is not null"), PER_LANGUAGE))
    texts = texts if model.langs else texts.limit(0)  # without a sample there is no language to find
    held = spark.sparkContext.broadcast(pickle.dumps(model))
    schema = "id string, code string, first_word int, n_words int, lang string, confidence double, ambiguous boolean"
    return texts.select(F.col("id").cast("string").alias("id"), F.col("code").cast("string").alias("code"), "text").where("text is not null").mapInArrow(_labeller(held), schema)


def named(code: str | Column) -> Column:
    """The sample language that a code names, whatever its spelling or standard; null if it names none of them."""
    c = F.col(code) if isinstance(code, str) else code
    head = F.lower(F.element_at(F.split(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")), "[-_ ,;(]"), 1))
    out = None
    for lang, names in SPELLINGS.items():
        out = F.when(head.isin(*names), lang) if out is None else out.when(head.isin(*names), lang)
    return out.otherwise(head)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").select("id", F.col("language_code").alias("code"), F.col("text_original").alias("text"))


def p6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, first_word, n_words, lang, confidence, ambiguous): the language of every segment, and of every part of a mixed one."""
    return parts(_segments(spark, sf_dir), table(spark, sf_dir, "language_samples")).drop("code").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang) of segments of at least five words whose code is missing or wrong, and of all that mix languages; a row per language."""
    enough = F.size(F.split(F.trim(F.regexp_replace("text", r"[\s\p{Z}\x{FEFF}]+", " ")), " ")) >= MIN_WORDS
    found = parts(_segments(spark, sf_dir).where(enough & F.col("id").isNotNull()), table(spark, sf_dir, "language_samples"))
    per = found.groupBy("id").agg(F.collect_set("lang").alias("langs"), F.min(F.coalesce(named("code"), F.lit(""))).alias("lo"), F.max(F.coalesce(named("code"), F.lit(""))).alias("hi"))
    wrong = (F.size("langs") > 1) | (F.col("lo") != F.col("langs")[0]) | (F.col("hi") != F.col("langs")[0])
    return per.where(wrong).select("id", F.explode("langs").alias("lang"))
