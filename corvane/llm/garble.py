"""Problem 9: text read with the wrong encoding, found and undone by a hidden Markov model.

States: one clean state and one for each pair (encoding of the text, encoding it was read with), some pairs twice over. A
state emits a character given the one before it; its tables come from the labelled language samples, garbled by its pair, so
they are bounded and need no corpus statistics. ASCII after ASCII is emitted alike by all states, since no pair changes it.
Viterbi labels the characters; every labelled span gets its state's inverse transform, where that gives back text.

A document whose best possible gain over the clean labelling (the largest sum of per-character gains of any stretch) doesn't
pay for entering and leaving a state is clean for certain and isn't labelled at all; the others are labelled in blocks of
documents of similar length. Whole texts are used throughout.

Defined results: null and empty texts hold no garbled characters and come back unchanged; U+FFFD is garbled and stays.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm.samples import labelled
from corvane.session import ship, table

#: Fixed values: (encoding of the text, encoding it was read with, times).
PAIRS = (
    *(("utf-8", w, 1) for w in ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "cp437", "mac_roman", "iso8859-5", "mac_cyrillic", "cp850")),
    ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "cp1251", 2),
    *(("cp1251", w, 1) for w in ("cp1252", "koi8-r", "cp866", "mac_roman", "cp437", "iso8859-5", "mac_cyrillic")),
    *(("koi8-r", w, 1) for w in ("cp1252", "cp1251", "cp866", "mac_roman")),
    *(("cp866", w, 1) for w in ("cp1252", "cp1251", "koi8-r", "mac_roman")),
    *(("iso8859-5", w, 1) for w in ("cp1251", "cp1252", "koi8-r")),
    *(("cp1252", w, 1) for w in ("cp1251", "koi8-r", "cp866", "cp437", "mac_roman")),
)
ENTER = 7.0
#: Probabilities of what the samples don't show: other letters, other signs, and signs that no one types.
OTHER_LETTER, OTHER_SIGN, UNTYPED = 1e-5, 1e-7, 1e-9
GARBLED_FLOOR = 1e-7
KEEP = 0.9
#: Least probabilities of usual neighbours in clean text, whatever the samples show: the samples are few. Letters that the
#: samples don't hold may stand beside others of their script, more rarely beside each other; signs stand before or after
#: blanks and figures.
FLOOR_LOWER, FLOOR_UPPER, FLOOR_STOP = 2e-3, 2e-4, 5e-3
FLOOR_OTHER, FLOOR_OTHERS, FLOOR_GREEK = 5e-4, 3e-4, 1e-2
FLOOR_SIGN, FLOOR_SIGN_OF_WORD = 1e-3, 2e-4
#: What a garbled state pays for a character that no garbled sample holds.
UNKNOWN = 2.0
#: Greatest probability of neighbours of two scripts that the samples don't show.
MIXED = 1e-5
#: Typed signs beside the samples' own, signs that follow or precede a word's letters, and signs of the rest.
SIGNS = "§ № « » — – … “ ” „ ’ ‘ °"
AFTER_LETTER, BEFORE_LETTER = "²³¹ªº®™’´", "µ°¿¡$£€№§©’"
TYPED = "§№«»—–…“”„’‘°£€¥¢₽±×÷µ²³¹½¼¾©®™¿¡•†‡ªº·‰¶≤≥≠≈∞∑∫π∂∆∏−¬¦‹›→←↑↓"


@cache
def _bytes(ch: str, encoding: str) -> bytes | None:
    """A character's bytes; one that the encoding lacks is the byte of its number (as browsers do), or None where there is none."""
    try:
        return ch.encode(encoding)
    except UnicodeEncodeError:
        return bytes([ord(ch)]) if ord(ch) < 256 else None


@cache
def _chars(encoding: str, replace: bool) -> str:
    """The characters of all bytes; a byte without one there becomes U+FFFD, or the character of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append("\ufffd" if replace else chr(b))
    return "".join(out)


def encode(text: str, encoding: str, lossy: bool = False) -> bytes | None:
    """Bytes of `text`; characters that the encoding lacks are left out if lossy, else there is no result."""
    parts = [_bytes(ch, encoding) for ch in text]
    if not lossy and None in parts:
        return None
    return b"".join(p for p in parts if p)


def decode(data: bytes, encoding: str, replace: bool) -> str:
    """`data` read in `encoding`."""
    if encoding == "utf-8":
        return data.decode("utf-8", "replace")
    table = _chars(encoding, replace)
    return "".join([table[b] for b in data])


def garble(text: str, pair: tuple[str, str, int], replace: bool = False) -> str:
    """`text` read wrongly."""
    source, wrong, times = pair
    for _ in range(times):
        if source != "utf-8":  # letters the old encoding lacks were typed as others
            text = text.replace("Ӏ", "I").replace("ӏ", "I")
        text = decode(encode(text, source, lossy=True), wrong, replace)
    return text


def ungarble(text: str, pair: tuple[str, str, int]) -> str | None:
    """The original of a garbled span, or None where it can't be won back."""
    source, wrong, times = pair
    for _ in range(times):
        data = encode(text, wrong)
        if data is None:
            return None
        try:
            text = data.decode(source) if source == "utf-8" else decode(data, source, False)
        except UnicodeDecodeError:
            return None
    return text


@cache
def script_of(ch: str) -> int:
    """1 for Cyrillic letters, 2 for Latin and 3 for Greek ones, 0 for all else."""
    if not ch.isalpha():
        return 0
    name = unicodedata.name(ch, "")
    return 1 if name.startswith("CYRILLIC") else 2 if name.startswith("LATIN") else 3 if name.startswith("GREEK") else 0


def mixed(text: str) -> int:
    """How many neighbours are letters of different scripts; what is typed for a palochka goes with any within a word."""
    out = 0
    for k in range(1, len(text)):
        if (text[k - 1] >= "\x80" or text[k] >= "\x80") and (a := script_of(text[k - 1])) and (b := script_of(text[k])) and a != b:
            out += not (text[k] in "IlӀӏ" or text[k - 1] in "IlӀӏ" and k > 1 and text[k - 2] >= "\x80")
    return out


def _fits(text: str, encoding: str) -> bool:
    """Whether someone would have written `text` in that encoding: it holds nearly all of the letters, and letters beyond ASCII."""
    beyond, letters = sum(ch.isalpha() for ch in text if ch >= "\x80"), sum(map(str.isalpha, text))
    if beyond < (1 if encoding in ("utf-8", "cp1252") else 0.3 * letters):
        return False
    return sum(len(ch.encode(encoding, "ignore")) == 0 for ch in text if ch not in "Ӏӏ") <= 0.05 * len(text)


def accented(samples: list[str]) -> list[str]:
    """Latin samples in which one letter carries a mark, for every letter with one in Latin-1 and Latin Extended-A, or holds a
    typed sign or an apostrophe: garbled texts may come from words that the samples don't hold."""
    out, latin = [], [s for s in samples if s and s.isascii()] or [s for s in samples if s and sum(map(str.isascii, s)) > 0.9 * len(s)]
    for k, ch in enumerate(chr(c) for c in range(0xC0, 0x180)):
        base = unicodedata.normalize("NFD", ch)[0]
        if ch.isalpha() and latin:
            for s in (latin[k % len(latin)], latin[(k * 7 + 3) % len(latin)]):
                at = [m.start() for m in re.finditer(re.escape(base) if base != ch else "[a-z]", s, 0 if base.isupper() else re.I)] or [len(s) // 2]
                at = at[k % len(at)]
                out.append(s[:at] + ch + s[at + 1 :])
    for k, sign in enumerate(TYPED):
        if latin:
            s = latin[k % len(latin)]
            out += [s.replace(" ", f" {sign}", 1), s.replace(" ", f"{sign} ", 1)]
    out += [s[:at] + "’" + s[at:] for s in latin[::3] for at in range(3, len(s) - 3, 9) if s[at - 1].isalpha() and s[at].isalpha()]
    return out


class Garbling:
    """The model: `lp[previous, character, state]`, state 0 being the clean one."""

    def __init__(self, samples: list[str]) -> None:
        clean = [s for s in samples if s]
        clean = clean + [s.upper() for s in clean[::5]] + [f"{a} {s}" for s, a in zip(clean, SIGNS.split() * 99)]
        quoted = [f"«{s}» — “{s}” №" for s in clean[::3]]
        sets = [clean + quoted]
        for pair in PAIRS:
            fit = [s for s in [*clean, *quoted, *accented(samples)] if _fits(s, pair[0])]
            texts = [(s, garble(s, pair, replace)) for s in fit for replace in (False, True)]
            sets.append([t for s, t in texts if s != t and not t.isascii()])
        self._sampled = {c for s in sets[0] for c in s}
        # ASCII stays one symbol for itself; the last symbol stands for all that no set holds
        self.chars = np.array(sorted({*map(ord, {c for s in sets for t in s for c in t}), *range(32, 127), 9, 10, 13}), np.uint32)
        n = len(self.chars) + 1
        ascii_ = np.append(self.chars < 128, False)
        letter = np.array([chr(c).isalpha() for c in self.chars] + [False])
        untyped = np.append((self.chars >= 0x80) & (self.chars < 0xA0) | (self.chars == 0xFFFD), False)
        lp = np.empty((n, n, len(sets)), np.float32)
        for k, texts in enumerate(sets):
            code = self.code("\n".join(["", *texts, ""]))
            two = np.bincount(code[:-1].astype(np.int64) * n + code[1:], minlength=n * n).reshape(n, n).astype(np.float64)
            one = two.sum(axis=0)
            base = np.where(letter, OTHER_LETTER, OTHER_SIGN) if k == 0 else np.full(n, GARBLED_FLOOR)
            base = np.where(untyped, UNTYPED, base) if k == 0 else base
            p1 = np.maximum(one / max(one.sum(), 1), base)
            given = two.sum(axis=1, keepdims=True)
            keep = KEEP * given / (given + 5)
            p = keep * two / np.maximum(given, 1) + (1 - keep) * p1
            if k == 0:
                p = np.where(self._foreign() & (two == 0), np.minimum(p, MIXED), np.maximum(p, self._usual()))
            lp[:, :, k] = np.log(p)
        lp[n - 1, :, :], lp[:, n - 1, :] = lp[n - 1, :, :1], lp[:, n - 1, :1]
        lp[:, n - 1, 1:] -= UNKNOWN
        both = ascii_[:, None] & ascii_[None, :]
        lp[both] = lp[both][:, :1]
        if 0xFFFD in self.chars:
            lp[:, self.code("�")[0], 0] = np.log(UNTYPED) - ENTER
        self.__setstate__({"_sampled": self._sampled, "chars": self.chars, "lp": lp, "mixed": ~both.ravel()})

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        gains = self.lp[:, :, 1:] - self.lp[:, :, :1]
        self.flat_best = np.maximum(gains.max(axis=2), 0).ravel()
        read = {}  # states that were read with one encoding show in the same characters; their best gain bounds each of theirs
        for k, (source, wrong, _) in enumerate(PAIRS):
            read.setdefault((wrong, source) if wrong == "mac_cyrillic" else wrong, []).append(k)
        self.flat_gains = [gains[:, :, k].max(axis=2).ravel() for k in read.values()]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("flat_")}

    def _foreign(self) -> np.ndarray:
        """Which neighbours are letters of different scripts."""
        script = np.array([0 if c in "IlӀӏ" else script_of(c) for c in [*map(chr, self.chars), "\ufffe"]])
        return (script[:, None] != script[None, :]) & (script[:, None] > 0) & (script[None, :] > 0)

    def _usual(self) -> np.ndarray:
        """Least probabilities of what any clean text may hold: letters of one script and case one after the other, capitals
        that begin words, and blanks, stops and quotes anywhere."""
        chars = [chr(c) for c in self.chars] + ["\ufffe"]
        script = np.array([script_of(c) for c in chars])
        own = np.array([c in self._sampled or c < "\x80" or "а" <= c.lower() <= "я" or c in "ёЁӀ" for c in chars])
        upper = np.array([c.isupper() for c in chars])
        one_of = lambda signs: np.array([c in signs for c in chars])
        stop, sign = one_of(" \n\r\t.,;:!?()-\"'«»“”„’‘—–…0123456789§"), one_of(TYPED)
        out = np.zeros((len(chars), len(chars)))
        same = (script[:, None] == script[None, :]) & (script[:, None] > 0)
        both, neither = own[:, None] & own[None, :], ~own[:, None] & ~own[None, :]
        cased = same & ~upper[None, :]
        out[cased] = FLOOR_OTHER
        out[cased & neither] = FLOOR_OTHERS
        out[cased & both] = FLOOR_LOWER
        out[same & upper[:, None] & upper[None, :]] = FLOOR_OTHERS
        out[same & upper[:, None] & upper[None, :] & both] = FLOOR_UPPER
        out[same & ~upper[:, None] & upper[None, :]] = 0
        out[cased & (script == 3)[:, None]] = FLOOR_GREEK
        out[np.ix_(stop, script > 0)] = FLOOR_OTHER
        out[np.ix_(stop, (script > 0) & (own | (script == 3)))] = FLOOR_LOWER
        out[np.ix_(stop, sign)] = FLOOR_SIGN
        out[np.ix_(stop, one_of("√"))] = FLOOR_SIGN_OF_WORD
        out[np.ix_((script > 0) & own, one_of(AFTER_LETTER))] = FLOOR_SIGN_OF_WORD
        out[np.ix_(one_of(BEFORE_LETTER), (script > 0) & own)] = FLOOR_SIGN_OF_WORD
        out[:, stop] = FLOOR_STOP
        return out

    def code(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.chars, points)
        at[at == len(self.chars)] = 0
        return np.where(self.chars[at] == points, at, len(self.chars)).astype(np.int32)

    def suspects(self, texts: list[str]) -> list[int]:
        """Which texts the clean labelling isn't certain for.

        A span pays for entering its state and, unless it ends the text, for leaving it. First the largest stretch sum of
        the best gain over all states is held against that, then, for the texts that are left, that of a few states at a time.
        Neighbours in ASCII gain nothing and are passed over."""
        n = len(self.chars) + 1
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        line = self.code("\n".join(["", *texts, ""]))
        pair = line[:-2].astype(np.int64) * n + line[1:-1] if len(texts) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)[: len(pair)]
        keep = self.mixed[pair]
        pair, text = pair[keep], text[keep]

        def certain(gain: np.ndarray, pair: np.ndarray, text: np.ndarray) -> np.ndarray:
            """Texts for which `gain` may pay."""
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            total = np.cumsum(gain[pair], dtype=np.float64)
            total -= text * 1e5  # the lowest sum so far starts anew with each text
            before = np.concatenate([total[:1] - gain[pair[0]], total[:-1]])
            before[first] = total[first] - gain[pair[first]]
            over = total - np.minimum.accumulate(before)
            end = np.concatenate([first[1:], [len(text)]]) - 1
            return text[first][(np.maximum.reduceat(over, first) > 2 * ENTER) | (over[end] > ENTER)]

        if not len(pair):
            return []
        some = np.zeros(len(texts), bool)
        some[certain(self.flat_best, pair, text)] = True
        keep = some[text]
        pair, text, some = pair[keep], text[keep], np.zeros(len(texts), bool)
        for gain in self.flat_gains if len(pair) else ():
            some[certain(gain, pair, text)] = True
        return np.flatnonzero(some).tolist()

    def label(self, texts: list[str]) -> list[np.ndarray]:
        """The state of every character of `texts`, labelled side by side."""
        states, width = self.lp.shape[2], max(map(len, texts))
        codes = np.full((width + 1, len(texts)), self.code("\n")[0], np.int32)
        for k, t in enumerate(texts):
            codes[1 : len(t) + 1, k] = self.code(t)
        score = np.full((len(texts), states), -ENTER, np.float32)
        score[:, 0] = 0
        back = np.empty((width, len(texts), states), np.int8)
        stay = np.arange(states, dtype=np.int8)
        for t in range(width):
            # a state is entered from the clean one, and left for it
            into = score[:, :1] - ENTER
            best = score[:, 1:].max(axis=1)
            leave = best - ENTER
            step, came = score, np.broadcast_to(stay, score.shape).copy()
            enter = into > score
            enter[:, 0] = False
            step = np.where(enter, into, step)
            came[enter] = 0
            home = leave > score[:, 0]
            step[home, 0] = leave[home]
            came[home, 0] = 1 + score[home, 1:].argmax(axis=1)
            back[t] = came
            score = step + self.lp[codes[t], codes[t + 1]]
            score -= score.max(axis=1, keepdims=True)
        path, state = np.empty((width, len(texts)), np.int8), score.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            path[t] = state
            state = back[t, np.arange(len(texts)), state]
        return [path[: len(t), k].copy() for k, t in enumerate(texts)]

    def spans(self, text: str, states: np.ndarray) -> list[tuple[int, int, int]]:
        """(from, to, state) of the stretches of a garbled state that hold more than ASCII."""
        cut = np.flatnonzero(np.diff(states)) + 1
        ends = [0, *cut.tolist(), len(text)]
        return [(a, b, int(states[a])) for a, b in zip(ends, ends[1:]) if b > a and states[a] and not text[a:b].isascii()]

    def clean_score(self, text: str) -> float:
        """Log likelihood of `text` in the clean state."""
        code = self.code(f"\n{text}\n")
        return float(self.lp[code[:-1], code[1:], 0].astype(np.float64).sum())

    def _better(self, span: str, pair: tuple[str, str, int]) -> tuple[float, str]:
        """What a garbled piece was and how much better it reads; the piece itself where it can't be undone or reads no better."""
        back = ungarble(span, pair)
        gain = self.clean_score(back) - self.clean_score(span) if back is not None else 0
        return (gain, back) if gain > 0 else (0, span)

    def _undone(self, text: str, a: int, b: int, low: int, pair: tuple[str, str, int]) -> tuple[int, int, str, bool] | None:
        """(from, to, original, whole) of a garbled span, the reading that is likeliest in the clean state; None if the span isn't garbled.

        A span may begin or end within a character's bytes or within a word, so it is tried with and without the characters
        beside it that aren't ASCII; a text that was read wrongly twice may have been read so once. Where no inverse
        transform of the whole exists, its pieces are undone one by one; if none reads better, only signs that no one types
        show that the span is garbled."""
        first, last = a, b
        while first > low and text[first - 1] >= "\x80":
            first -= 1
        while last < len(text) and text[last] >= "\x80":
            last += 1
        left, right = text[max(low, first - 2) : first], text[last : last + 1]
        before = mixed(left + text[first:last] + right)
        now = self.clean_score(left + text[first:last] + right)
        best, exists = (now + ENTER, None, True), False
        for p in [pair] if pair[2] == 1 else [pair, (*pair[:2], 1)]:
            for i, k in ((first, last), (a, b)):
                back = ungarble(text[i:k], p)
                exists |= back is not None and p == pair
                new = text[first:i] + (back or "") + text[k:last]
                if back is None or back == text[i:k] or mixed(left + new + right) > before:
                    continue
                best = max(best, (self.clean_score(left + new + right), new, True), key=lambda x: x[0])
        if not exists:
            parts = [self._better(x, pair) if k % 2 else (0, x) for k, x in enumerate(_PIECES.split(text[first:last]))]
            gain = sum(g for g, _ in parts)
            if now + gain > best[0] or best[1] is None and _UNTYPED.search(text[first:last]):
                best = now + gain, "".join(x for _, x in parts), False
        return None if best[1] is None else (first, last, *best[1:])

    def restore(self, text: str, states: np.ndarray) -> tuple[str, int, int]:
        """The text with all spans undone where possible, the number of spans, and how many were undone whole."""
        out, at, spans, undone = [], 0, 0, 0
        for a, b, s in self.spans(text, states):
            a = max(a, at)
            # ASCII at the borders doesn't count; it would only break a strict decoding
            while a < b and text[a] < "\x80":
                a += 1
            while a < b and text[b - 1] < "\x80":
                b -= 1
            got = self._undone(text, a, b, at, PAIRS[s - 1]) if a < b else None
            if got is not None:
                first, last, back, whole = got
                spans, undone = spans + 1, undone + whole
                out += [text[at:first], back]
                at = last
        return "".join([*out, text[at:]]), spans, undone


_PIECES = re.compile(r"([^\x00-\x7f]+)")
_UNTYPED = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
BLOCK = 64
#: Labelled samples of a language that the model is fitted to at most.
PER_LANGUAGE = 400
SCHEMA = pa.schema([("doc_id", pa.int64()), ("restored", pa.string()), ("spans", pa.int64()), ("undone", pa.int64())])


def _labeller(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, waiting = pickle.loads(held.value), []

        def flush(rows: list[tuple[int, str]]):
            rows = sorted(rows, key=lambda r: len(r[1]))
            out, at = [], 0
            while at < len(rows):
                n = max(1, min(BLOCK, 2_000_000 // (len(rows[min(at + BLOCK, len(rows)) - 1][1]) + 1)))
                block, at = rows[at : at + n], at + n
                for (k, text), states in zip(block, model.label([t for _, t in block])):
                    new, spans, undone = model.restore(text, states)
                    if spans:
                        out.append((k, new, spans, undone))
            return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in out], SCHEMA)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 2000):
                waiting += [(ids[at + k], texts[at + k]) for k in model.suspects(texts[at : at + 2000])]
            if len(waiting) >= 8 * BLOCK:
                yield flush(waiting)
                waiting = []
        yield flush(waiting)

    return run


def garbled(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, restored, spans, undone) of the documents (doc_id, text) that hold garbled characters."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(pickle.dumps(Garbling([t for _, t in labelled(samples, PER_LANGUAGE)])))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''").mapInArrow(_labeller(held), "doc_id long, restored string, spans long, undone long")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, restored, spans, undone): documents with garbled characters, and their text with what could be won back."""
    return garbled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_samples"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of documents whose text holds garbled characters."""
    return p9_restored(spark, sf_dir).select("doc_id").distinct()
