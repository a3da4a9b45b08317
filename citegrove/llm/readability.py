"""Reading level of texts: shares of words outside high-frequency lists of the corpus, plus average sentence length, on a graded scale."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.plans.materialize import ship

#: Graded passages read on the driver to fit the formula; the passages are a fixed table.
MAX_PASSAGES = 20_000
#: Lengths of the high-frequency lists: the first 8 words of the corpus, and on by a third of a doubling up to 4,096.
LISTS = [int(8 * 2 ** (i / 3)) for i in range(28)]
#: A listed word stands in so many English texts at least, and in as many English texts as others.
LEAST_TEXTS = 2
#: Letters of the longest word that can be listed.
LONGEST_WORD = 40
#: What English prose has: words at least, share of its letters that are ASCII, and the share of its words that are function words, and of how many
#: sorts; or else, as in telegraphic prose, the share of its words that are listed, and of its characters that are letters.
LEAST_WORDS, ASCII_LETTERS, FUNCTION_SHARE, FUNCTION_SORTS, LISTED_SHARE, LETTER_SHARE = 25, 0.75, 0.15, 5, 0.6, 0.75
#: Longest sentence length that counts, in words.
LONGEST = 40
#: Distinct words that a task counts before it hands the counts on.
HELD = 200_000
#: Function words of English; fixed values.
FUNCTION_WORDS = frozenset(
    """the a an this that these those and or but nor if because although though while when where whether since until unless than as of in on at by for from with
    without to into onto over under between among through during before after about against within across is are was were be been being am has have had having do
    does did can could may might must shall should will would it its he she they them their his her we our us i you your my me him not no there here which who whom
    whose what how why so such very more most each every any some all both few many much other then also only just""".split()
)

_ASCII_WORD = re.compile(r"[a-z]+").findall
_ANY_WORD = re.compile(r"[^\W\d_]+").findall
_END = re.compile(r"[.!?。]+(?=\s|$)|。").findall


def words(text: str) -> list[str]:
    low = text.lower()
    return _ASCII_WORD(low) if low.isascii() else _ANY_WORD(low)


def has_function_words(counts: Counter, n: int) -> bool:
    """Whether n counted words hold as many function words, of as many sorts, as English prose does."""
    there = FUNCTION_WORDS & counts.keys()
    return len(there) >= FUNCTION_SORTS and sum(counts[w] for w in there) >= FUNCTION_SHARE * n


def frequent_words(df: DataFrame, text: str) -> list[str]:
    """The words that most English texts of df hold, the most frequent first, as many as the longest list has.

    English texts are those of LEAST_WORDS words or more with function words as prose has them. All words of all texts are counted:
    each task adds up its own texts, the sums are shuffled by word, and the first words by document frequency (ties by alphabet) are read.
    """
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        english: Counter = Counter()

        def out() -> pa.RecordBatch:
            held = list(every)
            b = pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([every[w] for w in held], pa.int64()), pa.array([english[w] for w in held], pa.int64())], names=["word", "n", "english"])
            every.clear()
            english.clear()
            return b

        for b in batches:
            for x in b.column(0):
                if t := x.as_py():
                    c = Counter(words(t))
                    own = [w for w in c if len(w) <= LONGEST_WORD]
                    every.update(own)
                    n = sum(c.values())
                    if n >= LEAST_WORDS and has_function_words(c, n):
                        english.update(own)
            if len(every) > HELD:
                yield out()
        yield out()

    sums = df.select(text).mapInArrow(count, "word string, n long, english long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("english").alias("english"))
    listed = sums.filter((F.col("english") >= LEAST_TEXTS) & (2 * F.col("english") >= F.col("n")))
    return [r["word"] for r in listed.orderBy(F.desc("english"), "word").limit(LISTS[-1]).collect()]


@dataclass
class Formula:
    """at: of each listed word the number of the shortest list that holds it; levels, means, inverse: the fit of the features."""

    at: dict[str, int]
    levels: list[int] = field(default_factory=list)
    means: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    inverse: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def features(self, text: str) -> tuple[int, bool, list[float]]:
        """Words, whether the text is English prose, and the shares of words outside each list with the average sentence length last."""
        counts = Counter(words(text))
        n = letters = plain = 0
        by_list = [0] * len(LISTS)
        for w, k in counts.items():
            n += k
            letters += k * len(w)
            if w.isascii():
                plain += k * len(w)
            i = self.at.get(w)
            if i is not None:
                by_list[i] += k
        if not n:
            return 0, False, [1.0] * len(LISTS) + [0.0]
        inside = np.cumsum(by_list)
        prose = n >= LEAST_WORDS and plain >= ASCII_LETTERS * letters
        if prose and not has_function_words(counts, n):
            prose = inside[-1] >= LISTED_SHARE * n and letters >= LETTER_SHARE * len("".join(text.split()))
        length = min(LONGEST, n / max(1, len(_END(text)))) / LONGEST
        return n, bool(prose), [*(1 - inside / n).tolist(), length]

    def level(self, features: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """The levels of many texts, and their mean levels by the probabilities of all."""
        x = np.array(features)[:, None, :] - self.means[None]
        s = -0.5 * np.einsum("nij,jk,nik->ni", x, self.inverse, x, optimize=True)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return np.array(self.levels)[p.argmax(1)], p @ np.array(self.levels, float)


def fit(passages: list[tuple[str, int]], listed: list[str]) -> Formula:
    """The formula for passages (text, level) with the listed words of the corpus, the most frequent first.

    The lists come from the corpus alone. The passages only say what shares and sentence lengths each level has: their means by level, and the spread
    about them, which all levels share.
    """
    f = Formula({w: next(i for i, size in enumerate(LISTS) if rank < size) for rank, w in enumerate(listed[: LISTS[-1]])})
    f.levels = sorted({level for _, level in passages})
    x = np.array([f.features(t)[2] for t, _ in passages])
    y = np.array([level for _, level in passages])
    f.means = np.array([x[y == level].mean(0) for level in f.levels])
    rest = x - f.means[[f.levels.index(level) for level in y]]
    f.inverse = np.linalg.inv(rest.T @ rest / len(y) + 1e-4 * np.eye(x.shape[1]))
    return f


def reading_levels(df: DataFrame, key: str, text: str, graded: DataFrame) -> DataFrame:
    """(key, n_words, prose, level, mean_level, outside, sentence_length) of each text.

    graded: text and level of the passages that set the scale. prose tells whether the text is English prose of LEAST_WORDS words
    or more, which doesn't depend on the passages; level is null for texts without a word and, with mean_level, only meant for prose. outside is the
    share of words outside the longest list. A null or empty text has no words and no level. Other columns of df are dropped, repeated keys stay.

    Ties of levels go to the lower one. Two passes over the texts: one counts the document frequencies of all words, one scores.
    """
    rows = graded.select("text", "level").filter("text is not null and level is not null").limit(MAX_PASSAGES + 1).collect()
    if len(rows) > MAX_PASSAGES:
        raise ValueError(f"more than {MAX_PASSAGES} graded passages; give a sample of them")
    passages = sorted((r["text"], int(r["level"])) for r in rows)
    if len({level for _, level in passages}) < 2:
        raise ValueError("graded passages of two levels at least are needed")
    formula = df.sparkSession.sparkContext.broadcast(fit(passages, frequent_words(df, text)))
    kind = df.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = formula.value
        for b in batches:
            if not b.num_rows:
                continue
            n, prose, feats = zip(*(f.features(x.as_py() or "") for x in b.column(1)), strict=True)
            level, mean = f.level(list(feats))
            none = np.array(n) == 0
            last = np.array([(x[-2], x[-1] * LONGEST) for x in feats])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(prose, pa.bool_()), pa.array(level, pa.int32(), mask=none), pa.array(mean, pa.float64(), mask=none), *(pa.array(last[:, i], pa.float64(), mask=none) for i in (0, 1))],
                names=[key, "n_words", "prose", "level", "mean_level", "outside", "sentence_length"],
            )

    return df.select(key, text).mapInArrow(score, f"`{key}` {kind}, n_words long, prose boolean, level int, mean_level double, outside double, sentence_length double")
