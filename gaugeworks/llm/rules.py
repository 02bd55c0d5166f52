"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import encoded, long_id, pieces, ship_package, slices, table
from gaugeworks.session import settle

#: Documents with fewer words, or a larger share of repeated words, are dropped whatever the votes.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_AT = 0.5
ROUNDS = 200
#: Rates of the votes bad, none, good on bad and on good documents that the estimation starts
#: from, and the number of votes by which it holds on to them.
START = ((0.4, 0.4, 0.2), (0.05, 0.35, 0.6))
SMOOTHING = 2.0

_PIECE = 1 << 20  # characters whose case is looked up at a time
_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\t\n\x0b\x0c\r"
# A word of letters with an inner hyphen or apostrophe, in quotes or brackets, with one mark behind it.
_PLAIN = re.compile(r"""["'(\[«„“‚‘¿¡]*[^\W\d_]+(?:['’‑-][^\W\d_]+)*["')\]»”“’]*[.,;:?!…]?["')\]»”“’]*""")


@dataclass(frozen=True)
class Measures:
    """What the rules look at in one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_ended_lines: int
    n_upper: int
    n_lower: int
    n_calls: int
    n_plain_words: int
    top_word: int


class _Numbers(dict):
    """Number of every distinct word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated_words(numbers: np.ndarray, window: int = 3) -> int:
    """Words covered by windows that occur at least twice in the sequence."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    runs = numbers[:n].astype(np.int64)
    for k in range(1, window):  # renumbered after each word, so that equal numbers mean equal words
        runs = runs * (int(numbers.max()) + 1) + numbers[k : k + n]
        runs = np.unique(runs, return_inverse=True)[1].astype(np.int64)
    again = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edges = np.zeros(len(numbers) + 1, np.int64)
    edges[again] += 1
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


@lru_cache(maxsize=1 << 16)
def _is_plain(word: bytes) -> bool:
    return _PLAIN.fullmatch(word.decode("utf-8", "replace")) is not None


@cache
def _cases() -> np.ndarray:
    """For every code point 1 if it is a capital, 2 if a small letter, else 0."""
    points = [chr(i) for i in range(0x110000)]
    return np.array([c.isupper() + 2 * c.islower() for c in points], np.uint8)


def _cased(text: str) -> tuple[int, int]:
    """Numbers of capitals and of small letters, a piece of the text at a time."""
    counts = np.zeros(3, np.int64)
    for start in range(0, len(text), _PIECE):
        points = text[start : start + _PIECE].encode("utf-32-le", "replace")
        counts += np.bincount(_cases()[np.frombuffer(points, np.uint32)], minlength=3)
    return int(counts[1]), int(counts[2])


def measure(text: str | None) -> Measures:
    """All measures of a whole text, null as empty.

    The words become numbers piece by piece; what is held is one number per word and each
    distinct word and line once.
    """
    text = text or ""
    raw = encoded(text)
    known, parts = _Numbers(), []
    for piece in pieces(raw):
        words = piece.split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    numbers = np.concatenate(parts) if parts else np.empty(0, np.int32)
    counts = np.bincount(numbers, minlength=len(known))
    plain = int(counts @ np.fromiter(map(_is_plain, known), np.int64, len(known)))
    lines: Counter[bytes] = Counter()
    ended = 0
    for line in raw.split(b"\n"):
        body = line.strip()
        if body:
            lines[line] += 1
            ended += body.endswith((b".", b"!", b"?", b'"', "…".encode(), "»".encode(), "”".encode()))
    upper, lower = _cased(text)
    return Measures(
        n_words=len(numbers),
        word_chars=len(text) - sum(text.count(chr(c)) for c in _SPACES),
        n_symbols=sum(raw.count(c) for c in _SYMBOLS),
        n_dup_lines=sum(lines.values()) - len(lines),
        n_repeat_words=repeated_words(numbers),
        n_lines=sum(lines.values()),
        n_ended_lines=ended,
        n_upper=upper,
        n_lower=lower,
        n_calls=raw.count(b"!"),
        n_plain_words=plain,
        top_word=int(counts.max()) if len(counts) else 0,
    )


@dataclass(frozen=True)
class Rule:
    """A measured share with the bounds of its votes: bad, good, or none between them.

    `bad` and `good` are bounds of numerator / denominator; whichever is larger tells the
    direction. A rule without one of them has one vote only. A denominator below `least`
    is too little to judge, and the rule abstains.
    """

    name: str
    share: tuple[str, str]
    bad: float | None = None
    good: float | None = None
    rising_is_good: bool = False
    least: int = 1

    def vote(self, m: Measures) -> str:
        over, under = (getattr(m, name) for name in self.share)
        if under < self.least:
            return "0"
        value = over / under
        sign = 1 if self.rising_is_good else -1
        if self.bad is not None and sign * value <= sign * self.bad:
            return "-"
        if self.good is not None and sign * value >= sign * self.good:
            return "+"
        return "0"


# Bounds follow the published heuristics for web text (word length, symbols, repeated lines
# and n-grams, line endings) and leave a gap between the votes.
RULES: tuple[Rule, ...] = (
    Rule("long words", ("word_chars", "n_words"), bad=12.0, good=9.0),
    Rule("short words", ("word_chars", "n_words"), bad=2.5, good=3.0, rising_is_good=True),
    Rule("symbols", ("n_symbols", "n_words"), bad=0.1, good=0.01),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), bad=0.3, least=4),
    Rule("repeated words", ("n_repeat_words", "n_words"), bad=0.3, good=0.15),
    Rule("one word", ("top_word", "n_words"), bad=0.25, good=0.15, least=20),
    Rule("capitals", ("n_upper", "n_lower"), bad=0.5, good=0.2),
    Rule("calls", ("n_calls", "n_words"), bad=0.15, good=0.05),
    Rule("plain words", ("n_plain_words", "n_words"), bad=0.7, good=0.85, rising_is_good=True),
    Rule("line ends", ("n_ended_lines", "n_lines"), bad=0.1, good=0.5, rising_is_good=True),
)


@dataclass(frozen=True)
class Fit:
    """Outcome of the estimation: share of good documents, and how the rules vote on each kind.

    `rates[k, r, v]` is the probability that rule r gives vote v (bad, none, good) to a
    document that is bad (k = 0) or good (k = 1). A rule's accuracy on good documents is
    rates[1, r, 2], on bad ones rates[0, r, 0].
    """

    prior: float
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of votes: 0 bad, 1 none, 2 good."""
        ratio = np.log(self.rates[1]) - np.log(self.rates[0])
        logit = np.log(self.prior) - np.log1p(-self.prior)
        logit = logit + ratio[np.arange(votes.shape[1]), votes].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def fit_accuracies(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Fit:
    """Expectation-maximisation over distinct vote patterns and their numbers of documents.

    Given a document's quality the rules vote independently, each with its own rates for
    good and for bad documents; abstaining is a vote as well, since a rule that looks for
    one defect rarely finds it in a document that has another. Expectation: the posterior of
    each pattern. Maximisation: the expected rates and share of good documents, smoothed by
    a few votes as START has them. That start, where a vote is right more often than wrong,
    tells the two kinds apart.
    """
    rules = votes.shape[1]
    cast = (votes[:, :, None] == np.arange(3)).astype(float)
    start = np.repeat(np.array(START)[:, None, :], rules, axis=1)
    fit = Fit(0.5, start)
    for _ in range(rounds):
        good = fit.posterior(votes)
        kinds = np.stack([counts * (1 - good), counts * good])
        seen = np.einsum("kp,prv->krv", kinds, cast) + SMOOTHING * start
        rates = seen / seen.sum(axis=2, keepdims=True)
        prior = float((kinds[1].sum() + 1) / (counts.sum() + 2))
        moved = max(np.abs(rates - fit.rates).max(initial=0), abs(prior - fit.prior))
        fit = Fit(prior, rates)
        if moved < 1e-10:
            break
    return fit


def _as_votes(patterns: Sequence[str], rules: int) -> np.ndarray:
    return np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(-1, rules)


def measured(df: DataFrame, id_column: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Each document's id, base counts and votes, one character of `+-0` per rule."""
    ship_package(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measure(t.as_py()) for t in batch.column(1)]
            votes = ["".join(rule.vote(m) for rule in rules) for m in found]
            counts = [pa.array([getattr(m, name) for m in found], pa.int64()) for name in _BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(votes, pa.string())], ["id", *_BASE, "votes"]
            )

    own = df.select(long_id(df, id_column).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(run, "id long, " + ", ".join(f"{name} long" for name in _BASE) + ", votes string")


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES,
    keep_at: float = KEEP_AT,
) -> DataFrame:
    """Quality of every document from votes of rules whose accuracies nobody has labelled.

    Returns id, the base counts, votes, `quality` (posterior probability of good quality),
    base_failed and kept; one row per input row. Texts are measured once, in whole; that
    table, without texts, is written. Its documents are counted per distinct vote pattern
    (at most 3**len(rules), whatever the corpus), these counts meet the estimation on the
    driver, and each pattern's posterior goes back by a broadcast of the same bound.

    Null and empty texts have no words and fail the base rules; every rule abstains on them.
    Null and repeated ids are kept as they are, repeated rows count each and are judged
    alike. An empty table gives an empty one. Other columns, whatever their names, are left
    out.
    """
    spark = df.sparkSession
    found = settle(measured(df, id_column, text, rules))
    patterns = found.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    votes = _as_votes([r["votes"] for r in patterns], len(rules))
    fit = fit_accuracies(votes, np.array([float(r["n"]) for r in patterns]))
    posterior = fit.posterior(votes)
    judged = spark.createDataFrame(
        [(r["votes"], float(p)) for r, p in zip(patterns, posterior, strict=True)], "votes string, quality double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return (
        found.join(F.broadcast(judged), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= keep_at))
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *_BASE, "base_failed", "kept", "quality"
    )


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLE: dict[str, str] = {}
