"""Document quality by weak supervision.

Rules look at counts of a text and vote good, bad or abstain. Expectation
maximisation over the counts of vote patterns estimates what each rule's votes are
worth, and the posterior probability of quality replaces all-must-pass filtering.

The patterns number at most ``3 ** len(RULES)`` however many documents there are,
so all documents are aggregated to them and only they reach the driver. Both passes
are narrow: no document moves.

Null text counts as empty: no words, every count 0, rejected by the base rules.
Repeated rows are judged alike, one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import SPACES, arrow_map, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# frequent short words of the four languages; they mark running prose
STOP_WORDS = frozenset(
    b"the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they "
    b"de la que el en y los se del las un por con no una su para es al lo como "
    b"le et les des du une dans est pour qui sur pas par plus au avec il sont ce "
    b"der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch an".split()
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# further counts, for the rules only
EXTRA = (  # capitals and letters are those of ASCII
    "n_lines", "n_end_lines", "n_letters", "n_capitals", "n_stop_words", "n_distinct", "n_odd_words",
)


def repeat_words(words: Sequence[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + (hashed[k : k + n] ^ (hashed[k : k + n] >> np.uint64(29)))
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def _kinds() -> np.ndarray:
    """Of each byte: 0 white space, 1 an ASCII mark, 2 part of a word."""
    kinds = np.full(256, 2, np.int8)
    kinds[:128] = 1
    kinds[[c for c in range(128) if chr(c).isalnum()]] = 2
    kinds[[ord(c) for c in SPACES]] = 0
    return kinds


_KINDS = _kinds()


def odd_words(raw: np.ndarray) -> int:
    """Words that hold two marks in a row, or nothing but marks."""
    kind = _KINDS[raw]
    solid = kind != 0
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    if not len(starts):
        return 0
    odd = np.add.reduceat(kind == 2, starts, dtype=np.int64) == 0
    pairs = np.flatnonzero((kind[1:] == 1) & (kind[:-1] == 1))
    odd[np.searchsorted(starts, pairs, "right") - 1] = True
    return int(odd.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS + EXTRA`` of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    of_byte = np.bincount(raw, minlength=256)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    ended = sum(line.rstrip(SPACES)[-1] in ".?!:;\"'" for line in lines)
    capitals = int(of_byte[65:91].sum())
    return (
        len(words),
        len(text) - int(of_byte[[ord(c) for c in SPACES]].sum()),
        int(of_byte[[ord(c) for c in SYMBOLS]].sum()),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        ended,
        capitals + int(of_byte[97:123].sum()),
        capitals,
        sum(map(STOP_WORDS.__contains__, data.lower().split())),
        len(set(words)),
        odd_words(raw),
    )


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """0 bad, 1 abstain, 2 good; a rule never votes both ways."""
    return np.where(bad, 0, np.where(good, 2, 1))


# each rule: counts as float arrays -> votes; most only spot faults and abstain otherwise
RULES = {
    "symbols": lambda c: _vote(c["n_symbols"] > 0.2 * c["n_words"], False),
    "odd_words": lambda c: _vote(c["n_odd_words"] > 0.3 * c["n_words"], c["n_odd_words"] <= 0.02 * c["n_words"]),
    "capitals": lambda c: _vote(c["n_capitals"] > 0.3 * c["n_letters"], False),
    "word_length": lambda c: _vote((c["word_chars"] < 2.5 * c["n_words"]) | (c["word_chars"] > 12 * c["n_words"]), False),
    "repeated_lines": lambda c: _vote(c["n_dup_lines"] > 0.3 * c["n_lines"], False),
    "repeated_windows": lambda c: _vote(c["n_repeat_words"] > 0.15 * c["n_words"], False),
    "line_ends": lambda c: _vote(c["n_end_lines"] < 0.1 * c["n_lines"], c["n_end_lines"] > 0.6 * c["n_lines"]),
    "stop_words": lambda c: _vote(c["n_stop_words"] < 0.03 * c["n_words"], c["n_stop_words"] > 0.12 * c["n_words"]),
    "variety": lambda c: _vote(c["n_distinct"] < 0.2 * c["n_words"], False),
    "length": lambda c: _vote(c["n_words"] < 10, c["n_words"] >= 50),
}
# where the estimate starts, and what it is held to by PRIOR as many imagined documents
# as there are real ones: a rule's votes (bad, abstain, good) on poor and on good texts
START = ((0.35, 0.4, 0.25), (0.02, 0.5, 0.48))
PRIOR = 0.5


def _counted(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All counts, and the vote pattern of each text as a number in base 3."""
    names = COUNTS + EXTRA
    got = np.array([text_counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(names))
    counts = {name: got[:, k] for k, name in enumerate(names)}
    pattern = np.zeros(len(got), np.int64)
    for rule in RULES.values():
        pattern = pattern * 3 + rule(counts)
    return counts, pattern


def pattern_counts(documents: DataFrame, text: str = "text") -> list[tuple[int, int]]:
    """How many documents show each vote pattern: at most ``3 ** len(RULES)`` pairs."""
    patterns = arrow_map(
        documents.select(F.col(text).alias("text")), lambda b: {"pattern": _counted(b.column("text"))[1]}, "pattern long"
    )
    return sorted((r[0], r[1]) for r in patterns.groupBy("pattern").count().collect())


def fit(counts: Sequence[tuple[int, int]], rules: int = len(RULES), rounds: int = 200) -> dict[int, float]:
    """The posterior probability of quality for each pattern, by expectation maximisation.

    The model has a class share and, for each rule and class, the probabilities of
    its three votes. ``START`` fixes which class is the good one, and as a prior keeps
    a kind of junk that few rules see from being taken for good prose.
    """
    if not counts:
        return {}
    codes = np.array([c for c, _ in counts], np.int64)
    weight = np.array([n for _, n in counts], float)
    votes = np.stack([codes // 3 ** (rules - 1 - k) % 3 for k in range(rules)], 1)
    one_hot = np.eye(3)[votes]
    share = 0.8
    prior = np.array(START)
    votes_of = np.tile(prior, (rules, 1, 1))
    strength = PRIOR * weight.sum() * np.array([1 - share, share])
    posterior = np.zeros(len(codes))
    for _ in range(rounds):
        by_class = np.einsum("pkv,kcv->pc", one_hot, np.log(votes_of)) + np.log([1 - share, share])
        fresh = 1 / (1 + np.exp(np.clip(by_class[:, 0] - by_class[:, 1], -500, 500)))
        if np.abs(fresh - posterior).max() < 1e-9:
            break
        posterior = fresh
        share = float(np.clip((weight @ posterior + 1) / (weight.sum() + 2), 1e-6, 1 - 1e-6))
        for c, of_class in enumerate((1 - posterior, posterior)):
            seen = np.einsum("p,pkv->kv", weight * of_class, one_hot) + strength[c] * prior[c]
            votes_of[:, c] = seen / seen.sum(1, keepdims=True)
    return dict(zip(codes.tolist(), posterior.tolist()))


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def judge(documents: DataFrame, posterior: dict[int, float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every document's counts, votes, posterior, base verdict and verdict, beside its ``doc_id``."""

    def batch(rows: pa.RecordBatch) -> dict:
        counts, pattern = _counted(rows.column("text"))
        failed = _failed(counts)
        quality = np.array([posterior[p] for p in pattern.tolist()])
        return (
            {"doc_id": rows.column("doc_id")}
            | {name: counts[name] for name in COUNTS}
            | {"base_failed": failed, "kept": ~failed & (quality >= threshold), "quality": quality, "pattern": pattern}
        )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return arrow_map(
        documents.select("doc_id", F.col(text).alias("text")),
        batch,
        f"{schema}, base_failed boolean, kept boolean, quality double, pattern long",
    )


def keep_good(documents: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents kept, with all their columns."""
    posterior = fit(pattern_counts(documents, text))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts, pattern = _counted(rows.column(rows.schema.get_field_index(text)))
        quality = np.array([posterior[p] for p in pattern.tolist()])
        return rows.filter(pa.array(~_failed(counts) & (quality >= threshold)))

    return arrow_map(documents, batch, documents.schema)


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(pattern_counts(documents))).drop("pattern")


QUERIES = {"op5_weak_quality": (op5_weak_quality, None)}
