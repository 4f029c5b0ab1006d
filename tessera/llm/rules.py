"""Quality rules: statistics of a text, and decision lists learnt from labelled statistics.

Sequential covering: each rule is grown condition by condition on two thirds of the labelled
rows (FOIL gain), then pruned on the rest; covered rows go and the next rule is grown.  A rule stays
if it is pure and unlikely to be so by chance, one test for all sizes; rows with equal statistics and
label count once.  The list becomes one ordered Spark conditional expression over the statistics.

Defined results: a null or empty text has no words and fails the base rule; very long texts are
measured whole; repeated rows get equal results; an empty table gives an empty result; without
labels of both classes the list is empty and keeps everything the base rule keeps; a document with
several labels has the lowest; labels without a document are left aside; of thresholds with equal
gain the first statistic's lowest is taken, and of rules that hold the first is named; columns of the
input are passed through, and statistics are held in one struct so that names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .store import ship

#: Labelled rows that a list is learnt from, at most.
MAX_FIT_ROWS = 40_000
#: Thresholds of a statistic that are tried.
BINS = 64
#: A rule stays if this share of what it rejects is bad, and if rejecting so purely by chance is this unlikely.
PRECISION, CHANCE = 0.9, 0.01
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_marks", "n_chars", "n_word_kinds"]
FEATURES = ["n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "digit_share", "upper_share", "mark_share", "kind_share"]
STATS = "_quality_stats"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(_BLANK):
            n += line in seen
            seen.add(line)
    return n


def _repeats(w: K.Words, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each row that lie in a window of ``k`` words found twice or more in the row."""
    inside = K.inside_rows(w, k)
    if not inside.any():
        return np.zeros(w.chunk.n, np.int64)
    own = K.mix(w.rows.astype(K.U64) + K.U64(1))[: len(inside)]
    keys = K.mix(K.windows(hashes, k) ^ own)
    ordered = np.sort(keys[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(w.chunk.n, np.int64)
    at = np.flatnonzero(inside & (twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys))
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    total = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(np.cumsum(step[:-1]) > 0, out=total[1:])
    return np.diff(total[w.bounds])


def _kinds(w: K.Words, hashes: np.ndarray) -> np.ndarray:
    return np.array([len(set(hashes[a:b].tolist())) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())], np.int64)


def stats(chunk: K.Chunk) -> list[np.ndarray]:
    """``COUNTS`` of each row."""
    w = K.words(chunk, K.NOT_SPACE)
    hashes = w.hashes()
    data = chunk.data
    lead = K.LEAD[data]
    lines = chunk.per_row(data == 10)
    multi = lines > 0
    dups = np.zeros(chunk.n, np.int64)
    for i in np.flatnonzero(multi):
        dups[i] = _dup_lines(chunk.row_bytes(i))
    return [
        w.counts.astype(np.int64),
        chunk.per_row(K.NOT_SPACE[data] & lead),
        chunk.per_row(_SYMBOL[data]),
        dups,
        _repeats(w, hashes),
        lines + 1,
        chunk.per_row(_DIGIT[data]),
        chunk.per_row(_UPPER[data]),
        chunk.per_row(_MARK[data]),
        chunk.per_row(lead),
        _kinds(w, hashes),
    ]


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and a struct ``STATS`` of ``COUNTS``."""
    ship(docs.sparkSession)
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(STATS, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [stats(c) for c in K.chunks(batch.column(text))]
            counts = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.StructArray.from_arrays(counts, COUNTS)], names=[*keep, STATS])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(K.tidied(run), schema)


def features(s: Column | str = STATS) -> dict[str, Column]:
    """``FEATURES`` as Spark expressions over the struct."""
    s = F.col(s) if isinstance(s, str) else s
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["n_chars"], F.lit(1)).cast("double")
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": s["word_chars"] / n,
        "symbols_per_word": s["n_symbols"] / n,
        "dup_line_share": s["n_dup_lines"] / s["n_lines"].cast("double"),
        "repeat_share": s["n_repeat_words"] / n,
        "words_per_line": s["n_words"] / s["n_lines"].cast("double"),
        "digit_share": s["n_digits"] / chars,
        "upper_share": s["n_upper"] / chars,
        "mark_share": s["n_marks"] / chars,
        "kind_share": s["n_word_kinds"] / n,
    }


def base_failed(s: Column | str = STATS) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions."""

    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int, bins: int = BINS) -> Rule:
    conditions: list[Condition] = []
    live = np.ones(len(x), bool)
    while len(conditions) < max_conditions:
        p, n = int((live & bad).sum()), int((live & ~bad).sum())
        if not p or not n:
            break
        now, best, pick = np.log2(p / (p + n)), 1e-9, None
        for j, name in enumerate(FEATURES):
            v, y = x[live, j], bad[live]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[:-1], method="lower"))
            at, ordered = np.quantile(v[y], np.linspace(0, 1, 17), method="lower"), np.sort(v)
            below = np.searchsorted(ordered, at, "left") - 1  # the value before each, so that a rule can begin with it
            cuts = np.unique(np.concatenate([cuts, at, ordered[below[below >= 0]]]))
            hp, hn = np.sort(v[y]), np.sort(v[~y])
            lp, ln = np.searchsorted(hp, cuts, "right"), np.searchsorted(hn, cuts, "right")
            for above, cp, cn in ((False, lp, ln), (True, p - lp, n - ln)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / np.maximum(cp + cn, 1)) - now), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    v_all = np.unique(v)
                    nxt = v_all[np.searchsorted(v_all, cuts[k], "right") :][:1]
                    best, pick = gain[k], Condition(name, above, float((cuts[k] + nxt[0]) / 2 if len(nxt) else cuts[k]))
        if pick is None:
            break
        conditions.append(pick)
        live &= pick.holds(x)
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = r.holds(x)
        return (int((hit & bad).sum()) - int((hit & ~bad).sum())) / max(1, int(hit.sum()))

    best, value = rule, worth(rule)
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if worth(shorter) >= value:
            best, value = shorter, worth(shorter)
    return best


def by_chance(hits: int, right: int, rate: float) -> float:
    """Chernoff's bound of the chance that ``right`` or more of ``hits`` rows are bad where a share ``rate`` is."""
    q = right / hits
    if q <= rate:
        return 1.0
    return float(np.exp(-hits * (q * np.log(q / rate) + ((1 - q) * np.log((1 - q) / (1 - rate)) if q < 1 else 0.0))))


def _fold(x: np.ndarray, turn: int) -> np.ndarray:
    """A fold from 0 to 2 of each row, by its values."""
    h = np.full(len(x), K.U64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for j in range(x.shape[1]):
        h = K.mix(h + np.ascontiguousarray(x[:, j]).view(K.U64))
    return (h >> K.U64(33)).astype(np.int64) % 3


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION, chance: float = CHANCE, max_rules: int = 12, max_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """A decision list that rejects.

    Rows with the same statistics and label are one observation, so that copies prove nothing.  A rule stays if
    ``precision`` of what it rejects is bad, on the pruning part too, and if a rule as pure would be found among all
    tested thresholds with a chance of ``chance`` at most; the same at every size.
    """
    rules: list[Rule] = []
    rows = np.unique(np.column_stack([np.asarray(x, float) + 0.0, np.asarray(bad, float)]), axis=0)
    x, bad = rows[:, :-1], rows[:, -1] > 0
    tests = 2 * len(FEATURES) * BINS
    misses = turn = 0
    while len(rules) < max_rules and misses < 3 and bad.any() and not bad.all():
        turn += 1
        part = _fold(x, seed + turn) > 0
        rule = _prune(_grow(x[part], bad[part], max_conditions), x[~part], bad[~part])
        hit = rule.holds(x)
        held, right = hit & ~part, int((hit & bad).sum())
        pure = right >= precision * hit.sum() and (held & bad).sum() >= precision * held.sum()
        if not rule.conditions or not right or not pure or tests * by_chance(int(hit.sum()), right, bad.mean()) > chance:
            misses += 1
            continue
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def rejected(rules: list[Rule], s: Column | str = STATS) -> Column:
    """The number of the first rule that holds, as an ordered conditional expression; null if none does."""
    cols = features(s)
    out = None
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule.conditions:
            test = test & (cols[c.feature] > c.threshold if c.above else cols[c.feature] <= c.threshold)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, **options) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled documents, chosen by a hash of their ids."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    total = labels.count()
    if not total:
        return []
    if total > max_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # at most max_rows ids
    rows = measure(chosen, ["doc_id", "_quality"]).where(~base_failed()).select("doc_id", "_quality", *(c.alias(n) for n, c in features().items())).toPandas().sort_values(["doc_id", *FEATURES])
    return learn(rows[FEATURES].to_numpy(), rows["_quality"].to_numpy() == 0, **options) if len(rows) else []


def judge(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """A row per row of ``docs``: ``keep``, the base counts, ``base_failed``, ``kept`` and the rule that rejects."""
    d = measure(docs, keep)
    rule = rejected(rules)
    return d.select(*keep, *(F.col(STATS)[c].alias(c) for c in COUNTS[:5]), base_failed().alias("base_failed"), (~base_failed() & rule.isNull()).alias("kept"), rule.alias("rule"))


def select(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept; all columns stay, nothing is shuffled."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    kept = measure(d, names, names[docs.columns.index(text)]).where(~base_failed() & rejected(rules).isNull())
    return kept.select(*names).toDF(*docs.columns)
