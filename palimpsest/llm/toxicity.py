"""Toxicity by noisy-channel deobfuscation: disguised spans are restored under a character model, then words are scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, cut, free_name, slices, text_bytes, tidied, with_column

SLICE = 1 << 20
#: Labelled rows to learn from, at most; the rows with the smallest key hashes are taken.
MOST_LABELLED = 8_000
#: What a written character may stand for besides itself.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "", ".": "", "-": "", "_": "", " ": "",
}
#: Costs in nats: a stand-in, a dropped separator, a separator that ends a word, a dropped repetition, a stand-in without a letter.
COST_STAND_IN, COST_SEPARATOR, COST_BOUNDARY, COST_REPEAT, COST_KEPT = 1.0, 0.3, 1.0, 0.7, 9.0
#: Stand-ins that are also punctuation and may end a word, or stand before it, at a cost.
PUNCTUATION, COST_PUNCTUATION = frozenset("!|+("), 2.0
#: Letters of a word that make its features: its first 4, 5 and 6, and all.
PREFIXES = (4, 5, 6, None)
#: Features count from so many nats of log-odds on, some twelve times likelier in toxic texts.
LEAST_ODDS = 2.5

_LETTER, _UNIT, _MIXED = r"[^\W\d_]", r"[^\W_*.\-]|[@$!|+(€£]", r"[\w@$!|+(€£*.\-]"
#: Spans that may be disguised: single letters or stand-ins, three or more, with any separators between; runs without a space
#: that hold a stand-in, or a separator between others, but not numbers alone; words with a letter three times and more.
SUSPECT = re.compile(
    rf"(?<![\w@$!|+(€£])(?:{_UNIT})(?:[ .\-_*]++(?:{_UNIT})){{2,}}(?![\w@$!|+(€£])"
    rf"|(?<!{_MIXED})(?=[._*\-]*+{_LETTER}*+(?:[\d@$!|+(€£]|(?<={_LETTER})[._*\-]++[\w@$!|+(€£]))(?![\d._*\-]++(?!{_MIXED})){_MIXED}++"
    rf"|(?<!{_LETTER})(?={_LETTER}*?({_LETTER})(?i:\1\1)){_LETTER}+"
)
#: Characters without width, which may stand inside a word.
UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]+")
LETTERS = 28
#: Characters of a suspect span that are restored together.
WINDOW = 48


def letter_classes() -> np.ndarray:
    """Byte to class: 1 to 26 for letters, 27 for bytes of other letters, 0 for the rest."""
    c = np.zeros(256, np.int64)
    for base in (ord("a"), ord("A")):
        c[base : base + 26] = np.arange(1, 27)
    c[0x80:] = 27
    return c


_CLASS = letter_classes()


def letter_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of three letter classes in a row over all texts, words apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for part in slices(batches, "_text", SLICE):
            c = _CLASS[text_bytes(part.column("_text"))[0]]
            if len(c) > 2:
                total += np.bincount(c[:-2] * LETTERS**2 + c[1:-1] * LETTERS + c[2:], minlength=LETTERS**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(tidied(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LETTERS**3)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


def letter_model(counts: np.ndarray) -> list[list[float]]:
    """-ln P(third | first two), smoothed by the pair and the single letter, by first * 28 + second."""
    c = counts.reshape(LETTERS, LETTERS, LETTERS)
    one = c.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    two = c.sum(axis=0) + 5.0 * one
    two /= two.sum(axis=1, keepdims=True)
    three = c + 5.0 * two[None]
    three /= three.sum(axis=2, keepdims=True)
    return (-np.log(three)).reshape(LETTERS**2, LETTERS).tolist()


def restore(span: str, model: list[list[float]]) -> str:
    """The likeliest letters behind a span: Viterbi over a lattice of stand-ins, separators and repetitions.

    A state is the last two letters' classes and whether the last may be repeated; of the readings
    that end in it only the cheapest goes on.
    """
    best: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    for ch in span.lower():
        after: dict[tuple[int, int, str], tuple[float, str]] = {}

        def offer(state: tuple[int, int, str], cost: float, said: str, after: dict = after) -> None:
            if state not in after or cost < after[state][0]:
                after[state] = (cost, said)

        stands = STANDS_FOR.get(ch)
        for (p, q, last), (cost, said) in best.items():
            if ch.isalpha():
                k = ord(ch) - 96 if "a" <= ch <= "z" else 27
                offer((q, k, ch), cost + model[p * LETTERS + q][k], said + ch)
                if ch == last:
                    offer((p, q, last), cost + COST_REPEAT, said)
            elif stands is None:
                offer((q, 0, ""), cost + model[p * LETTERS + q][0] + COST_KEPT, said + ch)
            else:
                for x in stands:
                    k = ord(x) - 96
                    offer((q, k, x), cost + model[p * LETTERS + q][k] + COST_STAND_IN, said + x)
                    if x == last:
                        offer((p, q, last), cost + COST_REPEAT + COST_STAND_IN, said)
                offer((p, q, last), cost + (COST_SEPARATOR if not stands else COST_KEPT), said)
                if ch in PUNCTUATION or not stands:
                    ended = cost + (COST_PUNCTUATION if stands else COST_BOUNDARY)
                    if q:
                        offer((q, 0, ""), ended + model[p * LETTERS + q][0], said + " ")
                    else:
                        offer((p, q, ""), ended, said)
        best = after
    whole = ((cost + model[p * LETTERS + q][0], said) for (p, q, _), (cost, said) in best.items())
    return min(whole)[1]


def restored(text: str, model: list[list[float]], seen: dict[str, str]) -> str:
    """The words that the text's suspect spans may hide, apart from the text itself.

    A span longer than WINDOW is read in windows that overlap by half. Characters without width
    count as separators.
    """
    out = []
    if UNSEEN.search(text):
        text = UNSEEN.sub("_", text)
    for m in SUSPECT.finditer(text):
        whole = m.group()
        for i in range(0, max(1, len(whole) - WINDOW // 2), WINDOW // 2):
            span = whole[i : i + WINDOW]
            if span not in seen:
                if len(seen) > 100_000:
                    seen.clear()
                seen[span] = restore(span, model)
            out.append(seen[span])
    return " ".join(out)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    ink = _CLASS[data] > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(ink & (edge[:-1] | ~np.concatenate([[False], ink[:-1]])))
    return begin, np.flatnonzero(ink & (edge[1:] | ~np.concatenate([ink[1:], [False]]))) + 1


def word_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, before, document): by word, hashes of its prefixes (a column for each), of the word before it, and its text."""
    data = _LOWER[data]
    begin, end = word_spans(data, bounds)
    r = Rolling(data)
    whole = r.of(begin, end)
    columns = [whole ^ np.uint64(1) if k is None else np.where(end - begin >= k, r.of(begin, np.minimum(begin + k, end)), whole ^ np.uint64(1)) for k in PREFIXES]
    before = np.concatenate([np.zeros(1, np.uint64), whole[:-1]]) if len(whole) else whole
    doc = np.searchsorted(bounds, begin, side="right") - 1
    if len(doc):
        before[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
    return np.stack(columns, axis=1) if len(whole) else np.zeros((0, len(PREFIXES)), np.uint64), before, doc


def held_out(key: F.Column) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """At most `most` labelled texts that are not held out, those with the smallest hashes of their keys: (_text, _label)."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("_label"))
    one = one.orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("_k"), "_label")
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).where("_text is not null")
    # Of rows that repeat a key one counts, so that the bound on labels bounds the texts too.
    return own.join(F.broadcast(one), "_k").groupBy("_k").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).select("_text", "_label")


class Scorer:
    """Weights of word features, and the letter model with which spans are restored."""

    def __init__(self, names: np.ndarray, odds: np.ndarray, model: list[list[float]], empty: float):
        by = np.argsort(names)
        self.names, self.odds, self.model, self.empty = names[by], odds[by], model, empty
        self.cut, self.slope, self.rate = LEAST_ODDS, 1.5, 0.0
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(names & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.seen: dict[str, str] = {}

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, word, log-odds) of the words that have a feature, each by its strongest one, and the words of each text."""
        f, _, doc = word_features(data, bounds)
        words = np.bincount(doc, minlength=len(bounds) - 1)
        row, col = np.nonzero(self.maybe[(f & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(row) or not len(self.names):
            return doc[:0], f[:0, 0], np.zeros(0), words
        h = f[row, col]
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        hit = self.names[at] == h
        best = np.full(len(f), -np.inf)
        np.maximum.at(best, row[hit], self.odds[at[hit]])
        own = np.flatnonzero(best > 0)
        return doc[own], f[own, -1], best[own], words

    def doubled(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str]]:
        """(document, word) of the words with doubled letters that have a feature only with each of them once: those go through the lattice."""
        low = _LOWER[data]
        twice = np.concatenate([[False], (low[1:] == low[:-1]) & (_CLASS[low[1:]] > 0)]) if len(low) else np.zeros(0, bool)
        twice[bounds[:-1][bounds[:-1] < len(low)]] = False
        begin, end = word_spans(low, bounds)
        gone = np.concatenate([[0], np.cumsum(twice)])
        some = np.flatnonzero(gone[end] > gone[begin])
        if not len(some) or not len(self.names):
            return
        # The words with doubled letters alone, each a text of its own, as they are and with every letter once.
        inside = np.zeros(len(low) + 1, np.int64)
        np.add.at(inside, begin[some], 1)
        np.add.at(inside, end[some], -1)
        stay = np.cumsum(inside)[:-1] > 0
        size = (end - begin)[some]
        raw = np.unique(self.hits(low[stay], np.concatenate([[0], np.cumsum(size)]))[0])
        once = np.unique(self.hits(low[stay & ~twice], np.concatenate([[0], np.cumsum(size - (gone[end] - gone[begin])[some])]))[0])
        for k in some[np.setdiff1d(once, raw)]:
            yield int(np.searchsorted(bounds, begin[k], side="right")) - 1, data[begin[k] : end[k]].tobytes().decode(errors="replace")

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum, hits, words) of each text and its restored spans: the log-odds of its different words that have any, by the root of how often each stands."""
        hidden = [restored(t.decode(errors="replace"), self.model, self.seen).encode() if t else b"" for t in column.to_pylist()]
        data, bounds = text_bytes(column)
        doc, word, odds, words = self.hits(data, bounds)
        for d, raw in self.doubled(data, bounds):
            hidden[d] += b" " + restore(raw, self.model).encode()
        if any(hidden):
            more = self.hits(*text_bytes(pa.array(hidden, pa.binary())))
            doc, word, odds = (np.concatenate(x) for x in zip((doc, word, odds), more[:3], strict=True))
        by = np.lexsort((word, doc))
        doc, word, odds = doc[by], word[by], odds[by]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else by
        count = np.diff(np.append(new, len(doc)))
        return np.bincount(doc[new], odds[new] * np.sqrt(count), len(words)), np.bincount(doc, minlength=len(words)), words

    def balance(self, total: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The evidence less what a toxic text of this length would be likely to show; -inf without any."""
        return np.where(hits > 0, total - self.rate * words, -np.inf)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Scores on a logistic curve that is 0.3 at the cut."""
        best = self.balance(*self.evidence(column))
        x = np.clip(self.slope * (best - self.cut) + math.log(3 / 7), -30, 30)
        return np.where(np.isinf(best), self.empty, 1 / (1 + np.exp(-x)))

    def calibrate(self, total: np.ndarray, hits: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> None:
        """Learns the rate of words with features in toxic texts, half of which is held against long texts, and puts
        the cut in the widest gap among those with the best balance (F1) of caught and rightly caught texts."""
        if toxic.all() or not toxic.any():
            return
        self.rate = 0.5 * hits[toxic].sum() / max(1, words[toxic].sum())
        best = self.balance(total, hits, words)
        best = np.where(np.isinf(best), -5.0, best)
        at = np.unique(best)
        cuts = np.concatenate([(at[:-1] + at[1:]) / 2, at[:1]])
        caught = np.array([(best[toxic] >= c).sum() for c in cuts])
        right = 2 * caught / (toxic.sum() + caught + [(best[~toxic] >= c).sum() for c in cuts])
        gap = np.concatenate([np.diff(at), [0.0]])
        self.cut = float(cuts[np.lexsort((gap, np.round(right, 2)))[-1]])


def contexts(texts: list[str], model: list[list[float]], keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct (feature, word before) of all texts and their restored spans; only of the features `keep`, if given."""
    out = []
    hidden = [restored(x, model, {}) for x in texts]
    for raw in (texts, hidden):
        f, before, _ = word_features(*text_bytes(pa.array([x.encode() for x in raw], pa.binary())))
        for k in range(len(PREFIXES)):
            both = np.stack([f[:, k], before], axis=1)
            if keep is not None:
                both = both[np.isin(both[:, 0], keep)]
            out.append(np.unique(both, axis=0))
    return np.unique(np.concatenate(out), axis=0)


def learn(sample: DataFrame, model: list[list[float]], least: int = 3) -> Scorer:
    """Log-odds of word features from the numbers of toxic and clean contexts in which they stand.

    A context is the word before, so that copies of a text count once. Features of fewer than
    `least` toxic contexts are left out, and so are those that are not likelier in toxic texts. A
    quarter of the texts is kept to place the cut.
    """
    sample = cut(sample.withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(4)) == 0))
    sized = {(r["_fold"], int(r["_label"] > 0)): r["count"] for r in sample.groupBy("_fold", "_label").count().collect()}
    clean_n, toxic_n = sized.get((False, 0), 0), sized.get((False, 1), 0)
    ratio = (clean_n + 1) / (toxic_n + 1)

    def counted(toxic: bool, keep: np.ndarray | None) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield pd.DataFrame(contexts(list(p["_text"]), model, keep).astype(np.int64), columns=["name", "before"])

        own = sample.where(F.lit(toxic) == (F.col("_label") > 0)).where("not _fold").select("_text")
        return own.mapInPandas(tidied(run), "name long, before long").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))

    toxic = {r["name"]: r["n"] for r in counted(True, None).where(F.col("n") >= least).collect()}
    names = np.array(list(toxic), np.int64).astype(np.uint64)
    clean = {r["name"]: r["n"] for r in counted(False, names).collect()}
    t, c = np.array(list(toxic.values()), float), np.array([clean.get(k, 0) for k in toxic], float)
    # The lower end of what the counts allow.
    odds = np.log(np.maximum(t - np.sqrt(t), 0.1) * ratio / (c + 1.0))
    own = odds > LEAST_ODDS
    total = clean_n + toxic_n
    scorer = Scorer(names[own], odds[own], model, 0.1 * toxic_n / total if total else 0.0)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            total, hits, words = scorer.evidence(pa.array([x.encode() for x in p["_text"]], pa.binary()))
            yield pd.DataFrame({"total": total, "hits": hits, "words": words, "toxic": p["_label"] > 0})

    kept = sample.where("_fold").select("_text", "_label").mapInPandas(tidied(score), "total double, hits long, words long, toxic boolean").toPandas()
    if len(kept):
        scorer.calibrate(*(kept[c].to_numpy() for c in ("total", "hits", "words")), kept["toxic"].to_numpy(bool))
    return scorer


def scorer_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_labelled: int) -> Broadcast:
    model = letter_model(letter_counts(docs, text))
    return docs.sparkSession.sparkContext.broadcast(learn(labelled_sample(docs, labels, label, key, text, most_labelled), model))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = MOST_LABELLED, threshold: float = 0.3) -> DataFrame:
    """Returns key, held_out, score (0 to 1) and predicted (1 if score >= threshold) of each row.

    The letter model counts all texts of `docs`; word weights come from at most `most_labelled`
    labelled rows whose crc32(key) mod 4 is not 2. Null and empty texts get a score of a tenth of
    the toxic share; without labels, all scores are low. Repeated rows are scored alike; a null key
    is not held out. An empty table gives no rows; other columns are left out.
    """
    scorer = scorer_of(docs, labels, key, text, label, most_labelled)
    scored = with_column(docs.select(key, text), text, "score", "double", lambda x: scorer.value(x), SLICE)
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = MOST_LABELLED, threshold: float = 0.3) -> DataFrame:
    """The rows that `score_toxicity` does not predict to be toxic, with all their columns."""
    scorer = scorer_of(docs, labels, key, text, label, most_labelled)
    name = free_name(docs, "_toxicity")
    scored = with_column(docs, text, name, "double", lambda x: scorer.value(x), SLICE)
    return scored.where(F.col(name) < threshold).drop(name)
