"""Subjects of a document, by class-association rules.

A document is cut into segments (sentences, without code blocks).  From labelled
segments, rules "these words -> subject" with one or two words on the left are
mined by frequent-pattern growth, bounded at two words: counting gives the words
in order of frequency, each segment becomes a transaction of its frequent words
in that order, and every word of it takes the more frequent ones before it as its
conditional pattern base, from which the pairs grow.  Patterns are counted where
the transactions lie and added up by pattern.  A rule with two words stays only if
it says clearly more than each of its words alone.  Confidences are taken over
subjects of equal weight and smoothed, which makes them log-evidence that adds up.

Rules are mined twice: from the hand-labelled documents, and again from all corpus
segments that the first rules label with confidence, so words too rare among the
labels (and languages with few labels) get rules, and words that every subject
uses lose theirs.  A segment speaks for its subjects by the evidence of its
matching rules and, where that is ambiguous, by the rest of its document.  A
document has the subjects that make up at least ``cut`` of its speaking segments;
the cut is calibrated around a quarter on labelled documents kept out of the mining.

A pattern must occur in a share of the segments, whatever their number, so the
model does not grow with the corpus: as a segment has at most 20 words, at most
20 / ``support_share`` words, and rules of one word, can exist.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.llm.normal import folded, plain, without_code
from fluxloom.storage import materialize, spread

_SENTENCE = re.compile(r"[.!?:;]+(?:\s+|$)|\n+")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    segment_words: int = 20  # longer sentences are cut
    label_support: int = 2  # segments that must carry a rule mined from hand labels
    corpus_support: int = 5  # the same, from the corpus
    support_share: float = 1e-5  # and in both at least this share of the segments
    word_share: float = 0.2  # least share of a word's best subject for it to be mined at all, and at least 1.3 times chance
    confidence: float = 0.35  # least smoothed confidence of a rule, and at least 1.8 times chance
    sure: float = 0.3  # least lower bound (two standard errors) of a rule's confidence, and at least 1.5 times chance
    gain: float = 0.1  # what a second word must add
    pairs: bool = True  # rules with two words
    trusted: float = 0.8  # share from which a segment's label counts in the second mining
    fit_segments: int = 2_000_000  # bound of the sample of hand-labelled segments the first rules are fitted on
    cut: float = 0.22
    cut_range: tuple[float, float] = (0.18, 0.28)


def _frame(**columns) -> pd.DataFrame:
    return pd.DataFrame({n: c.reset_index(drop=True) if isinstance(c, pd.Series) else pd.Series(c, dtype=object) for n, c in columns.items()})


def segments_of(text: str, size: int) -> list[list[str]]:
    out = []
    for sentence in _SENTENCE.split(folded(plain(without_code(text)))):
        w = _WORD.findall(sentence)
        out += [w[i : i + size] for i in range(0, len(w), size)]
    return out


def segments(documents: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """(``key``, ``segs``): the segments of every text, a line each, words apart by a blank; null texts are left out."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame(**{key: b["_k"], "segs": ["\n".join(map(" ".join, segments_of(t, s.segment_words))) for t in b["_t"]]})

    rows = spread(documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")))
    return rows.mapInPandas(cut, f"`{key}` {documents.schema[key].dataType.simpleString()}, segs string")


def transactions(lines: list[str], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(line, code) of the known words of each line, each once, in order of line and code."""
    sizes = [x.count(" ") + 1 for x in lines]
    words = " ".join(lines).split(" ") if lines else []
    code = np.array(list(map(codes.get, words, repeat(-1))), dtype=np.int64)
    line = np.repeat(np.arange(len(lines)), sizes)
    n = max(len(codes), 1)
    both = np.unique(line[code >= 0] * n + code[code >= 0])
    return both // n, both % n


def grown(line: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, place) of every two words of a transaction: each word with the ones before it."""
    first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    d = 1
    while d < len(line):
        at = np.flatnonzero(line[d:] == line[:-d])
        if not len(at):
            break
        first.append(at)
        second.append(at + d)
        d += 1
    return np.concatenate(first), np.concatenate(second)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two codes in one number."""
    return a << 32 | b


@dataclass
class Rules:
    """Log-evidence per subject of single words and of pairs of words.  ``codes``: the words of all rules, numbered by
    frequency; ``single``: a row a code, ``alone``: whether it is a rule; ``keys``: the pairs in rising order, ``pairs``: a row each."""

    subjects: list[str]
    codes: dict[str, int]
    single: np.ndarray
    alone: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def none(subjects: list[str]) -> "Rules":
        return Rules(subjects, {}, np.zeros((0, len(subjects))), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), np.zeros((0, len(subjects))))

    def evidence(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the matching rules of every line, and whether there are any; a pair stands in for its two words, the
        strongest pair first."""
        total, speaks = np.zeros((len(lines), len(self.subjects))), np.zeros(len(lines), dtype=bool)
        line, code = transactions(lines, self.codes)
        if len(self.keys) and len(line):
            a, b = grown(line, code)
            key = _pair(code[a], code[b])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            a, b, at = a[hit], b[hit], at[hit]
            free = np.ones(len(line), dtype=bool)
            for n in np.lexsort((at, -self.pairs[at].max(1), line[a])) if len(at) else ():
                if free[a[n]] and free[b[n]]:
                    free[a[n]] = free[b[n]] = False
                    total[line[a[n]]] += self.pairs[at[n]]
                    speaks[line[a[n]]] = True
            line, code = line[free], code[free]
        line, code = line[self.alone[code]], code[self.alone[code]]
        if len(line):
            heads = np.flatnonzero(np.r_[True, np.diff(line) > 0])
            total[line[heads]] += np.add.reduceat(self.single[code], heads, axis=0)
            speaks[line[heads]] = True
        return total, speaks

    def shares(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents (lines of words): the share of each subject, whether a document says anything, and for every line its
        document and the posterior of its subjects (the document's shares, where the line says nothing)."""
        k = len(self.subjects)
        lines = [x for d in documents for x in d.split("\n")]
        doc = np.repeat(np.arange(len(documents)), [d.count("\n") + 1 for d in documents])
        prior, says = np.full((len(documents), k), 1 / k), np.zeros(len(documents), dtype=bool)
        total, speaks = self.evidence(lines)
        post = np.zeros((len(lines), k))
        if speaks.any():
            e, d = total[speaks], doc[speaks]
            heads = np.flatnonzero(np.r_[True, np.diff(d) > 0])
            says[d] = True
            count = np.diff(np.append(heads, len(d)))[:, None]
            for _ in range(3):
                z = e + np.log(prior[d] + 0.02)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                prior[d[heads]] = np.add.reduceat(p, heads, axis=0) / count
            post = prior[doc]
            post[speaks] = p
        return prior, says, doc, post


def _smoothed(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Confidences over subjects of equal weight, with a little of every subject added."""
    rate = counts / np.maximum(totals, 1e-9) * totals[totals > 0].mean()
    return (rate + 0.15) / (rate.sum(-1, keepdims=True) + 0.15 * counts.shape[-1])


def _lower(counts: np.ndarray, totals: np.ndarray, z: float = 2.0) -> np.ndarray:
    """Lower bound of the best confidence, by its support: a word met a few times may favour a subject by chance."""
    n = counts.sum(-1)
    rate = counts / np.maximum(totals, 1e-9)
    p = rate.max(-1) / np.maximum(rate.sum(-1), 1e-12)
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, subjects: list[str], support: int, s: Settings) -> Rules:
    """Rules of labelled segments (``words``: a line, ``subject``)."""
    place = {c: i for i, c in enumerate(subjects)}
    chance = 1 / len(subjects)
    word_share, confidence = min(max(s.word_share, 1.3 * chance), 0.9), min(max(s.confidence, 1.8 * chance), 0.9)
    sure = min(max(s.sure, 1.5 * chance), 0.8)
    total = np.zeros(len(subjects))
    for r in labelled.groupBy("subject").count().collect():  # one row a subject
        total[place[r[0]]] = r[1]
    if not total.sum():
        return Rules.none(subjects)
    least = max(support, int(np.ceil(total.sum() * s.support_share)))

    def table(df: DataFrame, key: str) -> tuple[list, np.ndarray]:
        """Counts per subject of the frequent keys whose best subject stands out, the most frequent first."""
        wide = df.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("subject") == c, F.col("n")).otherwise(0)).alias(f"c{i}") for i, c in enumerate(subjects)]).where(F.col("n") >= least)
        rate = [F.col(f"c{i}") / float(total[i]) if total[i] else F.lit(0.0) for i in range(len(subjects))]
        best = F.greatest(*rate) if len(rate) > 1 else rate[0]
        rows = wide.where(best >= word_share * sum(rate[1:], rate[0])).orderBy(F.desc("n"), key).collect()  # bounded by the support
        return [r[key] for r in rows], np.array([[r[f"c{i}"] for i in range(len(subjects))] for r in rows], dtype=float).reshape(-1, len(subjects))

    words, counts = table(labelled.select("subject", F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w", "subject").agg(F.count(F.lit(1)).alias("n")), "w")
    if not words:
        return Rules.none(subjects)
    conf, single = _smoothed(counts, total), np.log(_smoothed(counts, total) * len(subjects))
    alone = (conf.max(1) >= confidence) & (_lower(counts, total) >= sure)
    codes = {w: i for i, w in enumerate(words)}
    keys, pairs = np.zeros(0, dtype=np.int64), np.zeros((0, len(subjects)))
    if s.pairs:
        shared = labelled.sparkSession.sparkContext.broadcast((codes, place))

        def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codes, place = shared.value
            for b in batches:
                line, code = transactions(b["words"].tolist(), codes)
                first, second = grown(line, code)
                label = b["subject"].map(place).to_numpy(np.int64)[line[first]]
                both, n = np.unique(np.stack([label, _pair(code[first], code[second])]), axis=1, return_counts=True)
                yield _frame(subject=[subjects[c] for c in both[0]], p=both[1], n=n)

        found, counts = table(labelled.mapInPandas(grow, "subject string, p bigint, n bigint").groupBy("p", "subject").agg(F.sum("n").alias("n")), "p")
        if found:
            key, c, low = np.array(found, dtype=np.int64), _smoothed(counts, total), _lower(counts, total)
            k, a, b = c.argmax(1), key >> 32, key & 0xFFFFFFFF
            top = c.max(1)
            more = top >= np.maximum(conf[a, k], conf[b, k]) + s.gain  # else the shorter rule says as much
            kept = np.flatnonzero((low >= sure) & (top >= confidence) & more)
            kept = kept[np.argsort(key[kept])]
            keys, pairs = key[kept], np.log(c[kept] * len(subjects))
    used = alone.copy()
    used[keys >> 32] = used[keys & 0xFFFFFFFF] = True
    new = np.cumsum(used) - 1  # words without a rule are forgotten
    return Rules(subjects, {w: int(new[i]) for w, i in codes.items() if used[i]}, single[used], alone[used], _pair(new[keys >> 32], new[keys & 0xFFFFFFFF]), pairs)


def fit(segs: DataFrame, labels: DataFrame, key: str, subjects: list[str], s: Settings) -> tuple[Rules, float]:
    """The rules and the calibrated cut.  A tenth of the labelled documents is kept out of the first mining."""
    spark = segs.sparkSession
    named = labels.where(F.col("subject").isin(subjects) & F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("subject").alias("subjects"))
    taught = materialize(segs.join(named, key).withColumn("held", F.pmod(F.xxhash64(F.col(key)), F.lit(10)) == 0), "taught")
    lines = taught.where(~F.col("held")).select(F.explode(F.split("segs", "\n")).alias("words"), "subjects").select("words", F.explode("subjects").alias("subject")).where("words <> ''")
    first = spark.sparkContext.broadcast(mine(materialize(_bounded(lines, s), "lines"), subjects, s.label_support, s))

    def believe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            docs = b["segs"].tolist()
            _, says, doc, post = first.value.shares(docs)
            sure = np.flatnonzero(says[doc] & (post.max(1) >= s.trusted))
            lines, best = [x for d in docs for x in d.split("\n")], post.argmax(1)
            yield _frame(words=[lines[i] for i in sure], subject=[subjects[best[i]] for i in sure])

    corpus = materialize(segs.where("segs <> ''").select("segs").mapInPandas(believe, "words string, subject string"), "believed")
    rules = mine(corpus, subjects, s.corpus_support, s)
    shared = spark.sparkContext.broadcast(rules)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share, says, _, _ = shared.value.shares(b["segs"].tolist())
            out = [(int(round(100 * x)), c in set(true)) for row, said, true in zip(share, says, b["subjects"]) for c, x in zip(subjects, row if said else np.zeros(len(subjects)))]
            yield pd.DataFrame(out, columns=["share", "truth"])

    seen = taught.where("held").select("segs", "subjects").mapInPandas(judge, "share int, truth boolean").groupBy("share", "truth").count().collect()  # at most 202 rows
    return rules, calibrated_cut([(r[0] / 100, r[1], r[2]) for r in seen], s)


def _bounded(df: DataFrame, s: Settings) -> DataFrame:
    """A sample of at most about ``fit_segments`` hand-labelled segments; all of them where there are no more."""
    n = df.count()
    return df if n <= s.fit_segments else df.sample(fraction=s.fit_segments / n, seed=7)


def calibrated_cut(seen: list[tuple[float, bool, int]], s: Settings) -> float:
    """The share in ``cut_range`` from which calling a subject is most often right (F1), nearest to ``cut`` among equals."""
    best = (-1.0, 0.0, s.cut)
    for c in np.arange(s.cut_range[0], s.cut_range[1] + 1e-9, 0.01):
        hit = sum(n for x, t, n in seen if t and x >= c - 1e-9)
        wrong = sum(n for x, t, n in seen if not t and x >= c - 1e-9)
        missed = sum(n for x, t, n in seen if t and x < c - 1e-9)
        if hit:
            best = max(best, (round(2 * hit / (2 * hit + wrong + missed), 6), -abs(c - s.cut), float(c)))
    return best[2]


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(``key``, ``subject``, ``share``) of every document that says something about a subject.

    Null, empty and subjectless texts have no row; labels of unknown documents or subjects are ignored; without
    usable labels there are no rules and no rows.  ``areas`` is the closed list of subjects.
    """
    s = settings or Settings()
    spark: SparkSession = documents.sparkSession
    subjects = sorted({r[0] for r in areas.select("subject").where("subject is not null").distinct().collect()})
    if not subjects:
        return spark.createDataFrame([], f"`{key}` {documents.schema[key].dataType.simpleString()}, subject string, share double")
    segs = materialize(segments(documents, key, text, s), "segments")
    rules, cut = fit(segs, labels, key, subjects, s)
    shared = spark.sparkContext.broadcast(rules)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share, says, _, _ = shared.value.shares(b["segs"].tolist())
            d, c = np.nonzero((share >= cut) & says[:, None])
            yield _frame(**{key: b["_k"].iloc[d], "subject": [subjects[i] for i in c], "share": share[d, c]})

    return segs.where("segs <> ''").select(F.col(key).alias("_k"), "segs").mapInPandas(score, f"`{key}` {dict(segs.dtypes)[key]}, subject string, share double")
