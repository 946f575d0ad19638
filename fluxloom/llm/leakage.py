"""Evaluation texts inside a training corpus: latent semantic retrieval, then alignment.

Test items are a fixed, small set of queries; they stand against all documents.

1. Documents and items are read as words (see ``normal``) and encoded over the
   words of the items; any other word is one and the same stranger.
2. Passages are windows of words, weighted by TF-IDF.  Document frequencies are
   counted over the passages of all documents.
3. A randomised SVD of the passage matrix gives the latent space: the matrix
   meets a random test matrix, and once more its own range, in distributed
   passes that hand back one (vocabulary x rank) matrix a task.  Passages of the
   items weigh more than those of the corpus, so the space tells items apart.
4. Every passage of every document that can hold a quote is folded into the space
   and compared with the passages of the items it can quote; a cosine above
   ``cosine`` makes a candidate.  Two exact facts settle most pairs before.  A quote
   of ``least`` words, ``kept`` of them whole, leaves three successive words of the
   item whole in the passage over it: an inverted index of the items' word triples
   says which items those can be.  And the cosine is at most the share of a passage
   that lies in the items' words.
5. Candidates are checked word by word: a run of ``least`` successive item words
   of which ``kept`` agree in order, longest common subsequence with bounded gaps,
   within a stretch of about the same length.  The answer is looked for around it.

Nothing about documents is ever collected or broadcast but the fixed-size
matrices; the latent index itself is the items', its size is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.normal import words
from fluxloom.llm.quotes import longest_quote
from fluxloom.storage import materialize, spread


@dataclass(frozen=True)
class Settings:
    window: int = 16  # words of a passage
    stride: int = 4  # words between passages that are searched
    item_stride: int = 4  # words between passages of an item
    rank: int = 192  # dimensions of the latent space
    corpus_weight: float = 0.2  # of the corpus's passages beside the items' when the space is fitted
    fit_passages: int = 200_000  # bound of the sample of corpus passages the space is fitted on; frequencies take all
    fit_tasks: int = 24  # tasks that fit; their matrices are added up on executors
    item_chars: int = 50_000_000  # of item text and answers at once; more items go through in several rounds
    seed: int = 11
    cosine: float = 0.25  # from which a passage pair is a candidate; at 0.5 a quote of 15 words with 3 exchanged was often none
    least: int = 15  # successive words of the item
    kept: float = 0.8  # share of them that must agree
    stretch: float = 1.5  # length of the stretch of text, in item words
    block: int = 2048  # passages compared at once
    reach: int = 48  # words that the shortest part of a text that meets the rule takes at most, without words put in
    block_words: int = 50_000  # words of the texts that are searched at once; a longer text is searched whole
    piece: int = 512  # words of a text that are aligned with an item at once; longer stretches are taken in overlapping pieces


@dataclass
class Items:
    """The fixed queries: encoded words, answers, and after fitting their folded passages."""

    ids: list
    texts: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[str, int]


def read_items(items: DataFrame) -> Items:
    """Items (item_id, text, answer) without those that have no words."""
    vocabulary: dict[str, int] = {}
    rows = [(r[0], words(r[1]), words(r[2] or "")) for r in items.select("item_id", "text", "answer").where("item_id is not null and text is not null").orderBy("item_id").collect()]
    rows = [r for r in rows if r[1]]
    code = lambda ws: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int32)
    texts = [code(r[1]) for r in rows]
    return Items([r[0] for r in rows], texts, [code(r[2]) for r in rows], vocabulary)


def encode(documents: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """(``key``, ``codes``): the words of every text as places in the vocabulary, -1 for any other."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value.get
        for b in batches:
            yield pd.DataFrame({key: b["_k"], "codes": [np.array(list(map(at, words(t), repeat(-1))), dtype=np.int32) for t in b["_t"]]})

    rows = spread(documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")))
    return rows.mapInPandas(code, f"`{key}` {documents.schema[key].dataType.simpleString()}, codes array<int>")


def starts(n: int, window: int, stride: int) -> np.ndarray:
    """First words of the passages of a text of ``n`` words; the last passage ends with it."""
    last = max(n - window, 0)
    return np.unique(np.append(np.arange(0, last + 1, stride), last))


def _sums(x: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Sums of the rows of ``x`` over windows, as differences of a running sum."""
    run = np.concatenate([np.zeros((1, *x.shape[1:]), dtype=x.dtype), np.cumsum(x, axis=0)])
    return run[np.minimum(at + window, len(x))] - run[at]


def passages(codes: np.ndarray, weight: np.ndarray, basis: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, TF-IDF norms and folded vectors (before norming) of the passages of one text."""
    at = starts(len(codes), window, stride)
    inside = codes >= 0
    w = np.where(inside, weight[codes], weight[-1])  # the last weight is the stranger's
    norm = np.sqrt(_sums(w * w, at, window))
    # differences of a running sum: in short floats only while it stays short
    kind = np.float32 if len(codes) <= 4096 else np.float64
    rows = basis[codes].astype(kind, copy=False) * np.where(inside, w, 0).astype(kind)[:, None]
    return at, np.maximum(norm, 1e-9), _sums(rows, at, window)


class Triples:
    """Inverted index: three successive words of an item -> the items they stand in."""

    def __init__(self, texts: list[np.ndarray], size: int):
        self.size = max(size, 1)
        two = [t[:-1].astype(np.int64) * self.size + t[1:] for t in texts]
        self.two = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *two]))
        keys = [np.searchsorted(self.two, d[:-1]).astype(np.int64) * self.size + t[2:] for d, t in zip(two, texts)]
        pairs = np.unique(np.stack([np.concatenate([np.zeros(0, dtype=np.int64), *keys]), np.repeat(np.arange(len(texts)), [len(k) for k in keys])]), axis=1)
        self.three, self.first = np.unique(pairs[0], return_index=True)
        self.first = np.append(self.first, pairs.shape[1])
        self.items = pairs[1]

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every triple of a text that stands in an item."""
        codes, none = codes.astype(np.int64), np.zeros(0, dtype=np.int64)
        if len(codes) < 3 or not len(self.three):
            return none, none
        inside = codes >= 0
        two = np.where(inside[:-1] & inside[1:], codes[:-1] * self.size + codes[1:], -1)
        at = np.minimum(np.searchsorted(self.two, two), len(self.two) - 1)
        known = (self.two[at] == two)[:-1] & inside[2:]
        place = np.flatnonzero(known)
        three = at[place] * self.size + codes[place + 2]
        t = np.minimum(np.searchsorted(self.three, three), len(self.three) - 1)
        place, t = place[self.three[t] == three], t[self.three[t] == three]
        n = self.first[t + 1] - self.first[t]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.items[np.repeat(self.first[t], n) + offset]


@dataclass
class Block:
    """Some texts in a row, a gap between two: codes, where each text ends, and the starts of all passages with their texts."""

    codes: np.ndarray
    first: np.ndarray
    end: np.ndarray
    at: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(texts: list[np.ndarray], s: Settings) -> "Block":
        n = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(n + 1) - n - 1
        gap = np.full(1, _GAP, dtype=np.int64)
        codes = np.concatenate([x for t in texts for x in (t, gap)]).astype(np.int64)
        last = np.maximum(n - s.window, 0)
        count = np.where(n > 0, last // s.stride + 1 + (last % s.stride > 0), 0)
        text = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return Block(codes, first, first + n, first[text] + np.minimum(nth * s.stride, last[text]), text)


#: Code of the place between two texts.
_GAP = -2


def promising(b: Block, weight: np.ndarray, triples: Triples, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item) of the pairs that share a triple and can reach the cosine at all, and the (text, item) pairs, in one
    number, that can be a quote: the cosine is at most the share of the passage's weight that lies in the vocabulary, and a
    quote of n words with a share of ``kept`` holds n - 2 - 3 (1 - kept) n triples, no fewer than one of ``least`` words."""
    place, item = triples.of(b.codes)
    of = np.searchsorted(b.end, place, side="right")
    # the passages over a triple: those that start from ``window - 3`` words before it up to it
    lo, hi = np.searchsorted(b.at, place - (s.window - 3)), np.searchsorted(b.at, place, side="right")
    n = np.maximum(hi - lo, 0)
    passage = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    mine = b.text[passage] == np.repeat(of, n) if len(passage) else np.zeros(0, dtype=bool)
    many = len(triples.first) and int(triples.items.max(initial=0)) + 1
    both = np.unique(passage[mine] * many + np.repeat(item, n)[mine])
    passage, near = both // max(many, 1), both % max(many, 1)
    w = np.where(b.codes == _GAP, 0.0, weight[np.maximum(b.codes, -1)])
    own = np.where(b.codes >= 0, w, 0)
    end = np.minimum(b.at + s.window, b.end[b.text])
    run = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    norm2, own2 = (r[end] - r[b.at] for r in (run(w * w), run(own * own)))
    able = (s.window * own2 >= s.cosine**2 * norm2)[passage]  # the squared length in the vocabulary, were it all one word
    least = max(int(np.ceil(s.least - 2 - 3 * (1 - s.kept) * s.least - 1e-9)), 1)
    order = np.lexsort((place, item, of))
    group, place = of[order] * many + item[order], place[order]
    k = least - 1
    quotes = np.unique(group[: len(group) - k][(group[k:] == group[: len(group) - k]) & (place[k:] - place[: len(group) - k] <= s.reach)]) if len(group) > k else group[:0]
    return passage[able], near[able], quotes


def folded(b: Block, passages_: np.ndarray, weight: np.ndarray, basis: np.ndarray, s: Settings) -> np.ndarray:
    """Some passages as vectors of the latent space, over the passages' TF-IDF norms."""
    out = np.zeros((len(passages_), basis.shape[1]), dtype=np.float32)
    for a in range(0, len(passages_), s.block):
        part = passages_[a : a + s.block]
        place = b.at[part, None] + np.arange(s.window)
        inside = place < b.end[b.text[part], None]
        codes = b.codes[np.minimum(place, len(b.codes) - 1)]
        w = np.where(inside, weight[np.maximum(codes, -1)], 0)
        z = np.einsum("pw,pwr->pr", np.where(codes >= 0, w, 0).astype(np.float32), basis[np.maximum(codes, 0)], optimize=True)
        out[a : a + s.block] = z / np.sqrt(np.maximum((w**2).sum(1), 1e-12))[:, None].astype(np.float32)
    return out


def idf(encoded: DataFrame, size: int, window: int) -> np.ndarray:
    """Inverse frequency of every vocabulary word, and of the stranger, over the passages of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(size, dtype=np.int64), 0
        for b in batches:
            lengths = b["codes"].map(len).to_numpy(np.int64)
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *b["codes"]]).astype(np.int64)
            before = np.cumsum(lengths) - lengths
            windows = -(-lengths // window)
            place = (np.arange(len(flat)) - np.repeat(before, lengths)) // window + np.repeat(np.cumsum(windows) - windows, lengths)
            inside = flat >= 0
            seen += np.bincount(np.unique(place[inside] * size + flat[inside]) % size, minlength=size) if size else 0
            n += int(windows.sum())
        w = np.flatnonzero(seen)
        yield pd.DataFrame({"w": np.append(w, -1), "n": np.append(seen[w], n)})

    rows = encoded.select("codes").mapInPandas(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()  # at most one row a word
    df, total = np.zeros(size + 1), 1
    for w, n in rows:
        if w < 0:
            total = max(n, 1)
        else:
            df[w] = n
    out = np.log((total + 1) / (df + 1)) + 0.1
    out[-1] = np.median(out[:-1]) if size else 1.0
    return out


def _gram(texts, weight: np.ndarray, test: np.ndarray, s: Settings, stride: int) -> tuple[np.ndarray, float]:
    """A'A @ test and the squared norm of A, for the normed passage matrix A of some texts."""
    out, energy = np.zeros(test.shape), 0.0
    for codes in texts:
        codes = np.asarray(codes)
        if not len(codes):
            continue
        at, norm, z = passages(codes, weight, test, s.window, stride)
        z /= (norm**2)[:, None]
        energy += len(at)
        # add each passage's vector to its words: per word place, the passages over it are a range of the running sum
        run = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(z, axis=0)])
        place = np.arange(len(codes))
        lo, hi = np.searchsorted(at, place - s.window, side="right"), np.searchsorted(at, place, side="right")
        inside = codes >= 0
        w = codes[inside]
        add = (run[hi[inside]] - run[lo[inside]]) * weight[w][:, None]
        order = np.argsort(w, kind="stable")
        if len(order):
            heads = np.flatnonzero(np.r_[True, np.diff(w[order]) > 0])
            out[w[order][heads]] += np.add.reduceat(add[order], heads, axis=0)
    return out, energy


#: Rows of a matrix that are added up in one task.
_ROWS = 512


def latent_basis(encoded: DataFrame, items: Items, weight: np.ndarray, s: Settings) -> np.ndarray:
    """Orthonormal (vocabulary x rank) basis of the leading right singular vectors of the passage matrix."""
    size = len(items.vocabulary)
    n = encoded.select(F.sum(F.ceil(F.size("codes") / (s.window // 2)))).first()[0] or 0
    sample = encoded.select("codes") if n <= s.fit_passages else encoded.select("codes").sample(fraction=s.fit_passages / n, seed=s.seed)
    sample = materialize(sample, "sample").coalesce(s.fit_tasks)  # drawn once, by as many tasks as the scan has
    spark = encoded.sparkSession

    def corpus(test: np.ndarray) -> tuple[np.ndarray, float]:
        shared = spark.sparkContext.broadcast((weight, test.astype(np.float32)))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, energy = np.zeros(test.shape), 0.0
            for b in batches:
                y, e = _gram(b["codes"], shared.value[0], shared.value[1], s, s.window // 2)
                total += y
                energy += e
            rows = np.arange(0, size, _ROWS)
            yield pd.DataFrame({"at": [-1, *rows], "y": [np.array([energy]).tobytes(), *(total[a : a + _ROWS].tobytes() for a in rows)]})

        def add(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": b["at"].iloc[:1], "y": [np.sum([np.frombuffer(bytes(y)) for y in b["y"]], axis=0).tobytes()]})

        total, energy = np.zeros(test.shape), 0.0
        for at, y in sample.mapInPandas(part, "at bigint, y binary").groupBy("at").applyInPandas(add, "at bigint, y binary").toLocalIterator():  # one matrix in all
            block = np.frombuffer(bytes(y))
            if at < 0:
                energy = float(block[0])
            else:
                total[at : at + _ROWS] = block.reshape(-1, test.shape[1])
        return total, energy

    rank = min(s.rank, size)
    q = np.random.default_rng(s.seed).standard_normal((size, min(rank + 8, size)))
    for _ in range(2):  # the range of A'A, then one power step inside it
        y, energy = corpus(q)
        own, own_energy = _gram(items.texts, weight, q, s, s.item_stride)
        y = s.corpus_weight * y + own * (energy / own_energy if energy else 1.0)
        q = np.linalg.svd(y, full_matrices=False)[0]
    return q[:, :rank].astype(np.float32)


def found(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(``key``, ``item_id``, ``agreement``, ``answer_near``): documents that carry a passage of an item.

    ``agreement`` is the best share of agreeing words over a run of ``least`` item words; ``answer_near`` whether the
    item's answer stands within 40 words of the passage.  Null texts carry nothing; items that repeat are found each;
    rows with the same key are judged each on their own.  Without items or documents the result is empty.
    """
    s = settings or Settings()
    size = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)))).first()[0] or 0
    rounds = max(1, -(-size // s.item_chars))
    out = None
    for i in range(rounds):
        part = items if rounds == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == i)
        got = _found(documents, part, key, text, s)
        out = got if out is None else out.unionByName(got)
    return out


def _found(documents: DataFrame, items: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    spark = documents.sparkSession
    queries = read_items(items)
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {item_kind}, agreement double, answer_near boolean"
    if not queries.ids:
        return spark.createDataFrame([], schema)
    encoded = materialize(encode(documents, key, text, queries.vocabulary), "codes")
    weight = idf(encoded, len(queries.vocabulary), s.window)
    basis = latent_basis(encoded, queries, weight, s)
    index = []
    for codes in queries.texts:
        _, _, z = passages(codes, weight, basis, s.window, s.item_stride)
        index.append((z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32).T.copy())
    triples = Triples(queries.texts, len(queries.vocabulary))
    shared = spark.sparkContext.broadcast((weight, basis, index, triples, queries.ids, queries.texts, queries.answers))

    def check(codes: np.ndarray, near: list[int], item: int) -> tuple[float, bool] | None:
        """Candidates' check over the stretches of the text around the passages that came near."""
        _, _, _, _, _, texts, answers = shared.value
        reach = s.window + int(s.stretch * s.least)
        best, answered = 0.0, False
        stretches: list[list[int]] = []
        for a in near:
            lo, hi = max(a - reach, 0), a + s.window + reach
            # a quote that meets the rule holds one of fewer than piece / 4 words, so pieces that overlap by that lose none
            if stretches and lo <= stretches[-1][1] and hi - stretches[-1][0] <= s.piece:
                stretches[-1][1] = hi
            else:
                stretches.append([min(lo, max(stretches[-1][1] - s.piece // 4, 0)) if stretches and lo <= stretches[-1][1] else lo, hi])
        for lo, hi in stretches:
            share = longest_quote(texts[item], codes[lo:hi].tolist(), s.least, s.kept, s.stretch)
            if share > 0:
                best = max(best, share)
                answered = answered or _holds(codes[max(lo - 40, 0) : hi + 40], answers[item])
        return (best, answered) if best else None

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, basis, index, triples, ids, _, _ = shared.value
        many = int(triples.items.max(initial=0)) + 1
        for b in batches:
            out = []
            keys, texts = b["_k"].tolist(), [np.asarray(c) for c in b["codes"]]
            for first, last in _blocks(texts, s.block_words):
                block = Block.of(texts[first:last], s)
                passage, item, quotes = promising(block, weight, triples, s)
                if not len(passage):
                    continue
                used, row = np.unique(passage, return_inverse=True)
                z = folded(block, used, weight, basis, s)
                order = np.argsort(item, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0])
                for x, y in zip(heads, [*heads[1:], len(order)]):
                    rows, i = row[order[x:y]], int(item[order[x]])
                    hits = used[rows[(z[rows] @ index[i]).max(1) >= s.cosine]]
                    able = np.isin(block.text[hits] * many + i, quotes)
                    for t in np.unique(block.text[hits[able]]):
                        codes = block.codes[block.first[t] : block.end[t]]
                        near = block.at[hits[block.text[hits] == t]] - block.first[t]
                        if got := check(codes, near.tolist(), i):
                            out.append((keys[first + t], ids[i], float(got[0]), bool(got[1])))
            yield pd.DataFrame(out, columns=[key, "item_id", "agreement", "answer_near"])

    return spread(encoded.select(F.col(key).alias("_k"), "codes")).mapInPandas(search, schema)


def _blocks(texts: list[np.ndarray], words_: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many words."""
    first, n = 0, 0
    for d, codes in enumerate(texts):
        n += len(codes)
        if n >= words_:
            yield first, d + 1
            first, n = d + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _holds(codes: np.ndarray, answer: np.ndarray) -> bool:
    k = len(answer)
    return bool(k) and any(np.array_equal(codes[i : i + k], answer) for i in np.flatnonzero(codes == answer[0]))
