import random

import numpy as np
import pytest

subjects = pytest.importorskip("fluxloom.llm.subjects")

TERMS = {
    "sport": "goal striker coach match league racket".split(), "cooking": "oven dough butter onion garlic yeast".split(),
    "law": "court verdict tenant clause statute witness".split(),
}
FRAMES = ["the {} looked fine until the {} came along", "nobody here wants a {} without its {}", "keep the {} and the {} apart for a while"]


def sentence(rnd, subject):
    return rnd.choice(FRAMES).format(*rnd.sample(TERMS[subject], 2))


def corpus(n, seed=2):
    rnd, docs, truth = random.Random(seed), [], {}
    for d in range(n):
        main = rnd.choice(list(TERMS))
        parts = [sentence(rnd, main) for _ in range(8)]
        truth[d] = {main}
        if d % 4 == 0:
            other = rnd.choice([s for s in TERMS if s != main])
            parts += [sentence(rnd, other) for _ in range(5)]
            truth[d].add(other)
        elif d % 4 == 1:  # a passing remark
            parts.append(sentence(rnd, rnd.choice([s for s in TERMS if s != main])))
        rnd.shuffle(parts)
        docs.append((d, ". ".join(parts) + ".\n```\n" + " ".join(TERMS["law"] * 5) + "\n```\n", "x"))
    return docs, truth


def test_segments():
    assert subjects.segments_of("One two. Three!\n```\ncode here\n```\nfour <b>five</b>", 20) == [["one", "two"], ["three"], ["four", "five"]]
    assert [len(s) for s in subjects.segments_of("w " * 45, 20)] == [20, 20, 5] and subjects.segments_of("", 20) == []


def test_held_out_documents_get_their_subjects(spark):
    docs, truth = corpus(240)
    extra = [(1000, None, "x"), (1001, "", "x"), (1002, "nope, still the same", "x"), (1003, "```\ncourt verdict\n```", "x"), (1004, "striker", "x"), (None, "court verdict, tenant and clause", "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, subject string")
    labels = [(k, s, "desk") for k in range(120) for s in truth[k]] + [(5, "unlisted", "d"), (7777, "law", "d"), (None, "law", "d"), (3, None, "d"), (3, "sport" if "sport" not in truth[3] else "law", "wrong")]
    t = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string")
    areas = spark.createDataFrame([(s, "x") for s in TERMS] + [(None, "y")], "subject string, about string")
    got: dict = {}
    for r in subjects.assign(d, t, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(k) == truth[k] for k in range(120, 240))
    assert right >= 114, right
    assert not {1000, 1001, 1002, 1003} & set(got)
    assert subjects.assign(d.limit(0), t, areas).count() == subjects.assign(d, t.limit(0), areas).count() == subjects.assign(d, t, areas.limit(0)).count() == 0


def test_pairs_are_counted_over_whole_segments(spark):
    """Two words make a pair however many words of the segment stand between them."""
    between = [f"m{i}" for i in range(10)]
    lines = [(" ".join(["zulu", *between, "alpha"]), "a")] * 30 + [("alpha x", "b")] * 30 + [("y zulu", "c")] * 30 + [(f"w{c}", c) for c in "def" for _ in range(42)]
    got = subjects.mine(spark.createDataFrame(lines, "words string, subject string"), list("abcdef"), 2, subjects.Settings())
    pairs = {(int(k) >> 32, int(k) & 0xFFFFFFFF): e for k, e in zip(got.keys, got.pairs)}
    assert int(pairs[tuple(sorted((got.codes["alpha"], got.codes["zulu"])))].argmax()) == 0
    alone = subjects.mine(spark.createDataFrame(lines, "words string, subject string"), list("abcdef"), 2, subjects.Settings(pairs=False))
    assert not len(alone.keys) and len(alone.codes) == int(alone.alone.sum())


def test_patterns_and_counts_agree_with_brute_force(spark):
    rnd = random.Random(3)
    lines = [(" ".join(rnd.choices("abcdefgh", weights=range(1, 9), k=rnd.randint(1, 9))), rnd.choice("xy")) for _ in range(300)]
    codes = {w: i for i, w in enumerate("hgfedcba")}
    line, code = subjects.transactions([w for w, _ in lines], codes)
    first, second = subjects.grown(line, code)
    got = sorted((int(line[a]), int(code[a]), int(code[b])) for a, b in zip(first, second))
    assert got == sorted((i, p, q) for i, (w, _) in enumerate(lines) for c in [sorted({codes[x] for x in w.split()})] for n, p in enumerate(c) for q in c[n + 1 :])


def test_a_pair_stands_in_for_its_words():
    e = lambda *x: np.log(np.array(x))
    codes = {"season": 0, "onion": 1, "umpire": 2}
    r = subjects.Rules(["a", "b"], codes, np.stack([e(1.2, 0.8), e(1.9, 0.1), e(0.1, 1.9)]), np.ones(3, dtype=bool), np.array([2]), e(0.05, 1.95)[None])
    total, speaks = r.evidence(["season umpire", "season onion", "nothing", ""])
    assert np.allclose(total[0], e(0.05, 1.95)) and np.allclose(total[1], e(1.2, 0.8) + e(1.9, 0.1)) and speaks.tolist() == [True, True, False, False]
    share, says, doc, posterior = r.shares(["x", "onion\nx\numpire\numpire", ""])
    assert says.tolist() == [False, True, False] and doc.tolist() == [0, 1, 1, 1, 1, 2]
    assert share[1, 1] > share[1, 0] and np.allclose(posterior[2], share[1])
    assert subjects.Rules.none(["a"]).shares(["x"])[1].tolist() == [False]


def test_the_cut_is_calibrated_within_its_range():
    s = subjects.Settings()
    assert subjects.calibrated_cut([], s) == s.cut
    assert subjects.calibrated_cut([(0.2, False, 50), (0.24, True, 50), (0.9, True, 100)], s) == pytest.approx(0.22)
    assert subjects.calibrated_cut([(0.25, False, 50), (0.5, True, 50)], s) == pytest.approx(0.26)
