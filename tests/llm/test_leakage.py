import random

import pytest

normal = pytest.importorskip("fluxloom.llm.normal")
quotes = pytest.importorskip("fluxloom.llm.quotes")
leakage = pytest.importorskip("fluxloom.llm.leakage")


@pytest.mark.parametrize(
    "text, want",
    [
        ("The <b>quick</b>&nbsp;fox&#59; <p>jum<i>ps</i></p>", "the quick fox jumps"), ("# café\n# Café CAFÉ", "cafe cafe cafe"), ("раy​pal ­soft­ly", "paypal softly"),
        ("lÃ©ger", "leger"), ("Ｆｕｌｌ Ⅸ ﬁn", "full ix fin"), ("a_b*c* [d](e) 3<4 & 5>2", "a b c d e 3 4 5 2"), ("", ""), ("Straße", "strasse"), ("&amp;#59;x &amp;lt;", "x"), ("x" * 100_000, "x" * 100_000),
    ],
)
def test_words_behind_disguises(text, want):
    assert normal.words(text) == want.split()


def test_code_is_cut_out():
    assert normal.words(normal.without_code("a\r\n```py\r\nb = 1\r\n```\r\nc <pre><code>d</code></pre> e\n~~~\nopen")) == ["a", "c", "e"]


def lq(item, text):
    return quotes.longest_quote(item, text, 15, 0.8, 1.5)


def test_quotes():
    item = list(range(60))
    assert lq(item, [-1] * 9 + item[20:35] + [-1] * 9) == 1.0
    assert lq(item, [-1] * 9 + item[20:34] + [-1] * 9) == 0.0  # one word short
    edited = [w if i % 6 else -1 for i, w in enumerate(item[10:40])]
    assert 0.8 <= lq(item, edited) < 1
    assert lq(item, [w if i % 3 else -1 for i, w in enumerate(item[10:40])]) == 0.0
    assert lq(item, [w for i, w in enumerate(item[10:40]) if i % 6]) >= 0.8  # left out instead of exchanged
    assert lq(item, [x for w in item[10:30] for x in (w, -1, -1)]) == 0.0  # scattered
    assert lq(item, item[10:20][::-1] + item[20:30]) == 0.0
    assert lq(item, item[0:8] + [-1] * 30 + item[8:16]) == 0.0
    assert lq([], item) == lq(item, []) == 0.0
    assert lq(item, item[0:14] + item[21:35]) == 0.8  # seven successive words missing
    assert lq(item, item[0:14] + item[22:36]) == 0.0
    assert quotes.longest_gap(15, 0.8) == 7


def test_triples_say_which_items_a_text_can_quote():
    np = pytest.importorskip("numpy")
    items = [np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4]), np.array([], dtype=np.int32), np.array([5])]
    at, item = leakage.Triples(items, 6).of(np.array([-1, 1, 2, 3, 0, 1, 2, -1]))
    assert sorted(zip(at.tolist(), item.tolist())) == [(1, 0), (1, 1), (4, 0)]
    assert len(leakage.Triples(items, 6).of(np.array([1, 2]))[0]) == len(leakage.Triples([], 0).of(np.array([1, 2, 3]))[0]) == 0


def test_a_text_that_repeats_an_item_and_items_in_rounds(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join([text] * 400)), (2, " ".join(["w3 w4 w5 x"] * 2000) + " " + " ".join(f"w{i}" for i in range(9, 24))), (3, "w3 w4 w5 x " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(i, text + f" e{i}", "w7") for i in range(5)], "item_id long, text string, answer string")
    want = {(d, i) for d in (1, 2) for i in range(5)}
    assert {(r.doc_id, r.item_id) for r in leakage.found(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leakage.found(docs, items, settings=leakage.Settings(item_chars=400)).collect()} == want


FILLER = "the usual answer did nothing for my garden and nobody here seems to mind while a spare bucket stays near every gate".split()


def test_planted_passages_are_found(spark):
    rnd = random.Random(5)
    names = [f"{a}{b}" for a in ("zor", "mel", "tak", "vin", "lus", "pra") for b in ("ban", "dol", "rik", "sum", "tev", "nox", "gil", "har")]
    items = [(i, " ".join(rnd.choice(names) if rnd.random() < 0.6 else rnd.choice(FILLER) for _ in range(50)), rnd.choice(names)) for i in range(40)]
    docs, want = [], set()
    for d in range(300):
        words = [rnd.choice(FILLER) for _ in range(rnd.randint(0, 200))]
        if d % 3 == 0:
            i, text, _ = items[rnd.randrange(40)]
            w, a = text.split(), rnd.randint(0, 30)
            part = w[a : a + (20 if d % 2 else 8)]
            if d % 2:
                want.add((d, i))
                part[rnd.randint(5, 14)] = "other"
            words[len(words) // 2 : 0] = part
            words = words[: len(words) // 2] + part + words[len(words) // 2 :]
        docs.append((d, " ".join(words).upper() if d % 5 else "<p>" + "</p>\n<p>".join(words) + "</p>", "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, items[3][1] + ". " + " ".join(FILLER * 3000), "x"), (902, items[3][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    t = spark.createDataFrame([*items, (98, None, "a"), (99, "", None)], "item_id long, text string, answer string")
    out = leakage.found(d, t)
    got = [(r.doc_id, r.item_id) for r in out.collect()]
    brute = {(k, i) for k, x, _ in docs if x for i, q, _ in items if lq(_codes(q), _codes(x)) > 0}
    assert set(got) == brute and want <= brute and got.count((902, 3)) == 2  # rows with one key are judged each
    assert leakage.found(d.limit(0), t).count() == 0 and leakage.found(d, t.limit(0)).count() == 0


def test_short_edited_quotes_are_found(spark):
    """15 words with 3, and 20 with 4, exchanged or left out: what the rule still accepts must become a candidate."""
    rnd = random.Random(9)
    lexicon = [a + b + c for a in ("zo", "me", "ta", "vi", "lu", "pra", "ge", "ho", "ny") for b in ("ban", "dol", "rik", "sum", "tev", "nox", "gil", "har", "lom") for c in ("a", "en", "is", "or", "ul", "ix", "em", "ot", "und", "y", "ek", "ast")]
    items = [(i, " ".join(rnd.choice(lexicon) if rnd.random() < 0.6 else rnd.choice(FILLER) for _ in range(50)), "x") for i in range(300)]
    docs, want = [], set()
    for d in range(600):
        words = [rnd.choice(lexicon) if rnd.random() < 0.4 else rnd.choice(FILLER) for _ in range(rnd.randint(40, 120))]
        (n, edits), (i, text, _) = ((15, 3), (20, 4))[d % 2], rnd.choice(items)
        a, at = rnd.randint(0, 50 - n), rnd.randint(0, len(words))
        part = text.split()[a : a + n]
        for p in rnd.sample(range(1, n - 1), edits):
            part[p] = (rnd.choice(lexicon), f"stranger{rnd.randint(0, 500)}", "")[d % 3]
        words[at:at] = part
        docs.append((d, " ".join(words)))
        if lq(_codes(text), _codes(" ".join(words))) > 0:
            want.add((d, i))
    assert len(want) > 590
    out = leakage.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string"))
    missed = want - {(r.doc_id, r.item_id) for r in out.collect()}
    assert not missed, f"{len(missed)} of {len(want)} missed"


_CODES: dict = {}


def _codes(text):
    return [_CODES.setdefault(w, len(_CODES)) for w in normal.words(text)]
