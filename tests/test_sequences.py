"""Longest common subsequences against dynamic programming."""

import random
import time

import pytest

from casebook.functions import sequences as Q


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def check(a, b):
    pairs = Q.lcs_pairs(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) == table_length(a, b) == Q.lcs_length(a, b)


@pytest.mark.parametrize("few, kept", [(48, 1 << 25), (0, 1 << 25), (0, 64), (3, 400)])
def test_random_pairs_are_shortest(monkeypatch, few, kept):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "KEPT_BITS", kept)
    g = random.Random(few + kept)
    for _ in range(250):
        size, letters = g.randrange(0, 60), g.randrange(1, 12)
        a = [g.randrange(letters) for _ in range(size)]
        if g.random() < 0.5:
            b = [x if g.random() < 0.8 else g.randrange(letters) for x in a if g.random() < 0.9]
        else:
            b = [g.randrange(letters) for _ in range(g.randrange(0, 60))]
        check(a, b)
    check([], [1])
    check([1], [])
    check([], [])


def test_long_texts_in_time():
    """A rewrite of 20,000 words, and two edits far apart in a million tokens."""
    a = [t for k in range(20_000) for t in (f"a{k}", " ")]
    b = [t for k in range(20_000) for t in (f"b{k}", " ")]
    began = time.process_time()
    assert len(Q.lcs_pairs(a, b)) == 20_000
    assert time.process_time() - began < 3  # some 0.6 s on an idle core
    long = list(range(1_000_000))
    edited = [*long[:10], -1, *long[10:999_000], *long[999_001:]]
    assert len(Q.lcs_pairs(long, edited)) == 999_999


def test_meteor_by_hand():
    from casebook.operators.scoring import alignment, meteor_score

    a = "the cat sat on the mat".split()
    assert alignment(a, a) == [(i, i) for i in range(6)]
    assert meteor_score(a, a) == pytest.approx(1 - 0.5 * (1 / 6) ** 3)
    # three of four words, in one stretch: P = 3/4, R = 3/6
    assert meteor_score("the cat sat down".split(), a) == pytest.approx((0.75 * 0.5) / (0.9 * 0.75 + 0.1 * 0.5) * (1 - 0.5 * (1 / 3) ** 3))
    # all six words, in two stretches that change places
    b = "on the mat the cat sat".split()
    assert len(alignment(b, a)) == 6 and meteor_score(b, a) == pytest.approx(1 - 0.5 * (2 / 6) ** 3)
    # stems match where words don't
    assert alignment(["cats", "sitting"], ["cat", "sit", "cats"]) == [(0, 2), (1, 1)]
    assert meteor_score([], a) == meteor_score(a, []) == meteor_score(["x"], ["y"]) == 0
    assert alignment(["a", "a", "b"], ["b", "a"]) == [(0, 1), (2, 0)]
    g = random.Random(2)
    for limit in (10**9, 0):
        for _ in range(100):  # as many matches as there are equal words
            x, y = ([g.choice("abcdefg") for _ in range(g.randrange(0, 25))] for _ in "xy")
            pairs = alignment(x, y, limit)
            assert all(x[i] == y[j] for i, j in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) == sum(min(x.count(w), y.count(w)) for w in "abcdefg")


def test_changed_words():
    from casebook.operators.scoring import changed_words

    assert changed_words("Posteroanterior (PA) view", "Supine AP portable") == 6
    assert changed_words("No effusion. Clear lungs.", "No effusion.\nClear lungs.") == 0
    assert changed_words("No pleural effusion.", "No pleural effusion") == 1
    assert changed_words("", "two words") == 2 and changed_words("same", "same") == 0


def test_rest_that_lies_in_the_other(monkeypatch):
    """Every fifth word of a text becomes one found nowhere else: no table of the two texts is needed."""

    def never(*_):
        raise AssertionError("searched")

    g = random.Random(5)
    a = [t for _ in range(4000) for t in (f"w{g.randrange(300)}", " ")]
    b = [f"zq_{i}" if i % 10 == 8 else t for i, t in enumerate(a)]
    monkeypatch.setattr(Q, "_by_rows", never)
    for x, y in ((a, b), (b, a)):
        pairs = Q.script_pairs(x, y)
        assert len(pairs) == 7200 and all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_words_only_one_side_has(monkeypatch):
    g = random.Random(7)
    for few in (48, 0):
        monkeypatch.setattr(Q, "FEW", few)
        for _ in range(150):
            a, b = ([g.randrange(lo, lo + 8) for _ in range(g.randrange(0, 40))] for lo in (0, 5))
            for x, y in ((a, b), (b, a)):
                pairs = Q.script_pairs(x, y)
                assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
                assert len(pairs) == table_length(x, y)
