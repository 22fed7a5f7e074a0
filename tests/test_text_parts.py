import random

from docketry.functions.similarity import Parts, partial
from docketry.operators import detections


def test_no_part_that_is_alike_is_left_out():
    rng = random.Random(3)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    texts = [word("ab cd", 5, 30) for _ in range(50)] + [word("abcİ ", 500, 700)]
    for least in (50.0, 65.0, 72.5, 85.0):
        parts = Parts(texts, least)
        for _ in range(12):
            long = word("ab cde", 3, 60) + rng.choice(texts)[: rng.randint(0, 30)]
            fit = parts.fit(long)
            assert all(fit[k] for k, t in enumerate(texts) if partial(t, long, least)[0] >= least)
    assert Parts([], 65.0).fit("abc").tolist() == []
    # Sums that go on past the stretch after which they are set back.
    text = word("abcdefghij ", 150, 200)
    assert Parts([text, "z" * 80], 65.0).fit("x" * 3000 + text + "y" * 900).tolist() == [True, False]


def test_unlike_texts_are_not_compared_letter_by_letter(monkeypatch):
    rng, calls = random.Random(5), []
    prose = lambda n: "".join(rng.choice("etaoinshrdlu    ") for _ in range(n))
    monkeypatch.setattr(detections, "partial", lambda *x: calls.append(x[:2]) or partial(*x))
    needles = [prose(120) for _ in range(4)]
    left = [{"doc_id": k, "day": 3, "issuer": None, "needle": t} for k, t in enumerate(needles)]
    right = [{"doc_id": 9, "day": 4, "issuer": None, "reg_id": 7, "body": prose(400) + needles[2][:-3] + "xyz" + prose(300)}, {"doc_id": 10, "day": 40, "issuer": None, "reg_id": 7, "body": needles[0]}]
    assert [(a, b, r) for a, b, r, _ in detections._text_tile(65.0)(left, right, False)] == [(2, 9, 7)]
    assert [needles.index(a) for a, _ in calls] == [2]


def test_letters_in_order_are_counted_for_many_stretches_at_once():
    from docketry.functions import similarity

    rng = random.Random(12)
    word = lambda low, high: "".join(rng.choice("abcde ") for _ in range(rng.randint(low, high)))
    # Up to more than two words of 63 bits, with what is carried from one to the next.
    texts = sorted((word(50, 140) for _ in range(9)), key=len)
    side = similarity._Alongside(texts, 65.0)
    stretches = sorted((word(1, 200) for _ in range(25)), key=len, reverse=True)
    numbers = [similarity.np.searchsorted(side.letters, similarity._codes(s)) for s in stretches]
    assert side._common(numbers).tolist() == [[similarity.common(t, s) for t in texts] for s in stretches]
    longs = [word(3, 400) for _ in range(8)] + [word(100, 200) + texts[4] + word(0, 9)]
    parts = Parts(texts, 65.0)
    found = parts.fits(longs)
    assert found.tolist() == [parts.fit(x).tolist() for x in longs] and found[-1, 4]
