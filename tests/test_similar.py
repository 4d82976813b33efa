"""Similar words against comparing all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from tamiz.operators import similar, speech_repair


@pytest.mark.parametrize("least", [0.6, 0.8, 1.0])
def test_as_comparing_all(spark, least):
    r = random.Random(6)
    targets = [*speech_repair.TARGETS, "aab", "ñandú"]

    def twisted(w):
        out = list(w)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(out) + 1)
            out[at : at + r.randint(0, 1)] = r.choice("abcñ")
        return "".join(out)

    words = [twisted(r.choice(targets)) for _ in range(400)] + ["".join(r.choice("aeionrs") for _ in range(r.randint(1, 12))) for _ in range(400)] + ["", None, "fiebre", "fiebre"]
    df, against = spark.createDataFrame([(w,) for w in words], "word string").repartition(3), spark.createDataFrame([(t,) for t in targets], "target string")
    want = {(w, t): SequenceMatcher(None, w, t, autojunk=False).ratio() for w in set(words) if w for t in set(targets)}
    got = {(x.word, x.target): x.ratio for x in similar.similar(df, against, least).collect()}
    assert got == {k: v for k, v in want.items() if v >= least} and got
    left = similar.candidates(df, against, least).count()
    assert len(got) <= left < 0.35 * len(want)
    assert similar.similar(df.limit(0), against, least).count() == 0
