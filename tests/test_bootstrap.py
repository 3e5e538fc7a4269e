import hashlib
import math
import random

import pytest

from ledgerloom.operators import bootstrap


def plain(rows, resamples, level, seed):
    def difference(b):
        sums = {}
        for id, stratum, arm, value in rows:
            u = int(hashlib.md5(f"{seed}:{b}:{id}".encode()).hexdigest()[:8], 16) / 2**32
            w, p, below = 0, math.exp(-1), 0.0
            while b and u >= below + p and w < 12:  # inverse of the Poisson distribution
                below, w = below + p, w + 1
                p /= w
            w = w if b else 1
            n, x = sums.get((stratum, arm), (0, 0.0))
            sums[stratum, arm] = (n + w, x + w * value)
        both = [s for s in {s for s, _ in sums} if all(sums.get((s, a), (0, 0))[0] for a in (True, False))]
        parts = [(sums[s, True][0] + sums[s, False][0], sums[s, True][1] / sums[s, True][0] - sums[s, False][1] / sums[s, False][0]) for s in both]
        return round(sum(n * d for n, d in parts) / sum(n for n, _ in parts), 9)

    d = sorted(difference(b) for b in range(1, resamples + 1))
    tail = (1 - level) / 2
    return difference(0), d[max(1, math.ceil(round(resamples * tail, 9))) - 1], d[max(1, math.ceil(round(resamples * (1 - tail), 9))) - 1]


@pytest.mark.parametrize("seed,level", [("a", 0.95), ("b", 0.8)])
def test_against_a_plain_version(spark, seed, level):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("xyz"), (arm := rnd.random() < 0.4), rnd.random() + 0.3 * arm) for i in range(150)] + [(999, "alone", True, 50.0)]
    got = bootstrap.bootstrap(spark.createDataFrame(rows, "id long, stratum string, arm boolean, value double").repartition(3), 40, level, seed).first()
    assert (got.difference, got.low, got.high) == pytest.approx(plain(rows, 40, level, seed), abs=2e-9)
    assert got.resamples == 40 and got.low < 0.3 < got.high
