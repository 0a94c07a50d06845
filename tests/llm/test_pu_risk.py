"""op4's risk and prior against plain formulas."""

import numpy as np
import pytest

from breakweave.llm import pu_quality
from breakweave.llm.pu_quality import N_FEATURES


class Spy(pu_quality.Net):
    """Keeps the scores and the gradient of its steps, and does not move."""

    def step(self, x, h, grad, rate=0, decay=0):
        self.seen = getattr(self, "seen", []) + [(self.forward_of(h), grad)]

    def forward_of(self, h):
        return h @ self.p[2] + self.p[3]


def risk(z, k, prior):
    """The non-negative unbiased risk of scores z, whose first k are positives; its gradient turns where the negative part is below 0."""
    s = 1 / (1 + np.exp(-z))
    negative = s[k:].mean() - prior * s[:k].mean()
    return prior * (1 - s[:k]).mean() + negative if negative >= 0 else -negative


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.9])
def test_steps_follow_the_risk(prior):
    rng = np.random.default_rng(1)
    net = Spy(np.zeros(N_FEATURES), np.ones(N_FEATURES), rng)
    positive, unlabelled = rng.normal(0.5, 1, (40, N_FEATURES)), rng.normal(0, 1, (70, N_FEATURES))
    pu_quality.walk(net, positive, unlabelled, prior, rng)
    for z, grad in net.seen[:5]:
        k = len(z) - 70
        for at in [0, 1, k - 1, k, k + 1, len(z) - 1]:
            up, down = z.copy(), z.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            assert grad[at] == pytest.approx((risk(up, k, prior) - risk(down, k, prior)) / 2e-5, abs=1e-7)


@pytest.mark.parametrize("share", [0.2, 0.6])
def test_prior_by_all_thresholds(spark, share):
    """The estimate is the least ratio of tails over all thresholds, and near the true share."""
    rng = np.random.default_rng(2)
    draw = lambda n, good: np.where(good, rng.normal(1.5, 1, (N_FEATURES, n)), rng.normal(-1.5, 1, (N_FEATURES, n))).T
    positive, mixed = draw(1500, np.ones(1500, bool)), draw(6000, rng.random(6000) < share)
    net = pu_quality.Net(np.zeros(N_FEATURES), np.ones(N_FEATURES), rng)
    net.p = [np.zeros((N_FEATURES, pu_quality.HIDDEN)), np.zeros(pu_quality.HIDDEN), np.zeros(pu_quality.HIDDEN), np.zeros(1)]
    net.p[0][0, :2], net.p[2][:2] = (1, -1), (1, -1)  # the score is the first feature
    stored = lambda x: x.astype(np.float16).astype(np.float32)
    dealt = spark.createDataFrame([(k % 3, row.astype(np.float16).tobytes()) for k, row in enumerate(mixed)], "part int, f binary").repartition(1).sortWithinPartitions("part")
    got = pu_quality.estimate_prior(net, stored(positive), dealt)
    score = lambda x: net.forward(stored(x).astype(np.float64))[2]
    a, b = score(positive), score(mixed)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(b)) + 1 / np.sqrt(len(a)))
    edges = np.linspace(-30, 30, pu_quality.BINS + 1)[:-1]
    ratios = [(((b > e).mean() + slack) / (a > e).mean(), (b > e).mean() / (a > e).mean()) for e in edges if (a > e).any()]
    assert got == pytest.approx(min(ratios)[1], rel=1e-9) and abs(got - share) < 0.05
