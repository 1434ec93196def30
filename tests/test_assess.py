"""One-to-one assignment of prompts against all permutations."""

import itertools
import random

from sigtrail.operators.assess import best_assignment


def test_assignment_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        scores = [[rng.choice([0.0, 0.5, rng.random(), 1.0]) for _ in range(m)] for _ in range(n)]
        small = scores if n <= m else [list(c) for c in zip(*scores, strict=True)]
        best = max(sum(small[i][p[i]] for i in range(len(small))) for p in itertools.permutations(range(len(small[0])), len(small)))
        assert abs(best - best_assignment(scores)) < 1e-9
    assert best_assignment([]) == 0.0
