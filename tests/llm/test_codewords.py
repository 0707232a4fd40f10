import numpy as np
import pytest

from factweave.llm import langid


def least(code):
    n = code.shape[1]
    return min((n - abs(int(code[i] @ code[j]))) // 2 for i in range(len(code)) for j in range(i))


@pytest.mark.parametrize("classes", [7, 12, 30])
def test_the_kept_code_has_the_largest_least_distance(classes):
    rng = np.random.default_rng(7)
    n = int(np.ceil(12 * np.log2(classes)))
    codes = [rng.choice([-1.0, 1.0], size=(classes, n)) for _ in range(64)]
    best = max(least(c) for c in codes if (np.abs(c.sum(axis=0)) < classes).all())
    assert least(langid.codewords(classes)) == best
