"""Integer digamma without SciPy: psi(m) = H(m - 1) - gamma."""

EULER = 0.5772156649015329


def digamma_int(m: int) -> float:
    return sum(1.0 / i for i in range(1, m)) - EULER
