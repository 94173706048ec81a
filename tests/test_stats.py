import math

from hypothesis import given
from hypothesis import strategies as st

from lattica.functions.stats import incomplete_beta, t_cdf, t_quantile, two_sided_p


def test_known_quantiles():
    for df, want in ((1, 12.7062047364), (2, 4.30265272991), (10, 2.22813885196), (1e6, 1.95996635682)):
        assert math.isclose(t_quantile(0.975, df), want, rel_tol=1e-9)


def test_small_tails_of_either_sign():
    assert 0 < two_sided_p(470, 11) == two_sided_p(-470, 11) < 1e-20
    assert two_sided_p(0, 5) == 1


@given(st.floats(0.001, 0.999), st.floats(0.5, 500), st.floats(0.5, 500))
def test_beta_is_symmetric(x, a, b):
    assert math.isclose(incomplete_beta(x, a, b) + incomplete_beta(1 - x, b, a), 1, abs_tol=1e-9)


@given(st.floats(0.01, 0.99), st.integers(1, 10_000))
def test_quantile_inverts_cdf(p, df):
    assert math.isclose(t_cdf(t_quantile(p, df), df), p, rel_tol=1e-9)
