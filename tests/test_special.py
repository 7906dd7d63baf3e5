import math

import pytest

from sparkchemo.functions.special import beta_i, binomial_sf, chi2_ppf, f_ppf, gamma_p, minimise_1d, t_cdf


def test_chi_squared_quantiles():
    assert chi2_ppf(0.95, 36) == pytest.approx(50.998460165, abs=1e-8)
    assert chi2_ppf(0.95, 2) == pytest.approx(-2 * math.log(0.05), abs=1e-12)
    for p in (0.01, 0.3, 0.999):
        for k in (0.5, 3.7, 120.0):
            assert gamma_p(k / 2, chi2_ppf(p, k) / 2) == pytest.approx(p, abs=1e-12)


def test_f_and_t():
    # With two numerator degrees the F law has a closed form.
    d = 7.0
    assert f_ppf(0.9, 2, d) == pytest.approx(d / 2 * ((1 - 0.9) ** (-2 / d) - 1), rel=1e-10)
    # One degree of freedom is the Cauchy law.
    assert t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-12)
    assert t_cdf(-2.0, 2) == pytest.approx(0.5 - 2 / (2 * math.sqrt(6)), abs=1e-12)
    assert beta_i(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_binomial_tail():
    assert binomial_sf(8, 10) == pytest.approx(56 / 1024, abs=1e-12)
    assert binomial_sf(0, 10) == 1.0 and binomial_sf(11, 10) == 0.0


def test_simplex_finds_a_minimum():
    x, good = minimise_1d(lambda v: (v - 7.25) ** 2, 1.0)
    assert good and x == pytest.approx(7.25, abs=1e-3)
