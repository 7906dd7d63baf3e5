
import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkchemo.operators.projection import PCA, LatentRegression
from sparkchemo.sources.tables import csv_table

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def listed(nth: int) -> str:
    """The path of the nth table of the first section of FIXTURES.md."""
    with open(f"{TOP}/FIXTURES.md") as f:
        text = f.read()
    folder = re.search(r"paths relative to `([^`]+)`", text)[1]
    return folder + re.findall(r"^\| `([^`]+)` \|", text, re.MULTILINE)[nth]


def there(nth: int) -> bool:
    return os.path.isfile(f"{TOP}/FIXTURES.md") and os.path.isfile(listed(nth))


PEOPLE = ["height", "weight", "hair", "shoe", "age", "income", "beer", "wine", "sex", "swim", "region", "iq"]
REST = [c for c in PEOPLE if c != "shoe"]


@pytest.fixture(scope="module")
def people(spark):
    if not there(0):
        pytest.skip("no fixture table")
    df = csv_table(spark, f"file://{listed(0)}", "name string, " + ", ".join(f"{c} double" for c in PEOPLE), skip=2, sep=" ")
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).cache()


#: Scaled, way of the limits, h0, q0, degrees of freedom of h and of q.
PCA_LIMITS = [
    (True, "semi", 4.517604926884162, 0.3347298612776225, 15, 4),
    (False, "semi", 5.12575970787771, 17.26054862016219, 17, 4),
    (True, "classical", 4.84375, 0.3811163636820247, 13, 3),
    (False, "classical", 4.84375, 17.792849572635518, 14, 3),
]


@pytest.mark.parametrize(("scale", "robust", "h0", "q0", "nh", "nq"), PCA_LIMITS)
def test_pca_limits_of_people(people, scale, robust, h0, q0, nh, nq):
    assert people.count() == 32
    m = PCA(PEOPLE, 5, alpha=0.05, gamma=0.01, scale=scale, robust=robust).fit(people)
    assert m.dof_h == (nh, pytest.approx(h0, abs=1e-6)) and m.dof_q == (nq, pytest.approx(q0, abs=1e-6))


#: Scaled, robust, h0, q0, z0, degrees of freedom, and R2 of the training and the test rows where known.
PLS_LIMITS = [
    (True, True, 6.433454627, 0.159288717, 0.105430410, (21, 2, 1), (0.9873776585, 0.9051699791)),
    (True, False, 6.708333333, 0.150055243, 0.189247467, (13, 2, 1), None),
    (False, True, 6.220076404, 6.276821594, 0.175045172, (16, 1, 1), (0.9847652, 0.9141127)),
    (False, False, 6.708333333, 5.630580160, 0.228416894, (11, 1, 1), None),
]


@pytest.mark.parametrize(("scale", "robust", "h0", "q0", "z0", "dof", "r2"), PLS_LIMITS)
def test_pls_limits_of_people(people, scale, robust, h0, q0, z0, dof, r2):
    train, test = people.where("place % 4 <> 0"), people.where("place % 4 = 0")
    m = LatentRegression(REST, "shoe", 7, alpha=0.05, gamma=0.01, scale=scale, robust=robust).fit(train)
    assert [m.dof[k][0] for k in "hqz"] == list(dof)
    assert [m.dof[k][1] for k in "hqz"] == [pytest.approx(v, rel=1e-5) for v in (h0, q0, z0)]
    if r2:
        assert [m.r2(t, "shoe").first()[0] for t in (train, test)] == [pytest.approx(v, abs=1e-6) for v in r2]


@pytest.mark.parametrize(("scale", "c_crit", "c_out"), [(True, 59.30351203, 84.88690268), (False, 14.06714045, 28.98425643)])
def test_pca_limits_of_elements(spark, scale, c_crit, c_out):
    if not there(1):
        pytest.skip("no fixture table")
    path = listed(1)
    with open(path, encoding="utf-8-sig") as f:
        names = [f"e{k}" for k, _ in enumerate(f.readline().strip().split(","))]
    df = csv_table(spark, f"file://{path}", ", ".join(f"{c} string" for c in names[:2]) + ", " + ", ".join(f"{c} double" for c in names[2:]), header=True)
    m = PCA(names[2:], 3, alpha=0.05, gamma=0.01, scale=scale, robust="semi").fit(df)
    assert m.n == 69 and (m.c_crit, m.c_out) == (pytest.approx(c_crit, abs=1e-5), pytest.approx(c_out, abs=1e-5))
