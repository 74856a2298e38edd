"""What decompositions recover from signals of known parts, and that one that does nothing fails."""

import duckdb
import numpy as np
import pytest

from modeloom.operators import decompose as D
from modeloom.plans import catalogue, recovery

NAMES = sorted(q for q in catalogue.QUERIES if q.startswith("recovers_"))


def rows(spark, name):
    df = catalogue.QUERIES[name](spark, "")
    return sorted(tuple(r) for r in df.select("part", "bin", "alike", "strong").collect())


def wanted(name):
    return sorted(duckdb.connect().sql(f"SELECT part, bin, alike, strong FROM ({catalogue.ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_parts_are_recovered(spark, name):
    assert rows(spark, name) == wanted(name)


IDLE = ["emd", "acmd", "apmd", "jmd", "dd_acmd", "stl", "mstl", "osd", "imd", "vme"]


@pytest.mark.parametrize("name", IDLE)
def test_an_idle_kernel_fails(spark, monkeypatch, name):
    """One for each scene: modes that are nothing and the signal itself."""
    monkeypatch.setitem(D.KERNELS, name, lambda x, **_: (np.array([np.zeros_like(x), x]), None))
    assert rows(spark, f"recovers_{name}") != wanted(f"recovers_{name}")


def test_idle_kernels_of_images_and_channels_fail(spark, monkeypatch):
    for name in ("vmd2d", "emd2d"):
        monkeypatch.setitem(D.IMAGE_KERNELS, name, lambda a, **_: np.array([np.zeros_like(a), a]))
        assert rows(spark, f"recovers_{name}") != wanted(f"recovers_{name}")
    monkeypatch.setitem(D.MULTI, "memd", lambda x, **_: (np.array([np.zeros_like(x), x]), None))
    assert rows(spark, "recovers_memd") != wanted("recovers_memd")


def test_every_exact_decomposition_is_tried():
    from modeloom.plans import decompositions

    assert set(decompositions.EXACT) <= set(recovery.TRIALS)
