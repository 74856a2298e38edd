"""Methods that depart from the reference recover known modes; the README lists them."""

from pathlib import Path

import numpy as np

from modeloom.operators.kernels import fields
from tests.test_kernels import T, best

SLOW, FAST = np.cos(2 * np.pi * 50 * T), 0.5 * np.cos(2 * np.pi * 200 * T)


def test_apmd_recovers_two_tones():
    modes = fields.apmd(SLOW + FAST, 3)[:-1]
    assert best(modes, SLOW) > 0.99 and best(modes, FAST) > 0.99


def test_vtfmtd_recovers_two_tones():
    modes = fields.vtfmtd(SLOW + FAST, (0.06, 0.19))[0]
    assert best(modes, SLOW) > 0.99 and best(modes, FAST) > 0.99


def test_cvmd2d_recovers_halves():
    y, x = np.mgrid[:32, :32]
    left, right = np.where(x < 16, np.cos(2 * np.pi * x / 8), 0.0), np.where(x >= 16, np.cos(2 * np.pi * y * 10 / 32), 0.0)
    modes, supports, _ = fields.cvmd2d(left + right, K=2)
    modes = modes.reshape(2, -1)
    assert best(modes, left.ravel()) > 0.95 and best(modes, right.ravel()) > 0.95
    own = supports[np.argmax([abs(np.corrcoef(m, left.ravel())[0, 1]) for m in modes])]
    assert (own == (x < 16)).mean() > 0.9


def test_readme_lists_departures():
    said = (Path(__file__).parent.parent / "README.md").read_text().split("## Departures")[1]
    assert all(name in said for name in "cvmd2d apmd vtfmtd AVNCMD VGNMD IVGNMD AGNCMD".split())
