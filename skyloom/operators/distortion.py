"""Distortion: which polynomial a field needs, whether to report it, and its SIP form. One group is one field."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skyloom.operators import fit

F_LEAST, CELLS = 4.0, 7


def _cells(x: np.ndarray, y: np.ndarray, width: int, height: int, least: int = 3) -> int:
    cx, cy = np.clip(x / width * 3, 0, 2).astype(int), np.clip(y / height * 3, 0, 2).astype(int)
    return int((np.bincount(cx * 3 + cy, minlength=9) >= least).sum())


def wide_radius(density: float, chance: float = 0.1) -> float:
    """The pairing radius (pixels) at which a tenth of a star is met by chance, within 4 to 24."""
    return float(np.clip(np.sqrt(chance / (np.pi * density)), 4, 24)) if density > 0 else 24.0


def choose_order(x, y, u, v, width: int, height: int) -> tuple[int, tuple]:
    """3, 6 or 10 terms: more only with a significant gain and pairs over most of the frame."""
    cx, cy = x - width / 2, y - height / 2
    best, kept = 3, fit.robust_fit(cx, cy, u, v, 3, 1.0)
    if kept is None:
        return 0, ()
    for n in (6, 10):
        got = fit.robust_fit(cx, cy, u, v, n, 1.0)
        if got is None or got[2].sum() < 2 * n or _cells(x[got[2]], y[got[2]], width, height) < CELLS:
            break
        both = got[2]
        rss = [float(((fit.monomials(cx[both], cy[both], m) @ c[0] - u[both]) ** 2 + (fit.monomials(cx[both], cy[both], m) @ c[1] - v[both]) ** 2).sum()) for m, c in ((best, kept), (n, got))]
        dof = 2 * (both.sum() - n)
        if dof <= 0 or rss[1] > 0 and ((rss[0] - rss[1]) / (2 * (n - best))) / (rss[1] / dof) < F_LEAST:
            break
        best, kept = n, got
    return best, kept


def departure(cu, cv, n: int, width: int, height: int) -> float:
    """How far the model departs from its best linear plate over a 9 by 9 grid (F09), in its own units."""
    gx, gy = (g.ravel() for g in np.meshgrid(np.linspace(-width / 2, width / 2, 9), np.linspace(-height / 2, height / 2, 9)))
    m = fit.monomials(gx, gy, n)
    u, v = m @ cu, m @ cv
    lu, lv = fit.fit_poly(gx, gy, u, 3), fit.fit_poly(gx, gy, v, 3)
    line = fit.monomials(gx, gy, 3)
    return float(np.hypot(line @ lu - u, line @ lv - v).max())


def chosen(pairs: DataFrame, group: str, width: int, height: int) -> DataFrame:
    """X03-X06 for paired stars of each field: terms, pairs used, departure in pixels, and the decision.

    A model is reported when it departs by a pixel or more from a linear plate; the linear plate stays else.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ix", "iy", "cx", "cy"])
        x, y, u, v = (pdf[c].to_numpy(float) for c in ("ix", "iy", "cx", "cy"))
        n, got = choose_order(x, y, u, v, width, height)
        if not n:
            return pd.DataFrame({group: pdf[group].iloc[:1], "terms": [0], "used": [0], "departure_px": [0.0], "model": ["none"]})
        cu, cv, keep = got
        scale = float(np.hypot(cu[1], cv[1])) or 1.0
        off = departure(cu, cv, n, width, height) / scale
        model = "linear" if n == 3 else "distorted" if off >= 1.0 else "nearest linear"
        return pd.DataFrame({group: pdf[group].iloc[:1], "terms": [n], "used": [int(keep.sum())], "departure_px": [round(off, 3)], "model": [model]})

    return pairs.groupBy(group).applyInPandas(one, f"{group} long, terms long, used long, departure_px double, model string")


def sip(pairs: DataFrame, group: str, width: int, height: int) -> DataFrame:
    """F10 for each field: whether a SIP correction is fitted, from how many pairs, and its largest term."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ix", "iy", "cx", "cy"])
        x, y, u, v = (pdf[c].to_numpy(float) for c in ("ix", "iy", "cx", "cy"))
        a = np.stack([x - width / 2, y - height / 2, np.ones(len(x))], 1)
        none = pd.DataFrame({group: pdf[group].iloc[:1], "fitted": [False], "used": [0], "largest": [0.0]})
        if len(x) < 3:
            return none
        cu, cv = (np.linalg.lstsq(a, t, rcond=None)[0] for t in (u, v))
        inverse = np.linalg.inv(np.array([cu[:2], cv[:2]]))
        linear = np.stack([u - cu[2], v - cv[2]], 1) @ inverse.T
        got = fit.sip_of(a[:, 0], a[:, 1], linear[:, 0], linear[:, 1], width, height)
        if got is None:
            return none
        return pd.DataFrame({group: pdf[group].iloc[:1], "fitted": [True], "used": [got["used"]], "largest": [float(np.abs(got["a"][3:]).max())]})

    return pairs.groupBy(group).applyInPandas(one, f"{group} long, fitted boolean, used long, largest double")
