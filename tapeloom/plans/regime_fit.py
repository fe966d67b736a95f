"""Regime model per ticker: a hidden Markov chain with Gaussian states, refit on trailing windows.

Every refit restarts the filter, so blocks of bars are independent: each block goes to
Python with a halo as long as the training window, bounded in size whatever the ticker.
All refits of a block are one batch: arrays carry the refit on their first axis, so one
step over time serves every window.  Shorter windows are filled up in front and masked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regimes import PROBS, fuse, merged_regimes, soft_profile
from ..operators.blocks import BARS, Layout, block_groups

STATES = 3
# Rows a fit needs, the addition to each variance, the seed of the starting rows.
LEAST_ROWS, RIDGE, SEED = 24, 1e-3, 42
TINY = 1e-12
#: Rows of the blocks that go to Python together, and of the windows fitted in one batch.
PACK_ROWS, BATCH_ROWS = 1 << 15, 1 << 17


@dataclass
class Chains:
    """``n`` models: start (n, S), move (n, S, S), mean (n, S, d), cov (n, S, d, d)."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def roles(self) -> np.ndarray:
        """(n, 3): the state that is impulse (highest mean of the first dimension), mean
        reversion, and stress (of the other two the one with the higher mean of the second
        dimension; the lower one where they tie)."""
        rising = np.argsort(self.mean[:, :, 0], axis=1, kind="stable")
        second = self.mean[:, :, 1] if self.mean.shape[2] > 1 else np.zeros(self.mean.shape[:2])
        lower = np.take_along_axis(second, rising[:, :2], axis=1)
        swap = (lower[:, 0] < lower[:, 1]).astype(int)
        stress = np.take_along_axis(rising, swap[:, None], axis=1)
        calm = np.take_along_axis(rising, 1 - swap[:, None], axis=1)
        return np.concatenate([rising[:, 2:], calm, stress], axis=1)


def stacked(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of rows as one array (n, T, d), filled up in front, and where each begins."""
    longest = max(map(len, windows))
    x = np.zeros((len(windows), longest, windows[0].shape[1]))
    first = np.array([longest - len(w) for w in windows])
    for row, w, at in zip(x, windows, first):
        row[at:] = w
    return x, first


def densities(m: Chains, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densities of the rows under each state, each row divided by its largest, (n, T, S),
    and the logarithms of the divisors (n, T).  By Cholesky factors of the covariances."""
    root = np.linalg.cholesky(m.cov)
    half = np.log(np.diagonal(root, axis1=2, axis2=3)).sum(2)
    gap = np.swapaxes(x[:, None] - m.mean[:, :, None], 2, 3)  # n, S, d, T
    white = np.linalg.solve(root, gap)
    log = -0.5 * (white**2).sum(2) - half[:, :, None] - 0.5 * x.shape[2] * np.log(2 * np.pi)
    log = np.swapaxes(log, 1, 2)
    top = log.max(2)
    return np.exp(log - top[:, :, None]), top


def forward(m: Chains, dens: np.ndarray, first: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities (n, T, S) and each row's scale (n, T).  ``before`` are
    the probabilities of a row ahead of the first one; without it the chain starts there."""
    n, long, _ = dens.shape
    seen, scale = np.full((n, long, STATES), 1 / STATES), np.ones((n, long))
    opening = m.start if before is None else np.einsum("ns,nsk->nk", before, m.move)
    now = opening
    for t in range(long):
        guess = now if t == 0 else np.einsum("ns,nsk->nk", now, m.move)
        guess = np.where((first >= t)[:, None], opening, guess)
        joint = guess * dens[:, t] + TINY * TINY
        total = joint.sum(1)
        live = first <= t
        now = np.where(live[:, None], joint / total[:, None], opening)
        seen[:, t], scale[:, t] = now, np.where(live, total, 1.0)
    return seen, scale


def backward(m: Chains, dens: np.ndarray, scale: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scaled backward variables (n, T, S); ones in the rows that fill a window up, where
    the product would run to nothing or beyond bounds."""
    out = np.ones_like(dens)
    for t in range(dens.shape[1] - 2, -1, -1):
        step = np.einsum("nsk,nk->ns", m.move, dens[:, t + 1] * out[:, t + 1]) / scale[:, t + 1, None]
        out[:, t] = np.where((first <= t)[:, None], step, 1.0)
    return out


def flat(n: int, d: int) -> Chains:
    eye = np.broadcast_to(np.eye(d), (n, STATES, d, d)).copy()
    return Chains(np.full((n, STATES), 1 / STATES), np.full((n, STATES, STATES), 1 / STATES), np.zeros((n, STATES, d)), eye)


def fit(windows: list[np.ndarray], rounds: int = 10) -> Chains:
    """One model per window by expectation maximisation from three drawn rows; windows
    under LEAST_ROWS keep the flat model."""
    d = windows[0].shape[1]
    m = flat(len(windows), d)
    use = [i for i, w in enumerate(windows) if len(w) >= LEAST_ROWS]
    if not use:
        return m
    chosen = [windows[i] for i in use]
    x, first = stacked(chosen)
    g = flat(len(use), d)
    for i, w in enumerate(chosen):
        g.mean[i] = w[np.random.default_rng(SEED).choice(len(w), size=STATES, replace=False)]
        g.cov[i] = np.atleast_2d(np.cov(w.T)) + np.eye(d) * RIDGE
    live = (np.arange(x.shape[1]) >= first[:, None]).astype(float)
    opened = np.arange(len(use)), first
    follows = live[:, 1:] * (np.arange(1, x.shape[1]) > first[:, None])
    for _ in range(rounds):
        dens, _ = densities(g, x)
        ahead, scale = forward(g, dens, first)
        behind = backward(g, dens, scale, first)
        share = ahead * behind
        share = share / share.sum(2, keepdims=True) * live[:, :, None]
        into = dens[:, 1:] * behind[:, 1:] / scale[:, 1:, None] * follows[:, :, None]
        moved = g.move * np.einsum("nts,ntk->nsk", ahead[:, :-1], into) + TINY
        g.start, g.move = share[opened], moved / moved.sum(2, keepdims=True)
        weight = share.sum(1)
        solid = weight > 1e-8  # a state without rows stays where it is
        safe = np.where(solid, weight, 1.0)
        mean = np.einsum("nts,ntd->nsd", share, x) / safe[:, :, None]
        g.mean = np.where(solid[:, :, None], mean, g.mean)
        gap = x[:, :, None] - g.mean[:, None]
        cov = np.einsum("nts,ntsd,ntse->nsde", share, gap, gap) / safe[:, :, None, None] + np.eye(d) * RIDGE
        g.cov = np.where(solid[:, :, None, None], cov, g.cov)
    for part in ("start", "move", "mean", "cov"):
        getattr(m, part)[use] = getattr(g, part)
    return m


def filtered(m: Chains, windows: list[np.ndarray], before: np.ndarray | None = None) -> list[np.ndarray]:
    """Filtered state probabilities of each window's rows under its own model."""
    x, first = stacked(windows)
    seen, _ = forward(m, densities(m, x)[0], first, before)
    return [s[at:] for s, at in zip(seen, first)]


def log_likelihood(m: Chains, windows: list[np.ndarray]) -> np.ndarray:
    x, first = stacked(windows)
    dens, top = densities(m, x)
    _, scale = forward(m, dens, first)
    live = np.arange(x.shape[1]) >= first[:, None]
    return ((np.log(scale) + top) * live).sum(1)


def free_parameters(d: int) -> int:
    """Start and moves sum to one; each state has a mean and a symmetric covariance."""
    return STATES**2 - 1 + STATES * d * (d + 3) // 2


REGIME_COLS = [*PROBS, "hmm_confidence", "hmm_state"]


def regime_table(obs: DataFrame, dims: tuple[str, ...] = ("trend_z", "vol_z", "ret_z"), *, train: int = 2016, every: int = 72, least: int = 48, rounds: int = 10, lay: Layout = BARS) -> DataFrame:
    """Causal regime probabilities per bar: refit every ``every`` bars on the ``train``
    bars before, filter in between.  ``obs`` has no null in ``dims``.

    A row's position fixes its refit, so a block with a halo of train + every rows gives
    the same numbers as the whole series would.  Blocks go to Python many at a time: windows
    of equal length, whatever their block, are steps of one batch.
    """
    keep = [c for c in obs.columns]
    groups, by = block_groups(obs, back=train + every, lay=lay)
    schema = ", ".join(f"`{c}` {t}" for c, t in obs.dtypes) + ", p_imp double, p_mr double, p_st double, hmm_confidence double, hmm_state int"

    def windows_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple]] | None:
        """Sorted rows of a block and its refits: (past rows, past and own rows, offsets)."""
        pdf = pdf.sort_values("_pos")
        base, end = int(pdf["_pos"].iloc[0]), int(pdf["_pos"].iloc[-1]) + 1
        x, own = pdf[list(dims)].to_numpy(dtype=float), ~pdf["_halo"].to_numpy()
        if not own.any():
            return None
        begin = int(pdf["_pos"].to_numpy()[own][0])
        # refits at ``least`` and at every multiple of ``every`` after it
        starts = [at for at in sorted({least, *range(0, end, every)}) if least <= at < end]
        spans = [(at, min((at // every + 1) * every, end)) for at in starts]
        spans = [(at, to) for at, to in spans if to > begin and max(0, at - train) >= base]
        if not spans:
            return None
        return pdf, [(x[max(0, at - train) - base : at - base], x[max(0, at - train) - base : to - base], at - base, to - base) for at, to in spans]

    def frame(held: list) -> pd.DataFrame:
        """The rows of the held blocks under models fitted together."""
        refits = [w for _, each in held for w in each]
        out = [None] * len(refits)
        # one batch holds windows of one length, so none is filled up for another's sake
        batches: dict[int, list[int]] = {}
        for i, w in enumerate(refits):
            batches.setdefault(len(w[0]), []).append(i)
        for length, members in batches.items():
            size = max(1, BATCH_ROWS // length)
            for at in range(0, len(members), size):
                part = members[at : at + size]
                m = fit([refits[i][0] for i in part], rounds)
                for i, p, r in zip(part, filtered(m, [refits[i][1] for i in part]), m.roles()):
                    new = p[length:]
                    out[i] = new[:, r], new.argmax(1)
        frames, done = [], 0
        for pdf, each in held:
            mine = out[done : done + len(each)]
            done += len(each)
            idx = np.concatenate([np.arange(at, to) for *_, at, to in each])
            named = np.concatenate([n for n, _ in mine])
            res = pdf.iloc[idx][[*keep, "_halo"]].assign(**dict(zip(PROBS, named.T)), hmm_confidence=named.max(1), hmm_state=np.concatenate([s for _, s in mine]).astype("int32"))
            frames.append(res)
        res = pd.concat(frames, ignore_index=True)
        return res[~res["_halo"].astype(bool)].drop(columns="_halo")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [w for _, g in pdf.groupby(by, sort=False, dropna=False) if (w := windows_of(g)) is not None]
        return frame(held) if held else pd.DataFrame(columns=keep + REGIME_COLS)

    packs = max(1, -(-obs.count() // PACK_ROWS))
    groups = groups.withColumn("_pack", F.pmod(F.xxhash64(*by), F.lit(packs)))
    return groups.groupBy("_pack").applyInPandas(run, schema)


def blended_frame(tables: DataFrame, weights: DataFrame) -> DataFrame:
    """Per-ticker tables to one fused row per time with its soft profile."""
    return soft_profile(fuse(merged_regimes(tables, weights)))


def fitted_models(obs: DataFrame, dims: tuple[str, ...] = ("trend_z", "vol_z", "ret_z"), *, train: int = 2016, rounds: int = 20, lay: Layout = BARS) -> DataFrame:
    """One model per ticker on its last ``train`` rows, with likelihood, AIC and BIC."""
    from ..operators.aggregates import tail_rows

    last = tail_rows(obs.select(*lay.keys, *lay.order, *dims), train, lay)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(lay.order))[list(dims)].to_numpy(dtype=float)
        m = fit([x], rounds)
        ll, k, to = float(log_likelihood(m, [x])[0]), free_parameters(x.shape[1]), m.roles()[0]
        row = {c: pdf[c].iloc[0] for c in lay.keys}
        row |= {"n": len(x), "log_likelihood": ll, "aic": 2 * (k - ll), "bic": k * np.log(len(x)) - 2 * ll}
        row |= {"pi": m.start[0][to].tolist(), "means": m.mean[0][to].ravel().tolist(), "covs": m.cov[0][to].ravel().tolist(), "transition": m.move[0][np.ix_(to, to)].ravel().tolist()}
        return pd.DataFrame([row])

    keys = ", ".join(f"`{c}` {t}" for c, t in obs.select(*lay.keys).dtypes)
    return last.groupBy(*lay.keys).applyInPandas(run, f"{keys}, n long, log_likelihood double, aic double, bic double, pi array<double>, means array<double>, covs array<double>, transition array<double>")
