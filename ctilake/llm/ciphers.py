"""Unknown code-page swaps as substitution ciphers, learned by expectation-maximisation against letter bigrams.

A source whose text no known page explains is read as a cipher: every symbol outside ASCII stands for
some letter, ASCII letters stand for themselves. The counts of neighbouring symbols are all that the
learning needs, so a source of any size comes down to one small table before a task sees it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

ROUNDS, RESTARTS, SWEEPS = 80, 6, 12
LEAST_PAIRS = 400  # neighbouring symbols of a source before anything is learned from them
LEAST_GAIN = 1.5  # log likelihood a pair that a learned table must win over the text as it stands
HOPELESS = -4.0  # the same after a first attempt: less is no text of a known language under any table
LEVEL = -3.0  # log probability of a letter after the one before that deciphered text must reach on average, as clean text does
EDGE = "\n"


class Language:
    """Joint probabilities of letter pairs, smoothed, over ASCII letters, the word's edge and the letters beyond."""

    def __init__(self, pairs: dict[str, float]):
        seen: dict[str, float] = {}
        for p, n in pairs.items():
            for c in p:
                seen[c] = seen.get(c, 0.0) + n
        total = sum(seen.values()) or 1.0
        self.plain = [EDGE, *"abcdefghijklmnopqrstuvwxyz"]
        # letters of alphabets, not of Han: what a single byte can stand for
        self.letters = sorted(c for c, n in seen.items() if not c.isascii() and c.isalpha() and ord(c) < 0x600 and n * 1e5 > total)
        self.states = self.plain + self.letters
        at = {c: i for i, c in enumerate(self.states)}
        q = np.zeros((len(at), len(at)))
        for p, n in pairs.items():
            if p[0] in at and p[1] in at:
                q[at[p[0]], at[p[1]]] += n
        one = q.sum(0) + q.sum(1) + 1e-9
        self.joint = (q + 0.02 * q.sum() * np.outer(one, one) / one.sum() ** 2) / (1.02 * max(q.sum(), 1e-9))
        self.share = self.joint.sum(1)
        self.log = np.log(self.joint + 1e-12)


def learn_table(language: Language, counts: dict[tuple[str, str], float]) -> tuple[dict[str, str], float, float]:
    """(letter of every symbol, gain a pair, log probability of a deciphered letter) from counts of neighbouring symbols; ASCII letters and EDGE are as they are."""
    fixed = len(language.plain)
    symbols = sorted({c for p in counts for c in p if c not in language.plain})
    if not symbols or not language.letters:
        return {}, 0.0, -np.inf
    every = language.plain + symbols
    at = {c: i for i, c in enumerate(every)}
    n = np.zeros((len(every), len(every)))
    for (a, b), k in counts.items():
        n[at[a], at[b]] += k
    seen = n.sum(0) + n.sum(1)
    best, most = None, -np.inf
    for seed in range(RESTARTS):
        theta = _start(language, seen[fixed:], np.random.default_rng(seed), fixed)
        for _ in range(ROUNDS):
            r = n / np.maximum(theta.T @ language.joint @ theta, 1e-12)
            expected = theta * (language.joint @ theta @ r.T + language.joint.T @ theta @ r)
            theta[fixed:, fixed:] = expected[fixed:, fixed:] + 1e-6
            theta[fixed:] /= theta[fixed:].sum(1, keepdims=True)
        to = _settle(language, n, np.argmax(theta * language.share[:, None], axis=0), fixed, 1, False)
        score = (n * language.log[np.ix_(to, to)]).sum()
        if score > most:
            best, most = to, score
    if _level(language, n, best) < HOPELESS:
        return {}, 0.0, -np.inf
    best = _settle(language, n, best, fixed, 1)
    best = _settle(language, n, best, fixed, 2)  # now a letter may have a small and a capital form
    most = (n * language.log[np.ix_(best, best)]).sum()
    # as it stands, a symbol is a letter of its own where the language knows it, else it is nothing the language has
    known = {c: i for i, c in enumerate(language.states)}
    as_is = np.array([known.get(c.lower(), -1) for c in every])
    log = np.where((as_is[:, None] >= 0) & (as_is[None, :] >= 0), language.log[np.ix_(as_is, as_is)], language.log.min())
    gain = (most - (n * log).sum()) / max(n.sum(), 1.0)
    return _cased(language, every, best, seen, fixed), float(gain), _level(language, n, best)


def _level(language: Language, n: np.ndarray, to: np.ndarray) -> float:
    """Mean log probability of a letter after the one before it."""
    return float((n * (language.log[np.ix_(to, to)] - np.log(language.share[to] + 1e-12)[:, None])).sum() / max(n.sum(), 1.0))


def _start(language: Language, seen: np.ndarray, rnd: np.random.Generator, fixed: int) -> np.ndarray:
    """Emission probabilities to begin with: symbols about as frequent as a letter are likely to stand for it."""
    theta = np.zeros((len(language.states), fixed + len(seen)))
    theta[:fixed, :fixed] = np.eye(fixed)
    a, b = np.log(language.share[fixed:] + 1e-9), np.log(seen / seen.sum() + 1e-9)
    near = np.exp(-0.5 * (a[:, None] - a.max() - b[None, :] + b.max()) ** 2) * rnd.uniform(0.5, 1.5, (len(a), len(b))) + 1e-3
    theta[fixed:, fixed:] = near / near.sum(1, keepdims=True)
    return theta


def _settle(language: Language, n: np.ndarray, to: np.ndarray, fixed: int, alike: int, swaps: bool = True) -> np.ndarray:
    """Change one symbol's letter, or exchange those of two, as long as the likelihood grows; at most ``alike`` symbols share a letter while there are letters left."""
    to, log = to.copy(), language.log
    used = np.bincount(to[fixed:], minlength=len(language.states))
    order = np.argsort(-(n.sum(0) + n.sum(1))[fixed:]) + fixed
    for c in order[::-1]:  # letters with too many symbols keep the frequent ones
        if used[to[c]] > alike:
            used[to[c]] -= 1
            free = np.flatnonzero(used[fixed:] < alike) + fixed
            if len(free):
                to[c] = free[np.argmax(_scores(log, n, to, c)[free])]
            used[to[c]] += 1
    size = n.sum(0)
    for _ in range(SWEEPS):
        changed = False
        for c in order:
            s = _scores(log, n, to, c)
            if alike > 1:  # symbols that share a letter share its probability
                held = np.bincount(to[fixed:], weights=size[fixed:], minlength=len(language.states))
                held[to[c]] -= size[c]
                both = held + size[c]
                s = s - (both * np.log(np.maximum(both, 1e-9)) - held * np.log(np.maximum(held, 1e-9)))
            open_ = np.flatnonzero(used[fixed:] < alike) + fixed
            if len(open_) and s[open_].max() > s[to[c]] + 1e-9:
                used[to[c]] -= 1
                to[c] = open_[np.argmax(s[open_])]
                used[to[c]] += 1
                changed = True
            for d in order if alike == 1 and swaps else ():
                if d > c and to[d] != to[c]:
                    other = to.copy()
                    other[c], other[d] = to[d], to[c]
                    rows = np.array([c, d])
                    gain = lambda t: (n[rows] * log[np.ix_(t[rows], t)]).sum() + (n[:, rows] * log[np.ix_(t, t[rows])]).sum() - (n[np.ix_(rows, rows)] * log[np.ix_(t[rows], t[rows])]).sum()
                    if gain(other) > gain(to) + 1e-9:
                        to, changed = other, True
        if not changed:
            break
    return to


def _scores(log: np.ndarray, n: np.ndarray, to: np.ndarray, c: int) -> np.ndarray:
    """Log likelihood of the pairs with symbol ``c`` for every letter that it might stand for."""
    row, column = n[c].copy(), n[:, c].copy()
    twice = row[c]
    row[c] = column[c] = 0
    return log[:, to] @ row + column @ log[to] + twice * np.diag(log)


def _cased(language: Language, every: list[str], to: np.ndarray, seen: np.ndarray, fixed: int) -> dict[str, str]:
    """The table with the rarer of two symbols of one letter as its capital."""
    out: dict[str, str] = {}
    first: dict[int, int] = {}
    for c in np.argsort(-seen[fixed:]) + fixed:
        letter = language.states[to[c]]
        out[every[c]] = letter.upper() if to[c] in first and len(letter.upper()) == 1 else letter
        first.setdefault(int(to[c]), int(c))
    return out


def tables_of(pairs: dict[str, float]):
    """For applyInPandas over (source, a, b, n): the table that a source's unexplained text follows, where it follows one."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"source": pd.Series(dtype=str), "symbol": pd.Series(dtype=str), "letter": pd.Series(dtype=str)})
        if group["n"].sum() < LEAST_PAIRS:
            return out
        table, gain, level = learn_table(Language(pairs), dict(zip(zip(group["a"], group["b"]), group["n"])))
        if gain < LEAST_GAIN or level < LEVEL:
            return out
        return pd.DataFrame({"source": group["source"].iloc[0], "symbol": list(table), "letter": list(table.values())})

    return run
