"""Search for peptides under a precursor's mass: greedy, beam and knapsack beam.

A scorer gives log-probabilities of the next residue, last residue first. The
search itself is the same for every scorer: residues that overshoot the mass are
barred, terminal modifications may only complete it, and a prefix whose mass is
reached ends. Spectra are independent, so a search is one pass over their rows; the
beams of all spectra of a block grow side by side, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from peakloom.constants import CARBON_MASS_DELTA, H2O_MASS, PROTON_MASS, RESIDUE_MASSES
from peakloom.operators.knapsack import Knapsack

NEVER = -np.inf
#: Spectra whose beams grow side by side.
BLOCK = 512


class Scorer(Protocol):
    """Log-probabilities of residues (the last is the end) after prefixes of residue indices, last residue first.

    start is given the peaks and precursor masses of several spectra; score, for each of some prefixes of one length
    (rows of an array), the number of its spectrum among them, and returns a row of log-probabilities for each.
    """

    def start(self, peaks: list[tuple[np.ndarray, np.ndarray]], precursor_masses: np.ndarray) -> object: ...

    def score(self, state: object, spectrum: np.ndarray, prefixes: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class FragmentEvidence:
    """A plain scorer: intensity near the two fragments that a residue would make, through a softmax.

    It needs no training and makes no claim to a trained model's accuracy.
    """

    masses: tuple[float, ...]
    tolerance: float = 0.02
    sharpness: float = 8.0

    def start(self, peaks: list[tuple[np.ndarray, np.ndarray]], precursor_masses: np.ndarray) -> tuple:
        # Peaks of all spectra in one ascending array: each spectrum's m/z in a range of its own.
        mz = [np.sort(m) for m, _ in peaks]
        span = 2.0 * max([1.0, *precursor_masses.tolist(), *(float(m[-1]) for m in mz if len(m))]) + 1000.0
        keys = np.concatenate([m + span * k for k, m in enumerate(mz)]) if mz else np.zeros(0)
        heights = [i[np.argsort(m, kind="stable")] for m, i in peaks]
        sums = np.concatenate(([0.0], np.cumsum(np.concatenate(heights) if heights else np.zeros(0))))
        top = np.array([float(i.max()) if len(i) else 1.0 for _, i in peaks])
        return keys, sums, span, np.asarray(precursor_masses, float), top

    def score(self, state: tuple, spectrum: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        keys, sums, span, whole, top = state
        masses = np.array(self.masses)
        done = np.zeros(len(spectrum))
        for k in range(prefixes.shape[1]):
            done = done + masses[prefixes[:, k]]
        suffix = done[:, None] + masses
        found = np.zeros(suffix.shape)
        for ion in (suffix + H2O_MASS + PROTON_MASS, whole[spectrum, None] - H2O_MASS - suffix + PROTON_MASS):
            at = span * spectrum[:, None] + np.clip(ion, -0.25 * span, 0.9 * span)
            found += sums[np.searchsorted(keys, at + self.tolerance, "right")] - sums[np.searchsorted(keys, at - self.tolerance, "left")]
        logits = np.append(self.sharpness * np.minimum(found / top[spectrum, None], 2.0), np.zeros((len(spectrum), 1)), axis=1)
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Beam:
    tokens: tuple[int, ...] = ()
    remaining: float = 0.0
    log_prob: float = 0.0
    steps: tuple[float, ...] = ()
    met: bool = False


@dataclass
class Search:
    """Bounds of a search. beams 1 is greedy; a knapsack bars residues after which no residues fit."""

    table: Mapping[str, float] = field(default_factory=lambda: RESIDUE_MASSES)
    beams: int = 1
    max_length: int = 40
    tolerance: float = 5e-5
    max_isotope: int = 1
    min_log_prob: float = NEVER
    suppressed: tuple[str, ...] = ()
    terminal_anywhere: bool = False
    keep_unfinished: bool = False
    knapsack: Knapsack | None = None

    def __post_init__(self):
        self.names = tuple(self.table)
        self.masses = np.array([self.table[n] for n in self.names])
        self.terminal = np.array([not n[0].isalpha() for n in self.names])
        self.barred = np.array([n in self.suppressed for n in self.names])
        self.isotopes = CARBON_MASS_DELTA * np.arange(self.max_isotope + 1)
        self.offsets = np.array([0.0, *self.masses[self.masses < 0]])

    def meets(self, remaining: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Whether each remaining mass is some isotopes."""
        return (np.abs(remaining[..., None] - self.isotopes) < allowed[..., None]).any(axis=-1)

    def open_residues(self, remaining: np.ndarray | float, allowed: np.ndarray | float) -> np.ndarray:
        """Which residues may come next, after each remaining mass."""
        allowed = np.asarray(allowed, float)[..., None]
        left = np.asarray(remaining, float)[..., None] - self.masses
        marks = (self.isotopes[:, None] + self.offsets[None, :]).ravel()
        ok = (left > -allowed) | (np.abs(left[..., None] - marks) < allowed[..., None]).any(axis=-1)
        ok &= ~self.barred
        done = self.meets(left, np.broadcast_to(allowed, left.shape))
        if not self.terminal_anywhere:
            ok &= ~self.terminal | done
        if self.knapsack is not None:
            ok &= done | self._fits(left, allowed)
        return ok

    def _fits(self, mass: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Whether some residues add up to each mass, within what is allowed."""
        low, high = (np.rint(self.knapsack.scale * (mass + d)).astype(np.int64) for d in (-allowed, allowed))
        at = np.maximum(0, low + 1)
        return self.knapsack.below(np.maximum(at, high)) > self.knapsack.below(at)

    def run(self, scorer: Scorer, mz: np.ndarray, intensity: np.ndarray, precursor_mass: float) -> list[Beam]:
        """Finished beams of one spectrum, best first: those that meet the precursor, then the likelier; of those that spell one peptide the best."""
        return self.run_all(scorer, [(mz, intensity)], np.array([precursor_mass]))[0]

    def run_all(self, scorer: Scorer, peaks: list[tuple[np.ndarray, np.ndarray]], masses: np.ndarray) -> list[list[Beam]]:
        """run() of several spectra."""
        state, n = scorer.start(peaks, masses), len(peaks)
        allowed = self.tolerance * masses
        of, tokens, steps = np.arange(n), np.zeros((n, 0), np.int64), np.zeros((n, 0))
        remaining, log_prob = masses - H2O_MASS, np.zeros(n)
        done: list[tuple[np.ndarray, ...]] = []

        def put(which: np.ndarray, met: bool, last: np.ndarray | None = None) -> None:
            if len(which):
                ends = steps[which] if last is None else np.append(steps[which], last[:, None], axis=1)
                gained = log_prob[which] if last is None else log_prob[which] + last
                done.append((of[which], np.full(len(which), met), gained, remaining[which], [*tokens[which]], [*ends]))

        for _ in range(self.max_length + 1):
            if not len(of):
                break
            scores = scorer.score(state, of, tokens)
            ends = self.meets(remaining, allowed[of]) & (tokens.shape[1] > 0)
            put(np.flatnonzero(ends), True, scores[ends, -1])
            capped = ~ends & ((tokens.shape[1] >= self.max_length) | (log_prob < self.min_log_prob))
            put(np.flatnonzero(capped), False)
            grow = np.flatnonzero(~ends & ~capped)
            ok = self.open_residues(remaining[grow], allowed[of[grow]])
            if self.keep_unfinished:
                put(grow[~ok.any(axis=1)], False)
            offered = np.where(ok, scores[grow, :-1], NEVER)
            best = np.argsort(-offered, axis=1, kind="stable")[:, : self.beams]
            chosen = np.take_along_axis(ok, best, axis=1)
            parent, residue = np.repeat(grow, best.shape[1])[chosen.ravel()], best[chosen]
            gained = log_prob[parent] + scores[parent, residue]
            order = np.lexsort((np.arange(len(parent)), -gained, of[parent]))
            owner = of[parent[order]]
            place = np.arange(len(order)) - np.searchsorted(owner, owner)
            order = order[place < self.beams]
            parent, residue, log_prob = parent[order], residue[order], gained[order]
            tokens = np.append(tokens[parent], residue[:, None], axis=1)
            steps = np.append(steps[parent], scores[parent, residue][:, None], axis=1)
            remaining, of = remaining[parent] - self.masses[residue], of[parent]
        out: list[list[Beam]] = [[] for _ in range(n)]
        if done:
            owner, met, gained, left = (np.concatenate([d[k] for d in done]) for k in range(4))
            prefixes, ends = ([x for d in done for x in d[k]] for k in (4, 5))
            seen: set[tuple[int, str]] = set()  # residues in different pieces may spell one peptide
            for k in np.lexsort((np.arange(len(owner)), -gained, ~met, owner)).tolist():
                beams, spelt = out[owner[k]], "".join(self.names[i] for i in reversed(prefixes[k].tolist()))
                if len(beams) < self.beams and (owner[k], spelt) not in seen:
                    seen.add((owner[k], spelt))
                    beams.append(Beam(tuple(prefixes[k].tolist()), float(left[k]), float(gained[k]), tuple(ends[k].tolist()), bool(met[k])))
        return out


SCHEMA = "rank int, predictions array<string>, log_prob double, token_log_probs array<double>, meets_precursor boolean, mass_error double"


def _peaks(frame: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Peaks and precursor masses of a frame of spectra."""
    peaks = [(np.asarray(m, float), np.asarray(i, float)) for m, i in zip(frame["mz_array"], frame["intensity_array"], strict=True)]
    return peaks, ((frame["precursor_mz"] - PROTON_MASS) * frame["precursor_charge"]).to_numpy(float)


def decode(spectra: DataFrame, search: Search, scorer: Scorer, id_col: str = "id", best_only: bool = True) -> DataFrame:
    """id and the beams found, best first (rank from 0); a spectrum without any has an empty prediction of log_prob -inf.

    spectra has mz_array, intensity_array, precursor_mz and precursor_charge. Predictions stand first residue first.
    """
    names = search.names
    # The search holds the knapsack's bits: sent once to each executor, not with each task.
    given = spectra.sparkSession.sparkContext.broadcast((search, scorer))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, scorer = given.value
        for frame in frames:
            for lo in range(0, len(frame), BLOCK):
                some = frame.iloc[lo : lo + BLOCK]
                peaks, masses = _peaks(some)
                out = []
                for key, mass, beams in zip(some[id_col].tolist(), masses.tolist(), search.run_all(scorer, peaks, masses), strict=True):
                    for k, b in enumerate(beams[:1] if best_only else beams):
                        out.append((key, k, [names[i] for i in reversed(b.tokens)], b.log_prob, list(b.steps[: len(b.tokens)])[::-1], b.met, b.remaining))
                    if not beams:
                        out.append((key, 0, [], NEVER, [], False, mass - H2O_MASS))
                yield pd.DataFrame(out, columns=[id_col, "rank", "predictions", "log_prob", "token_log_probs", "meets_precursor", "mass_error"])

    id_type = spectra.schema[id_col].dataType.simpleString()
    wanted = spectra.select(id_col, "mz_array", "intensity_array", "precursor_mz", "precursor_charge")
    return wanted.mapInPandas(rows, f"`{id_col}` {id_type}, {SCHEMA}")


def score_sequences(spectra: DataFrame, peptide: str, scorer: Scorer, table: Mapping[str, float] = RESIDUE_MASSES, id_col: str = "id") -> DataFrame:
    """id and log_prob of a given list of residues under the scorer, the end included; null for unknown residues."""
    index = {n: i for i, n in enumerate(table)}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), BLOCK):
                some = frame.iloc[lo : lo + BLOCK]
                state = scorer.start(*_peaks(some))
                tokens = [[index.get(t) for t in reversed(list(x))] if x is not None else [None] for x in some[peptide]]
                total = np.array([np.nan if None in t else 0.0 for t in tokens])
                for k in range(max(map(len, tokens), default=0) + 1):
                    on = np.array([i for i, t in enumerate(tokens) if len(t) >= k and None not in t], np.int64)
                    if len(on):
                        scores = scorer.score(state, on, np.array([tokens[i][:k] for i in on], np.int64).reshape(len(on), k))
                        total[on] += scores[np.arange(len(on)), [tokens[i][k] if len(tokens[i]) > k else -1 for i in on]]
                yield pd.DataFrame({id_col: some[id_col], "log_prob": [None if np.isnan(x) else x for x in total]})

    id_type = spectra.schema[id_col].dataType.simpleString()
    wanted = spectra.select(id_col, "mz_array", "intensity_array", "precursor_mz", "precursor_charge", peptide)
    return wanted.mapInPandas(rows, f"`{id_col}` {id_type}, log_prob double")


def choose(beams: int = 1, knapsack: Knapsack | None = None, **options) -> Search:
    """Knapsack beam search if there is a knapsack, else beam search for several beams, else greedy search."""
    return Search(beams=max(1, beams), knapsack=knapsack, **options)
