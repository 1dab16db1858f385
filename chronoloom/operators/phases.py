"""Chains of phases with explicit lengths, for the scans of blocks.

A phase is a line of ``k`` sub-states that are passed one after the other, so its length is a sum of k geometric
ones. A reading of one cell is at the level of its phase; one of two cells at the higher level of its own phase and
the phase of the cell before, for which the state keeps that phase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from chronoloom.operators.scans import Chains, constant


@dataclass(frozen=True)
class Kind:
    """Phases of a chain: which are positive, the level of each for every column of readings, and the chances of the next phase."""

    positive: tuple[int, ...]
    levels: tuple[tuple[int, ...], ...]
    onward: tuple[tuple[float, ...], ...]


_THIRD = 1 / 3
#: The kinds of chains.
KINDS = {
    "two": Kind((0, 1), ((0, 1),), ((0, 1), (1, 0))),
    "three_nested": Kind((0, 0, 1), ((0, 1, 2),), ((0, 1, 0), (0.5, 0, 0.5), (0, 1, 0))),
    "three_free": Kind((0, 0, 1), ((0, 1, 2),), ((0, 0.5, 0.5), (0.5, 0, 0.5), (0.5, 0.5, 0))),
    "joint": Kind((0, 1, 1, 1), ((0, 0, 1, 1), (0, 1, 0, 1)), ((0, _THIRD, _THIRD, _THIRD), (_THIRD, 0, _THIRD, _THIRD), (_THIRD, _THIRD, 0, _THIRD), (_THIRD, _THIRD, _THIRD, 0))),
}


@dataclass(frozen=True)
class PhaseChain:
    """``transition`` and ``start`` over states (phase before, phase, sub-state) in this order, the last running fastest, with the ``before`` and ``phase`` of each; ``before`` is None if the chain doesn't keep it."""

    kind: Kind
    transition: np.ndarray
    start: np.ndarray
    phase: np.ndarray
    before: np.ndarray | None

    @property
    def positive(self) -> np.ndarray:
        return np.array(self.kind.positive)[self.phase] == 1

    def levels(self, column: int, pairs: bool) -> np.ndarray:
        """Level of each state for readings of one or of two cells."""
        own = np.array(self.kind.levels[column])
        return np.maximum(own[self.phase], own[self.before]) if pairs else own[self.phase]


def phase_chain(kind: Kind, k: int, cell: float, length: tuple[float, float], start: np.ndarray | float, keep_before: bool = True, independent: bool = False) -> PhaseChain:
    """The chain of a kind. ``length``: mean lengths of phases that are not and that are positive, in the unit of ``cell``; ``start``: chances of the phases, or of the positive one of two.

    A phase of mean length d leaves each of its k sub-states with chance k * cell / d, within 1e-9 and 1. ``independent``
    takes one sub-state and draws every cell's phase anew from ``start``.
    """
    phases = len(kind.positive)
    first = np.array([1 - start, start]) if np.ndim(start) == 0 else np.asarray(start, dtype=float)
    if independent:
        k, steps = 1, np.tile(first, (phases, 1)).reshape(phases, 1, phases, 1)
    else:
        leave = np.clip(k * cell / np.array([length[1] if p else length[0] for p in kind.positive]), 1e-9, 1.0)
        steps = np.zeros((phases, k, phases, k))
        steps[np.arange(phases), :, np.arange(phases), :] = (1 - leave)[:, None, None] * np.eye(k) + leave[:, None, None] * np.eye(k, k=1)
        steps[:, k - 1, :, 0] += leave[:, None] * np.array(kind.onward, dtype=float)
    phase, begin = np.repeat(np.arange(phases), k), np.repeat(first / k, k)
    flat = steps.reshape(phases * k, phases * k)
    if not keep_before:
        return PhaseChain(kind, flat, begin, phase, None)
    wide = np.zeros((phases, phases * k, phases, phases * k))
    wide[:, np.arange(phases * k), phase] = flat
    return PhaseChain(kind, wide.reshape(phases * phases * k, -1), np.r_[begin, np.zeros((phases - 1) * phases * k)], np.tile(phase, phases), np.repeat(np.arange(phases), phases * k))


def readings(chain: PhaseChain, means: list[list[float]], sd: float) -> Chains:
    """The chain over values of one column a kind's list of levels, and, if it keeps the phase before, a last column that is 1 where the reading is of two cells. A missing value says nothing."""
    columns = range(len(means))
    levels = {pairs: [np.asarray(means[c], dtype=float)[chain.levels(c, pairs)] for c in columns] for pairs in ((False, True) if chain.before is not None else (False,))}

    def emission(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(chain.start)))
        for c in columns:
            mean = levels[False][c][None]
            if chain.before is not None:
                mean = np.where(x[:, len(means)][:, None] == 1, levels[True][c][None], mean)
            out += np.nan_to_num(-0.5 * ((x[:, c][:, None] - mean) / sd) ** 2, nan=0.0)
        return out

    return constant(emission, chain.transition, chain.start)
