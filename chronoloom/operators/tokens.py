"""Frames of token vectors: tokens that stayed as they were are clustered, those that moved compete by salience.

A row is a token: (gid, frame, token, n, v, salience), with n the tokens of its
frame. A token is static if its cosine with the same token of frame - 1 is above
a limit; a frame whose predecessor is missing or has another n has no static
tokens. A frame keeps ``budget`` groups, shared between static and dynamic tokens
in proportion to their numbers. Centres of static groups are density peaks;
other static tokens go to the nearest centre. Dynamic groups are the most salient
tokens, each by itself.

The comparison is a join on (gid, frame, token), so a series with most frames is
dealt over all tasks. Grouping takes one frame a group: its memory grows with the
square of a frame's tokens, not with the length of a series.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalars import cosine


@dataclass(frozen=True)
class Grouping:
    """Groups a frame keeps, cosine of a static token, neighbours of a density (itself included), weight of a centre beside its members."""

    budget: int = 50
    similarity: float = 0.9
    neighbours: int = 7
    centre_weight: float = 0.6


def shared_budget(n_static: int, n_dynamic: int, budget: int) -> tuple[int, int]:
    """Static and dynamic groups: in proportion, the static share rounded down; what one side cannot use goes to the other."""
    n = n_static + n_dynamic
    total = min(budget, n)
    static = max(total * n_static // max(n, 1), total - n_dynamic)
    return static, total - static


def density_peaks(x: np.ndarray, k: int, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k highest products of density and separation, in order, and the distances.

    The density falls with the mean square of the nearest distances; the separation
    is the distance to the nearest point of less density, the later of equals being
    less dense, and the largest distance of all where there is none.
    """
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0) / x.shape[1])
    near = np.sort(d, axis=1)[:, : min(neighbours, len(x) - 1)]
    density = np.exp(-(near**2).mean(1))
    order = np.lexsort((np.arange(len(x)), -density))  # from the densest on
    place = np.empty(len(x), int)
    place[order] = np.arange(len(x))
    separation = np.where(place[:, None] < place[None, :], d, d.max()).min(1)
    return np.sort(np.lexsort((np.arange(len(x)), -density * separation))[:k]), d


def frame_groups(token: np.ndarray, x: np.ndarray, salience: np.ndarray, static: np.ndarray, how: Grouping) -> list[tuple[int, str, int, float]]:
    """(root, kind, member, weight) of a frame's groups; tokens ascend."""
    still, moved = np.flatnonzero(static), np.flatnonzero(~static)
    n_static, n_dynamic = shared_budget(len(still), len(moved), how.budget)
    out = []
    if n_static:
        if n_static == len(still):
            centres, nearest = np.arange(len(still)), np.arange(len(still))
        else:
            centres, d = density_peaks(x[still], n_static, how.neighbours)
            nearest = centres[d[:, centres].argmin(1)]
            nearest[centres] = centres  # also where two centres are one point
        others = np.bincount(nearest, minlength=len(still)) - 1
        for i, c in enumerate(nearest):
            weight = 1.0 if not others[c] else how.centre_weight if i == c else (1 - how.centre_weight) / others[c]
            out.append((int(token[still[c]]), "static", int(token[still[i]]), float(weight)))
    top = moved[np.lexsort((token[moved], -salience[moved]))[:n_dynamic]]
    return sorted(out + [(int(token[i]), "dynamic", int(token[i]), 1.0) for i in top])


GROUPS = "gid bigint, frame bigint, root bigint, kind string, member bigint, weight double"


def compared(tokens: DataFrame, how: Grouping = Grouping()) -> DataFrame:
    """``tokens`` with ``static``: compared with the frame before by a join."""
    before = tokens.select("gid", (F.col("frame") + 1).alias("frame"), "token", F.col("n").alias("_n"), F.col("v").alias("_v"))
    same = (F.col("n") == F.col("_n")) & (cosine(F.col("v"), F.col("_v")) > how.similarity)
    return tokens.join(before, ["gid", "frame", "token"], "left").withColumn("static", F.coalesce(same, F.lit(False))).drop("_n", "_v")


def grouped(tokens: DataFrame, how: Grouping = Grouping()) -> DataFrame:
    """Groups of each frame of ``compared`` tokens: gid, frame, root, kind, member, weight."""

    def step(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("token")
        rows = frame_groups(own["token"].to_numpy(), np.array(own["v"].tolist(), dtype=float), own["salience"].to_numpy(float), own["static"].to_numpy(bool), how)
        return pd.DataFrame([(own["gid"].iloc[0], own["frame"].iloc[0], *r) for r in rows], columns=["gid", "frame", "root", "kind", "member", "weight"])

    return tokens.select("gid", "frame", "token", "v", "salience", "static").groupBy("gid", "frame").applyInPandas(step, GROUPS)


def aggregated(tokens: DataFrame, groups: DataFrame, dims: int) -> DataFrame:
    """The weighted sum of each group's vectors: gid, frame, root, kind, members, v."""
    own = groups.join(tokens.select("gid", "frame", F.col("token").alias("member"), "v"), ["gid", "frame", "member"])
    return own.groupBy("gid", "frame", "root", "kind").agg(F.count("*").alias("members"), F.array(*[F.sum(F.col("weight") * F.get("v", F.lit(i))) for i in range(dims)]).alias("v"))
