"""Phrases that many items share, items that repeat themselves, and hashes that meet."""

import time

import numpy as np
import pytest

from chronoloom.llm import decontaminate


def plain(text, items):
    """Hit words and items, window by window."""
    w, hit, those = text.split(), set(), set()
    for i, t in items:
        own = t.split()
        for k in range(max(1, len(own) - 12)) if own else ():
            window = own[k : k + 13]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    those.add(i)
    return sorted(hit), those


def scanned(machine, text):
    n, hits, those = decontaminate.scan(machine, text)
    return [h["word"] for h in hits], {int(k) for k in those}


@pytest.mark.parametrize("mixed", [True, False])
def test_folded_places_find_what_all_places_find(monkeypatch, mixed):
    if not mixed:  # all surroundings get one hash, and are told apart by their words
        monkeypatch.setattr(decontaminate, "_MIX", np.zeros(decontaminate.WINDOW + decontaminate.SIDE, np.uint64))
    rng = np.random.default_rng(7)
    boilerplate = " ".join(f"b{k}" for k in range(20))
    few = lambda n: " ".join("xyz"[k] for k in rng.integers(0, 3, n))
    items = [(k, f"{few(rng.integers(0, 12))} {boilerplate} {few(rng.integers(0, 12))}") for k in range(25)]
    items += [(25, "same " * 60), (26, "same " * 13), (27, "same " * 5), (28, "x y z x y z x"), (29, few(40)), (30, f"{boilerplate} {boilerplate}")]
    machine = decontaminate.Machine([(str(i), t) for i, t in items])
    assert not mixed or len(machine.places) < 200
    texts = [f"{few(15)} {boilerplate} {few(15)}", "same " * 12, "same " * 40 + "other", few(60), boilerplate, " ".join(boilerplate.split()[3:17]), f"a {few(30)} b {boilerplate} {boilerplate} c", ""]
    for text in texts:
        assert scanned(machine, text) == plain(text, items), text


def test_boilerplate_costs_what_a_rare_phrase_costs():
    boilerplate = " ".join(f"b{k}" for k in range(40))
    items = [(str(k), f"{boilerplate} own{k} " + " ".join(f"w{k}n{j}" for j in range(20))) for k in range(20_000)] + [("r", "same " * 20_000)]
    machine = decontaminate.Machine(items)
    began = time.process_time()
    for _ in range(20):
        n, hits, those = decontaminate.scan(machine, f"{boilerplate} and more")
        assert len(hits) == 40 and len(those) == 20_000
    n, hits, those = decontaminate.scan(machine, "same " * 4_000)
    assert len(hits) == 4_000 and len(those) == 1
    assert time.process_time() - began < 6
