"""Accuracy of personal-information spans on patterns that were left out of training: `python tests/llm/held_out.py` prints all five folds together."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

FOLDS = 5


def scores(model, table) -> tuple[Counter, Counter, Counter]:
    """Right, wanted and found spans by type, of a model on labelled rows."""
    from cueweave.llm import pii

    right, want, got = Counter(), Counter(), Counter()
    for (_, gold), found in zip(table, pii.find(model, [t for t, _ in table])):
        want.update(k for *_, k in gold)
        got.update(k for *_, k in found)
        right.update(k for *_, k in set(gold) & set(found))
    return right, want, got


def fold(k: int, copies: int = 16) -> tuple[Counter, Counter, Counter]:
    """The scores of every FOLDS-th pattern, in the order of a fixed shuffle, by a model of the others."""
    from cueweave.llm import pii, pii_labels

    every = [p for part in pii_labels.patterns() for p in part]
    random.Random(4).shuffle(every)
    left = frozenset(every[k::FOLDS])
    model = pii.train([], rows=pii_labels.rows([], copies, without=left))
    return scores(model, [row for p in sorted(left) for row in pii_labels.filled(p, [], 8, 99)])


if __name__ == "__main__":
    totals = [Counter(), Counter(), Counter()]
    for k in range(FOLDS):
        for total, part in zip(totals, fold(k)):
            total.update(part)
    right, want, got = totals
    for kind in sorted(want):
        print(f"{kind} {want[kind]}: recall {right[kind] / want[kind]:.3f}, precision {right[kind] / max(1, got[kind]):.3f}")
    print(f"all: recall {right.total() / want.total():.3f}, precision {right.total() / got.total():.3f}")
