"""Benchmark items near a document's ends, by kind of edit."""

import random

import pytest

from siftmill.llm import decontaminate


@pytest.mark.parametrize("n", [10, 20, 40, 60, 80, 120, 200])
def test_near_copies_are_found_wherever_they_stand(n):
    rnd = random.Random(n)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(n)]) for i in range(30)]
    index = decontaminate.Index([(i, " ".join(ws)) for i, ws in items])
    k, found, asked = decontaminate.allowed(n), 0, 0
    for before in (0, 5, 20, 100):
        for kind in ("delete", "insert", "replace"):
            for span in (range(n // 2), range(n // 2, n), range(n)):
                docs = []
                for _, ws in items:
                    ws = list(ws)
                    for at in sorted(rnd.sample(span, min(k, len(span))), reverse=True):
                        ws[at : at + (kind != "insert")] = [] if kind == "delete" else [f"x{rnd.randrange(9999)}"]
                    around = [rnd.choice(vocabulary) for _ in range(before + 30)]
                    docs.append(" ".join(around[:before] + ws + around[before : before + rnd.choice([0, 30])]))
                for (i, _), got in zip(items, index.search_all(docs)):
                    found += any(a == i for a, _ in got)
                    asked += 1
    assert found >= 0.99 * asked
