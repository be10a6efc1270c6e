"""How much reconciliation compares, and that looking items up by their times loses none."""

import itertools
import random
from collections import namedtuple

from tidemark.operators import reconcile

Row = namedtuple("Row", "image at n window finding title start end all_day day inferred")
SECOND, HOUR = 1_000_000, 3_600_000_000


def test_findings_meet_items_of_their_time_only(monkeypatch):
    calls = []
    agreement = reconcile.agreement
    monkeypatch.setattr(reconcile, "agreement", lambda a, b, event: calls.append(1) or agreement(a, b, event))
    block, n, items = reconcile.Block(True, reconcile.Thresholds()), 2_400, set()
    for k in range(n):
        (told,) = block.picture([Row(f"p{k}", k, 0, None, f"f{k}", ["view", "click"][k % 2], k % 24 * HOUR, None, False, "d", False)])
        items.add(told[1])
    assert len(items) == 24 and len(calls) <= 4 * n


def test_no_item_is_missed(monkeypatch):
    def everything(self, span, extra):
        return set(self.items)

    for seed in range(60):
        rng = random.Random(seed)
        event = seed % 3 > 0
        step = HOUR // 12 if event else 8 * HOUR
        pictures = []
        for k in range(40):
            image, rows = f"p{rng.randrange(25)}", []
            for i in range(rng.randrange(1, 4)):
                start = None if rng.random() < 0.15 else rng.randrange(0, 60) * step + rng.choice([0, 0, 500_000, SECOND])
                end = None if start is None or rng.random() < 0.5 else start + rng.choice([-1, 1, 6, 30, 4_000]) * step
                rows.append(Row(image, k, i, rng.choice([None, "w"]), f"f{k}-{i}", rng.choice(["team sync", "team sync with ana", "dentist", "dentist visit", "lunch"]), start, end, rng.random() < 0.1, rng.choice(["d", "d", "e"]), rng.random() < 0.3))
            pictures.append(rows)

        def told(apart):
            block = reconcile.Block(event, reconcile.Thresholds())
            block.apart |= apart
            return list(itertools.chain.from_iterable(block.picture(rows) for rows in pictures))

        names = [r.finding for rows in pictures for r in rows]
        apart = {tuple(sorted(rng.sample(names, 2))) for _ in range(30)}
        got = told(apart)
        with monkeypatch.context() as m:
            m.setattr(reconcile.Block, "_near", everything)
            assert got == told(apart)
