"""Gold and candidates are dealt to tasks by their number."""

import pytest

from taxograft.model import Settings
from taxograft.operators import evaluate as E
from taxograft.plans import placement


def test_gold_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(E, "TASK_ROWS", 50)
    seen = []
    real = E.gold_ranks
    monkeypatch.setattr(E, "gold_ranks", lambda c, g, tasks=None: seen.append(tasks) or real(c, g, tasks))
    ranked = spark.createDataFrame([(m, r, f"p{r}", "c") for m in range(300) for r in range(1, 4)], "mention_id long, rank int, parent_idx string, child_idx string")
    gold = spark.createDataFrame([(m, "p2", "c") for m in range(300)] * 2 + [(m, "p9", "c") for m in range(150)], "mention_id long, parent_idx string, child_idx string")
    got = {r.k: r for r in placement.evaluate_placement(ranked.coalesce(1), gold, Settings(ks=(1, 2))).collect()}
    assert seen == [33]  # 900 candidates and 750 gold rows
    assert (got[1].tp, got[2].tp, got[2].n_gold, got[2].n_mentions) == (0, 300, 450, 300)
    assert got[2]["any"] == 1.0 and got[2]["all"] == 0.5 and got[2].recall == pytest.approx(300 / 450)
