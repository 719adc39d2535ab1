"""Windows of conversations against their budget, for random turns."""

import numpy as np
import pytest

from supplyscope.llm import chat

TURNS = "conv_id long, turn int, role string, text string, window string, loss string"


def size(text):
    return len(text.split()) + chat.OVERHEAD if text.strip() else 1 + chat.OVERHEAD


@pytest.mark.parametrize("budget,history", [(1024, 256), (60, 30), (40, 100), (20, 0)])
def test_windows_keep_their_budget(spark, budget, history):
    rng = np.random.default_rng(budget)
    rows, sizes, system = [], {}, {}
    for conv in range(60):
        for turn in range(int(rng.integers(1, 15))):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant")[turn % 2]
            words = int(rng.integers(0, budget)) if rng.random() < 0.2 else int(rng.integers(0, max(budget // 4, 2)))
            text = " ".join([f"c{conv}t{turn}"] * words)
            rows.append((conv, turn, role, text, "w", "l"))
            sizes[conv, turn] = size(text)
            if role == "system":
                system[conv] = sizes[conv, turn]
    rows += [(99, k, "user", t, "w", "l") for k, t in enumerate(["a " * 195, "b " * 900])]
    sizes |= {(99, 0): size("a " * 195), (99, 1): size("b " * 900)}
    out = chat.chat_windows(spark.createDataFrame(rows, TURNS), budget=budget, history=history).collect()
    new = {}
    for r in sorted(out, key=lambda r: (r["conv_id"], r["window"])):
        conv, pieces = r["conv_id"], r["text"].split(chat.END)[:-1]
        turns = [p.split(chat.TEXT)[1] for p in pieces]
        fresh = turns[r["n_context"] :]
        done = new.setdefault(conv, 0)
        total = sum(size(t) for t in turns)
        assert fresh
        has_system = conv in system and done > 0
        if total > budget:  # only the system turn with one that does not fit beside it, or such a turn alone
            assert len(fresh) == 1 + (conv in system and done == 0 and len(turns) == 2) and r["n_context"] == int(has_system)
        context = r["n_context"] - has_system
        repeated = sum(sizes[conv, done - 1 - k] for k in range(context))
        assert repeated <= history
        # no longer history would have fitted
        before = done - 1 - context
        if done and before >= (conv in system):
            more = repeated + sizes[conv, before]
            assert more > history or (system.get(conv, 0) + more + sizes[conv, done]) > budget
        new[conv] = done + len(fresh)
    assert new == {c: 1 + max(t for k, t in sizes if k == c) for c in {c for c, _ in sizes}}
