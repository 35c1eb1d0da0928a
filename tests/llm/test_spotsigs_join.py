"""The pruned join of signature sets loses no pair, whatever the sizes, and sends numbers and 32-bit signatures."""

import numpy as np

from docprobe.llm import spotsigs


def test_pruned_join_is_that_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = {}
    for i in range(150):
        base = rng.choice(1 << 32, int(rng.integers(1, 40)), replace=False) if i % 5 == 0 else base
        got = {int(h) for h in base if rng.random() < 0.93} | {int(h) for h in rng.choice(1 << 32, int(rng.integers(0, 4)))} | ({0, (1 << 31) - 1, 1 << 31, (1 << 32) - 1} if i % 3 else set())
        sets[frozenset(got)] = f"k{i}"
    sets.pop(frozenset(), None)
    names = {k: s for s, k in sets.items()}
    cls = spark.createDataFrame([(k, sorted(s)) for k, s in names.items()], "key string, s array<bigint>")
    kept = []
    store = spotsigs.stored
    monkeypatch.setattr(spotsigs, "stored", lambda df, name: kept.append(df.schema) or store(df, name))
    for threshold in (0.8, 0.5):
        got = {(r.a, r.b): r.likeness for r in spotsigs.similar_classes(cls, threshold).collect()}
        alike = {(a, b): len(names[a] & names[b]) / len(names[a] | names[b]) for a in names for b in names if a < b}
        assert got == {p: v for p, v in alike.items() if v >= threshold} and len(got) > 30
    assert all(k["o"].dataType.simpleString() == "array<int>" and k["id"].dataType.simpleString() == "bigint" for k in kept)
