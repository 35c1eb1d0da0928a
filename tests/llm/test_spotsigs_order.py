"""What a set posts first is rare however large the table is."""

from docprobe.llm import spotsigs


def test_signatures_are_ordered_by_how_often_they_occur(spark):
    # signature k is in 2**k sets, and the greater the rarer
    sets = [(f"k{i}", sorted({1000 - k for k in range(9) if i < 2**k} | {5000 + i})) for i in range(256)]
    got = {r.key: r.o for r in spotsigs.rare_first(spark.createDataFrame(sets, "key string, s array<bigint>")).collect()}
    assert got["k0"] == [1000, 5000, 999, 998, 997, 996, 995, 994, 993, 992]
    assert all(sorted(got[k]) == s and got[k][0] == 5000 + int(k[1:]) or k == "k0" for k, s in sets)


def test_signatures_go_before_sets_meet(spark, tmp_path, monkeypatch):
    left, store = [], spotsigs.stored
    monkeypatch.setattr(spotsigs, "fresh", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(spotsigs, "stored", lambda df, name: left.append((name, sorted(p.name for p in tmp_path.iterdir() if p.is_dir()))) or store(df, name))
    docs = spark.createDataFrame([(i, f"the cat {i // 2} saw dogs and the bird {i // 2} slept in tall grass") for i in range(20)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.class_id) for r in spotsigs.links(docs).collect()) == [(i, i // 2 * 2) for i in range(20)]
    assert dict(left) == {"spotsigs-keys": ["spotsigs-sets", "spotsigs-signatures"], "spotsigs-classes": ["spotsigs-sets"], "spotsigs-pairs": []}
