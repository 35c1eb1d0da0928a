"""Every query of the training-data operators that has SQL against it, on the smallest tables and on texts of our own."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from docprobe.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "pages")


def cells(df):
    text = lambda x: "" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def compared(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'/*.parquet' if Path(f'{sf}/{t}.parquet').is_dir() else ''}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), db.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
    return got


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert len(compared(spark, SF, name))


def test_secrets_and_fingerprints_on_texts_of_our_own(spark, tmp_path):
    key, digits = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2
    texts = [
        None,
        "",
        "…!",
        f"é {key} Password = 'abc123' and {digits}{key}Token:short api-key: nope1234",
        f"API_KEY=\"{digits}\" apikey: {key} secret:x secret : yyyyyy, passwd=aaaaaa/bbb=",
        f"{key[:-1]} AKIA {digits[:23]} {digits[:24]}",
        "the cat saw a dog under the tree while the bird and the cat slept in the tall green grass",
        "the cat saw a dog under the tree while the bird and the cat slept in the tall green grass",
        "The cat saw a dog under the tree while the bird, and the cat, slept in the tall brown grass",
        "No anchors here",
        "\U0001f600" * 7 + " the \U0001f600 cat of Größe zwei drei vier",
    ]
    rows = [(i * 3 - 4, t, "en", "a", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    base = compared(spark, tmp_path, "secret_base_spans").sort_values("doc_id")
    assert list(zip(base.n_assign, base.n_access, base.n_hex))[3:6] == [(1, 2, 1), (4, 1, 1), (0, 0, 1)]
    pairs = compared(spark, tmp_path, "op9_spotsigs").sort_values("doc_id")
    assert list(pairs.near_next)[0] == 1.0 and list(pairs.near_next)[6] == 1.0 and 0 < list(pairs.near_next)[7] < 1
    compared(spark, tmp_path, "spotsigs_links")
