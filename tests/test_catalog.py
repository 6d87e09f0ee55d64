"""Every registered core query against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from strandlog.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or str(x) in ("nan", "<NA>", "NaT"):
            return "~"
        if isinstance(x, float):
            return round(x, 6)
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(plain(float(x) if isinstance(x, float) else x) for x in r) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.core_queries()))
def test_query(spark, duck, name):
    got = catalog.core_queries()[name](spark, DIR).toPandas()
    if name not in catalog.core_oracles():
        assert len(got) > 0
        return
    want = duck.sql(catalog.core_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = lambda df: df.apply(lambda c: pd.to_numeric(c).astype(float) if pd.api.types.is_numeric_dtype(c) and c.dtype != bool else c)
    assert rows(numbers(got)) == rows(numbers(want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sections_of_odd_documents(spark, tmp_path):
    """Null, blank and tiny texts, white space of Unicode, lines like headings, missing sources: as the SQL has them."""
    long = "word " * 90
    texts = [None, "", " \n\t", "a", "\x85", "\xa0" + long + "\x0b", "\r\n" + long + "\f", long + "\n== Own ==\n" + long + "\n== 参考 ==\nx", "== Part ==\n" + long, "x\x00"]
    rows = [(i, t, s) for i, (t, s) in enumerate([*((t, "src1") for t in texts), (long, None), ("b", None), (long, "")])]
    spark.createDataFrame([*rows, (None, "c", "src2"), rows[3]], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.core_queries()["split_sections"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.core_oracles()["split_sections"]).df()
    assert len(got) == 18 and rows_of(got) == rows_of(want)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    """As rows, but nulls are told from empty strings and white space is kept."""
    return sorted(tuple(repr(x if isinstance(x, str) else None if pd.isna(x) else int(x)) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def test_sections_of_pages(spark):
    """The operator by itself: a text's own headings divide, all white space goes, a null text has no section."""
    from strandlog.sources import wiki

    pages = spark.sql("select title, array(named_struct('timestamp', '2024', 'sha1', '', 'contributor', 'Ann', 'anonymous', false, 'text', text)) as revisions, id from values ('n', null, 'x'), ('p', concat(repeat('i', 500), '\\u00a0\\n== One ==\\n', repeat('o', 500)), null) as t(title, text, id)")
    found = [(r["page_title"], r["heading"], len(r["text"]), r["authors"], r["id"]) for r in wiki.page_sections(pages, blame=True, keep=["id"]).collect()]
    assert found == [("p", "[INTRO]", 500, ["Ann"], None), ("p", "One", 500, ["Ann"], None)]
