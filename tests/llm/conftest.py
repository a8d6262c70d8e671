import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], SCHEMA)

    return build


@pytest.fixture(scope="session")
def run_sql():
    """Rows of a checking SQL over given tables, as dicts."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        return [dict(zip(names, r)) for r in cur.fetchall()]

    return run


@pytest.fixture(scope="session")
def same():
    """Whether a DataFrame and rows of SQL hold the same values, in any order."""

    def compare(df, rows):
        def plain(v):
            return round(v, 6) if isinstance(v, float) else v

        cols = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
        want = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
        assert not rows or sorted(rows[0]) == cols
        assert got == want

    return compare
