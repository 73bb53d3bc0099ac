"""Rows of a DataFrame and of a DuckDB query, in any order."""


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.10g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def sql_rows(con, text):
    got = con.execute(text)
    names = [d[0] for d in got.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=repr), sorted(names)


def same(df, con, text):
    want, names = sql_rows(con, text)
    assert sorted(df.columns) == names
    assert rows(df) == want
