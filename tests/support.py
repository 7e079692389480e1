"""Comparison with DuckDB."""


def same_rows(frame, con, sql):
    """Rows of a DataFrame and of a SQL query, as sorted lists of tuples in order of column name."""
    names = sorted(frame.columns)
    got = sorted((tuple(row[n] for n in names) for row in frame.collect()), key=repr)
    out = con.execute(sql)
    order = [d[0] for d in out.description]
    assert sorted(order) == names
    want = sorted((tuple(row[order.index(n)] for n in names) for row in out.fetchall()), key=repr)
    assert got == want
