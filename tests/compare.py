"""Rows of a Spark query against rows of DuckDB SQL."""

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _rows(frame, columns):
    return sorted(tuple("null" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v) for v in row) for row in frame[columns].itertuples(index=False))


def same(df, duck, sql):
    """Assert equal columns, types and rows."""
    found = duck.sql(sql)
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    columns = sorted(df.columns)
    assert _rows(df.toPandas(), columns) == _rows(found.df(), columns)
