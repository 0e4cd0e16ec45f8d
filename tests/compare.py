"""Results of both engines side by side."""

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or v != v:
        return ""
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def same_rows(spark_df, relation) -> None:
    """Both results hold the same rows under the same names, whatever their order."""
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    rows = lambda data: sorted(tuple(_plain(v) for v in r) for r in data)
    mine = rows(tuple(r[c] for c in columns) for r in spark_df.collect())
    other = rows(relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == other
