"""Rows of two engines as comparable lists."""


def rows(df) -> list:
    """A pandas frame's rows, columns by name, sorted; numbers as floats, missing values as None."""
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return round(float(v), 9)
        return str(v)

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def same(spark_df, con, sql: str) -> None:
    mine, other = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
