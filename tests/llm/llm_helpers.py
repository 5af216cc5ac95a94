"""Shared by the tests of this folder."""


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
