"""Helpers of these tests."""


def rows(df):
    return sorted((tuple(v for _, v in sorted(r.asDict().items())) for r in df.collect()), key=str)
