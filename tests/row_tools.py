"""Helpers shared by the test modules (not in a conftest: several folders have one)."""


def rows(df, *cols):
    """Collect a small test result as a list of tuples (test-side only)."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
