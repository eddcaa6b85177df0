"""What several test modules use."""


def values(df, *order):
    """Rows as tuples, in a fixed order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
