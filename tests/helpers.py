import datetime


def ntz(seconds, day=1):
    """A time some seconds into a day of January 2024."""
    return datetime.datetime(2024, 1, day) + datetime.timedelta(seconds=seconds)


def tuples(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
