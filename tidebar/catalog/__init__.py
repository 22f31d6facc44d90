"""Named queries over the test tables, each with an SQL check where SQL can say it."""


def load():
    from tidebar.catalog import base, data, series, trading, portfolio, learning, live  # noqa: F401
    return base
