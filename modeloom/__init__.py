"""Signal and time-series decomposition on Spark DataFrames."""

__version__ = "0.2.0"


def greet() -> str:
    """A line that names the package and its version."""
    line = f"modeloom {__version__}: decomposition of signals on Spark"
    print(line)
    return line
