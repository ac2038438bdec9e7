"""Works out how the tables of an undocumented data export relate to each other, on Spark."""

__version__ = "0.1.0"


class UserError(Exception):
    """A problem with the input or the options, to be told in one line."""
