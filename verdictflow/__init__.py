"""verdictflow: cascaded yes/no claim verification and its evaluation, on Spark DataFrames."""

__version__ = "0.1.0"
