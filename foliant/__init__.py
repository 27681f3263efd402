"""foliant: DataFrame operators for long-form document collections and their translation runs."""

__version__ = "0.1.0"
