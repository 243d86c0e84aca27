"""Honest winner selection on Spark DataFrames.

Experiment tables in, corrected value tables out.  Every operator takes DataFrames and
plain parameters and returns a lazy DataFrame; bootstrap draws, splits, powers and settings
are ordinary key columns, so one plan corrects any number of tests at once.
"""

__version__ = "0.1.0"
