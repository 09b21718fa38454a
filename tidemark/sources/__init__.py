"""Tables and files as DataFrames of one shape per kind of data."""
