"""Training-data operators on DataFrames; nothing outside this subpackage imports it."""
