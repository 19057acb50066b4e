"""Operators: every public function takes and returns lazy DataFrames."""
