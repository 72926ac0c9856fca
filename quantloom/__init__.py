"""Panel analytics as DataFrame plans: long ``(date, id, value)`` tables in, DataFrames out."""
