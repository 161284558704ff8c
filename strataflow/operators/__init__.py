"""Operators on series: windows, feature families, relational helpers, matching, continuation, surfaces, learning."""
