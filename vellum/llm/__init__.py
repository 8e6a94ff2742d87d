"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns a DataFrame;
``registry`` holds the thin queries that apply each operator to whole tables.
"""
