"""Training-data operators: near-dedup, scoring, scanning, mixing, tokenising.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Every operator takes a DataFrame and column names and returns a DataFrame;
``queries`` holds the thin ``opN_*`` wrappers that fix inputs and outputs.
"""
