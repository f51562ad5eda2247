"""From text to DataFrames: syntax trees, the parser, and lowering."""
