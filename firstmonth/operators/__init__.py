"""One module per part of the analysis; every operator takes and returns lazy DataFrames."""
