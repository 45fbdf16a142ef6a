"""PDF text extraction and text analytics over corpora held as DataFrames."""
