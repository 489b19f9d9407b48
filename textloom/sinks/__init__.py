"""Writers: CSV, text lines, parquet windows, tokenizer tables, run logs."""
