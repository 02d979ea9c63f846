"""Column functions: every one is a built-in expression except ``visible_text`` (one Arrow UDF)."""
