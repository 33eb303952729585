"""SQL text to Spark SQL text: lexer, parser, and a typed binder."""
