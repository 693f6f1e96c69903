"""Sports-data analytics as Spark jobs: sources, functions, operators, streaming, query plans."""
