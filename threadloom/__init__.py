"""threadloom: report-text, triple-graph and ranking-evaluation analytics on Spark."""
