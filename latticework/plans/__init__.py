"""Plans: testbed graph, framework adapters, ingestion, and the registered queries."""
