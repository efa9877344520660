"""From SQL text to access paths: schemas, syntax trees, the parser and the planner of key ranges."""
