"""canopy: tree-shaped records to tables, and structural questions over them, on Spark."""
