"""Plans: the training and scoring orchestration plus the registered
queries (one per operator of the inventory), each paired with the DuckDB
SQL that checks it where one exists."""
