"""Plans: the derived record model on the star-schema tables, evaluations, reports and jobs."""
