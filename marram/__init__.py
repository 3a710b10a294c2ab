"""marram: node ranking, spreading studies and corpus preparation as Spark jobs."""
