"""girder: scene analytics and corpus preparation as Spark jobs."""
