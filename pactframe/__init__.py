"""pactframe: data contracts and corpus preparation as Spark jobs."""
