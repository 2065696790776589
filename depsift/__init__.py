"""Software-supply-chain analytics as Spark jobs."""
